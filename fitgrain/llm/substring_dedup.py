"""Removal of word windows that an earlier document has, by super-k-mers.

The minimiser of a window of words is the least of the short grams inside it, rare
grams first and then by hash. Consecutive windows with one minimiser travel as a single
string to the bucket of that minimiser, so a window is compared with all its equals in
one place although no window is sent alone. A task sends a string once, with the chunks of
documents that have it and the smallest and largest id in each; documents are dealt to
chunks by hash, so neither the order of files nor the ids matter. In its bucket, sorting
brings equal windows together; those that an earlier document has are reported to the
chunks, and there the documents meet the reports.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitgrain.llm.common import (
    CELLS,
    NO_ID,
    Words,
    combined,
    gram_counts,
    mixed,
    packed_bytes,
    release,
    slices,
    unpacked,
)

WINDOW = 13
GRAM = 3
#: Bytes of text for each bucket and for each chunk of documents.
BUCKET_BYTES = 4 << 20
CHUNK_BYTES = 4 << 20
#: Bytes that a task holds before it sends them, and what a string and each further chunk of
#: it take besides its text.
HELD_BYTES = 96 << 20
STRING_BYTES, ENTRY_BYTES = 400, 250


def super_kmers(found: Words, counts: np.ndarray, window: int, gram: int):
    """Runs of windows with one minimiser: first word, last word + 1, minimiser."""
    hashes, at = found.grams(gram)
    n = len(found.hash)
    # Frequent grams are last, so that no bucket is large for a common phrase.
    often = counts[(hashes & np.uint64(CELLS - 1)).astype(np.int64)]
    rank = np.ceil(np.log2(often + 1.0)).astype(np.uint64)
    order = np.full(max(n, 1), np.iinfo(np.uint64).max, np.uint64)
    order[at] = (rank << np.uint64(58)) | (mixed(hashes) >> np.uint64(6))
    starts = np.flatnonzero(found.row[: max(n - window + 1, 0)] == found.row[window - 1 :])
    if not len(starts):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    span = window - gram + 1
    # The least of each run of ``span`` by doubling, then by two overlapping runs.
    least, width = order.copy(), 1
    while width * 2 <= span:
        least[: n - width] = np.minimum(least[: n - width], least[width:n])
        width *= 2
    low = np.minimum(least[starts], least[starts + span - width])
    new = np.ones(len(starts), np.bool_)
    new[1:] = (low[1:] != low[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return starts[first], starts[last] + window, low[first]


def _digest(data: bytes) -> bytes:
    return xxhash.xxh3_128_digest(data)


def _pack(held: list[tuple[bytes, tuple | dict]]) -> bytes:
    """Strings, and for each of them its chunks with their least and largest ids."""
    lengths = np.array([len(string) for string, _ in held], np.uint32)
    each = [[x] if isinstance(x, tuple) else list(x.values()) for _, x in held]
    times = np.array([len(x) for x in each], np.uint32)
    entries = np.array([e for x in each for e in x], np.int64).T
    entries[2] -= entries[1]
    parts = [np.array([len(held), entries.shape[1]], np.uint32), lengths, times, entries]
    data = b"".join([*(np.ascontiguousarray(p).tobytes() for p in parts), *(s for s, _ in held)])
    return packed_bytes(np.frombuffer(data, np.uint8))


def _unpack(blob: bytes):
    """Lengths of strings, chunks of each, entries (chunk, least, largest id), all text."""
    data = unpacked(blob, np.uint8)
    strings, entries = data[:8].view(np.uint32).tolist()
    ends = np.cumsum([8, 4 * strings, 4 * strings, 24 * entries])
    lengths, times, table = (data[i:j] for i, j in zip(ends, ends[1:]))
    table = np.frombuffer(table.tobytes(), np.int64).reshape(3, entries).copy()
    table[2] += table[1]
    return lengths.view(np.uint32), times.view(np.uint32), table, data[ends[-1] :]


def _sent(docs: DataFrame, counts, window: int, gram: int, buckets: int) -> DataFrame:
    """``bucket, blob``: what a task has for a bucket, one row each time that it sends."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def flush(held: dict):
        by: dict = {}
        for (bucket, string), where in held.items():
            by.setdefault(bucket, []).append((string, where))
        held.clear()
        while by:
            keys = [by.popitem() for _ in range(min(256, len(by)))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([bucket for bucket, _ in keys], pa.int64()),
                    pa.array([_pack(own) for _, own in keys], pa.binary()),
                ],
                names=["bucket", "blob"],
            )

    def find(batches):
        held: dict = {}
        size = 0
        for whole in batches:
            for batch in slices(whole, "text"):
                ids = pa.compute.fill_null(batch["id"], NO_ID).to_numpy(zero_copy_only=False)
                chunks = batch["chunk"].to_numpy(zero_copy_only=False)
                found = Words(batch["text"])
                start, stop, low = super_kmers(found, shared.value, window, gram)
                bucket = (mixed(low) % np.uint64(buckets)).astype(np.int64).tolist()
                rows = found.row[start]
                chunk, doc = chunks[rows].tolist(), ids[rows].tolist()
                text = _joined(found)
                begin = text[1][start].tolist()
                end = (text[1][stop] - 1).tolist()
                for c, b, i, j, d in zip(chunk, bucket, begin, end, doc):
                    key = (b, text[0][i:j])
                    seen = held.get(key)
                    if seen is None:
                        held[key] = (c, d, d)
                        size += j - i + STRING_BYTES
                        continue
                    if isinstance(seen, tuple):
                        if seen[0] == c:
                            if not seen[1] <= d <= seen[2]:
                                held[key] = (c, min(d, seen[1]), max(d, seen[2]))
                            continue
                        seen = held[key] = {seen[0]: seen}
                    own = seen.get(c)
                    size += ENTRY_BYTES * (own is None)
                    own = own or (c, d, d)
                    seen[c] = (c, min(d, own[1]), max(d, own[2]))
                if size > HELD_BYTES:
                    yield from flush(held)
                    size = 0
        yield from flush(held)
        release()

    return docs.mapInArrow(find, "bucket long, blob binary")


def _joined(found: Words) -> tuple[bytes, np.ndarray]:
    """All words, each with one space after it, and where each begins."""
    length = found.end - found.start
    at = np.concatenate([[0], np.cumsum(length + 1)])
    out = np.full(at[-1], 32, np.uint8)
    total = int(length.sum())
    inside = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
    out[inside + np.repeat(at[:-1], length)] = found.bytes[inside + np.repeat(found.start, length)]
    return out.tobytes(), at


def _late(blobs: list[bytes], window: int):
    """Of one bucket's strings, those with a window that an earlier document has: chunk,
    name of the string, and the smallest id that has each of its windows."""
    parts = [_unpack(blob) for blob in blobs]
    lengths, times = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in (0, 1))
    chunk, low, high = np.concatenate([p[2] for p in parts], axis=1)
    raw = np.concatenate([p[3] for p in parts])
    del parts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    column = pa.Array.from_buffers(
        pa.large_string(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]
    )
    found = Words(column)
    h, at = found.grams(window)
    row = found.row[at]
    order = np.argsort(h, kind="stable")
    # Equal hashes are equal windows when all their words agree one by one.
    same = h[order[1:]] == h[order[:-1]]
    some = np.flatnonzero(same)
    a, b = at[order[some]], at[order[some + 1]]
    for j in range(window):
        same[some] &= found.hash[a + j] == found.hash[b + j]
    run = np.concatenate([[0], np.flatnonzero(~same) + 1])
    # Every string has a window and an entry.
    entry = np.concatenate([[0], np.cumsum(times)])
    earliest = np.minimum.reduceat(low, entry[:-1])
    least = np.minimum.reduceat(earliest[row[order]], run)
    first = np.empty(len(order), np.int64)
    first[order] = np.repeat(least, np.diff(np.append(run, len(order))))
    begin = np.searchsorted(row, np.arange(len(lengths) + 1))
    of_string = np.minimum.reduceat(first, begin[:-1])
    owner = np.repeat(np.arange(len(lengths)), times)
    late = np.flatnonzero(of_string[owner] < high)
    for e, r in zip(late.tolist(), owner[late].tolist()):
        name = _digest(raw[offsets[r] : offsets[r + 1]].tobytes())
        yield int(chunk[e]), name, first[begin[r] : begin[r + 1]]


def _reports(sent: DataFrame, window: int) -> DataFrame:
    """``chunk, blob``: the late strings of the chunk. A task gathers those of its buckets,
    so that it sends few rows for a chunk."""

    def flush(by: dict):
        while by:
            keys = [by.popitem() for _ in range(min(256, len(by)))]
            blobs = []
            for _, (names, minima) in keys:
                parts = [
                    packed_bytes(np.frombuffer(b"".join(names), np.uint8)),
                    packed_bytes(np.array([len(x) for x in minima], np.uint32)),
                    packed_bytes(np.concatenate(minima)),
                ]
                blobs.append(np.array([len(p) for p in parts], np.uint32).tobytes() + b"".join(parts))
            yield pa.RecordBatch.from_arrays(
                [pa.array([c for c, _ in keys], pa.int64()), pa.array(blobs, pa.binary())],
                names=["chunk", "blob"],
            )

    def buckets(batches):
        bucket, blobs = None, []
        for batch in batches:
            for one, blob in zip(batch["bucket"].to_pylist(), batch["blob"]):
                if one != bucket and blobs:
                    yield blobs
                    blobs = []
                bucket = one
                blobs.append(blob.as_py())
        if blobs:
            yield blobs

    def find(batches):
        by: dict = {}
        size = 0
        for blobs in buckets(batches):
            for chunk, name, minima in _late(blobs, window):
                names, own = by.setdefault(chunk, ([], []))
                names.append(name)
                own.append(minima.copy())
                size += STRING_BYTES + minima.nbytes
                if size > HELD_BYTES:
                    yield from flush(by)
                    size = 0
        yield from flush(by)
        release()

    dealt = sent.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(find, "chunk long, blob binary")


def _read_reports(blobs) -> dict[bytes, np.ndarray]:
    out = {}
    for blob in blobs:
        blob = blob.as_py()
        sizes = np.frombuffer(blob[:12], np.uint32)
        ends = np.cumsum(sizes, dtype=np.int64) + 12
        names, counts, minima = (blob[e - s : e] for s, e in zip(sizes, ends))
        names = unpacked(names, np.uint8).tobytes()
        at = np.cumsum(unpacked(counts, np.uint32), dtype=np.int64)[:-1]
        for i, least in enumerate(np.split(unpacked(minima, np.int64), at)):
            out[names[16 * i : 16 * i + 16]] = least
    return out


def _covered(found: Words, ids, reports, counts, window: int, gram: int) -> np.ndarray:
    """Whether each word is to be removed."""
    depth = np.zeros(len(found.hash) + 1, np.int64)
    if reports:
        start, stop, _ = super_kmers(found, counts, window, gram)
        joined, at = _joined(found)
        begin, end = at[start].tolist(), (at[stop] - 1).tolist()
        doc = ids[found.row[start]].tolist()
        first = start.tolist()
        for i, j, s, d in zip(begin, end, first, doc):
            least = reports.get(_digest(joined[i:j]))
            if least is not None:
                gone = np.flatnonzero(least < d) + s
                depth[gone] += 1
                depth[gone + window] -= 1
    return np.cumsum(depth[:-1]) > 0


def dedup_substrings(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    keep_space: bool = True,
) -> DataFrame:
    """The documents without repeated passages, and ``n_words``, ``n_removed``.

    A word goes if a window of ``window`` words covers it whose words also occur in a
    document with a smaller id. Windows are judged on the input. ``keep_space`` leaves
    the white space between kept words as it is, and else one space joins them.

    Null texts give an empty text; texts shorter than a window keep all words. Rows
    with one id don't remove each other's windows, so repeated rows all stay. A null id
    is larger than any other. All other columns are passed on as they are; columns
    called ``n_words`` or ``n_removed`` are replaced. An empty table gives no rows.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    buckets = max(1, size // BUCKET_BYTES)
    key = F.pmod(F.xxhash64(F.col(id), F.col(text)), F.lit(max(1, size // CHUNK_BYTES)))
    slim = docs.select(
        F.col(id).cast("long").alias("id"),
        F.col(text).cast("string").alias("text"),
        key.cast("long").alias("chunk"),
    )
    counts = gram_counts(docs, text, GRAM)
    reports = _reports(_sent(slim, counts, window, GRAM, buckets), window)
    shared = spark.sparkContext.broadcast(counts)
    # A name no column has, for the chunk.
    chunk = "chunk_" + "_".join(docs.columns)
    names = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    fields = docs.select(*names).schema
    whole = fields.add("n_words", "long").add("n_removed", "long")

    def kept(found: Words, drop: np.ndarray, row: int) -> str:
        i, j = found.first[row], found.first[row + 1]
        raw = found.bytes[found.at[row] : found.at[row + 1]]
        gone = drop[i:j]
        start, end = found.start[i:j] - found.at[row], found.end[i:j] - found.at[row]
        if keep_space:
            if not gone.any():
                return raw.tobytes().decode()
            mask = np.zeros(len(raw) + 1, np.int64)
            follow = np.append(start[1:], len(raw))[gone]
            np.add.at(mask, start[gone], 1)
            np.add.at(mask, follow, -1)
            return raw[np.cumsum(mask[:-1]) == 0].tobytes().decode()
        return b" ".join(
            raw[s:e].tobytes() for s, e in zip(start[~gone].tolist(), end[~gone].tolist())
        ).decode()

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        reports = _read_reports(right["blob"]) if right.num_rows else {}
        out = []
        for whole in left.combine_chunks().to_batches():
            for batch in slices(whole, text):
                found = Words(batch[text])
                ids = pa.compute.fill_null(batch[id].cast(pa.int64()), NO_ID)
                ids = ids.to_numpy(zero_copy_only=False)
                drop = _covered(found, ids, reports, shared.value, window, GRAM)
                texts = [kept(found, drop, row) for row in range(batch.num_rows)]
                total = np.concatenate([[0], np.cumsum(drop)])
                columns = {c: batch[c] for c in names}
                columns[text] = pa.array(texts, pa.string())
                columns["n_words"] = pa.array(np.diff(found.first))
                columns["n_removed"] = pa.array(np.diff(total[found.first]))
                out.append(pa.RecordBatch.from_pydict(columns))
        release()
        return pa.Table.from_batches(out)

    left = docs.select(*names, key.cast("long").alias(chunk)).groupBy(chunk)
    return left.cogroup(reports.groupBy("chunk")).applyInArrow(remove, whole)
