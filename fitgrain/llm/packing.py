"""Best-fit packing of token sequences by exact complements.

Documents are cut into pieces of at most ``size`` tokens. Only the number of pieces of
each length, at most ``size`` numbers, decides the plan: lengths, pairs and triples are
indexed by their sums, and as many sequences as the counts allow are filled exactly at
once; what has no complement is placed by best fit. Each step uses up a length, so the
plan has at most about ``size`` steps whatever the number of documents. Pieces then find
their places by their rank among the pieces of their length: each task numbers its own,
and the tasks' counts add up to where its numbers begin.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fitgrain.llm.common import slices, write_and_read
from fitgrain.llm.tokens import default_path, encoder

SIZE = 1024


class Lengths:
    """Counts by length, with the sums of present lengths."""

    def __init__(self, counts: dict[int, int], size: int):
        self.size = size
        self.count = np.zeros(size + 1, np.int64)
        for length, n in counts.items():
            self.count[length] = n
        self._index()

    def _index(self) -> None:
        self.has = (self.count > 0).astype(np.int64)
        self.pairs = np.convolve(self.has, self.has)[: self.size + 1]

    def fits(self, lengths: list[int]) -> int:
        """How many times these lengths can be taken together."""
        return min(int(self.count[x]) // n for x, n in Counter(lengths).items())

    def take(self, lengths: list[int], times: int) -> None:
        before = self.has.sum()
        for x in lengths:
            self.count[x] -= times
        if ((self.count > 0).sum()) != before:
            self._index()

    def exact(self, largest: int) -> list[int] | None:
        """Lengths that together with the largest one fill a sequence: one, two or three."""
        gap = self.size - largest
        if gap == 0:
            return [largest]
        if self.has[gap] and self.fits([largest, gap]):
            return [largest, gap]
        for a in self._seconds(gap, self.has):
            got = [largest, a, gap - a]
            if self.fits(got):
                return got
        for a in self._seconds(gap, self.pairs):
            for b in self._seconds(gap - a, self.has):
                got = [largest, a, b, gap - a - b]
                if self.fits(got):
                    return got
        return None

    def _seconds(self, gap: int, rest: np.ndarray):
        """Present lengths below the gap whose complement is indexed, large ones first."""
        a = np.arange(gap - 1, 0, -1)
        return a[(self.has[a] > 0) & (rest[gap - a] > 0)].tolist()

    def best_fit(self, largest: int) -> list[int]:
        """The largest length, then over and over the largest one that still fits."""
        out, gap = [largest], self.size - largest
        left = self.count.copy()
        left[largest] -= 1
        while gap:
            fit = np.flatnonzero(left[1 : gap + 1] > 0)
            if not len(fit):
                break
            x = int(fit[-1]) + 1
            n = min(int(left[x]), gap // x)
            out += [x] * n
            left[x] -= n
            gap -= x * n
        return out


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[list[int], int]]:
    """Patterns of lengths and how many sequences have each."""
    lengths, out = Lengths(counts, size), []
    residual = []
    while lengths.has.any():
        largest = int(np.flatnonzero(lengths.has)[-1])
        got = lengths.exact(largest)
        if got is None:
            # Set aside: shorter lengths may yet complete each other exactly.
            residual.append((largest, int(lengths.count[largest])))
            lengths.take([largest], int(lengths.count[largest]))
            continue
        times = lengths.fits(got)
        lengths.take(got, times)
        out.append((got, times))
    lengths = Lengths(dict(residual), size)
    while lengths.has.any():
        got = lengths.best_fit(int(np.flatnonzero(lengths.has)[-1]))
        times = lengths.fits(got)
        lengths.take(got, times)
        out.append((got, times))
    return out


def places(patterns: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first ranks of runs of pieces, their first sequence, and the offset."""
    runs: dict[int, list] = {}
    used: Counter = Counter()
    sequence = 0
    for lengths, times in patterns:
        offset = 0
        for x in lengths:
            runs.setdefault(x, []).append((used[x], sequence, offset))
            used[x] += times
            offset += x
        sequence += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*rows)) for x, rows in runs.items()}


def pieces(
    docs: DataFrame, id: str, text: str, size: int, end_id: int, path: str, with_ids: bool
) -> DataFrame:
    """``id, piece, start, length, crc, task, rank`` of each piece, and its ``ids`` if wanted.

    ``rank`` counts the pieces of one length in one task, from 0.
    """
    schema = "id long, piece int, start long, length long, crc long, task int, rank long"
    schema += ", ids array<long>" * with_ids
    last = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        encode = encoder(path).ids
        task, ranks = TaskContext.get().partitionId(), Counter()
        for whole in batches:
            for batch in slices(whole, "text"):
                out: list[list] = [[], [], [], [], [], [], [], []]
                for doc, string in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
                    ids = encode(string or "") + last
                    n = len(ids) // 4
                    start, piece = 0, 0
                    while start < n:
                        # The first piece takes what is over.
                        stop = start + ((n - start - 1) % size + 1)
                        part = ids[4 * start : 4 * stop]
                        length = stop - start
                        row = (doc, piece, start, length, zlib.crc32(part), task, ranks[length])
                        ranks[length] += 1
                        for values, value in zip(out, row):
                            values.append(value)
                        if with_ids:
                            out[7].append(np.frombuffer(part, "<u4").astype(np.int64))
                        start, piece = stop, piece + 1
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                types += [pa.int32(), pa.int64()]
                arrays = [pa.array(v, t) for v, t in zip(out, types)]
                if with_ids:
                    arrays.append(pa.array(out[7], pa.list_(pa.int64())))
                names = ["id", "piece", "start", "length", "crc", "task", "rank", "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names=names[: len(arrays)])

    slim = docs.select(
        F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text")
    )
    return slim.mapInArrow(cut, schema)


def pack_documents(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    size: int = SIZE,
    end_id: int = 2,
    path: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """One row for each piece: ``id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its ids and then ``end_id``. Those longer than ``size`` are cut into
    full pieces and a first one with what is over. Pieces of one ``sequence_id`` lie in
    it without gaps, ``size`` tokens at most. ``with_ids`` adds the ids themselves.

    Null and empty texts are a piece of one id. Repeated rows and null ids are packed
    like any others, each row on its own. Other columns are not read. An empty table
    gives no rows.
    """
    found = pieces(docs, id, text, size, end_id, path or default_path(), with_ids)
    found = write_and_read(found, "pieces")
    # As a table the numbers stay as they are, whichever tasks are lost later.
    groups = found.groupBy("task", "length").agg((F.max("rank") + 1).alias("n"))
    groups = write_and_read(groups, "lengths")
    totals = groups.groupBy("length").agg(F.sum("n").alias("n")).collect()
    table = places(plan({r["length"]: r["n"] for r in totals}, size))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(
        Window.unboundedPreceding, -1
    )
    first = groups.select(
        "task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    # A task and length have no more pieces than one task made.
    ranked = found.join(first, ["task", "length"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("first")).drop("first", "task")

    def place(batches):
        for batch in batches:
            length = batch["length"].to_numpy(zero_copy_only=False)
            rank = batch["rank"].to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                begins, base, inner = table[int(x)]
                run = np.searchsorted(begins, rank[at], "right") - 1
                sequence[at] = base[run] + rank[at] - begins[run]
                offset[at] = inner[run]
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in kept), pa.array(sequence), pa.array(offset)],
                names=[*kept, "sequence_id", "offset"],
            )

    kept = ["id", "piece", "start", "length", "crc"] + ["ids"] * with_ids
    schema = ranked.select(kept).schema.add("sequence_id", "long").add("offset", "long")
    out = ranked.mapInArrow(place, schema)
    return out.withColumnsRenamed({"id": id, "crc": "ids_crc32"})
