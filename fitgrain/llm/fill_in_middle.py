"""Fill-in-the-middle texts by block rotation inside a byte array, and back.

A text is cut into units, two draws from the hash of its id choose where prefix and
middle end, and a sentinel is put in before each of the three segments. Two neighbouring
blocks then change places by three reversals, so the text is moved inside its own bytes:
``P prefix | M middle | S suffix`` becomes psm by exchanging the last two blocks and spm
by exchanging the first two, taken as one, with the last. The inverse rotation and the
removal of the sentinels give the text again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitgrain.llm.common import slices

#: What stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 42
#: Percent of texts that are transformed, and percent of those that begin with the suffix.
RATE = 50
SPM = 80


def draws(id: Column, seed: int) -> Column:
    """The first four 8-digit groups of the hash of ``seed:id``, as numbers."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit("")))
    digest = F.sha2(name.cast("binary"), 256)
    return F.array(
        *(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4))
    )


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts, and where each text begins."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(at) or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def unit_ends(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where units end, and the number of the first unit of each text.

    A unit is white space and the word after it, or white space that ends a text. White
    space is of single bytes, so bytes give the same units as code points.
    """
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    ends = np.zeros(len(raw), np.bool_)
    ends[:-1] = ~space[:-1] & space[1:]
    ends[at[1:][np.diff(at) > 0] - 1] = True
    ends = np.flatnonzero(ends) + 1
    return ends, np.searchsorted(ends, at, "right")


def _reverse(view: np.ndarray, i: int, j: int) -> None:
    half = (j - i) // 2
    head = view[i : i + half].copy()
    view[i : i + half] = view[j - half : j][::-1]
    view[j - half : j] = head[::-1]


def rotate(buffer: bytearray, i: int, middle: int, j: int) -> None:
    """Exchange the blocks ``i`` to ``middle`` and ``middle`` to ``j`` by three reversals."""
    view = np.frombuffer(buffer, np.uint8)
    _reverse(view, i, middle)
    _reverse(view, middle, j)
    _reverse(view, i, j)


def to_middle(text: bytes, prefix: int, middle: int, form: str) -> bytes:
    """The text with its middle last; ``prefix`` and ``middle`` are where those end."""
    buffer = bytearray(text)
    # From the right, so that earlier places hold.
    buffer[middle:middle] = SUFFIX
    buffer[prefix:prefix] = MIDDLE
    buffer[0:0] = PREFIX
    start = prefix + len(PREFIX) if form == "psm" else 0
    rotate(buffer, start, middle + len(PREFIX) + len(MIDDLE), len(buffer))
    return bytes(buffer)


def from_middle(output: bytes, form: str) -> bytes:
    """The text that ``to_middle`` or a plain row was made from."""
    if form == "plain":
        return output
    buffer, end = bytearray(output), len(output)
    middle = buffer.index(MIDDLE)
    if form == "psm":
        start = buffer.index(SUFFIX)
        rotate(buffer, start, middle, end)
        middle, suffix = start, start + end - middle
    else:
        start = buffer.index(PREFIX)
        rotate(buffer, 0, start, end)
        middle, suffix = middle - start, end - start
    del buffer[suffix : suffix + len(SUFFIX)]
    del buffer[middle : middle + len(MIDDLE)]
    del buffer[: len(PREFIX)]
    return bytes(buffer)


def _forms(column: pa.Array, size: np.ndarray, h: np.ndarray, rate: int, spm: int) -> np.ndarray:
    plain = (size == 0) | (h[:, 2] % 100 >= rate)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        found = pc.fill_null(pc.match_substring(column, mark.decode()), False)
        plain |= found.to_numpy(zero_copy_only=False)
    return np.where(plain, "plain", np.where(h[:, 3] % 100 < spm, "spm", "psm"))


def fill_in_middle(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    seed: int = SEED,
    rate: int = RATE,
    spm: int = SPM,
) -> DataFrame:
    """``id, n, form, prefix_chars, middle_chars, output`` of each document.

    ``n`` counts units. ``form`` is plain for ``100 - rate`` percent of the texts, for
    empty ones and for those that contain a sentinel; of the others ``spm`` percent are
    spm and the rest psm. ``prefix_chars`` and ``middle_chars`` are code points, null in
    plain rows. ``restore`` gives the text back from ``output`` and ``form``.

    Null texts are empty ones. A null id draws like an empty id, and rows that repeat an
    id draw alike. A text is taken whole, however long. Other columns are not read, and
    an empty table gives no rows.
    """
    names = ["id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def cut(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                column = batch["text"]
                raw, at = _flat(column)
                ends, first = unit_ends(raw, at)
                n = np.diff(first)
                h = batch["draws"].flatten().to_numpy().reshape(-1, 4)
                form = _forms(column, np.diff(at), h, rate, spm)
                # Where prefix and middle end.
                units = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
                padded = np.append(ends, 0)
                place = np.where(units == 0, at[:-1, None], padded[first[:-1, None] + units - 1])
                chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                counted = chars[place]
                out = []
                for row, kind in enumerate(form):
                    a, b = at[row], at[row + 1]
                    one = raw[a:b].tobytes()
                    if kind != "plain":
                        prefix, middle = (place[row] - a).tolist()
                        one = to_middle(one, prefix, middle, kind)
                    out.append(one)
                none = form == "plain"
                columns = [
                    batch["id"],
                    pa.array(n.astype(np.int64)),
                    pa.array(form.tolist(), pa.string()),
                    pa.array(counted[:, 0] - chars[at[:-1]], mask=none),
                    pa.array(counted[:, 1] - counted[:, 0], mask=none),
                    pa.array(out, pa.binary()).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    slim = docs.select(
        F.col(id).alias("id"),
        F.col(text).cast("string").alias("text"),
        draws(F.col(id), seed).alias("draws"),
    )
    schema = slim.select("id").schema
    for name, kind in zip(names[1:], ("long", "string", "long", "long", "string")):
        schema = schema.add(name, kind)
    return slim.mapInArrow(cut, schema).withColumnRenamed("id", id)


def restore(rows: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """The rows with ``restored``, the text that ``output`` was made from.

    A null output gives null. Columns are passed on as they are, but ``restored`` is
    replaced if there is one. An empty table gives no rows.
    """
    kept = rows.drop("restored")

    def undo(batches):
        for whole in batches:
            for batch in slices(whole, output):
                texts = zip(batch[output].cast(pa.binary()).to_pylist(), batch[form].to_pylist())
                back = [None if x is None else from_middle(x, kind) for x, kind in texts]
                restored = pa.array(back, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, restored], names=[*batch.schema.names, "restored"]
                )

    schema = kept.select("*").schema.add("restored", "string")
    return kept.mapInArrow(undo, schema)


def digests(docs: DataFrame) -> DataFrame:
    """Per ``doc_id`` of ``docs``: its units, form and cuts, and the hashes of output and
    restored text."""
    return restore(fill_in_middle(docs)).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


#: The same rows for DuckDB.
DIGESTS_SQL = r"""
WITH cut AS (
    SELECT doc_id, coalesce("text", '') AS body,
        regexp_extract_all(coalesce("text", ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
        sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
    FROM documents
), drawn AS (
    SELECT *, len(units) AS n,
        CAST('0x' || digest[1:8] AS BIGINT) % (len(units) + 1) AS u1,
        CAST('0x' || digest[9:16] AS BIGINT) % (len(units) + 1) AS u2,
        CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>')
            OR CAST('0x' || digest[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
            WHEN CAST('0x' || digest[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM cut
), parted AS (
    SELECT *,
        array_to_string(units[1:least(u1, u2)], '') AS prefix,
        array_to_string(units[least(u1, u2) + 1:greatest(u1, u2)], '') AS middle,
        array_to_string(units[greatest(u1, u2) + 1:], '') AS suffix
    FROM drawn
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
    CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN body
        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(body) AS restored_sha256
FROM parted
"""
