"""Shared pieces: reading tables, cutting lineage, word hashes and gram counts.

Words are maximal runs of characters other than space and U+0009 to U+000D. They
are hashed a slice of an Arrow batch at a time, on the bytes of the string column.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitgrain.session import fresh_path

#: White space between words, as a regular expression.
GAP = r"[ \t-\r]+"
WORD = r"[^ \t-\r]+"
#: Text that a kernel looks at in one go; its arrays take some 25 times as much.
SLICE_BYTES = 1 << 20
#: Cells of a gram count. One array of this size travels from every task.
CELLS = 1 << 18
#: Arrays added up on the driver, each a sum over many tasks.
GROUPS = 16
NO_ID = np.iinfo(np.int64).max


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def write_and_read(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet to the shared folder and read again."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Return what a task has freed to the system. Its worker stays for later tasks, and
    would keep the memory while the JVM beside it grows."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``SLICE_BYTES`` of text each."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch[text]), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False)) if batch.num_rows else []
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of a column of texts: byte ranges, hashes, and the row of each."""

    def __init__(self, column: pa.Array, lower: bool = False):
        column = pa.compute.fill_null(column.cast(pa.large_string()), "")
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        _, at, data = column.buffers()
        at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
        size = int(at[-1] - at[0]) if len(at) else 0
        raw = np.frombuffer(data, np.uint8)[at[0] : at[0] + size] if size else np.zeros(0, np.uint8)
        self.bytes = np.concatenate([raw, np.zeros(8, np.uint8)])
        self.rows = len(column)
        self.at = at - at[0] if len(at) else np.zeros(1, np.int64)
        if lower:
            upper = (self.bytes >= 65) & (self.bytes <= 90)
            self.bytes[upper] += 32
        inside = np.empty(size + 2, np.bool_)
        inside[0] = inside[-1] = False
        body = inside[1:-1]
        np.not_equal(raw, 32, out=body)
        body &= (raw < 9) | (raw > 13)
        begins = inside[1:] & ~inside[:-1]
        ends = inside[:-1] & ~inside[1:]
        cut = self.at[1:-1]
        cut = cut[inside[cut + 1] & inside[cut]]
        begins[cut] = ends[cut] = True
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends)
        self.row = np.searchsorted(self.at, self.start, "right") - 1
        # Empty texts share their offset with the next one; the last of those holds the word.
        self.first = np.searchsorted(self.row, np.arange(self.rows + 1))
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        length = self.end - self.start
        blocks = np.ndarray(
            shape=(len(self.bytes) - 7,), dtype="<u8", buffer=self.bytes.data, strides=(1,)
        )
        keep = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
        h = mixed(length.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        left = np.arange(len(length))
        for k in range(8):
            got = blocks[self.start[left] + 8 * k] & keep[np.minimum(length[left] - 8 * k, 8)]
            h[left] = mixed(h[left] ^ got) + np.uint64(0x9E3779B97F4A7C15)
            left = left[length[left] > 8 * (k + 1)]
            if not len(left):
                break
        for i in left:
            h[i] = xxhash.xxh3_64_intdigest(self.bytes[self.start[i] : self.end[i]].tobytes())
        return h

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of every k words in sequence, and the number of the first of them."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.row[:n] == self.row[k - 1 :])
        return combined(self.hash, at, k), at

    def text(self, i: int, j: int) -> bytes:
        """Words i to j - 1, joined by one space."""
        raw, start, end = self.bytes, self.start, self.end
        return b" ".join(raw[start[w] : end[w]].tobytes() for w in range(i, j))


def combined(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    h = np.full(len(at), k, np.uint64)
    for j in range(k):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + hashes[at + j])
    return h


def packed_bytes(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(array).tobytes())


def unpacked(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)


def array_sum(
    df: DataFrame,
    kernel: Callable[[pa.RecordBatch], np.ndarray],
    cells: int,
    dtype=np.int64,
    add: np.ufunc = np.add,
) -> np.ndarray:
    """Add up a fixed-size array that ``kernel`` computes for each Arrow batch.

    A task gives one array; arrays are added in groups of tasks and then on the driver.
    """

    def per_task(batches):
        total = np.zeros(cells, dtype)
        for batch in batches:
            add(total, kernel(batch), out=total)
        part = TaskContext.get().partitionId() % GROUPS
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([packed_bytes(total)], pa.binary())],
            names=["part", "data"],
        )
        release()

    def merge(batches):
        total = np.zeros(cells, dtype)
        for batch in batches:
            for data in batch["data"]:
                add(total, unpacked(data.as_py(), dtype), out=total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([packed_bytes(total)], pa.binary())], names=["data"]
        )

    some = df.mapInArrow(per_task, "part int, data binary").repartition(GROUPS, "part")
    out = np.zeros(cells, dtype)
    for row in some.mapInArrow(merge, "data binary").collect():
        add(out, unpacked(bytes(row["data"]), dtype), out=out)
    return out


def gram_counts(docs: DataFrame, text: str, k: int, lower: bool = False) -> np.ndarray:
    """How often grams of k words occur, in ``CELLS`` cells that grams share by hash.

    It is for ordering only: a gram that is frequent against the mean of a cell is seen
    to be so, whatever the size of the input, and the array never grows.
    """

    def kernel(batch):
        total = np.zeros(CELLS, np.int64)
        for part in slices(batch, "text"):
            gram, _ = Words(part["text"], lower).grams(k)
            total += np.bincount((gram & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        return total

    return array_sum(docs.select(F.col(text).cast("string").alias("text")), kernel, CELLS)
