"""Feature columns: unpacking, dot products and Arrow kernels for wide rows.

Features are ``array<double>`` (or float) or ML vectors. Up to ``NARROW`` elements
they are unpacked to plain columns and every expression is generated code. Wider
rows go to numpy in Arrow batches, where one call handles a whole batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NARROW = 16
#: Groups of tasks whose sums are added up before they reach the driver, and cells of a sum
#: that travel as one row.
SUM_GROUPS = 8
BLOCK_CELLS = 1 << 18


def is_vector(df: DataFrame, features: str) -> bool:
    return isinstance(df.schema[features].dataType, VectorUDT)


def sparse_parts(features: str) -> Column:
    """An ML vector, dense or sparse, as ``struct(size, indices, values)``."""
    raw = F.unwrap_udt(F.col(features))
    count = F.size(raw["values"])
    every = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.struct(
        F.coalesce(raw["size"], count).alias("size"),
        F.coalesce(raw["indices"], every).alias("indices"),
        raw["values"].alias("values"),
    )


def length(df: DataFrame, features: str) -> Column:
    """Number of elements of a feature column."""
    if is_vector(df, features):
        return sparse_parts(features)["size"]
    return F.size(features)


def unusable(df: DataFrame, features: str, dim: int) -> Column:
    """Whether a row can't be fitted on: its features are null, of another length, or
    hold a null or NaN."""
    if dim <= NARROW:
        # Single columns keep the check in generated code.
        bad = length(df, features) != dim
        for x in unpack(df, features, dim):
            bad = bad | x.isNull() | F.isnan(x)
        return F.coalesce(bad, F.lit(True))
    if is_vector(df, features):
        values = sparse_parts(features)["values"]
    else:
        values = F.col(features)
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x.cast("double")))
    return F.coalesce((length(df, features) != dim) | bad, F.lit(True))


def unusable_label(label: str | Column) -> Column:
    """Whether a label is null or NaN."""
    column = F.col(label) if isinstance(label, str) else label
    return column.isNull() | F.isnan(column.cast("double"))


def dimension(df: DataFrame, features: str = "features") -> int:
    """Number of elements in the first row."""
    row = df.select(length(df, features).alias("d")).first()
    if row is None:
        raise ValueError("cannot fit on an empty table")
    return row.d


def unpack(df: DataFrame, features: str, dim: int) -> list[Column]:
    """The elements as double columns ``x0, x1, ...``."""
    column = F.col(features)
    if is_vector(df, features):
        column = vector_to_array(column)
    return [F.get(column, F.lit(j)).cast("double").alias(f"x{j}") for j in range(dim)]


def weighted_sum(terms: list[tuple[Column, float]]) -> Column:
    """Sum of columns times numbers, left to right."""
    total = F.lit(0.0)
    for column, factor in terms:
        total = total + column * F.lit(float(factor))
    return total


def dot(df: DataFrame, features: str, weights: np.ndarray) -> Column:
    """Dot product of a feature column with fixed weights."""
    weights = np.asarray(weights, dtype=float)
    if len(weights) <= NARROW:
        return weighted_sum(list(zip(unpack(df, features, len(weights)), weights)))
    return products(df, features, weights.reshape(1, -1))[0]


def products(df: DataFrame, features: str, rows: np.ndarray) -> Column:
    """Dot products with each row of a matrix, as an array, one numpy call per batch."""
    rows = np.asarray(rows, dtype=float)

    @F.arrow_udf("array<double>")
    def multiply(batch: pa.Array) -> pa.Array:
        return list_array(batch_matrix(batch, rows.shape[1]).dot(rows.T))

    return multiply(kernel_column(df, features))


def kernel_column(df: DataFrame, features: str) -> Column:
    """The feature column in the form that ``batch_matrix`` reads."""
    if is_vector(df, features):
        return sparse_parts(features)
    return F.col(features).cast("array<double>")


class SparseBatch:
    """Rows of one Arrow batch as row numbers, positions and values."""

    def __init__(self, batch: pa.StructArray, dim: int):
        positions = batch.field("indices")
        self.shape = (len(batch), dim)
        self.owner = np.repeat(
            np.arange(len(batch)), positions.value_lengths().to_numpy(zero_copy_only=False)
        )
        self.position = positions.flatten().to_numpy(zero_copy_only=False)
        self.value = batch.field("values").flatten().to_numpy(zero_copy_only=False)

    def dot(self, right: np.ndarray) -> np.ndarray:
        columns = right.reshape(self.shape[1], -1)
        out = np.stack(
            [
                np.bincount(self.owner, self.value * c[self.position], minlength=self.shape[0])
                for c in columns.T
            ],
            axis=1,
        )
        return out.reshape(self.shape[0], *right.shape[1:])

    def weighted_rows(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(
            self.position, self.value * weights[self.owner], minlength=self.shape[1]
        )

    def squares(self) -> np.ndarray:
        return np.bincount(self.owner, self.value**2, minlength=self.shape[0])

    def spread(self, rows: np.ndarray) -> np.ndarray:
        """Some rows as a matrix."""
        out = np.zeros((len(rows), self.shape[1]))
        place = np.full(self.shape[0], -1)
        place[rows] = np.arange(len(rows))
        mine = place[self.owner] >= 0
        out[place[self.owner[mine]], self.position[mine]] = self.value[mine]
        return out


class DenseBatch:
    """Rows of one Arrow batch as a matrix."""

    def __init__(self, batch: pa.ListArray, dim: int):
        self.matrix = batch.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), dim)
        self.shape = self.matrix.shape

    def dot(self, right: np.ndarray) -> np.ndarray:
        return self.matrix @ right

    def weighted_rows(self, weights: np.ndarray) -> np.ndarray:
        return weights @ self.matrix

    def squares(self) -> np.ndarray:
        return np.einsum("ij,ij->i", self.matrix, self.matrix)


def batch_matrix(batch: pa.Array, dim: int) -> SparseBatch | DenseBatch:
    if pa.types.is_struct(batch.type):
        return SparseBatch(batch, dim)
    return DenseBatch(batch, dim)


def list_array(matrix: np.ndarray) -> pa.Array:
    """A matrix as an Arrow list column."""
    offsets = np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, np.ascontiguousarray(matrix).ravel())


def partition_sums(
    df: DataFrame, kernel: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, int]
) -> np.ndarray:
    """Sum a matrix that ``kernel`` computes for each Arrow batch.

    Each task adds up its own batches and sends the matrix as blocks of bytes. Blocks are
    added in ``SUM_GROUPS`` groups of tasks, in the order of tasks, and the driver adds what
    the groups give.
    """

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += kernel(batch)
        task, flat = TaskContext.get().partitionId(), total.ravel()
        for block, start in enumerate(range(0, len(flat), BLOCK_CELLS)):
            row = {
                "block": block,
                "part": task % SUM_GROUPS,
                "task": task,
                "data": flat[start : start + BLOCK_CELLS].tobytes(),
            }
            yield pa.RecordBatch.from_pylist([row], schema=sent)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip((*key, total.tobytes()), (pa.int32(), pa.int32(), pa.binary()))],
                names=["block", "part", "data"],
            )

        for batch in batches:
            for row in batch.to_pylist():
                cells = np.frombuffer(row["data"])
                if (row["block"], row["part"]) == key:
                    total = total + cells
                    continue
                if key is not None:
                    yield done()
                key, total = (row["block"], row["part"]), cells
        if key is not None:
            yield done()

    sent = pa.schema(
        [("block", pa.int32()), ("part", pa.int32()), ("task", pa.int32()), ("data", pa.binary())]
    )
    sums = (
        df.mapInArrow(per_task, "block int, part int, task int, data binary")
        .repartition(SUM_GROUPS, "block", "part")
        .sortWithinPartitions("block", "part", "task")
        .mapInArrow(merge, "block int, part int, data binary")
    )
    out = np.zeros(shape).ravel()
    for row in sorted(sums.collect(), key=lambda row: (row["block"], row["part"])):
        start = row["block"] * BLOCK_CELLS
        cells = np.frombuffer(bytes(row["data"]))
        out[start : start + len(cells)] += cells
    return out.reshape(shape)
