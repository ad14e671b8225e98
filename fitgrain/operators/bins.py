"""Bins of feature values: thresholds, and rows as bin numbers.

Arrays become rows of one bin per feature. Wide vectors stay sparse: a row keeps the bins of
its entries that are not in the bin of zero, so it is as long as it has such entries,
however many features there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitgrain.functions.summaries import STEPS, value_sets_and_quantiles
from fitgrain.functions.vectors import batch_matrix, list_array, unpack

#: Values of a batch that one task spreads out at a time.
CHUNK_VALUES = 2_000_000
#: Columns whose quantiles one job takes.
QUANTILE_COLUMNS = 64
#: Values of a sparse feature up to which its quantiles are taken from all of them.
EXACT_VALUES = 10_000
GROUP_ENTRIES, GROUPS = 1_000_000, 256


@dataclass
class Cuts:
    """Thresholds of all features, one after the other; those of feature ``j`` are
    ``flat[start[j]:start[j + 1]]``. A value's bin is how many of them lie below it."""

    flat: np.ndarray
    start: np.ndarray

    @classmethod
    def of(cls, thresholds: list[np.ndarray]) -> Cuts:
        sizes = [len(cuts) for cuts in thresholds]
        flat = np.concatenate([*thresholds, np.empty(0)])
        return cls(flat, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64))

    @property
    def dim(self) -> int:
        return len(self.start) - 1

    @property
    def most(self) -> int:
        """Bins of the feature with the most."""
        return int(np.diff(self.start).max(initial=0)) + 1

    def bins(self, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The bin of each value, by bisection of all at once."""
        low, high = self.start[feature], self.start[feature + 1]
        first = low
        for _ in range(max(self.most - 1, 0).bit_length()):
            middle = (low + high) // 2
            open_ = low < high
            below = open_ & (self.flat[np.where(open_, middle, 0)] < value)
            low, high = np.where(below, middle + 1, low), np.where(open_ & ~below, middle, high)
        return (low - first).astype(np.int32)

    def zero_bins(self) -> np.ndarray:
        return self.bins(np.arange(self.dim), np.zeros(self.dim))


def matrices(batch: pa.Array, dim: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of a batch as dense matrices of bounded size, each with its first row number."""
    step = max(1, CHUNK_VALUES // max(dim, 1))
    for start in range(0, len(batch), step):
        part = batch_matrix(batch.slice(start, step), dim)
        if hasattr(part, "matrix"):
            yield start, part.matrix
        else:
            dense = np.zeros(part.shape)
            dense[part.owner, part.position] = part.value
            yield start, dense


# Arrays, and vectors of few features.


def dense_cuts(
    df: DataFrame, points: DataFrame, features: str, dim: int, rows: int, max_bins: int
) -> Cuts:
    """Midpoints between the values of features with at most ``max_bins`` of them, else
    quantiles of all rows."""
    few = _few_values(points, dim, max_bins)
    many = [j for j in range(dim) if j not in few]
    cuts = _quantiles(df, features, dim, many, rows, max_bins)
    return Cuts.of(
        [cuts[j] if j in cuts else (few[j][1:] + few[j][:-1]) / 2.0 for j in range(dim)]
    )


def _few_values(points: DataFrame, dim: int, limit: int) -> dict[int, np.ndarray]:
    """The sorted values of each feature that has at most ``limit`` of them.

    A task gives up on a feature beyond the limit and says so with a null.
    """

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray | None] = [np.empty(0)] * dim
        for batch in batches:
            for _, matrix in matrices(batch.column(0), dim):
                for j in range(dim):
                    if seen[j] is not None:
                        values = np.union1d(seen[j], matrix[:, j] + 0.0)
                        seen[j] = values if len(values) <= limit else None
        for j, values in enumerate(seen):
            found = [None] if values is None else values.tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([j] * len(found), pa.int32()), pa.array(found, pa.float64())],
                names=["feature", "value"],
            )

    whole = Window.partitionBy("feature")
    found = (
        points.select("x")
        .mapInArrow(per_task, "feature int, value double")
        .repartition("feature")
        .distinct()
        .select(
            "feature",
            "value",
            F.count(F.lit(1)).over(whole).alias("n"),
            F.bool_or(F.col("value").isNull()).over(whole).alias("over"),
        )
        .filter((F.col("n") <= limit) & ~F.col("over"))
        .groupBy("feature")
        .agg(F.array_sort(F.collect_list("value")).alias("values"))
    )
    return {row["feature"]: np.array(row["values"]) for row in found.collect()}


def _quantiles(
    df: DataFrame, features: str, dim: int, many: list[int], rows: int, max_bins: int
) -> dict[int, np.ndarray]:
    """Thresholds of features with many values: quantiles of all rows."""
    shares = [i / max_bins for i in range(1, max_bins)]
    columns = unpack(df, features, dim) if many else []
    out = {}
    for start in range(0, len(many), QUANTILE_COLUMNS):
        block = many[start : start + QUANTILE_COLUMNS]
        flat = df.select(*[columns[j] for j in block])
        found = value_sets_and_quantiles(flat, rows, [], [f"x{j}" for j in block], shares)
        for j in block:
            out[j] = np.unique(np.array(found[f"x{j}"], dtype=float) + 0.0)
    return out


def dense_rows(points: DataFrame, cuts: Cuts, classes: list[float] | None) -> DataFrame:
    """Bin numbers of each row, its class number (0 in regression) and its label."""
    dim = cuts.dim
    known = None if classes is None else np.array(classes)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            for start, matrix in matrices(batch.column(1), dim):
                bins = np.empty(matrix.shape, dtype=np.int32)
                for j in range(dim):
                    own = cuts.flat[cuts.start[j] : cuts.start[j + 1]]
                    bins[:, j] = np.searchsorted(own, matrix[:, j], side="left")
                part = y[start : start + len(matrix)]
                yield pa.RecordBatch.from_arrays(
                    [list_array(bins), _class_numbers(part, known), pa.array(part)],
                    names=["bins", "c", "y"],
                )

    return points.mapInArrow(per_task, "bins array<int>, c int, y double")


def _class_numbers(y: np.ndarray, known: np.ndarray | None) -> pa.Array:
    numbers = np.zeros(len(y)) if known is None else np.searchsorted(known, y)
    return pa.array(numbers.astype(np.int32))


# Vectors of many features.


def sparse_cuts(points: DataFrame, dim: int, rows: int, max_bins: int) -> Cuts:
    """The thresholds that ``dense_cuts`` gives, from entries alone.

    Entries are counted by feature and value; the rows that a feature has no entry in count
    as zeros. A feature with more than ``EXACT_VALUES`` values gets its quantiles from
    sketches of its entries, merged in two levels.
    """
    entries = points.select(
        F.explode(F.arrays_zip(F.col("x.indices"), F.col("x.values"))).alias("e")
    ).select(F.col("e.indices").alias("feature"), (F.col("e.values") + F.lit(0.0)).alias("value"))
    counts = entries.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")).persist()
    try:
        sizes = counts.groupBy("feature").agg(
            F.count(F.lit(1)).alias("values"), F.sum("n").alias("entries")
        )
        light = (
            counts.join(sizes.filter(F.col("values") <= EXACT_VALUES).select("feature"), "feature")
            .groupBy("feature")
            .agg(F.array_sort(F.collect_list(F.struct("value", "n"))).alias("pairs"))
        )

        def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pairs = batch.column(1)
                ends = np.cumsum(pairs.value_lengths().to_numpy(zero_copy_only=False))
                flat = pairs.flatten()
                values = np.split(flat.field(0).to_numpy(), ends[:-1])
                times = np.split(flat.field(1).to_numpy(), ends[:-1])
                found = [_thresholds(v, n, rows, max_bins) for v, n in zip(values, times)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([x.tolist() for x in found], pa.list_(pa.float64()))],
                    names=["feature", "cuts"],
                )

        schema = "feature int, cuts array<double>"
        found = light.mapInArrow(per_task, schema)
        heavy = sizes.filter(F.col("values") > EXACT_VALUES)
        found = found.unionByName(_sketched(entries, heavy, rows, max_bins)).toArrow()
    finally:
        counts.unpersist()
    thresholds: list[np.ndarray] = [np.empty(0)] * dim
    lists = found["cuts"].combine_chunks()
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    for j, own in zip(found["feature"].to_pylist(), np.split(flat, ends[:-1])):
        thresholds[j] = np.unique(own + 0.0)
    return Cuts.of(thresholds)


def _thresholds(values: np.ndarray, times: np.ndarray, rows: int, max_bins: int) -> np.ndarray:
    """Thresholds of one feature from its sorted values and how many rows have each."""
    zeros = rows - int(times.sum())
    if zeros:
        at = np.searchsorted(values, 0.0)
        if at < len(values) and values[at] == 0.0:
            times = times + np.where(np.arange(len(values)) == at, zeros, 0)
        else:
            values, times = np.insert(values, at, 0.0), np.insert(times, at, zeros)
    if len(values) <= max_bins:
        return (values[1:] + values[:-1]) / 2.0
    upto = np.cumsum(times)
    ranks = np.maximum(np.ceil(np.arange(STEPS + 1) / STEPS * rows), 1)
    steps = values[np.searchsorted(upto, ranks)]
    # Each step stands for as many values as there are rows.
    place = (len(steps) * rows - 1) * (np.arange(1, max_bins) / max_bins)
    low, high = np.floor(place), np.ceil(place)
    a, b = steps[(low // rows).astype(int)], steps[(high // rows).astype(int)]
    return np.where(a == b, a, (high - place) * a + (place - low) * b)


def _sketched(entries: DataFrame, heavy: DataFrame, rows: int, max_bins: int) -> DataFrame:
    """``feature, cuts`` of features with very many values."""
    steps = [i / STEPS for i in range(STEPS + 1)]
    shares = [i / max_bins for i in range(1, max_bins)]
    group = F.pmod(F.spark_partition_id(), F.lit(min(GROUPS, ceil(rows / GROUP_ENTRIES))))
    sketches = (
        entries.withColumn("group", group)
        .join(heavy.select("feature"), "feature")
        .groupBy("feature", "group")
        .agg(
            F.count(F.lit(1)).alias("weight"),
            F.percentile_approx("value", steps, 10 * STEPS).alias("at"),
        )
        .select("feature", F.explode("at").alias("at"), "weight")
    )
    zeros = heavy.select(
        "feature",
        F.lit(0.0).alias("at"),
        ((F.lit(rows) - F.col("entries")) * len(steps)).alias("weight"),
    ).filter("weight > 0")
    return (
        sketches.unionByName(zeros)
        .groupBy("feature")
        .agg(F.percentile("at", shares, F.col("weight")).alias("cuts"))
    )


def sparse_rows(points: DataFrame, cuts: Cuts, classes: list[float] | None) -> DataFrame:
    """Like ``dense_rows``, with the features ``at`` that the row's ``bins`` belong to; entries
    in the bin of zero are left out."""
    known = None if classes is None else np.array(classes)
    zero = cuts.zero_bins()

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            rows = batch_matrix(batch.column(1), cuts.dim)
            bins = cuts.bins(rows.position, rows.value)
            kept = bins != zero[rows.position]
            sizes = np.bincount(rows.owner[kept], minlength=len(y))
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            lists = [
                pa.ListArray.from_arrays(ends, x[kept].astype(np.int32)) for x in (rows.position, bins)
            ]
            yield pa.RecordBatch.from_arrays(
                [*lists, _class_numbers(y, known), pa.array(y)], names=["at", "bins", "c", "y"]
            )

    return points.mapInArrow(per_task, "at array<int>, bins array<int>, c int, y double")


class BinBatch:
    """Rows of one batch as bins: those of a feature, and all entries with their owners."""

    def __init__(self, at: pa.ListArray | None, bins: pa.ListArray, dim: int, zero: np.ndarray | None):
        self.dim, self.zero, self.rows = dim, zero, len(bins)
        self.bin = bins.flatten().to_numpy(zero_copy_only=False)
        if at is None:
            self.matrix = self.bin.reshape(self.rows, dim)
            self.owner = np.repeat(np.arange(self.rows), dim)
            self.position = np.tile(np.arange(dim), self.rows)
        else:
            sizes = at.value_lengths().to_numpy(zero_copy_only=False)
            self.owner = np.repeat(np.arange(self.rows), sizes)
            self.position = at.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            self.key = self.owner * dim + self.position

    def of(self, feature: np.ndarray) -> np.ndarray:
        """The bin of one feature of each row."""
        every = np.arange(self.rows)
        if self.zero is None:
            return self.matrix[every, feature]
        wanted = every * self.dim + feature
        place = np.minimum(np.searchsorted(self.key, wanted), max(len(self.key) - 1, 0))
        if not len(self.key):
            return self.zero[feature]
        return np.where(self.key[place] == wanted, self.bin[place], self.zero[feature])


def bin_batches(batch: pa.RecordBatch, dim: int, zero: np.ndarray | None):
    """Parts of a batch of bounded size, each with its first row number."""
    bins = batch.column("bins")
    at = None if zero is None else batch.column("at")
    ends = np.cumsum(bins.value_lengths().to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + CHUNK_VALUES, "right")))
        size = stop - start
        yield start, BinBatch(at and at.slice(start, size), bins.slice(start, size), dim, zero)
        start = stop
