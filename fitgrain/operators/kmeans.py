"""k-means by Lloyd rounds on DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitgrain.functions.vectors import (
    NARROW,
    batch_matrix,
    dimension,
    is_vector,
    kernel_column,
    list_array,
    partition_sums,
    unpack,
    unusable,
)
from fitgrain.operators.grain import distinct_estimate, weigh
from fitgrain.operators.metrics import report

TOLERANCE = 1e-4
#: Rounds in which about all seeded centres are chosen.
SEED_ROUNDS = 8
#: A prime below which draws lie, so that products of two of them fit in 64 bits.
PRIME = (1 << 31) - 1
#: Share of a squared distance that rounding may make up.
ERROR = 1e-10
#: Values of sparse rows that are spread out at a time.
SPREAD_VALUES = 2_000_000


@dataclass(frozen=True)
class KMeansModel:
    """Cluster centres, one row per cluster."""

    centres: np.ndarray
    rounds: int

    def predict(
        self, df: DataFrame, features: str = "features", output: str = "prediction"
    ) -> DataFrame:
        """Append the index of the nearest centre; the lowest index wins a tie."""
        return df.withColumn(output, _nearest(df, features, self.centres)["cluster"])

    def distances(
        self, df: DataFrame, features: str = "features", output: str = "distance"
    ) -> DataFrame:
        """Append the squared distance to the nearest centre."""
        return df.withColumn(output, _nearest(df, features, self.centres)["distance"])

    def cost(
        self,
        df: DataFrame,
        features: str = "features",
        name: str = "Within Set Sum of Squared Errors",
    ) -> DataFrame:
        """Within-set sum of squared errors: one scan, one sum."""
        return report(self.distances(df, features, "distance"), name, F.sum("distance"))

    def to_df(self, spark: SparkSession) -> DataFrame:
        """One row per cluster and coordinate."""
        rows = [
            (c, j, float(x)) for c, centre in enumerate(self.centres) for j, x in enumerate(centre)
        ]
        return spark.createDataFrame(rows, "cluster int, j int, x double")


def fit_kmeans(
    df: DataFrame,
    k: int = 2,
    max_iterations: int = 20,
    centres: Sequence[Sequence[float]] | None = None,
    seed: int = 1,
    features: str = "features",
) -> KMeansModel:
    """Assign every row to the nearest centre, move centres to the mean, repeat.

    Stops after ``max_iterations`` or when every centre moved by at most 1e-4. An
    empty cluster keeps its centre. Without given centres the start comes from
    ``seeded_centres``, and a table of fewer different points has fewer clusters.
    """
    dim = dimension(df, features)
    if centres is not None and np.shape(centres) != (k, dim):
        raise ValueError(f"expected {k} centres of {dim} values")
    if dim * k <= NARROW * 4:
        points, point, distance, sums = _narrow_rounds(df, features, dim)
    else:
        points, point, distance, sums = _wide_rounds(df, features, dim)
    try:
        if centres is None:
            start = seeded_centres(points, point, distance, k, seed)
        else:
            start = np.array(centres, dtype=float)
        return _lloyd(start, max_iterations, sums)
    finally:
        points.unpersist()


def _lloyd(start: np.ndarray, max_iterations: int, sums) -> KMeansModel:
    current = start
    for done in range(1, max_iterations + 1):
        # The last column holds each cluster's total weight.
        found = sums(current)
        weight = found[:, -1:]
        moved_to = np.where(
            weight > 0, found[:, :-1] / np.where(weight > 0, weight, 1.0), current
        )
        shift = np.linalg.norm(moved_to - current, axis=1)
        current = moved_to
        if (shift <= TOLERANCE).all():
            return KMeansModel(current, done)
    return KMeansModel(current, max_iterations)


def seeded_centres(points: DataFrame, point: Column, distance, k: int, seed: int) -> np.ndarray:
    """Up to ``k`` different rows of ``points``, far apart: fewer if there are fewer.

    Every point draws a number from seed, round and its values. In a round the points race
    for being chosen, each by its draw and its squared distance to the centres so far
    (``distance`` gives the column); one wins in each of some buckets by hash. Equal points
    draw alike and count once, so neither weights nor partitions matter, and a round is one
    aggregate.
    """
    chosen: list[np.ndarray] = []
    for turn in range(k):
        wanted = min(k - len(chosen), ceil(k / SEED_ROUNDS)) if chosen else 1
        gap = distance(np.array(chosen)) if chosen else F.lit(1.0)
        race = points.select(
            point.alias("point"), gap.alias("gap"), _value_hash(point, seed * 1009 + turn).alias("h")
        ).filter("gap > 0")
        first = F.pmod((F.col("h") + 1) * (F.col("h") + 1), F.lit(PRIME))
        second = F.pmod(first * first + F.col("h"), F.lit(PRIME))
        key = F.struct((-F.log((second + 1) / F.lit(float(PRIME))) / F.col("gap")), "point")
        won = race.groupBy(F.pmod(first, F.lit(wanted)).alias("bucket")).agg(
            F.min_by("point", key).alias("point")
        )
        found = sorted(won.collect(), key=lambda row: row["bucket"])
        chosen += [np.array(row["point"], dtype=float) for row in found]
        if not found or len(chosen) == k:
            break
    return np.array(chosen)


def _value_hash(point: Column, start: int) -> Column:
    """A number below ``PRIME`` from the millionths of a point's values, one after the other."""

    def add(acc: Column, x: Column) -> Column:
        return F.pmod(acc * F.lit(48271) + F.pmod(F.floor(x * 1e6), F.lit(PRIME)), F.lit(PRIME))

    return F.aggregate(point, F.lit(start % PRIME).cast("bigint"), add)


def _narrow_nearest(x: list[Column], centres: np.ndarray) -> Column:
    options = []
    for cluster, centre in enumerate(centres):
        distance = F.lit(0.0)
        for column, value in zip(x, centre):
            gap = column - F.lit(float(value))
            distance = distance + gap * gap
        options.append(
            F.struct(distance.alias("distance"), F.lit(cluster).alias("cluster"))
        )
    return F.least(*options) if len(options) > 1 else options[0]


def _nearest(df: DataFrame, features: str, centres: np.ndarray) -> Column:
    """Struct of the distance to and the index of the nearest centre."""
    k, dim = centres.shape
    if k * dim <= NARROW * 4:
        return _narrow_nearest(unpack(df, features, dim), centres)

    @F.arrow_udf("array<double>")
    def distances(batch: pa.Array) -> pa.Array:
        return list_array(_squared_distances(batch_matrix(batch, dim), centres))

    every = F.transform(
        distances(kernel_column(df, features)),
        lambda distance, cluster: F.struct(
            distance.alias("distance"), cluster.alias("cluster")
        ),
    )
    return F.array_min(every)


def _from_centres(matrix: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.stack([np.square(matrix - c).sum(axis=1) for c in centres], axis=1)


def _squared_distances(x, centres: np.ndarray) -> np.ndarray:
    """Dense rows subtract the centre first, so that large values far from zero keep
    their digits. Sparse rows expand the square, which keeps them sparse; where the
    rounding of that may exceed ``ERROR`` of a distance, the row is spread out and the
    centre subtracted, some rows at a time."""
    if hasattr(x, "matrix"):
        return _from_centres(x.matrix, centres)
    lengths = np.einsum("ij,ij->i", centres, centres)
    squares, products = x.squares()[:, None] + lengths[None, :], 2.0 * x.dot(centres.T)
    out = np.maximum(squares - products, 0.0)
    # A sum of n terms is off by at most n roundings of its largest partial sum.
    terms = np.maximum(np.bincount(x.owner, minlength=len(out)), np.count_nonzero(centres, axis=1).max())
    bound = np.finfo(float).eps * (terms + 3)[:, None] * (squares + np.abs(products))
    rows = np.flatnonzero((bound > ERROR * out).any(axis=1))
    step = max(1, SPREAD_VALUES // max(x.shape[1], 1))
    for start in range(0, len(rows), step):
        some = rows[start : start + step]
        out[some] = _from_centres(x.spread(some), centres)
    return out


def _check(rows: int, wrong_lengths: int, dim: int) -> None:
    if wrong_lengths:
        raise ValueError(f"{wrong_lengths} of {rows} rows do not have {dim} features that are numbers")


def _narrow_rounds(df: DataFrame, features: str, dim: int):
    names = [f"x{j}" for j in range(dim)]
    flat = df.select(
        unusable(df, features, dim).alias("wrong"), *unpack(df, features, dim)
    )
    profile = flat.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("wrong").alias("wrong"),
        distinct_estimate([F.col(name) for name in names]).alias("distinct"),
    ).first()
    _check(profile["rows"], profile["wrong"], dim)
    points = weigh(flat.select(*names), profile["rows"], profile["distinct"]).persist()

    def sums(centres: np.ndarray) -> np.ndarray:
        nearest = _narrow_nearest([F.col(name) for name in names], centres)
        per_cluster = (
            points.select(nearest["cluster"].alias("cluster"), *names, "weight")
            .groupBy("cluster")
            .agg(
                *[F.sum(F.col(name) * F.col("weight")) for name in names],
                F.sum("weight"),
            )
        )
        out = np.zeros((len(centres), dim + 1))
        for cluster, *values in per_cluster.collect():
            out[cluster] = values
        return out

    def distance(centres: np.ndarray) -> Column:
        return _narrow_nearest([F.col(name) for name in names], centres)["distance"]

    # Zero has one sign.
    return points, F.array(*(F.col(name) + F.lit(0.0) for name in names)), distance, sums


def _wide_rounds(df: DataFrame, features: str, dim: int):
    points = df.select(
        kernel_column(df, features).alias("x"),
        unusable(df, features, dim).alias("wrong"),
    ).persist()
    profile = points.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("wrong").alias("wrong")
    ).first()
    if profile["wrong"]:
        points.unpersist()
    _check(profile["rows"], profile["wrong"], dim)

    def sums(centres: np.ndarray) -> np.ndarray:
        k = len(centres)

        def kernel(batch: pa.RecordBatch) -> np.ndarray:
            x = batch_matrix(batch.column("x"), dim)
            nearest = _squared_distances(x, centres).argmin(axis=1)
            out = np.zeros((k, dim + 1))
            for cluster in range(k):
                member = (nearest == cluster).astype(float)
                out[cluster, :-1] = x.weighted_rows(member)
                out[cluster, -1] = member.sum()
            return out

        return partition_sums(points.select("x"), kernel, (k, dim + 1))

    def distance(centres: np.ndarray) -> Column:
        @F.arrow_udf("double")
        def least(batch: pa.Array) -> pa.Array:
            return pa.array(_squared_distances(batch_matrix(batch, dim), centres).min(axis=1))

        return least("x")

    @F.arrow_udf("array<double>")
    def spread(batch: pa.Array) -> pa.Array:
        return list_array(batch_matrix(batch, dim).spread(np.arange(len(batch))))

    point = spread("x") if is_vector(df, features) else F.col("x")
    return points, F.transform(point, lambda x: x + F.lit(0.0)), distance, sums
