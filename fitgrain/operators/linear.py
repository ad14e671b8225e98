"""Least squares and linear SVM by full-batch gradient descent.

Weights start at zero and there is no intercept. Round ``i`` uses step ``1/sqrt(i)``
over all rows. From the second round on, a fit stops once the weights move by less
than ``tolerance * max(norm, 1)``, so the number of rounds is an upper bound.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitgrain.functions.vectors import (
    NARROW,
    batch_matrix,
    dimension,
    dot,
    kernel_column,
    partition_sums,
    unpack,
    unusable,
    unusable_label,
    weighted_sum,
)
from fitgrain.operators.grain import distinct_estimate, weigh

TOLERANCE = 0.001
SVM_REGULARISATION = 0.01


@dataclass(frozen=True)
class LinearModel:
    """Fitted weights. ``threshold`` is None for a regression or for raw margins."""

    weights: np.ndarray
    rounds: int
    threshold: float | None = None

    def clear_threshold(self) -> LinearModel:
        return LinearModel(self.weights, self.rounds, None)

    def predict(
        self, df: DataFrame, features: str = "features", output: str = "prediction"
    ) -> DataFrame:
        """Append the margin, or 1.0 / 0.0 for above / not above the threshold."""
        margin = dot(df, features, self.weights)
        if self.threshold is None:
            return df.withColumn(output, margin)
        return df.withColumn(
            output, F.when(margin > F.lit(self.threshold), 1.0).otherwise(0.0)
        )

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(j, float(w)) for j, w in enumerate(self.weights)]
        return spark.createDataFrame(rows, "j int, weight double")


def fit_least_squares(
    df: DataFrame,
    iterations: int = 20,
    label: str = "label",
    features: str = "features",
    dim: int | None = None,
) -> LinearModel:
    """Least squares by gradient descent; the gradient is not halved.

    The gradient ``(X'X w - X'y) / n`` depends on the rows only through ``X'X`` and
    ``X'y``. For narrow features these come from one scan and the rounds need no
    further job; wide features take one job per round.
    """
    dim = dim or dimension(df, features)
    if dim <= NARROW:
        gradient = _moment_gradient(df, label, features, dim)
        weights, rounds = _descend(gradient, dim, iterations, lambda w, step: w)
        return LinearModel(weights, rounds)

    def residual(margin: np.ndarray, y: np.ndarray) -> np.ndarray:
        return margin - y

    weights, rounds = _descend_wide(
        df, label, features, dim, iterations, residual, lambda w, step: w, unusable_label(label)
    )
    return LinearModel(weights, rounds)


def fit_svm(
    df: DataFrame,
    iterations: int = 20,
    regularisation: float = SVM_REGULARISATION,
    label: str = "label",
    features: str = "features",
    dim: int | None = None,
) -> LinearModel:
    """Linear SVM: hinge gradient with L2 shrinkage. Labels must be 0 or 1."""
    dim = dim or dimension(df, features)

    def shrink(w: np.ndarray, step: float) -> np.ndarray:
        return w * (1.0 - step * regularisation)

    bad_label = ~F.coalesce(F.col(label).isin(0.0, 1.0), F.lit(False))
    if dim <= NARROW:
        weights, rounds = _descend_hinge(
            df, label, features, dim, iterations, shrink, bad_label
        )
    else:

        def hinge(margin: np.ndarray, y: np.ndarray) -> np.ndarray:
            sign = 2.0 * y - 1.0
            return np.where(sign * margin < 1.0, -sign, 0.0)

        weights, rounds = _descend_wide(
            df, label, features, dim, iterations, hinge, shrink, bad_label
        )
    return LinearModel(weights, rounds, threshold=0.0)


def _descend(
    gradient: Callable[[np.ndarray], np.ndarray],
    dim: int,
    iterations: int,
    shrink: Callable[[np.ndarray, float], np.ndarray],
) -> tuple[np.ndarray, int]:
    """The driver's part of a fit: one weight vector, one gradient per round."""
    w = np.zeros(dim)
    for i in range(1, iterations + 1):
        step = 1.0 / np.sqrt(i)
        new = shrink(w, step) - step * gradient(w)
        moved = np.linalg.norm(new - w)
        w = new
        if i > 1 and moved < TOLERANCE * max(np.linalg.norm(w), 1.0):
            return w, i
    return w, iterations


def _check(rows: int, bad_labels: int, wrong_lengths: int, dim: int) -> None:
    if not rows:
        raise ValueError("cannot fit on an empty table")
    if bad_labels:
        raise ValueError(f"input validation failed: {bad_labels} labels are null, NaN or not allowed")
    if wrong_lengths:
        raise ValueError(f"{wrong_lengths} rows do not have {dim} features that are numbers")


def _moment_gradient(
    df: DataFrame, label: str, features: str, dim: int
) -> Callable[[np.ndarray], np.ndarray]:
    x = unpack(df, features, dim)
    narrow = df.select(
        unusable_label(label).alias("bad"),
        unusable(df, features, dim).alias("wrong"), F.col(label).alias("y"), *x
    )
    pairs = [(i, j) for i in range(dim) for j in range(i, dim)]
    row = narrow.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("bad").alias("bad"),
        F.count_if("wrong").alias("wrong"),
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"m{i}_{j}") for i, j in pairs],
        *[F.sum(F.col(f"x{j}") * F.col("y")).alias(f"v{j}") for j in range(dim)],
    ).first()
    _check(row["rows"], row["bad"], row["wrong"], dim)
    square = np.zeros((dim, dim))
    for i, j in pairs:
        square[i, j] = square[j, i] = row[f"m{i}_{j}"]
    cross = np.array([row[f"v{j}"] for j in range(dim)])
    return lambda w: (square @ w - cross) / row["rows"]


def _descend_hinge(
    df: DataFrame,
    label: str,
    features: str,
    dim: int,
    iterations: int,
    shrink: Callable[[np.ndarray, float], np.ndarray],
    bad_label: Column,
) -> tuple[np.ndarray, int]:
    # With z = sign * x a row is inside the margin when w.z < 1 and adds -z.
    sign = F.col(label) * 2.0 - 1.0
    signed = df.select(
        bad_label.alias("bad"),
        unusable(df, features, dim).alias("wrong"),
        *[(sign * x).alias(f"z{j}") for j, x in enumerate(unpack(df, features, dim))],
    )
    names = [f"z{j}" for j in range(dim)]
    z = [F.col(name) for name in names]
    profile = signed.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("bad").alias("bad"),
        F.count_if("wrong").alias("wrong"),
        distinct_estimate(z).alias("distinct"),
    ).first()
    _check(profile["rows"], profile["bad"], profile["wrong"], dim)
    points = weigh(signed.select(*names), profile["rows"], profile["distinct"]).persist()

    def gradient(w: np.ndarray) -> np.ndarray:
        inside = points.filter(weighted_sum(list(zip(z, w))) < 1.0)
        row = inside.agg(*[F.sum(c * F.col("weight")) for c in z]).first()
        return -np.array([value or 0.0 for value in row]) / profile["rows"]

    try:
        return _descend(gradient, dim, iterations, shrink)
    finally:
        points.unpersist()


def _descend_wide(
    df: DataFrame,
    label: str,
    features: str,
    dim: int,
    iterations: int,
    coefficient: Callable[[np.ndarray, np.ndarray], np.ndarray],
    shrink: Callable[[np.ndarray, float], np.ndarray],
    bad_label: Column,
) -> tuple[np.ndarray, int]:
    """One numpy pass per round; ``coefficient`` gives each row's factor of ``x``."""
    checked = df.select(
        F.col(label).cast("double").alias("y"),
        kernel_column(df, features).alias("x"),
        bad_label.alias("bad"),
        unusable(df, features, dim).alias("wrong"),
    ).persist()
    points = checked.select("y", "x")
    try:
        profile = checked.agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if("bad").alias("bad"),
            F.count_if("wrong").alias("wrong"),
        ).first()
        _check(profile["rows"], profile["bad"], profile["wrong"], dim)

        def gradient(w: np.ndarray) -> np.ndarray:
            def kernel(batch: pa.RecordBatch) -> np.ndarray:
                x = batch_matrix(batch.column("x"), dim)
                y = batch.column("y").to_numpy(zero_copy_only=False)
                return x.weighted_rows(coefficient(x.dot(w), y)).reshape(1, -1)

            return partition_sums(points, kernel, (1, dim))[0] / profile["rows"]

        return _descend(gradient, dim, iterations, shrink)
    finally:
        checked.unpersist()
