"""Multinomial naive Bayes: one aggregate to fit, one projection to score."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitgrain.functions.vectors import (
    NARROW,
    dimension,
    is_vector,
    length,
    products,
    sparse_parts,
    unpack,
    weighted_sum,
)



@dataclass(frozen=True)
class BayesModel:
    """Log priors ``pi`` and log likelihoods ``theta``, one row per class in label order."""

    labels: list
    pi: np.ndarray
    theta: np.ndarray
    label_type: str

    def predict(
        self, df: DataFrame, features: str = "features", output: str = "prediction"
    ) -> DataFrame:
        """Append the most likely label; the lowest label wins a tie. No shuffle."""
        classes, dim = self.theta.shape
        if classes * dim <= NARROW * NARROW:
            x = unpack(df, features, dim)
            scores = F.array(
                *[
                    weighted_sum(list(zip(x, row))) + F.lit(float(prior))
                    for prior, row in zip(self.pi, self.theta)
                ]
            )
        else:
            priors = F.lit([float(p) for p in self.pi])
            scores = F.zip_with(
                products(df, features, self.theta), priors, lambda score, prior: score + prior
            )
        # A name that no column has.
        name = "scores_" + "_".join(df.columns)
        best = F.array_position(F.col(name), F.array_max(name))
        return (
            df.withColumn(name, scores)
            .withColumn(output, F.element_at(F.lit(self.labels), best.cast("int")))
            .drop(name)
        )

    def to_df(self, spark: SparkSession) -> DataFrame:
        """One row per class and feature."""
        rows = [
            (label, j, float(self.pi[c]), float(self.theta[c, j]))
            for c, label in enumerate(self.labels)
            for j in range(self.theta.shape[1])
        ]
        schema = f"label {self.label_type}, j int, pi double, theta double"
        return spark.createDataFrame(rows, schema)


def fit_naive_bayes(
    df: DataFrame,
    smoothing: float = 1.0,
    label: str = "label",
    features: str = "features",
    dim: int | None = None,
) -> BayesModel:
    """Fit from counts per class and sums per class and feature, in one pass.

    Negative, NaN or infinite features are an error.
    """
    dim = dim or dimension(df, features)
    if dim <= NARROW * 4:
        rows = _narrow_sums(df, label, features, dim)
    else:
        rows = _wide_sums(df, label, features, dim)
    if not rows:
        raise ValueError("cannot fit on an empty table")
    if any(row["bad"] for row in rows):
        raise ValueError("features must be finite, not negative, and as many in every row")
    rows.sort(key=lambda row: row["label"])
    counts = np.array([row["n"] for row in rows], dtype=float)
    sums = np.array([row["sums"] for row in rows], dtype=float)
    pi = np.log(counts + smoothing) - np.log(counts.sum() + smoothing * len(rows))
    theta = np.log(sums + smoothing) - np.log(
        sums.sum(axis=1, keepdims=True) + smoothing * dim
    )
    label_type = df.schema[label].dataType.simpleString()
    return BayesModel([row["label"] for row in rows], pi, theta, label_type)


def _unusable(value: Column) -> Column:
    return value.isNull() | (value < 0) | F.isnan(value) | (value == float("inf"))


def _narrow_sums(df: DataFrame, label: str, features: str, dim: int) -> list:
    x = [F.col(f"x{j}") for j in range(dim)]
    bad = F.coalesce(length(df, features) != dim, F.lit(True))
    flat = df.select(F.col(label).alias("label"), bad.alias("bad"), *unpack(df, features, dim))
    unusable = F.col("bad")
    for column in x:
        unusable = unusable | _unusable(column)
    return (
        flat.groupBy("label")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(unusable).alias("bad"),
            F.array(*[F.sum(column) for column in x]).alias("sums"),
        )
        .collect()
    )


def _wide_sums(df: DataFrame, label: str, features: str, dim: int) -> list:
    if is_vector(df, features):
        vector, values = F.col(features), sparse_parts(features)["values"]
    else:
        values = F.col(features).cast("array<double>")
        vector = array_to_vector(values)
    bad = (length(df, features) != dim) | F.exists(values, _unusable)
    bad = F.coalesce(bad, F.lit(True))
    # Rows that end the fit are still summed, as zeros.
    none = array_to_vector(F.array_repeat(F.lit(0.0), dim))
    vector = F.when(bad, none).otherwise(vector)
    return [
        {"label": row["label"], "n": row["n"], "bad": row["bad"], "sums": row["sums"].toArray()}
        for row in df.select(
            F.col(label).alias("label"), vector.alias("v"), bad.alias("bad")
        )
        .groupBy("label")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("bad").alias("bad"),
            Summarizer.sum(F.col("v")).alias("sums"),
        )
        .collect()
    ]
