"""Rows that can't be fitted on are errors in every fit, never silently counted."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fitgrain.operators.kmeans import KMeansModel, fit_kmeans
from fitgrain.operators.linear import fit_least_squares, fit_svm
from fitgrain.operators.trees import fit_tree
from fitgrain.session import clear_staged, fresh_path

FITS = {
    "least squares": fit_least_squares,
    "svm": fit_svm,
    "tree": fit_tree,
    "k-means": lambda df: fit_kmeans(df, 2, centres=[[0.0] * N, [1.0] * N]),
}
N = 40


def table(spark, dim, extra):
    rows = [(float(i % 2), [float(i % 2)] * dim) for i in range(8)] + [extra]
    return spark.createDataFrame(rows, "label double, features array<double>").coalesce(1)


@pytest.mark.parametrize("dim", [2, N])
@pytest.mark.parametrize("name", ["least squares", "svm", "tree"])
def test_bad_rows_raise(spark, name, dim):
    nan = float("nan")
    bad = [(1.0, None), (1.0, [None] * dim), (1.0, [nan] * dim), (None, [1.0] * dim), (nan, [1.0] * dim)]
    for extra in bad:
        with pytest.raises(ValueError):
            FITS[name](table(spark, dim, extra))


def test_bad_rows_raise_in_kmeans(spark):
    for extra in ((1.0, None), (1.0, [None] * N), (1.0, [float("nan")] * N)):
        with pytest.raises(ValueError):
            FITS["k-means"](table(spark, N, extra))


def test_wide_distances_keep_their_digits(spark):
    x = 1e6 + 0.01 * np.random.default_rng(1).standard_normal((50, 80))
    df = spark.createDataFrame([(row.tolist(),) for row in x], "features array<double>")
    centre = x.mean(axis=0)
    found = KMeansModel(centre.reshape(1, -1), 1).cost(df).first()["value"]
    assert found == pytest.approx(((x - centre) ** 2).sum(), rel=1e-6)


def test_staged_folders_go(spark):
    path = fresh_path(spark, "gone")
    spark.range(3).write.parquet(path)
    clear_staged()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    assert spark.range(1).select(F.lit(1)).count() == 1
