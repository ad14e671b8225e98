import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fitgrain.operators import metrics


def scored(spark, rows):
    return spark.createDataFrame(
        [(float(a), float(b)) for a, b in rows], "label double, prediction double"
    )


def value(df):
    row = df.collect()
    assert len(row) == 1 and df.columns == ["name", "value"]
    return row[0].value


def test_shares_and_errors(spark):
    df = scored(spark, [(1, 1), (0, 1), (1, 1), (2, 5)])
    assert value(metrics.training_error(df)) == 0.5
    assert value(metrics.accuracy(df)) == 0.5
    assert value(metrics.mean_squared_error(df)) == 2.5
    assert value(metrics.mean_squared_error(df, form="sum")) == 2.5
    assert metrics.misclassified(df).count() == metrics.correct(df).count() == 2


def test_without_rows(spark):
    df = scored(spark, [])
    assert math.isnan(value(metrics.training_error(df)))
    assert math.isnan(value(metrics.accuracy(df)))
    assert value(metrics.mean_squared_error(df)) is None
    assert value(metrics.mean_squared_error(df, form="sum")) is None
    assert value(metrics.area_under_roc(df.withColumn("score", F.lit(1.0)))) is None


def pair_count(scores, labels):
    pos, neg = scores[labels == 1], scores[labels == 0]
    gap = pos[:, None] - neg[None, :]
    return ((gap > 0).sum() + 0.5 * (gap == 0).sum()) / gap.size


def area(spark, scores, labels):
    data = [(float(s), float(y)) for s, y in zip(scores, labels)]
    return value(metrics.area_under_roc(spark.createDataFrame(data, "score double, label double")))


@pytest.mark.parametrize(("range_rows", "block"), [(200_000, 1_000), (7, 1_000), (7, 3)])
def test_area_equals_pair_counts_in_one_or_many_ranges(spark, monkeypatch, range_rows, block):
    monkeypatch.setattr(metrics, "AUC_RANGE_ROWS", range_rows)
    monkeypatch.setattr(metrics, "AUC_BLOCK", block)
    random = np.random.default_rng(2)
    labels = random.integers(0, 2, 300)
    for scores in (
        random.normal(size=300),
        random.integers(0, 5, 300).astype(float),
        # One score holds a third of the rows.
        np.where(random.random(300) < 0.33, 0.5, random.normal(size=300)),
        np.array([-0.0, 0.0, 1.0] * 100),
    ):
        assert area(spark, scores, labels) == pytest.approx(pair_count(scores, labels))


def test_area_with_one_class(spark):
    assert area(spark, [0.1, 0.9], [1, 1]) == 1.0
    assert area(spark, [0.1, 0.9], [0, 0]) == 0.0
    assert area(spark, [0.1, 0.9, 0.5], [0, 1, 0]) == 1.0
