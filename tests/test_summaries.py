import numpy as np
from pyspark.sql import functions as F

from fitgrain.functions import summaries
from fitgrain.functions.summaries import value_sets_and_quantiles


def test_values_and_quantiles_over_many_groups(spark, monkeypatch):
    monkeypatch.setattr(summaries, "GROUPS", 4)
    monkeypatch.setattr(summaries, "GROUP_ROWS", 10)
    df = spark.range(20_000).repartition(7).select(
        (F.col("id") % 5).cast("double").alias("few"),
        F.col("id").cast("double").alias("many"),
        (F.col("id") * -2.0).alias("falling"),
    )
    shares = [0.25, 0.5, 0.75]
    found = value_sets_and_quantiles(df, 20_000, ["few"], ["many", "falling"], shares)
    assert found["few"] == [0.0, 1.0, 2.0, 3.0, 4.0]
    assert np.allclose(found["many"], [5_000, 10_000, 15_000], atol=100)
    assert np.allclose(found["falling"], [-30_000, -20_000, -10_000], atol=200)
