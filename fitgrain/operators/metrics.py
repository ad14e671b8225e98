"""Evaluation of scored rows. Each metric is one aggregate giving ``name, value``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distinct scores of a range, about, and ranges whose totals are added up together.
AUC_RANGE_ROWS = 2_000_000
AUC_BLOCK = 1_000


def report(df: DataFrame, name: str, value: Column) -> DataFrame:
    """One captioned number as a one-row DataFrame."""
    return df.agg(value.cast("double").alias("value")).select(
        F.lit(name).alias("name"), F.col("value")
    )


def share(condition: Column) -> Column:
    """Share of rows that meet a condition, NaN without rows."""
    rows = F.count(F.lit(1))
    return F.when(rows == 0, F.lit(float("nan"))).otherwise(
        F.try_divide(F.count_if(condition).cast("double"), rows)
    )


def misclassified(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("label") != F.col("prediction"))


def correct(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("label") == F.col("prediction"))


def training_error(scored: DataFrame, name: str = "Training Error") -> DataFrame:
    return report(scored, name, share(F.col("label") != F.col("prediction")))


def accuracy(scored: DataFrame, name: str = "Accuracy") -> DataFrame:
    return report(scored, name, share(F.col("label") == F.col("prediction")))


def mean_squared_error(
    scored: DataFrame, name: str = "training Mean Squared Error", form: str = "mean"
) -> DataFrame:
    """Mean of squared residuals, as a mean or as a sum over a count."""
    square = F.pow(F.col("label") - F.col("prediction"), F.lit(2.0))
    if form == "mean":
        return report(scored, name, F.avg(square))
    return report(scored, name, F.try_divide(F.sum(square), F.count(F.lit(1))))


def area_under_roc(
    scored: DataFrame,
    score: str = "score",
    label: str = "label",
    name: str = "Area under ROC",
) -> DataFrame:
    """Exact area under the ROC curve; tied scores count one half.

    Rows first collapse to one per distinct score. Running counts over those need
    an order over the whole set, so they are dealt out by ranges of bounded size:
    counts run within a range, and each range adds the totals of the ranges below it,
    which are summed in blocks first. The cut points only balance the work and do not
    change the result.
    Rows with a null or NaN score or label are left out.
    """
    scored = scored.dropna(subset=[score, label])
    is_positive = F.col(label) > 0.5
    ranked = (
        scored.select((F.col(score) + F.lit(0.0)).alias("s"), is_positive.alias("y"))
        .groupBy("s")
        .agg(
            F.count_if("y").cast("double").alias("pos"),
            F.count_if(~F.col("y")).cast("double").alias("neg"),
        )
        .persist()
    )
    try:
        ranges = ranked.count() // AUC_RANGE_ROWS + 1
        dealt = ranked.repartitionByRange(ranges, "s").withColumn("part", F.spark_partition_id())
        within = (
            Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
        )
        below = F.coalesce(F.sum("neg").over(within), F.lit(0.0))
        won = F.col("pos") * (below + F.col("neg") / 2)
        sums = [F.sum(c).alias(c) for c in ("won", "pos", "neg")]
        # Totals of ranges, and then of blocks of ranges, are the same kind of rows.
        counted = dealt.select("part", "pos", "neg", won.alias("won"))
        counted = counted.groupBy("part").agg(*sums)
        block = F.floor(F.col("part") / AUC_BLOCK)
        counted = _above(counted.withColumn("block", block), ["block"])
        counted = _above(counted.groupBy("block").agg(*sums).withColumnRenamed("block", "part"), [])
        row = counted.agg(*sums).first()
    finally:
        ranked.unpersist()
    if not row.pos and not row.neg:
        value = None
    elif not row.neg:
        value = 1.0
    elif not row.pos:
        value = 0.0
    else:
        value = row.won / (row.pos * row.neg)
    return scored.sparkSession.createDataFrame([(name, value)], "name string, value double")


def _above(counted: DataFrame, within: list[str]) -> DataFrame:
    """Adds to ``won`` the pairs of a part's positives with negatives of the parts below."""
    below = (
        Window.partitionBy(*within).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.coalesce(F.sum("neg").over(below), F.lit(0.0))
    return counted.withColumn("won", F.col("won") + F.col("pos") * before)
