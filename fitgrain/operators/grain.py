"""Replacing equal rows by one row with a weight.

An iterative fit reads its table once per round. Where features take few values,
far fewer distinct rows than rows exist, and a sum over weighted distinct rows is the
same sum. One groupBy, combined map-side, then shrinks every later round.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHRINK = 8
GROUPED_ROWS_PER_PARTITION = 250_000


def distinct_estimate(columns: list[Column]) -> Column:
    """Estimated number of distinct combinations, usable next to other aggregates."""
    return F.approx_count_distinct(F.xxhash64(*columns))


def worth_grouping(rows: int, distinct: int) -> bool:
    return distinct * SHRINK <= rows


def gather(grouped: DataFrame, distinct: int) -> DataFrame:
    """Few partitions for a grouped table, so that a round over it is a few tasks.

    A shuffle of the grouped rows, not a coalesce: that would also put the final
    aggregation, fed by every task of the scan, into those few tasks.
    """
    return grouped.repartition(max(1, ceil(distinct / GROUPED_ROWS_PER_PARTITION)))


def weigh(df: DataFrame, rows: int, distinct: int) -> DataFrame:
    """Rows with a ``weight``: grouped when that shrinks the table, else 1.0 each."""
    if not worth_grouping(rows, distinct):
        return df.withColumn("weight", F.lit(1.0))
    grouped = df.groupBy(*df.columns).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return gather(grouped, distinct)
