"""Value sets and quantiles of columns, merged in two levels.

A global aggregate sends one set or sketch per task to a single reducer, and the many
tasks of a large table make that reducer the bottleneck. Here tasks are first merged in
groups, each giving small arrays, and only those arrays meet.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUPS = 256
GROUP_ROWS = 1_000_000
STEPS = 1_000


def value_sets_and_quantiles(
    df: DataFrame, rows: int, small: list[str], large: list[str], shares: list[float]
) -> dict[str, list[float]]:
    """Sorted distinct values of ``small`` columns and quantiles of ``large`` ones.

    ``small`` columns must have few values; quantiles have a rank error of about
    ``1 / STEPS``. ``rows`` is the size of the table; a small one is one group.
    """
    steps = [i / STEPS for i in range(STEPS + 1)]
    groups = min(GROUPS, ceil(rows / GROUP_ROWS))
    group = F.pmod(F.spark_partition_id(), F.lit(groups))
    grouped = (
        df.select(group.alias("group"), *small, *large)
        .groupBy("group")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.collect_set(name).alias(name) for name in small],
            *[F.percentile_approx(name, steps, 10 * STEPS).alias(name) for name in large],
        )
        .persist()
    )
    try:
        found = {}
        if small:
            merged = [
                F.array_sort(F.array_distinct(F.flatten(F.collect_list(name)))).alias(name)
                for name in small
            ]
            found.update(grouped.agg(*merged).first().asDict())
        if large:
            arrays = F.array(
                *[F.struct(F.lit(name).alias("name"), F.col(name).alias("at")) for name in large]
            )
            points = grouped.select("rows", F.inline(arrays)).select(
                "name", "rows", F.explode("at").alias("at")
            )
            cuts = points.groupBy("name").agg(F.percentile("at", shares, F.col("rows")).alias("at"))
            found.update({row["name"]: row["at"] for row in cuts.collect()})
        return found
    finally:
        grouped.unpersist()
