"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitgrain.session import shared_folder


def cut(df: DataFrame) -> DataFrame:
    """The rows behind a reliable checkpoint, so that plans don't grow in loops."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of an edge table ``a, b``; root is the smallest node.

    A round joins each node with the least of its neighbours, which is one map-side
    combined aggregate, so no node's neighbours are gathered. Loops and repeated edges
    are allowed; rows with a null end are ignored; an empty table gives none.
    """
    edges = edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    edges = cut(edges.distinct())
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), "m")
        large = large.filter("a <> m").distinct().select("a", F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b"))
        )
        edges = cut(small.filter("a <> b").distinct())
        now = edges.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        roots.select("node", F.col("node").alias("root"))
    )
