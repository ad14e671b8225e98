"""Splitting rows into training and test parts."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitgrain.session import fresh_path, settings

#: A prime; positions of keys are residues, so weights hold to one millionth.
PRIME = 1_000_003


def random_split(df: DataFrame, weights: list[float], seed: int = 11) -> list[DataFrame]:
    """Spark's seeded split. Which row goes where depends on the partitioning."""
    return df.randomSplit(weights, seed)


#: Draws are whole numbers below this.
DRAWS = 1 << 32
#: Equal rows that one task deals out.
EQUAL_ROWS = 100_000
#: Types whose values are equal just when their JSON is.
EXACT = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType, T.DateType)


def row_split(df: DataFrame, weights: list[float], seed: int = 11) -> list[DataFrame]:
    """Split rows by what they hold, without a key: the same parts on any partitioning.

    Equal rows are counted, and each of them draws by the hash of seed, row and its number
    among them, so they are split too. The table is read once; the parts are the folders
    of one staged table. Rows are equal if they are as JSON with nulls.

    The equal rows are few before they are dealt out, so the number of tasks that deal them
    out is set: by its size the shuffle would be merged into one task. Each task has a
    file open for every part, so that its rows aren't sorted by part.
    """
    names = df.columns
    # Names that no column has.
    key, row, n, block, nth, part = (f"{x}_" + "_".join(names) for x in ("k", "r", "n", "b", "i", "p"))
    text = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    digest = F.md5(text.cast("binary")).alias(key)
    if all(isinstance(c.dataType, EXACT) or c.dataType == T.StringType() for c in df.schema):
        # Counted in hash tables; to keep a first row, the whole scan would be sorted.
        equal = df.groupBy(*names).agg(F.count(F.lit(1)).alias(n))
        equal = equal.select(digest, F.struct(*names).alias(row), n)
    else:
        equal = df.groupBy(digest).agg(
            F.first(F.struct(*names)).alias(row), F.count(F.lit(1)).alias(n)
        )
    last = F.floor((F.col(n) - 1) / EQUAL_ROWS)
    blocks = equal.withColumn(block, F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    start = F.col(block) * EQUAL_ROWS
    end = F.least(F.col(n), start + EQUAL_ROWS) - 1
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = blocks.repartition(parts, key, block).withColumn(nth, F.explode(F.sequence(start, end)))
    edges = [round(DRAWS * upto / sum(weights)) for upto in accumulate(weights)]
    number = F.lit(len(weights) - 1)
    draw = row_draw(F.col(key), F.col(nth), seed)
    for k in range(len(weights) - 2, -1, -1):
        number = F.when(draw < edges[k], k).otherwise(number)
    path = fresh_path(spark, "split")
    with settings(spark, spark__sql__maxConcurrentOutputFileWriters=len(weights)):
        rows.select(f"{row}.*", number.alias(part)).write.partitionBy(part).parquet(path)
    schema = df.select("*", F.lit(0).alias(part)).schema
    whole = spark.read.schema(schema).parquet(path)
    return [whole.filter(F.col(part) == k).select(names) for k in range(len(weights))]


def row_draw(digest: Column, nth: Column, seed: int) -> Column:
    """The draw of the ``nth`` of equal rows, from the MD5 of seed, row digest and number."""
    text = F.concat_ws("|", F.lit(str(seed)), digest, nth.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def split_position(key: Column, seed: int = 11) -> Column:
    """Position 0 to ``PRIME`` - 1 of an integer key, from the key alone.

    The key is reduced first, so none overflows, then multiplied and squared modulo the
    prime, so that keys in equal steps spread too.
    """
    reduced = F.pmod(key.cast("bigint"), F.lit(PRIME))
    moved = F.pmod(reduced * F.lit(7919) + F.lit(seed), F.lit(PRIME))
    return F.pmod(moved * moved, F.lit(PRIME))


def hash_split(
    df: DataFrame, key: str | Column, weights: list[float], seed: int = 11
) -> list[DataFrame]:
    """Split by key so that the parts are the same on any partitioning or engine.

    A narrow filter per part: no shuffle, and the test can reach the scan. Keys of
    other types than integers can be passed as ``xxhash64(...)``. Rows with a null key
    are in the first part.
    """
    column = F.col(key) if isinstance(key, str) else key
    bucket = F.coalesce(split_position(column, seed), F.lit(0))
    total = sum(weights)
    edges = [0] + [round(PRIME * upto / total) for upto in accumulate(weights)]
    return [df.filter((bucket >= low) & (bucket < high)) for low, high in zip(edges, edges[1:])]
