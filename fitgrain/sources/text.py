"""Scans of text, LIBSVM and edge-list files, and staging of datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fitgrain.functions.parsing import parse_edges


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line, in column ``value``."""
    return spark.read.text(path)


def read_libsvm(spark: SparkSession, path: str, dimension: int | None = None) -> DataFrame:
    """``label i:v ...`` lines with 1-based indices to ``label double, features vector``.

    Features stay sparse vectors. Giving ``dimension`` saves the extra scan that
    otherwise looks for the largest index.
    """
    reader = spark.read.format("libsvm")
    if dimension is not None:
        reader = reader.option("numFeatures", str(dimension))
    return reader.load(path)


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """``src dst`` lines to ``src bigint, dst bigint``."""
    return parse_edges(read_lines(spark, path))


def stage_dataset(df: DataFrame, path: str, format: str = "parquet") -> str:
    """Write a dataset once; an existing target is refused. Returns the path."""
    df.write.mode("errorifexists").format(format).save(path)
    return path
