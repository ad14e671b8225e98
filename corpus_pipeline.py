"""A corpus from raw documents to packed sequences, in stages that are each written out.

A stage takes (spark, docs, sf_dir). All but the last return the columns of documents.

A stage sets the session's Arrow batches to ``BATCH_ROWS`` rows and leaves them so, because
its rows are read after it has returned. The JVM and the Python worker hold a batch whole.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitgrain.llm.common import table, write_and_read
from fitgrain.llm.jaccard_join import one_of_each
from fitgrain.llm.mixing import take_mix
from fitgrain.llm.packing import pack_documents
from fitgrain.llm.substring_dedup import dedup_substrings
from fitgrain.llm.toxicity import fit_toxicity

BATCH_ROWS = 1000


def _in_small_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        now = int(spark.conf.get(name))
        if not 0 < now <= BATCH_ROWS:
            spark.conf.set(name, BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run_stage


def _remeasured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


@_in_small_batches
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go. The model is fitted on the labelled ones of the folder."""
    model = fit_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return model.keep_clean(docs)


@_in_small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of likeness 0.8 in five-word shingles stays."""
    return one_of_each(docs)


@_in_small_batches
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of words that an earlier document has are cut out of the texts."""
    out = dedup_substrings(docs).drop("n_words", "n_removed")
    return _remeasured(out).select(docs.columns)


@_in_small_batches
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return take_mix(docs)


@_in_small_batches
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources to target weights", mixture),
    ("best-fit packing", packing),
]

#: Fitting a classifier and the packing plan have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = write_and_read(docs, f"stage-{number}")
    return docs
