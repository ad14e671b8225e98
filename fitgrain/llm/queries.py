"""The numbered operators over the test tables."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitgrain.llm.chat_format import canonical_turns, digests, format_chats
from fitgrain.llm.common import table
from fitgrain.llm.fill_in_middle import digests as middle_digests
from fitgrain.llm.fingerprints import edit_and_compare
from fitgrain.llm.jaccard_join import jaccard_components
from fitgrain.llm.language_id import identify_held_out
from fitgrain.llm.license_scan import scan_licenses
from fitgrain.llm.merkle import document_manifest
from fitgrain.llm.mixing import mix_sources
from fitgrain.llm.oracles import SQL
from fitgrain.llm.packing import pack_documents
from fitgrain.llm.quality_rules import quality_cascade
from fitgrain.llm.substring_dedup import dedup_substrings
from fitgrain.llm.token_counts import EDITS, apply_edits, build_counts
from fitgrain.llm.toxicity import fit_toxicity


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = dedup_substrings(docs, keep_space=False)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    # The rule that ended the cascade depends on measured times, so it is left out.
    return quality_cascade(table(spark, folder, "documents")).drop("rejected_by")


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"))


def op4_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return edit_and_compare(table(spark, folder, "documents"))


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents"))


def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(table(spark, folder, "documents"), k=3, num=9, den=10)


def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(table(spark, folder, "documents")).drop("matched")


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = fit_toxicity(docs, table(spark, folder, "labels"))
    return model.score(docs)


def op9_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    chats = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    turns = [
        F.struct(*(F.lit(x).cast(kind).alias(name) for x, (name, kind) in zip(row, chats.dtypes)))
        for row in ((-7, 0, "user", text), (-7, 1, "assistant", text))
    ]
    chats = chats.unionByName(spark.range(1).select(F.inline(F.array(*turns))))
    return digests(format_chats(canonical_turns(chats)), "conv_id")


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's tokens before and after three edits: a note put in after a quarter
    of it, 20 characters taken out in the middle, 10 replaced after three quarters."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    counted = build_counts(docs).withColumnRenamed("n_tokens", "n_tokens_before")
    n = F.coalesce(F.length("text"), F.lit(0))
    places = [F.floor(n * share).cast("int") for share in (0.25, 0.5, 0.75)]
    steps = [(0, " (see the note) "), (20, ""), (10, "replaced")]
    edits = F.array(
        *(
            F.struct(p.alias("start"), (p + k).alias("stop"), F.lit(t).alias("text"))
            for p, (k, t) in zip(places, steps)
        )
    )
    out = apply_edits(counted.withColumn("edits", edits.cast(EDITS)))
    return out.select(
        "doc_id",
        F.col("n_tokens_before"),
        F.col("n_tokens").alias("n_tokens_after"),
        F.col("n_encoded").alias("n_chars_encoded"),
        F.length("text").cast("long").alias("n_chars_after"),
    )


def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return middle_digests(table(spark, folder, "documents"))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return document_manifest(table(spark, folder, "documents"))


def op13_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return identify_held_out(table(spark, folder, "documents"))


__all__ = ["QUERIES", "SQL"]

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_packing": op3_packing,
    "op4_fingerprints": op4_fingerprints,
    "op5_mixing": op5_mixing,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_license_scan": op7_license_scan,
    "op8_toxicity": op8_toxicity,
    "op9_chat_format": op9_chat_format,
    "op10_token_counts": op10_token_counts,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_language_id": op13_language_id,
    "pipeline": corpus_pipeline.run,
}
