"""Quality rules as a short-circuit cascade.

A bounded sample tells for each rule what share of documents it rejects and what it
costs; rules are then tried in order of rejection per cost, and a document that one rule
rejects isn't shown to the rest. The order decides the work, never the verdict: a
document is kept if it passes all rules. Everything is column expressions.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitgrain.llm.common import words

#: Documents on which costs and rejections are estimated, the first that are read.
SAMPLE = 2000
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for a bad document. It may use the base columns and the
    document's ``text`` and ``words``."""

    name: str
    rejects: Column


def default_rules() -> list[Rule]:
    """Rules that ordinary prose of any size passes."""
    n = F.col("n_words")
    lines = F.filter(F.split(F.col("text"), "\n"), lambda line: F.rlike(line, F.lit("[^ \t-\r]")))
    bullets = F.filter(lines, lambda line: F.rlike(line, F.lit("^[ \t]*[-*•]")))
    endings = F.filter(lines, lambda line: F.rlike(line, F.lit("(\\.\\.\\.|…)[ \t\r]*$")))
    # Vowel signs are marks, and part of the words of many scripts.
    letters = F.length(F.regexp_replace("text", r"[^\p{L}\p{M}]+", ""))
    # A vocabulary grows more slowly than its text, so long texts need no fixed share.
    distinct = F.size(F.array_distinct(F.transform("words", F.lower))).cast("long")
    return [
        Rule("symbols", F.col("n_symbols") * 10 > n),
        Rule("word_length", ~(F.col("word_chars").between(2 * n, 15 * n))),
        Rule("repeated_lines", F.col("n_dup_lines") * 10 > F.size(lines) * 3),
        Rule("letters", letters * 10 < F.col("word_chars") * 7),
        Rule("bullets", F.size(bullets) * 10 > F.size(lines) * 9),
        Rule("ellipses", F.size(endings) * 10 > F.size(lines) * 3),
        Rule("few_distinct_words", distinct < F.least(n / 20, F.sqrt(n))),
    ]


def repeated_words(w: Column) -> Column:
    """Words in 3-word windows that the text has twice or more.

    Windows are sorted with their places; equal neighbours mark both places.
    """
    n = F.size(w)
    windows = F.arrays_zip(
        F.slice(w, F.lit(1), F.greatest(n - 2, F.lit(0))).alias("a"),
        F.slice(w, F.lit(2), F.greatest(n - 2, F.lit(0))).alias("b"),
        F.slice(w, F.lit(3), F.greatest(n - 2, F.lit(0))).alias("c"),
        F.sequence(F.lit(1), n - 2).alias("at"),
    )
    # Two windows need four words; below that the places would count downwards.
    return F.when(n < 4, 0).otherwise(_covered(F.sort_array(windows)))


def _covered(windows: Column) -> Column:
    pairs = F.arrays_zip(windows.alias("x"), F.slice(windows, 2, 1 << 30).alias("y"))
    equal = F.filter(
        pairs,
        lambda p: (p["x"]["a"] == p["y"]["a"])
        & (p["x"]["b"] == p["y"]["b"])
        & (p["x"]["c"] == p["y"]["c"]),
    )
    places = F.transform(
        equal,
        lambda p: F.array(
            *(p[s]["at"] + k for s in ("x", "y") for k in range(3))
        ),
    )
    return F.size(F.array_distinct(F.flatten(places)))


def with_base(docs: DataFrame) -> DataFrame:
    """Adds ``words`` and the base columns to a table with a ``text`` without nulls."""
    w = F.col("words")
    lines = F.filter(F.split("text", "\n"), lambda line: F.rlike(line, F.lit("[^ \t-\r]")))
    out = docs.withColumn("words", words(F.col("text")))
    out = out.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_symbols": F.regexp_count(F.col("text"), F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": repeated_words(w).cast("long"),
        }
    )
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return out.withColumn("base_failed", failed)


def estimate(docs: DataFrame, rules: list[Rule], sample: int = SAMPLE) -> list[tuple]:
    """``(name, share rejected, seconds)`` of each rule on a sample, best first.

    The sample is kept for the rules, so that only their own work is timed.
    """
    some = with_base(docs.limit(sample)).filter("not base_failed").persist()
    try:
        n = max(1, some.count())
        out = []
        for rule in rules:
            best, rejected = None, 0
            for _ in range(2):
                start = time.perf_counter()
                rejected = some.agg(F.count_if(rule.rejects)).first()[0]
                took = time.perf_counter() - start
                best = took if best is None else min(best, took)
            out.append((rule.name, rejected / n, best))
    finally:
        some.unpersist()
    return sorted(out, key=lambda x: (-(x[1] + 1 / n) / max(x[2], 1e-6), x[0]))


def quality_cascade(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    rules: list[Rule] | None = None,
    sample: int = SAMPLE,
) -> DataFrame:
    """``id``, the base columns, ``base_failed``, ``kept`` and ``rejected_by``.

    Base columns: ``n_words``; ``word_chars``, their characters; ``n_symbols``;
    ``n_dup_lines``, lines with a word that equal an earlier line; ``n_repeat_words``.
    ``rejected_by`` is the rule of the cascade that ended it, which depends on measured
    costs where several reject; ``kept`` doesn't. A null verdict of a rule passes.

    Null and empty texts have zeros and fail the base. Repeated rows and null ids are
    judged like any others. Other columns are not read. An empty table gives no rows.
    """
    rules = default_rules() if rules is None else rules
    docs = docs.select(
        F.col(id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    by_name = {rule.name: rule for rule in rules}
    order = [by_name[name] for name, _, _ in estimate(docs, rules, sample)]
    # CASE evaluates no branch after the first true one.
    verdict = F.when(F.col("base_failed"), F.lit("base"))
    for rule in order:
        verdict = verdict.when(rule.rejects, F.lit(rule.name))
    return (
        with_base(docs)
        .withColumn("rejected_by", verdict)
        .select(
            F.col("id").alias(id),
            "n_words",
            "word_chars",
            "n_symbols",
            "n_dup_lines",
            "n_repeat_words",
            "base_failed",
            F.col("rejected_by").isNull().alias("kept"),
            "rejected_by",
        )
    )
