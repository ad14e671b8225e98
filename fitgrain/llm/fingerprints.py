"""Document fingerprints from closed syncmers of words.

A run of k words is a closed syncmer if the least hash of its inner runs of s words lies
at its first or last place. Whether a run is chosen depends on its own words alone, so an
edit moves no anchor beyond k words of it. The fingerprint has all anchors of a text and
their places, so it grows with the text. Two texts are as like as the share of anchors that
match at a consistent shift. Column expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of a run and of its inner runs.
RUN = 4
INNER = 1
#: A word is a run of characters without white space, 32 at most; characters of scripts
#: that are written without spaces are words of their own.
TOKEN = (
    r"[぀-ヿ㐀-鿿가-힯฀-๿]"
    r"|[^\s぀-ヿ㐀-鿿가-힯฀-๿]{1,32}"
)


def word_hashes(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return F.transform(found, lambda word: F.xxhash64(word))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def syncmers(hashes: Column, k: int = RUN, s: int = INNER) -> Column:
    """Anchors of a text as an array of ``struct(pos, hash)``.

    A text without a closed syncmer (of fewer than k words, or of few more) has one anchor,
    of all its words; an empty one none.
    """
    n = F.size(hashes)
    inner = hashes if s == 1 else _runs(hashes, s)
    span = k - s + 1
    shifted = [F.slice(inner, j + 1, 1 << 30).alias(f"m{j}") for j in range(span)]
    words = [F.slice(hashes, j + 1, 1 << 30).alias(f"h{j}") for j in range(k)] if s > 1 else []
    zipped = F.arrays_zip(*shifted, *words, F.sequence(F.lit(0), n - 1).alias("pos"))
    zipped = F.slice(zipped, F.lit(1), F.greatest(n - k + 1, F.lit(0)))

    def chosen(x: Column) -> Column:
        middle = [x[f"m{j}"] for j in range(1, span - 1)]
        edge = F.least(x["m0"], x[f"m{span - 1}"])
        return edge <= F.least(*middle) if len(middle) > 1 else edge <= middle[0]

    own = "m" if s == 1 else "h"
    anchors = F.transform(
        F.filter(zipped, chosen),
        lambda x: F.struct(
            x["pos"].cast("int").alias("pos"),
            F.xxhash64(*(x[f"{own}{j}"] for j in range(k))).alias("hash"),
        ),
    )
    whole = F.array(
        F.struct(F.lit(0).alias("pos"), F.xxhash64(F.array_join(hashes, " ")).alias("hash"))
    )
    none = F.array().cast("array<struct<pos:int,hash:bigint>>")
    return _let(
        F.when(n < k, none).otherwise(anchors),
        lambda a: F.when((n > 0) & (F.size(a) == 0), whole).otherwise(a),
    )


def _runs(hashes: Column, s: int) -> Column:
    parts = [F.slice(hashes, j + 1, 1 << 30).alias(f"w{j}") for j in range(s)]
    count = F.greatest(F.size(hashes) - s + 1, F.lit(0))
    zipped = F.slice(F.arrays_zip(*parts), F.lit(1), count)
    return F.transform(zipped, lambda x: F.xxhash64(*(x[f"w{j}"] for j in range(s))))


def as_text(anchors: Column) -> Column:
    """Nine hexadecimal digits for each anchor, in order: the low 32 bits of its hash, and
    how far it lies after the one before, which is at most RUN - INNER words."""

    def number(a: Column, i: Column) -> Column:
        gap = a["pos"] - F.coalesce(F.get(anchors, i - 1)["pos"], F.lit(0))
        return F.shiftleft(a["hash"].bitwiseAND(F.lit(0xFFFFFFFF)), 4) + gap

    return F.array_join(
        F.transform(anchors, lambda a, i: F.lpad(F.hex(number(a, i)), 9, "0")), ""
    )


def pairs(x: Column, y: Column) -> Column:
    """Equal anchors of two texts in order of place in x, as ``struct(pos, shift)``: how far
    the place in x lies after that in y. The first of some equal anchors in x goes with the
    first of them in y, the second with the second, and so on."""

    def side(anchors: Column, k: int) -> Column:
        return F.transform(
            anchors, lambda a: F.struct(a["hash"], F.lit(k).alias("side"), a["pos"])
        )

    def starts(both: Column) -> Column:
        def new(a: Column, i: Column) -> Column:
            before = F.get(both, i - 1)
            other = (before["hash"] != a["hash"]) | (before["side"] != a["side"])
            return F.when(F.coalesce(other, F.lit(True)), i)

        # The end follows the last group.
        return F.concat(
            F.filter(F.transform(both, new), F.isnotnull), F.array(F.size(both))
        )

    def of_group(both: Column, at: Column, j: Column) -> Column:
        here, there, end = (F.get(at, j + k) for k in range(3))
        return F.transform(
            F.sequence(F.lit(0), F.least(there - here, end - there) - 1),
            lambda r: F.struct(
                F.get(both, here + r)["pos"].alias("pos"),
                (F.get(both, here + r)["pos"] - F.get(both, there + r)["pos"]).alias("shift"),
            ),
        )

    def matched(both: Column, at: Column) -> Column:
        def goes_on(i: Column, j: Column) -> Column:
            here, there = F.get(both, i), F.get(both, F.get(at, j + 1))
            return F.when((here["side"] == 0) & (here["hash"] == there["hash"]), j)

        both_sides = F.filter(F.transform(at, goes_on), F.isnotnull)
        return F.flatten(F.transform(both_sides, lambda j: of_group(both, at, j)))

    found = _let(
        F.sort_array(F.concat(side(x, 0), side(y, 1))),
        lambda both: _let(starts(both), lambda at: matched(both, at)),
    )
    return F.sort_array(found)


def likeness(x: Column, y: Column) -> Column:
    """The share of all anchors of both that match; 1 for two empty texts.

    Equal anchors match if the pair before or after them in x has the same shift, so runs
    that lie about both texts by chance don't. A pair that is the only one matches.
    """

    def agreeing(found: Column) -> Column:
        def agrees(p: Column, i: Column) -> Column:
            near = [F.get(found, i + k)["shift"].eqNullSafe(p["shift"]) for k in (-1, 1)]
            return near[0] | near[1] | (F.size(found) == 1)

        return F.size(F.filter(found, agrees))

    n = F.size(x) + F.size(y)
    common = _let(pairs(x, y), agreeing)
    return F.when(n == 0, 1.0).otherwise(_let(common, lambda c: c / (n - c)))


def shift(x: Column, y: Column) -> Column:
    """How far the words of text x lie after those of y: the median of their common
    anchors, null without a common anchor."""
    moved = F.sort_array(F.transform(pairs(x, y), lambda p: p["shift"]))
    return _let(
        moved, lambda m: F.when(F.size(m) > 0, F.get(m, F.floor(F.size(m) / 2).cast("int")))
    )


def fingerprint_documents(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, fingerprint``, and ``anchors`` with their positions, of each document.

    Null and empty texts have an empty fingerprint. Equal texts have equal fingerprints.
    Repeated rows and null ids are like any others. Other columns are not read. An empty
    table gives no rows.
    """
    hashes = word_hashes(F.coalesce(F.col(text).cast("string"), F.lit("")))
    out = docs.select(F.col(id).alias(id), hashes.alias("hashes_"))
    out = out.select(id, syncmers(F.col("hashes_")).alias("anchors"))
    return out.select(id, as_text(F.col("anchors")).alias("fingerprint"), "anchors")


def edit_and_compare(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document against its edited text and against the next document.

    In the edited text the last ``floor(n / 2)`` of the n characters give way to the
    first as many (or all) of the next document by id; after the last comes the first.
    Returns ``id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``.

    The table is dealt out by ranges of ids; each range also gets the first document of
    the next one, so only neighbours within a range need be seen together. A null text
    is empty. Null ids come first. Rows with one id follow each other in order of text.
    A single document is its own next one. Other columns are not read. An empty table
    gives no rows.
    """
    slim = docs.select(
        F.col(id).cast("long").alias("id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    firsts = _range_starts(slim)
    coarse = firsts[:: max(1, round(len(firsts) ** 0.5))]
    step = max(1, round(len(firsts) ** 0.5))
    groups = [firsts[i : i + step] for i in range(0, len(firsts), step)]
    if firsts:
        group = F.greatest(F.size(F.filter(F.lit(coarse), lambda b: b <= F.col("id"))), F.lit(1))
        inner = F.filter(
            F.element_at(F.array(*(F.lit(g) for g in groups)), group), lambda b: b <= F.col("id")
        )
        part = (group - 1) * step + F.greatest(F.size(inner), F.lit(1)) - 1
        part = F.coalesce(part, F.lit(0))
    else:
        part = F.lit(0)
    slim = slim.withColumn("part", part)
    # The first document of each range ends the range before; that of the first ends the last.
    least = F.min(F.struct(F.coalesce("id", F.lit(-(1 << 63))), "text")).alias("least")
    heads = slim.filter(F.col("id").isin(firsts) | F.col("id").isNull())
    heads = heads.groupBy("part").agg(least).select("part", "least.text")
    last = F.lit(max(len(firsts), 1) - 1)
    heads = heads.select(
        F.lit(None).cast("long").alias("id"),
        "text",
        F.when(F.col("part") == 0, last).otherwise(F.col("part") - 1).alias("part"),
        F.lit(1).alias("head"),
    )
    # Anchors take more room than the text, so they are made after the shuffle, and once
    # for a document and the one before it.
    both = slim.withColumn("head", F.lit(0)).unionByName(heads).repartition("part")
    both = _with_anchors(both.withColumn("anchors", F.col("text")), "anchors")
    after = Window.partitionBy("part").orderBy("head", F.col("id").asc_nulls_first(), "text")
    following = [F.lead(name).over(after).alias(f"next_{name}") for name in ("text", "anchors")]
    both = both.select("*", *following).filter("head = 0")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), n - half),
        F.substring(F.col("next_text"), F.lit(1), half),
    )
    both = both.select(
        "id",
        n.cast("long").alias("n_chars"),
        "anchors",
        "next_anchors",
        edited.alias("edited"),
    )
    both = _with_anchors(both.withColumn("edited_sha256", F.sha2("edited", 256)), "edited")
    return both.select(
        F.col("id").alias(id),
        "n_chars",
        "edited_sha256",
        as_text(F.col("anchors")).alias("fingerprint"),
        as_text(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("edited")).alias("near_edited"),
        likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
    )


def _with_anchors(df: DataFrame, text: str) -> DataFrame:
    """Anchors in a text's place. The hashes are a column of their own, because an
    expression that several others hold is worked out by each of them."""
    df = df.withColumn(text, word_hashes(F.col(text)))
    return df.withColumn(text, syncmers(F.col(text)))


def _range_starts(docs: DataFrame) -> list[int]:
    """Ids that begin ranges of about equal size, the least first."""
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(parts)]
    row = docs.agg(
        F.min("id").alias("low"), F.percentile_approx("id", shares, 20 * parts).alias("starts")
    ).first()
    return sorted({row["low"], *row["starts"]}) if row["starts"] else []
