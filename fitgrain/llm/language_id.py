"""Language identification by prediction by partial matching.

Each language has a context tree over bytes: after up to four bytes of context, how often
each byte followed. A byte that its context has seen ``k`` times costs ``-log2(k / (n + q))``
bits, for ``n`` bytes and ``q`` different ones seen there; any other costs the context's
escape and is then looked up one byte of context shorter, down to all 256 bytes alike. A
context that the tree does not have costs nothing to leave. The tree is frozen after the
fit, so a text's code length is a sum over its bytes, in any order and exactly. A text has
the language that codes it in the fewest bits.

Texts are read as bytes in which A to Z are in lower case and each run of other bytes below
128 is one space.

As the statistics never change, the cost of a byte depends only on the byte and the four
before it: the fit resolves each known string of five, four and three bytes to one cost per
language, and a text is scored by looking its strings up, the longest first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitgrain.llm.common import slices

#: Bytes of context.
DEPTH = 4
#: Labelled documents of a language that a fit draws, on average, by hash.
SAMPLE = 2000
#: Strings of each length that a language's tree keeps at most, the most frequent ones, and
#: costs that a model holds at most, one for each string and language.
STRINGS = 1 << 16
COSTS = 1 << 26
#: Languages that a model may have.
LANGUAGES = 200
#: Costs of bytes that are held at a time, one for each language.
HELD = 1 << 21
UNKNOWN = "und"


def _plain_bytes() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    letter = ((table | 32) >= 97) & ((table | 32) <= 122)
    table[65:91] += 32
    table[:128][~letter[:128]] = 32
    return table


PLAIN = _plain_bytes()


def plain_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes as they are coded, each after DEPTH spaces, and where texts begin."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    size = int(at[-1] - at[0]) if len(at) else 0
    raw = PLAIN[np.frombuffer(data, np.uint8)[at[0] : at[-1]]] if size else np.zeros(0, np.uint8)
    at = at - at[0] if len(at) else np.zeros(1, np.int64)
    keep = np.ones(size, np.bool_)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    # The first byte of a text stays whatever was before it.
    keep[at[:-1][np.diff(at) > 0]] = True
    new_at = np.concatenate([[0], np.cumsum(keep)])[at] + DEPTH * np.arange(len(at))
    out = np.full(new_at[-1], 32, np.uint8)
    body = np.ones(len(out), np.bool_)
    body[(new_at[:-1, None] + np.arange(DEPTH)).ravel()] = False
    out[body] = raw[keep]
    return out, new_at


def strings(data: np.ndarray, length: int) -> np.ndarray:
    """The bytes' strings of ``length`` as numbers, one for each byte from DEPTH on."""
    n = max(len(data) - DEPTH, 0)
    code = np.zeros(n, np.int64)
    for back in range(length - 1, -1, -1):
        code = (code << 8) | data[DEPTH - back : DEPTH - back + n]
    return code


def has_letter(column: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script."""
    found = pc.match_substring_regex(column.cast(pa.large_string()), r"\pL")
    return pc.fill_null(found, False).to_numpy(zero_copy_only=False)


def held_out(id: Column) -> Column:
    """Whether a document is kept from the fit: a third, by hash of its id."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Level:
    """Known strings of one length: sorted codes, and the bits of each for every language."""

    codes: np.ndarray
    bits: np.ndarray
    #: Contexts of that length less one, and what leaving one costs each language.
    contexts: np.ndarray
    escapes: np.ndarray

    def place(self, codes: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(known):
            return np.zeros(len(codes), np.int64), np.zeros(len(codes), np.bool_)
        at = np.searchsorted(known, codes)
        at[at == len(known)] = 0
        return at, known[at] == codes

    def cost(self, codes: np.ndarray, shorter) -> np.ndarray:
        """Bits of the strings' last bytes; ``shorter`` gives those of strings it lacks."""
        at, there = self.place(codes, self.codes)
        out = self.bits[at] if len(self.codes) else np.zeros((len(codes), self.bits.shape[1]), np.float32)
        gone = np.flatnonzero(~there)
        if len(gone):
            code = codes[gone]
            at, there = self.place(code >> 8, self.contexts)
            extra = np.where(there[:, None], self.escapes[at], 0) if len(self.contexts) else 0
            out[gone] = extra + shorter(code)
        return out


class PartialMatching:
    """Code lengths of texts in every language of a fit."""

    def __init__(self, languages: list[str], counts: dict[int, tuple[np.ndarray, ...]]):
        """``counts`` has, for each string length from 1 to DEPTH + 1, arrays of language
        number, code, how often it occurs, and ``n`` and ``q`` of its context."""
        self.languages = languages
        self.levels: list[Level] = []
        for length in range(1, DEPTH + 2):
            self.levels.append(self._level(length, *counts[length]))

    def _level(self, length: int, language, code, times, n, q) -> Level:
        width = len(self.languages)
        codes, at = np.unique(code, return_inverse=True)
        contexts, context = np.unique(code >> 8, return_inverse=True)
        seen = np.zeros((len(contexts), width))
        total = np.ones((len(contexts), width))
        np.add.at(seen, (context, language), times)
        total[context, language] = n + q
        # What known bytes leave of a context's total is its escape.
        escapes = np.where(seen > 0, -np.log2((total - seen) / total), 0)
        if len(codes):
            of_code = np.searchsorted(contexts, codes >> 8)
            bits = escapes[of_code] + self._shorter(codes, length)
            bits[at, language] = -np.log2(times / (n + q))
        else:
            bits = np.zeros((0, width))
        return Level(codes, bits.astype(np.float32), contexts, escapes.astype(np.float32))

    def _shorter(self, codes: np.ndarray, length: int) -> np.ndarray:
        """Bits of strings without their first byte."""
        if length == 1:
            return np.full((len(codes), len(self.languages)), 8.0, np.float32)
        return self.cost(codes & ((1 << 8 * (length - 1)) - 1), length - 1)

    def cost(self, codes: np.ndarray, length: int) -> np.ndarray:
        return self.levels[length - 1].cost(codes, lambda some: self._shorter(some, length))

    def bits(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each text in each language, and bytes of each text."""
        data, at = plain_text(column)
        total = np.zeros((len(at) - 1, len(self.languages)))
        step = HELD // max(len(self.languages), 1)
        for start in range(0, len(data) - DEPTH, step):
            part = data[start : start + step + DEPTH]
            cost = self.cost(strings(part, DEPTH + 1), DEPTH + 1)
            # Bytes start + DEPTH to stop, in runs of one text each.
            stop = start + len(part)
            first = np.searchsorted(at, start + DEPTH, "right") - 1
            last = np.searchsorted(at, stop, "left")
            begins = np.maximum(at[first:last] + DEPTH, start + DEPTH)
            ends = np.minimum(at[first + 1 : last + 1], stop)
            sums = np.concatenate([np.zeros((1, cost.shape[1])), np.cumsum(cost, axis=0, dtype=np.float64)])
            begins = np.minimum(begins, ends) - start - DEPTH
            total[first:last] += sums[np.maximum(ends - start - DEPTH, 0)] - sums[np.maximum(begins, 0)]
        return total, np.diff(at) - DEPTH

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, its share of all languages' likelihood, and bits a byte, of each text."""
        rows = len(column)
        bits, size = self.bits(column)
        known = has_letter(column) & (len(self.languages) > 0)
        score, rate = np.zeros(rows), np.zeros(rows)
        names = [UNKNOWN] * rows
        at = np.flatnonzero(known)
        if len(at):
            best = bits[at].argmin(axis=1)
            least = bits[at, best]
            score[at] = 1 / np.exp2(least[:, None] - bits[at]).sum(axis=1)
            rate[at] = least / size[at]
            for row, which in zip(at.tolist(), best.tolist()):
                names[row] = self.languages[which]
        return names, score, rate

    def identify(self, docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
        """``id, held_out, lang_pred, score, bits_per_byte`` of each document.

        ``lang_pred`` is ``und``, with score 0, for null texts, texts without a letter, and
        all texts if the model has no language. ``score`` is the language's share of the
        likelihoods, from 0 to 1; ties go to the first language by name. Repeated rows and
        null ids are scored like any others (a null id is not held out). Other columns
        are not read. An empty table gives no rows.
        """
        model = self
        names = ["id", "held_out", "lang_pred", "score", "bits_per_byte"]

        def score(batches):
            for whole in batches:
                for batch in slices(whole, "text"):
                    got = model.predict(batch["text"])
                    columns = [batch["id"], batch["held_out"], *map(pa.array, got)]
                    columns[2] = columns[2].cast(pa.string())
                    yield pa.RecordBatch.from_arrays(columns, names=names)

        slim = docs.select(
            F.col(id).alias("id"),
            held_out(F.col(id)).alias("held_out"),
            F.col(text).cast("string").alias("text"),
        )
        schema = slim.select("id", "held_out").schema.add("lang_pred", "string")
        schema = schema.add("score", "double").add("bits_per_byte", "double")
        return slim.mapInArrow(score, schema).withColumnRenamed("id", id)


def count_strings(docs: DataFrame) -> DataFrame:
    """``lang, code, times`` of the longest strings in the texts of ``lang, text``."""

    def count(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                data, at = plain_text(batch["text"])
                lang = batch["lang"].dictionary_encode()
                of_row = lang.indices.to_numpy()
                code = strings(data, DEPTH + 1)
                place = np.arange(DEPTH, len(data))
                row = np.searchsorted(at, place, "right") - 1
                own = place >= at[row] + DEPTH
                for which, name in enumerate(lang.dictionary.to_pylist()):
                    some = own & (of_row[row] == which)
                    found, times = np.unique(code[some], return_counts=True)
                    columns = [pa.repeat(name, len(found)), pa.array(found), pa.array(times)]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "code", "times"])

    parts = docs.select("lang", "text").mapInArrow(count, "lang string, code long, times long")
    return parts.groupBy("lang", "code").agg(F.sum("times").alias("times"))


def fit_languages(
    docs: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE
) -> PartialMatching:
    """Fit on the documents with a text and a language.

    ``sample`` bounds the work: where a language has more documents, each is drawn with
    the chance that gives ``sample`` on average, by hash of the text, so reruns agree and
    copies are drawn together. Texts are taken whole. A language's tree keeps ``STRINGS``
    strings of each length at most (fewer with many languages, for ``COSTS``), those above
    a threshold of occurrences; the rest of a context's counts belongs to its escape. Without labelled texts the model has no
    language, and more than ``LANGUAGES`` of them is an error.
    """
    slim = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    sizes = slim.filter("text is not null and lang is not null").groupBy("lang").count()
    sizes = {r["lang"]: r["count"] for r in sizes.limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    languages = sorted(sizes)
    empty = {length: tuple(np.zeros(0, np.int64) for _ in range(5)) for length in range(1, DEPTH + 2)}
    if not languages:
        return PartialMatching([], empty)
    draw = F.shiftrightunsigned(F.xxhash64("text"), 2)
    chosen = F.lit(False)
    for name, size in sizes.items():
        chosen = chosen | ((F.col("lang") == name) & (draw < F.lit(min((1 << 62) * sample // size, 1 << 62))))
    longest = count_strings(slim.filter("text is not null").filter(chosen)).persist()
    try:
        counts = {n: _known(longest, languages, n) for n in range(1, DEPTH + 2)}
    finally:
        longest.unpersist()
    return PartialMatching(languages, counts)


def _known(longest: DataFrame, languages: list[str], length: int) -> tuple[np.ndarray, ...]:
    """The strings of one length that the trees keep, with the totals of their contexts."""
    mask = (1 << 8 * length) - 1
    code = F.col("code").bitwiseAND(F.lit(mask)).alias("code")
    counts = longest.groupBy("lang", code).agg(F.sum("times").alias("times"))
    counts = counts.withColumn("context", F.shiftright("code", 8))
    totals = counts.groupBy("lang", "context").agg(F.sum("times").alias("n"), F.count("*").alias("q"))
    # How many strings occur how often; from 255 on by powers of two, so it is bounded.
    rank = F.when(F.col("times") < 256, F.col("times")).otherwise(
        248 + F.floor(F.log2(F.col("times")))
    )
    most = min(STRINGS, COSTS // (DEPTH + 1) // len(languages) ** 2)
    found: dict[str, list[tuple[int, int]]] = {}
    for row in counts.groupBy("lang", rank.cast("long").alias("rank")).count().collect():
        found.setdefault(row["lang"], []).append((row["rank"], row["count"]))
    keep = F.lit(False)
    for name, ranks in found.items():
        left, least = most, 1 << 20
        for value, rows in sorted(ranks, reverse=True):
            left -= rows
            if left < 0:
                break
            least = value
        keep = keep | ((F.col("lang") == name) & (rank >= least))
    rows = counts.filter(keep).join(totals, ["lang", "context"])
    got = rows.select("lang", "code", "times", "n", "q").toArrow()
    number = pc.index_in(got["lang"], value_set=pa.array(languages, pa.string())).to_numpy()
    return (number.astype(np.int64), *(got[name].to_numpy() for name in ("code", "times", "n", "q")))


def identify_held_out(docs: DataFrame) -> DataFrame:
    """The language of every document, from the labels of those that aren't held out."""
    known = docs.filter("doc_id is not null").filter(~held_out(F.col("doc_id")))
    return fit_languages(known).identify(docs)
