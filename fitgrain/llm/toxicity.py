"""Severity of toxic text by cumulative-link ordinal regression.

The chance of a grade above k is ``sigmoid(w . x - t_k)`` with one weight vector for all
ordered thresholds. Features are the presence of words and of their first letters; the
model keeps those that tell toxic documents from others on the labelled sample. The
output is the expected severity, the sum of those chances.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The model is fitted on at most this many labelled documents, drawn by hash of the id.
SAMPLE = 4000
#: Words that a model may keep, and documents that a word must be in.
FEATURES = 1000
LEAST = 3
#: First letters of longer words are features too, for languages that compound.
STEMS = (5, 6, 7)
#: Chi-square of a word's presence against toxicity that earns it a weight.
LEAST_CHI2 = 20.0
RIDGE = 3e-4
ROUNDS = 500
LETTERS = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}-" for n in STEMS if len(word) > n)]


def words_of(text: str | None) -> set[str]:
    return set(LETTERS.findall(text.lower())) if text else set()


def tokens(text: str | None) -> set[str]:
    return {f for word in words_of(text) for f in features(word)}


@dataclass
class OrdinalModel:
    words: list[str]
    weights: np.ndarray
    thresholds: np.ndarray

    def severity(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Expected severity, and the chance of any grade above 0."""
        place = {w: i for i, w in enumerate(self.words)}
        seen: dict[str, tuple[int, ...]] = {}
        score = []
        for text in texts:
            found = set()
            for word in words_of(text):
                hit = seen.get(word)
                if hit is None:
                    hit = seen[word] = tuple(place[f] for f in features(word) if f in place)
                if hit:
                    found.update(hit)
            score.append(float(self.weights[sorted(found)].sum()) if found else 0.0)
        over = sigmoid(np.array(score)[:, None] - self.thresholds[None, :])
        return over.sum(axis=1), over[:, 0]

    def keep_clean(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """The rows whose text is not toxic, all columns as they are."""
        model = self

        def keep(batches):
            for batch in batches:
                _, chance = model.severity(batch[text].to_pylist())
                yield batch.filter(pa.array(chance <= 0.5))

        return docs.mapInArrow(keep, docs.schema)

    def score(self, docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
        """``id, expected_severity, p_toxic, is_toxic`` of each document.

        Null, empty and unknown texts have the severity of a text without known words.
        Repeated rows and null ids are scored like any others. Other columns are not
        read. An empty table gives no rows.
        """
        model = self

        def find(batches):
            for batch in batches:
                severity, chance = model.severity(batch["text"].to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch["id"], pa.array(severity), pa.array(chance)],
                    names=["id", "expected_severity", "p_toxic"],
                )

        slim = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
        schema = slim.select("id").schema.add("expected_severity", "double")
        out = slim.mapInArrow(find, schema.add("p_toxic", "double"))
        return out.select(
            F.col("id").alias(id),
            "expected_severity",
            "p_toxic",
            (F.col("p_toxic") > 0.5).alias("is_toxic"),
        )


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def choose_words(texts: list[str | None], toxic: np.ndarray) -> list[str]:
    """Words whose presence depends on toxicity the most, by chi-square. Only counts are
    held, never the words of all texts."""
    n, positive = len(texts), int(toxic.sum())
    with_word, both = Counter(), Counter()
    for text, y in zip(texts, toxic):
        found = tokens(text)
        with_word.update(found)
        if y:
            both.update(found)
    scored = []
    for word, a in with_word.items():
        b = both[word]
        if a < LEAST or a == n or positive in (0, n):
            continue
        top = n * (b * (n - positive) - (a - b) * positive) ** 2
        chi2 = top / (a * (n - a) * positive * (n - positive))
        if chi2 >= LEAST_CHI2:
            scored.append((-chi2, word))
    return [word for _, word in sorted(scored)[:FEATURES]]


def severity_grades(
    texts: list[str | None], toxic: list[int], words: list[str]
) -> list[int]:
    """Grades from labels of 0 and 1: 0 without the label, 2 for a toxic document with
    more different telling words than the median toxic one, else 1."""
    y, known = np.array(toxic) > 0, set(words)
    count = np.array([len(tokens(t) & known) for t in texts])
    middle = np.median(count[y]) if y.any() else 0
    return (y.astype(int) + (y & (count > middle))).tolist()


def fit_ordinal(
    texts: list[str | None],
    grades: list[int],
    words: list[str] | None = None,
    rounds: int = ROUNDS,
) -> OrdinalModel:
    """Fit on texts with grades 0, 1, 2, ...; gradient steps with momentum, fixed start."""
    y = np.array(grades, dtype=np.int64)
    top = max(1, int(y.max()) if len(y) else 1)
    words = choose_words(texts, y > 0) if words is None else words
    place = {w: i for i, w in enumerate(words)}
    x = np.zeros((len(y), len(words)))
    for i, text in enumerate(texts):
        x[i, [place[w] for w in tokens(text) & place.keys()]] = 1.0
    above = (y[:, None] > np.arange(top)[None, :]).astype(float)
    share = (above.sum(axis=0) + 0.5) / (len(y) + 1.0)
    w, t = np.zeros(len(words)), np.sort(-np.log(share / (1 - share)))
    if not words:
        return OrdinalModel(words, w, t)
    # The grade's chance is a difference of two neighbouring curves.
    mw, mt, vw, vt = np.zeros_like(w), np.zeros_like(t), np.zeros_like(w), np.zeros_like(t)
    rows = np.arange(len(y))
    for step in range(1, rounds + 1):
        z = x @ w
        curve = np.concatenate(
            [np.ones((len(y), 1)), sigmoid(z[:, None] - t[None, :]), np.zeros((len(y), 1))],
            axis=1,
        )
        slope = curve * (1 - curve)
        chance = np.maximum(curve[rows, y] - curve[rows, y + 1], 1e-9)
        up, down = slope[rows, y] / chance, slope[rows, y + 1] / chance
        gw = -(x.T @ (up - down)) / len(y) + RIDGE * w
        gt = np.zeros_like(t)
        np.add.at(gt, y[y > 0] - 1, up[y > 0])
        np.add.at(gt, y[y < top], -down[y < top])
        gt /= len(y)
        mw, mt = 0.9 * mw + 0.1 * gw, 0.9 * mt + 0.1 * gt
        vw, vt = 0.99 * vw + 0.01 * gw**2, 0.99 * vt + 0.01 * gt**2
        scale = 0.05 * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        w = w - scale * mw / (np.sqrt(vw) + 1e-8)
        t = np.sort(t - scale * mt / (np.sqrt(vt) + 1e-8))
    return OrdinalModel(words, w, t)


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    sample: int = SAMPLE,
) -> OrdinalModel:
    """Fit on documents with labels ``toxic`` (0 or 1).

    Grades are those of ``severity_grades``. ``sample`` bounds the labelled documents used, half
    of them toxic if there are so many; they are those with the least hash of their id,
    so reruns agree. Rows with a null id, text or ``toxic`` are not used. Without a
    toxic label the model finds nothing toxic.
    """
    marked = labels.filter("toxic is not null").select(
        F.col(id).alias("label_id"), F.col("toxic").cast("int").alias("grade")
    )
    draw = F.xxhash64(F.lit(29), F.col("label_id"))
    # The least hashes of ids alone choose the rows; texts are read for those only.
    picked = [
        marked.filter(which).withColumn("draw", draw).orderBy("draw", "grade").limit(sample // 2)
        for which in ("grade > 0", "grade = 0")
    ]
    chosen = {r["label_id"]: r["grade"] for part in picked for r in part.collect()}
    if not chosen:
        return fit_ordinal([], [])
    texts = docs.select(F.col(id).alias("label_id"), F.col(text).alias("label_text"))
    texts = texts.filter(F.col("label_id").isin(list(chosen))).dropna()
    texts = texts.groupBy("label_id").agg(F.min("label_text").alias("label_text"))
    rows = sorted((r["label_id"], r["label_text"]) for r in texts.toLocalIterator())
    texts, toxic = [t for _, t in rows], [chosen[i] for i, _ in rows]
    words = choose_words(texts, np.array(toxic) > 0)
    model = fit_ordinal(texts, severity_grades(texts, toxic, words), words)
    # The sample has more toxic documents than the labels have: the thresholds make up.
    found = {r["toxic"]: r["count"] for r in marked.groupBy(
        (F.col("grade") > 0).alias("toxic")).count().collect()}
    drawn = sum(y > 0 for y in toxic)
    if 0 < drawn < len(toxic):
        model.thresholds += np.log(found[False] / found[True] * drawn / (len(toxic) - drawn))
    return model
