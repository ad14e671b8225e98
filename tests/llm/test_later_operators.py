"""Fill-in-the-middle, manifest and language operators against plain Python and SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fitgrain.llm import fill_in_middle, language_id, merkle
from fitgrain.llm.queries import QUERIES, SQL
from tests import compare

FOLDER = "/root/testdata/sf0.001"
UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


@pytest.fixture(params=("corner", "small", "empty"))
def docs(request):
    found = request.getfixturevalue(request.param)
    for name, value in (("lang", F.col("source")), ("n_chars", F.length("text").cast("long"))):
        if name not in found.columns:
            found = found.withColumn(name, value)
    return found


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    columns, found = compare.spark_rows(QUERIES[name](spark, FOLDER))
    expected_columns, expected, _ = compare.sql_rows(compare.connect(FOLDER), SQL[name])
    assert columns == expected_columns
    assert found == expected


# 11


def cut(id, text, rate=50, spm=80):
    text = text or ""
    h = sha(f"42:{'' if id is None else id}")
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("rate, spm", [(50, 80), (100, 50), (0, 0)])
def test_fill_in_middle(docs, rate, spm):
    docs = docs.withColumn("output", F.lit(1)).withColumn("form", F.lit("x"))
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    out = fill_in_middle.fill_in_middle(docs, rate=rate, spm=spm)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    found = fill_in_middle.restore(out.withColumn("restored", F.lit(5))).collect()
    expected = [(i, *cut(i, t, rate, spm), t or "") for i, t in rows]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))


def test_sentinels_half_sentinels_and_long_texts(spark):
    texts = ["a <P> b", "<S>", "x<M>", "<P", "<S", "> <M", "< P>", "P>", "<", ">", " ", "\n\n", "é 漢 😀 "]
    texts += ["<P <S <M " * 50, " ".join(f"w{i}" for i in range(200000))]
    rows = [(i, t) for t in texts for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    out = fill_in_middle.restore(fill_in_middle.fill_in_middle(docs)).collect()
    expected = [(i, *cut(i, t), t) for i, t in rows]
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, expected))
    assert {r["form"] for r in out} == {"plain", "spm", "psm"}


def test_null_outputs_and_forms(spark):
    rows = spark.createDataFrame([(None, "psm"), ("abc", "plain")], "output string, form string")
    assert [r["restored"] for r in fill_in_middle.restore(rows).collect()] == [None, "abc"]


def test_rotation_exchanges_blocks():
    for i, m, j in ((0, 0, 9), (0, 9, 9), (2, 5, 7), (0, 4, 9), (3, 3, 3)):
        data = bytearray(b"abcdefghi")
        fill_in_middle.rotate(data, i, m, j)
        assert data == b"abcdefghi"[:i] + b"abcdefghi"[m:j] + b"abcdefghi"[i:m] + b"abcdefghi"[j:]


# 12


def tree(nodes):
    """Levels from the leaves to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 8])) for i in range(0, len(last), 8)])
    return levels


def steps(levels, place):
    out = []
    for nodes in levels[:-1]:
        start = place // 8 * 8
        out.append(("".join(nodes[start:place]), "".join(nodes[place + 1 : start + 8])))
        place //= 8
    return out


def expected_manifest(rows):
    def leaf(r, text):
        values = (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    by = defaultdict(list)
    for r in rows:
        other = r["text"]
        if other is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
            other = re.sub("[A-Z]", lambda m: m[0].lower(), other)
        by[r["lang"]].append((r["doc_id"], leaf(r, r["text"]), leaf(r, other)))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        by[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        trees.append(tree([x[1] for x in by[lang]]))
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, lang in enumerate(langs):
        for place, (id, node, claimed) in enumerate(by[lang]):
            path = steps(trees[k], place) + steps(top, k)
            proof = sha("".join(a + b for a, b in path))
            folded = claimed
            for a, b in path:
                folded = sha(a + folded + b)
            root = top[-1][0]
            out.append((id, node, trees[k][-1][0], root, proof, folded, folded == root))
    return out


@pytest.mark.parametrize("levels", [4, 1, 2])
def test_manifest(docs, levels, monkeypatch):
    """Superblocks of 8 and 64 leaves make several layers of these tables."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 8**levels)
    docs = docs.withColumn("tree", F.lit(1)).withColumn("place", F.lit(2))
    expected = expected_manifest(docs.collect())
    out = merkle.document_manifest(docs)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, expected))
    assert out.schema["doc_id"] == docs.schema["doc_id"]


def test_a_proof_holds_for_its_leaf_alone(spark):
    rows = [("t", i, sha(str(i)), sha(str(i if i % 10 else -i - 1))) for i in range(700)]
    leaves = spark.createDataFrame(rows, "tree string, id long, node string, claimed string")
    out = merkle.manifest(leaves).collect()
    assert [r["verified"] for r in sorted(out)] == [r["id"] % 10 > 0 for r in sorted(out)]
    for r in out:
        assert merkle.fold(r["node"], r["lefts"], r["rights"]) == r["root"] == r["subroot"]
        siblings = "".join(a + b for a, b in zip(r["lefts"], r["rights"]))
        assert r["proof_sha256"] == sha(siblings)


def test_one_tree_of_equal_rows_is_dealt_to_many_parts(spark):
    """Equal rows and rows of one id are spread, and no group exceeds a superblock."""
    rows = spark.range(20000).select(
        F.lit("=x").alias("tree"), F.lit(5).cast("long").alias("id"), F.lit(sha("a")).alias("node")
    )
    leaves = merkle.write_and_read(rows.withColumn("claimed", F.col("node")), "equal-rows")
    placed = merkle.with_block(merkle.numbered(leaves, ["id", "node", "claimed"]))
    assert sorted(r["place"] for r in placed.select("place").collect()) == list(range(20000))
    assert placed.groupBy("block").count().agg(F.max("count")).first()[0] == merkle.BLOCK
    dealt = spark.read.parquet(*placed.inputFiles()).groupBy("part").count().collect()
    assert len(dealt) == 8 and max(r["count"] for r in dealt) < 20000 / 4


# 13


def plain(text):
    data = "".join(c if not c.isascii() else c.lower() if c.isalpha() else " " for c in text)
    return re.sub(" +", " ", data).encode()


class Tree:
    """Partial matching, a byte at a time."""

    def __init__(self, texts):
        self.seen = defaultdict(Counter)
        for text in texts:
            data = b"    " + plain(text)
            for i in range(4, len(data)):
                for d in range(5):
                    self.seen[data[i - d : i]][data[i]] += 1

    def bits(self, text):
        data, total = b"    " + plain(text), 0.0
        for i in range(4, len(data)):
            for d in range(4, -2, -1):
                if d < 0:
                    total += 8
                    break
                found = self.seen.get(data[i - d : i])
                if not found:
                    continue
                n, q = sum(found.values()), len(found)
                if found[data[i]]:
                    total -= math.log2(found[data[i]] / (n + q))
                    break
                total -= math.log2(q / (n + q))
        return total


TRAIN = [
    ("en", "The cat sat on the mat, and the dog ran off."), ("en", "there is no time like the present"),
    ("de", "Die Katze saß auf der Matte und schlief."), ("de", "Über den Wölken ist die Freiheit grenzenlos"),
    ("ru", "Кошка сидела на ковре и спала"), ("xx", ""), ("xx", None), (None, "words without a language"),
]
TEXTS = ["the mat", "Der Hund", "", None, "123 -- !!", "кошка", "zzz  qqq", "A" * 3000, "ß", "the\n\n  cat" * 400, "漢字"]


@pytest.mark.parametrize("held", [1 << 21, 12])
def test_code_lengths_are_those_of_the_definition(spark, held, monkeypatch):
    monkeypatch.setattr(language_id, "HELD", held)
    model = language_id.fit_languages(spark.createDataFrame(TRAIN, "lang string, text string"))
    assert model.languages == ["de", "en", "ru", "xx"]
    got, size = model.bits(pa.array(TEXTS, pa.string()))
    for row, text in enumerate(TEXTS):
        assert size[row] == len(plain(text or ""))
        for column, lang in enumerate(model.languages):
            one = Tree([t for l, t in TRAIN if l == lang and t])
            assert got[row, column] == pytest.approx(one.bits(text or ""), rel=1e-5, abs=1e-4)


def test_predictions(spark):
    model = language_id.fit_languages(spark.createDataFrame(TRAIN, "lang string, text string"))
    rows = [(i, t, 0.5) for i, t in enumerate(TEXTS)] + [(None, "the cat", 1.0), (0, "the mat", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, score double")
    out = model.identify(docs)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"]
    by = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == len(rows)
    names = [by[i]["lang_pred"] for i in range(len(TEXTS))]
    assert names[:6] == ["en", "de", "und", "und", "und", "ru"]
    assert names[9] == "en" and names[10] != "und" and by[None]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in by.values()) and by[2]["score"] == 0
    assert by[None]["held_out"] is False
    assert model.identify(docs.limit(0)).count() == 0


def test_no_labels_and_too_many(spark, docs, monkeypatch):
    model = language_id.fit_languages(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in model.identify(docs).collect()} <= {"und"}
    monkeypatch.setattr(language_id, "LANGUAGES", 1)
    two = spark.createDataFrame(TRAIN, "lang string, text string")
    with pytest.raises(ValueError):
        language_id.fit_languages(two)


def test_a_pruned_tree_still_has_proper_chances(spark, small, monkeypatch):
    monkeypatch.setattr(language_id, "STRINGS", 300)
    model = language_id.fit_languages(small)
    assert all(len(level.codes) <= 4 * 300 for level in model.levels)
    for level, length in zip(model.levels, range(1, 6)):
        for context in level.contexts[:: max(1, len(level.contexts) // 20)]:
            cost = model.cost((int(context) << 8) + np.arange(256), length)
            assert (np.exp2(-cost.astype(float)).sum(axis=0) <= 1.001).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = language_id.identify_held_out(docs).withColumnRenamed("doc_id", "id")
    rows = out.join(docs, F.col("id") == F.col("doc_id")).select("doc_id", "held_out", "lang", "lang_pred").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    right = [r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]
    assert len(right) > 3000 and np.mean(right) > 0.995
    # Labels of held-out documents, sources and ids have no part in it.
    blind = docs.withColumn("lang", F.when(~language_id.held_out(F.col("doc_id")), F.col("lang")))
    blind = blind.withColumn("source", F.lit("s")).repartition(5)
    again = {r["doc_id"]: r["lang_pred"] for r in language_id.identify_held_out(blind).collect()}
    assert again == {r["doc_id"]: r["lang_pred"] for r in rows}
