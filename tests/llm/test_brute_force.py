"""Operators against plain Python over whole tables, corner cases and empty tables."""

import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict
from random import Random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fitgrain.llm import (
    chat_format,
    fingerprints,
    jaccard_join,
    license_scan,
    mixing,
    packing,
    quality_rules,
    substring_dedup,
    token_counts,
    tokens,
    toxicity,
)

WORD = re.compile("[^\x20\x09-\x0d]+")
TABLES = ("corner", "small", "empty")


def words(text):
    return WORD.findall(text or "")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(params=TABLES)
def docs(request):
    return request.getfixturevalue(request.param)


# 1


def test_substring_dedup(docs):
    rows = [(i if i is not None else 1 << 62, words(t)) for i, t in rows_of(docs)]
    first = {}
    for i, w in rows:
        for j in range(len(w) - 12):
            key = tuple(w[j : j + 13])
            first[key] = min(first.get(key, i), i)
    expected = []
    for i, w in rows:
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < i:
                gone[j : j + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        expected.append((i, len(w), sum(gone), kept))
    out = substring_dedup.dedup_substrings(docs, keep_space=False)
    got = [
        (r["doc_id"] if r["doc_id"] is not None else 1 << 62, r["n_words"], r["n_removed"], r["text"])
        for r in out.collect()
    ]
    assert sorted(got) == sorted(expected)
    spaced = substring_dedup.dedup_substrings(docs)
    assert sorted(" ".join(words(r["text"])) for r in spaced.collect()) == sorted(
        x[3] for x in expected
    )


def test_substring_dedup_keeps_the_space_and_the_columns(corner):
    out = substring_dedup.dedup_substrings(corner)
    assert out.columns == [*corner.columns, "n_words", "n_removed"]
    clean = {r["text"] for r in out.filter("n_removed = 0 and text is not null").collect()}
    assert clean <= {t or "" for _, t in rows_of(corner)}


def test_substring_dedup_over_many_chunks(spark):
    shared = " ".join(f"p{i}" for i in range(60))
    rows = [(i * 700, f"own{i} start{i} {shared} end{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    out = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(docs).collect()}
    assert out[0]["n_removed"] == 0
    assert all(out[i * 700]["text"] == f"own{i} start{i} end{i}" for i in range(1, 40))


def test_substring_rows_do_not_depend_on_the_order_of_files(spark, monkeypatch):
    """Ordered or hashed, a task sends one row for a bucket, however many chunks there are."""
    for name in ("BUCKET_BYTES", "CHUNK_BYTES"):
        monkeypatch.setattr(substring_dedup, name, 50_000)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    made = []
    for table in (docs.repartitionByRange(8, "doc_id"), docs.repartition(8, F.xxhash64("doc_id"))):
        slim = table.select(F.col("doc_id").alias("id"), "text", (F.col("doc_id") % 48).alias("chunk"))
        counts = substring_dedup.gram_counts(slim, "text", 3)
        made.append(substring_dedup._sent(slim, counts, 13, 3, 48).count())
    assert max(made) <= 8 * 48 and max(made) < 1.2 * min(made)
    whole = {r["doc_id"]: r["text"] for r in substring_dedup.dedup_substrings(docs).collect()}
    monkeypatch.setattr(substring_dedup, "HELD_BYTES", 200_000)
    pieces = substring_dedup.dedup_substrings(docs.repartition(5, F.xxhash64("doc_id")))
    assert {r["doc_id"]: r["text"] for r in pieces.collect()} == whole


# 2


def repeated(w):
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(windows)
    return len({i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(3)})


def test_quality_base(docs):
    def base(text):
        w, text = words(text), text or ""
        lines = [x for x in text.split("\n") if words(x)]
        n, r = len(w), repeated(w)
        symbols = sum(c in "#*$%&|<>" for c in text)
        failed = n < 50 or 100 * r > 50 * n
        return n, sum(map(len, w)), symbols, len(lines) - len(set(lines)), r, failed

    expected = sorted((str(i), *base(t)) for i, t in rows_of(docs))
    out = quality_rules.quality_cascade(docs).collect()
    assert sorted((str(r[0]), *r[1:7]) for r in out) == expected
    assert all(not r["kept"] for r in out if r["base_failed"])


def test_the_order_of_rules_changes_no_verdict(small):
    rules = quality_rules.default_rules()
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_cascade(small).collect()}
    base = quality_rules.with_base(small)
    fails = F.lit(False)
    for rule in rules:
        fails = fails | F.coalesce(rule.rejects, F.lit(False))
    plain = base.select("doc_id", (~F.col("base_failed") & ~fails).alias("kept"))
    assert got == {r["doc_id"]: r["kept"] for r in plain.collect()}
    assert 0.5 < sum(got.values()) / len(got) < 1
    order = quality_rules.estimate(small.select("doc_id", "text"), rules)
    assert sorted(x[0] for x in order) == sorted(r.name for r in rules)


def test_long_prose_and_vowel_signs_are_kept(spark):
    rng = np.random.default_rng(3)
    spelt = str.maketrans("0123456789", "abcdefghij")
    prose = " ".join(f"w{i}x".translate(spelt) for i in rng.integers(0, 1200, 40000))
    hindi = " ".join(f"कि{a}ी{b}ु" for a in "कखगघचछजझ" for b in "टठडढणतथद")
    tiny = " ".join(f"word{'abcdefghij'[i % 10]}x" for i in rng.integers(0, 10, 1000))
    texts = [prose, hindi, tiny]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = {r["doc_id"]: r for r in quality_rules.quality_cascade(docs).collect()}
    assert (out[0]["kept"], out[1]["kept"]) == (True, True)
    few = quality_rules.default_rules()[-1].rejects
    rows = quality_rules.with_base(docs).select("doc_id", few.alias("few")).collect()
    assert {r["doc_id"]: r["few"] for r in rows} == {0: False, 1: False, 2: True}


# 3


def test_packing(docs):
    tokenizer = Tokenizer.from_file(tokens.default_path())
    expected = []
    for i, t in rows_of(docs):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            crc = zlib.crc32(np.array(ids[a:b], "<u4").tobytes())
            expected.append((str(i), p, a, b - a, crc))
    out = packing.pack_documents(docs).collect()
    assert sorted((str(r[0]), *r[1:5]) for r in out) == sorted(expected)
    by = defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in out)
    assert len(by) <= -(-total // 1024) * 1.02 + 1


def test_plan_fills_exactly_and_uses_every_piece_once():
    counts = {1000: 5, 24: 3, 12: 4, 600: 2, 300: 2, 124: 2, 700: 1, 1024: 7}
    patterns = packing.plan(counts)
    used = Counter()
    for lengths, times in patterns:
        assert sum(lengths) <= 1024
        for x in lengths:
            used[x] += times
    assert used == counts
    assert sum(times for lengths, times in patterns if sum(lengths) == 1024) >= 13
    assert packing.plan({}) == []
    assert packing.plan({512: 3}) == [([512, 512], 1), ([512], 1)]


def test_packed_ids(corner):
    rows = packing.pack_documents(corner, with_ids=True).collect()
    assert all(len(r["ids"]) == r["length"] for r in rows)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)


# 4


def test_edited_texts(docs):
    rows = sorted(rows_of(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    expected = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        t, after = t or "", after or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        expected.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest()))
    out = fingerprints.edit_and_compare(docs).collect()
    assert sorted((str(r[0]), r[1], r[2]) for r in out) == sorted(expected)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    if len(out) > 100:
        assert np.mean([r["near_edited"] - r["near_next"] for r in out]) > 0.15


def test_syncmers_are_those_of_the_definition(spark):
    text = "the cat sat on the mat and the dog ran off to the sea " * 3
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    h = df.select(fingerprints.word_hashes(F.col("text"))).first()[0]
    for k, s in ((4, 1), (5, 2)):
        inner = h
        if s == 2:
            both = spark.createDataFrame([(h,)], "h array<long>")
            inner = both.select(fingerprints._runs(F.col("h"), 2)).first()[0]
        expected = []
        for i in range(len(h) - k + 1):
            window = inner[i : i + k - s + 1]
            if min(window) in (window[0], window[-1]):
                expected.append(i)
        got = df.select(fingerprints.syncmers(fingerprints.word_hashes(F.col("text")), k, s))
        assert [a["pos"] for a in got.first()[0]] == expected


def test_only_empty_texts_have_no_anchor(spark):
    texts = [" ".join(f"s{i}n{n}w{j}" for j in range(n)) for n in range(7) for i in range(40 if n else 1)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = fingerprints.fingerprint_documents(docs).collect()
    assert [texts[r["doc_id"]] for r in found if not r["anchors"]] == [""]
    assert len({r["fingerprint"] for r in found}) == len(texts)
    near = fingerprints.edit_and_compare(docs).select("near_next").collect()
    assert all(r["near_next"] == 0 for r in near)


def test_all_anchors_of_long_texts_count(spark):
    body = [f"t{i}" for i in range(20000)]
    changed = body[:9000] + [f"u{i}" for i in range(100)] + body[9100:]
    longer = body[:5000] + ["one", "more"] + body[5000:]
    passage = [f"p{i}" for i in range(3000)] + body[700:900] + [f"q{i}" for i in range(3000)]
    twice, thrice = (["some", "words", "again", "now"] * n for n in (200, 300))
    shuffled = [w for i in range(0, 400, 4) for w in body[396 - i : 400 - i]]
    texts = [body, body, changed, longer, passage, twice, thrice, body[:400], shuffled]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    out = fingerprints.edit_and_compare(spark.createDataFrame(rows, "doc_id int, text string"))
    out = {r["doc_id"]: r for r in out.collect()}
    near = [out[i]["near_next"] for i in range(len(texts))]
    assert out[0]["fingerprint"] == out[1]["fingerprint"] != out[2]["fingerprint"]
    assert near[0] == 1
    assert 0.98 < near[1] < 1
    assert 0.98 < near[2] < 1
    assert 0.003 < near[3] < 0.02
    assert near[4] == near[6] == 0
    assert abs(near[5] - 2 / 3) < 0.01
    # Runs of 4 words, each moved on its own, have no consistent shift.
    assert near[7] < 0.02
    anchors = fingerprints.fingerprint_documents(spark.createDataFrame(rows, "doc_id int, text string"))
    for r in anchors.collect():
        parts = re.findall("(.{8})(.)", r["fingerprint"])
        assert [int(g, 16) for _, g in parts] == list(np.diff([0] + [a["pos"] for a in r["anchors"]]))
        assert [int(h, 16) for h, _ in parts] == [a["hash"] & 0xFFFFFFFF for a in r["anchors"]]


def test_equal_texts_have_equal_fingerprints_and_shifts_are_found(spark, corner):
    out = defaultdict(set)
    for r in fingerprints.fingerprint_documents(corner.filter("doc_id < 100")).collect():
        out[dict(rows_of(corner))[r["doc_id"]] or ""].add(r["fingerprint"])
    assert all(len(x) == 1 for x in out.values())
    body = " ".join(f"t{i}" for i in range(80))
    df = spark.createDataFrame([(f"a b c {body}", body)], "x string, y string")
    anchors = [fingerprints.syncmers(fingerprints.word_hashes(F.col(c))) for c in "xy"]
    assert df.select(fingerprints.shift(*anchors)).first()[0] == 3


# 5


def test_mixing(docs):
    out = mixing.mix_sources(docs).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(i) for i, _ in rows_of(docs))
    source = {str(r["doc_id"]): r["source"] for r in docs.collect()}
    sizes, taken, largest, target = Counter(), Counter(), Counter(), {}
    for r in out:
        s = source[str(r["doc_id"])]
        assert r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
        target[s] = r["target"]
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, expected = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        full = {s for s in free if left * weight[s] / total > 2 * sizes[s]}
        if not full:
            expected |= {s: left * weight[s] / total for s in free}
            break
        expected |= {s: 2 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        free -= full
    for s in names:
        assert target[s] == pytest.approx(expected[s])
        assert abs(taken[s] - expected[s]) <= largest[s]
    assert all(r["source_size"] == sizes[source[str(r["doc_id"])]] for r in out)


def test_the_mix_is_taken_row_by_row(corner):
    want, got = Counter(), Counter()
    for r in mixing.mix_sources(corner).collect():
        want[r["doc_id"]] += r["taken"]
    taken = mixing.take_mix(corner)
    assert taken.columns == corner.columns
    for r in taken.collect():
        got[r["doc_id"]] += len(words(r["text"]))
    assert +got == +want
    # A share of everything twice takes rows without an id too.
    whole = Counter(str(r["text"]) for r in mixing.take_mix(corner, share=2.0).collect())
    texts = Counter(str(t) for _, t in rows_of(corner) if words(t))
    assert whole == Counter({t: 2 * n for t, n in texts.items()})


@pytest.mark.parametrize("cells", [1, 2])
def test_cells_only_divide_the_work(corner, monkeypatch, cells):
    want = mixing.mix_sources(corner)
    monkeypatch.setattr(mixing, "CELLS", cells)
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    got = mixing.mix_sources(corner)
    per = {}
    for name, rows in (("want", want), ("got", got)):
        for r in rows.collect():
            at = per.setdefault((name, r["target"]), [0, 0])
            at[0] += r["taken"]
            at[1] = max(at[1], r["size"])
            assert r["taken"] <= 2 * r["size"]
    for (_, target), (total, largest) in per.items():
        assert abs(total - target) <= largest + 1
    assert got.columns == want.columns


def test_mixing_of_overlapping_sources(spark):
    rows = [(i, "w " * 10, [["a"], ["a", "b"], ["b"], ["c"]][i % 4]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    out = mixing.mix_sources(docs, weights=(1.0, 3.0, 1.0), share=1.0).collect()
    by = Counter()
    for r in out:
        by[r["doc_id"] % 4] += r["taken"]
    # 4,000 words: 800, 2,400 and 800 for a, b and c; b needs all it shares with a.
    assert by[0] + by[1] + by[2] == pytest.approx(3200, abs=30)
    assert by[3] == pytest.approx(800, abs=10)


def test_smaller_documents_fill_what_is_left(spark):
    sizes = [900, 233, 700, 41, 40, 3, 2, 1, 1, 1, 800, 1000]
    for extra in range(1, sum(sizes), 397):
        rows = [(i, "w " * n, "a") for i, n in enumerate(sizes)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
        out = mixing.mix_sources(docs, share=extra / sum(sizes)).collect()
        got = sum(r["taken"] for r in out)
        assert all(r["taken"] in (0, r["size"]) for r in out)
        # What is free and fits into the words left was taken, or one document was nearer.
        smallest = min([r["size"] for r in out if not r["taken"]], default=0)
        assert abs(got - extra) <= 1000
        assert got > extra or extra - got < smallest or smallest == 0


def test_flow_over_many_sources():
    supply = {(f"s{i}",): 10 + i % 7 for i in range(20_000)}
    supply |= {(f"s{i}", f"s{i + 1}"): 5 for i in range(0, 19_999)}
    quota = {f"s{i}": 12 + i % 5 for i in range(20_000)}
    given = mixing.min_cost_flow(supply, quota, 2)
    assert sum(given.values()) == sum(quota.values())
    assert all(0 <= given[p] <= 2 * supply[p] for p in supply)


@pytest.mark.parametrize("seed", range(30))
def test_flow_costs_least(seed):
    random = Random(seed)
    names = "abcd"
    supply = {
        tuple(sorted(random.sample(names, random.randint(1, 3)))): random.randint(0, 4)
        for _ in range(4)
    }
    quota = {s: random.randint(0, 6) for s in names}
    given = mixing.min_cost_flow(supply, quota, 2)

    def reached(amounts):
        """The most words that the amounts of patterns bring to sources, by augmenting."""
        units = [p for p, n in amounts.items() for _ in range(n)]
        slots = [s for s in names for _ in range(quota[s])]
        match = {}

        def assign(u, seen):
            for k, s in enumerate(slots):
                if s in units[u] and k not in seen:
                    seen.add(k)
                    if k not in match or assign(match[k], seen):
                        match[k] = u
                        return True
            return False

        return sum(assign(u, set()) for u in range(len(units)))

    assert reached(given) == sum(given.values())
    twice = {p: 2 * n for p, n in supply.items()}
    # All that can flow does, and as much as can of it is a first copy.
    assert sum(given.values()) == reached(twice)
    assert sum(min(given[p], supply[p]) for p in supply) == reached(supply)


def test_flow_moves_what_it_gave():
    supply = {("a",): 10, ("a", "b"): 10, ("b", "c"): 10}
    given = mixing.min_cost_flow(supply, {"a": 15, "b": 10, "c": 5}, 1)
    assert given == {("a",): 10, ("a", "b"): 10, ("b", "c"): 10}
    given = mixing.min_cost_flow({("a",): 10}, {"a": 15}, 2)
    assert given == {("a",): 15}


# 6


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("k, num, den", [(3, 9, 10), (5, 4, 5), (1, 1, 2)])
def test_jaccard_components(docs, k, num, den):
    rows = rows_of(docs)
    sets = []
    for _, t in rows:
        w = words(low(t))
        grams = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
        sets.append(grams if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]) and sets[a]:
                root[find(a)] = find(b)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[find(x)] = min(least.get(find(x), i), i)
    expected = sorted(
        (str(i), len(sets[x]), str(least.get(find(x)))) for x, (i, _) in enumerate(rows)
    )
    out = jaccard_join.jaccard_components(docs, k=k, num=num, den=den).collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in out) == expected


def test_small_sets_meet_by_their_subsets(spark):
    rows = [(i, " ".join(f"g{i}w{j}" for j in range(19))) for i in range(0, 300, 2)]
    rows += [(i + 1, t.rsplit(" ", 1)[0] + " z" * (i % 4)) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = jaccard_join.jaccard_components(docs, k=1, num=9, den=10).collect()
    assert all(r["component_id"] == r["doc_id"] - r["doc_id"] % 2 for r in out)
    assert jaccard_join.choose_boundary({19: 300}, 9, 10) >= 19
    assert jaccard_join.choose_boundary({2000: 300}, 9, 10) == 0


def test_one_of_each(corner):
    kept = jaccard_join.one_of_each(corner)
    assert kept.columns == corner.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    # 6 repeats 5 and 8, 9 and 10 are like 7, as is a row with a null id; the repeated rows
    # of 7 are one document. The null id without words stays.
    assert not ids.keys() & {6, 8, 9, 10}
    assert {5, 7, 11}.issubset(ids) and max(ids.values()) == 1 and ids[None] == 1


A, B, C = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
NEAR_A = A.replace("a59", "z")


@pytest.mark.parametrize(
    "rows, expected",
    [
        ([(1, A), (5, A), (5, C)], [(1, A), (5, C)]),
        ([(5, A), (5, A), (6, C)], [(5, A), (6, C)]),
        ([(None, A), (None, NEAR_A), (None, B), (None, B)], None),
        ([(None, A), (4, NEAR_A), (4, B), (4, ""), (4, "")], [(4, ""), (4, ""), (4, NEAR_A), (4, B)]),
        ([(3, A), (3, NEAR_A), (2, B), (None, B), (3, C)], None),
    ],
)
def test_no_document_is_lost(spark, rows, expected):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, jaccard_join.one_of_each(docs).collect()), key=str)
    if expected is not None:
        assert got == sorted(expected, key=str)
    # One text of each group stays, whichever ids its rows have.
    group = {A: "a", NEAR_A: "a", B: "b", C: "c"}
    assert sorted(group[t] for _, t in got if t) == sorted({group[t] for _, t in rows if t})


def test_near_copies_with_null_and_repeated_ids_link(spark):
    rows = [(None, A), (9, NEAR_A), (9, B), (7, C), (None, C + " more"), (7, A + " " + C), (None, "x y z w v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1))
    out = sorted(map(tuple, jaccard_join.jaccard_components(docs).collect()), key=str)
    expected = [(None, 56, 9), (9, 56, 9), (9, 56, 9), (7, 56, 7), (None, 57, 7), (7, 116, 7), (None, 1, None)]
    assert out == sorted(expected, key=str)


# 7


def test_license_scan(docs):
    listed = [
        (name, set(license_scan.bigrams(license_scan.normal_words(b))))
        for name, bodies in license_scan.TEMPLATES.items()
        for b in bodies
    ]

    def best(text):
        blocks = re.split(r"\n[ \t\r]*\n", text or "")
        parts = (text or "").split("\n") + [b for b in blocks if "\n" in b]
        parts += [text] * (len(blocks) > 1)
        found = []
        for part in parts:
            g = set(license_scan.bigrams(license_scan.normal_words(part)))
            dice = [(-2 * len(g & t) / (len(g) + len(t)), name) for name, t in listed]
            if -min(dice)[0] >= 0.8:
                found.append(min(dice))
        if not found:
            return None, 0.0, 0
        return min(found)[1], -min(found)[0], len(found)

    expected = sorted((str(i), str(a), round(b, 9), c) for i, t in rows_of(docs) for a, b, c in [best(t)])
    out = license_scan.scan_licenses(docs).collect()
    assert sorted((str(r[0]), str(r[1]), round(r[2], 9), r[3]) for r in out) == expected


def test_near_statements_match(spark):
    text = "Hello.\nLicensed under the APACHE license, version 2.0!\n\nReleased under a licence."
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    row = license_scan.scan_licenses(docs).first()
    # The line, and the paragraph that is little more than the line.
    assert (row["license"], row["dice"], row["n_matches"]) == ("Apache-2.0", 1.0, 2)


def test_statements_inside_longer_segments_match(spark):
    filler = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    short = "Licensed under CC BY-NC 4.0."
    mit = license_scan.TEMPLATES["MIT"][2].split()
    comment = "\n".join(f" * {' '.join(mit[i : i + 9])}" for i in range(0, len(mit), 9))
    code = "\n".join(f"int x{i} = {i};" for i in range(90))
    apart = "// My tool\n//\n// Licensed under the Apache License,\n// Version 2.0.\n//\n" + code
    expected = {
        f"{filler} {short}": ("CC-BY-NC-4.0", 1),
        "This code is Copyright X. Licensed under the Apache License, Version 2.0.": ("Apache-2.0", 1),
        f"{code}\n{comment}\n{code}": ("MIT", 1),
        apart: ("Apache-2.0", 1),
        # On a line of its own, then twice inside a line.
        f"{short}\n{filler} {short} {filler} {short}": ("CC-BY-NC-4.0", 3),
        # A segment of 9 bigrams has a coefficient of 0.8 exactly.
        f"one two three {short}": ("CC-BY-NC-4.0", 1),
        f"{filler} licensed under cc {filler} nc 4.0": (None, 0),
    }
    docs = spark.createDataFrame(list(enumerate(expected)), "doc_id int, text string")
    out = {r["doc_id"]: r for r in license_scan.scan_licenses(docs).collect()}
    found = {t: (out[i]["license"], out[i]["n_matches"]) for i, t in enumerate(expected)}
    assert found == expected
    assert out[0]["dice"] == 1.0
    assert out[0]["matched"][0]["segment"] == short[:-1]


# 8


def test_ordinal_regression_recovers_grades():
    rng = np.random.default_rng(5)
    texts, grades = [], []
    for _ in range(600):
        bad = int(rng.integers(0, 4))
        own = [f"n{rng.integers(0, 50)}" for _ in range(20)]
        terms = ["vile", "foul", "rude"]
        texts.append(" ".join([f"w{x}" for x in own] + terms[:bad]))
        grades.append(min(bad, 2))
    model = toxicity.fit_ordinal(texts, grades)
    severity, chance = model.severity(["plain text", "vile", "vile foul", "vile foul rude"])
    assert chance[0] < 0.2 < 0.8 < chance[1]
    assert severity[1] < severity[2] <= severity[3]
    assert np.all(np.diff(model.thresholds) >= 0)


def test_toxicity_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    train = labels.filter("doc_id % 3 <> 0")
    model = toxicity.fit_toxicity(docs, train)
    held = model.score(docs).join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    right = np.mean([r["is_toxic"] == (r["toxic"] == 1) for r in held])
    false = np.mean([r["is_toxic"] for r in held if r["toxic"] == 0])
    caught = np.mean([r["is_toxic"] for r in held if r["toxic"] == 1])
    assert right > 0.97 and caught > 0.8 and false < 0.01
    again = toxicity.fit_toxicity(docs.repartition(3), train)
    assert np.array_equal(model.weights, again.weights)


def test_toxicity_corner_cases(docs, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    some = spark.createDataFrame([(1, None, 1), (None, 1, 1), (7, 0, None)], none.schema)
    for labels in (none, some):
        model = toxicity.fit_toxicity(docs, labels)
        out = model.score(docs).collect()
        assert sorted(str(r[0]) for r in out) == sorted(str(i) for i, _ in rows_of(docs))
        assert not any(r["is_toxic"] for r in out)
        assert model.keep_clean(docs).count() == docs.count()


# 9


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|end|><|turn|>x<|text|>", "\\l\\\\b\\", "", None, "é\n😀<"]
    rows = [(c, t, ["user", "assistant", "a<b", None][t % 4], x) for c in (1, 2, None)
            for t, x in enumerate(nasty)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    df = df.withColumn("turns", F.lit(1)).repartition(4)
    chats = chat_format.format_chats(chat_format.canonical_turns(df))
    out = chats.withColumn("back", chat_format.read_turns(F.col("formatted")))
    rows = out.collect()
    assert len(rows) == 3
    for r in rows:
        assert r["back"] == r["turns"]
        assert [t["text"] for t in r["turns"]] == [x or "" for x in nasty]
        assert "[INST]" not in r["formatted"] and "</s>" not in r["formatted"]
    got = chat_format.digests(chats, "conv_id").collect()
    loss = "".join(x or "" for t, x in enumerate(nasty) if t % 4 == 1)
    lines = "".join(f"{['user', 'assistant', 'a<b', ''][t % 4]}\n{x or ''}\n" for t, x in enumerate(nasty))
    for r in got:
        assert r["loss_chars"] == len(loss)
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["turns_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
    assert chat_format.canonical_turns(df.limit(0)).count() == 0


def test_layouts(spark):
    records = [
        (1, '{"messages":[{"role":"user","content":"hi"},{"content":"yo","role":"assistant"}]}'),
        (2, '{"conversations":[{"from":"human","value":"hi"},{"from":"gpt","value":"yo"}]}'),
        (3, '{"prompt":"hi","completion":"yo"}'),
        (4, '{"instruction":"hi","input":"","output":"yo"}'),
        (5, '{"other":1}'),
        (6, "not json"),
        (7, None),
    ]
    records += [
        (8, '{"id":3,"messages":[{"role":"user","content":"hi","name":"x"},{"role":"gpt","content":null}]}'),
        (9, '{"messages":[],"source":"s"}'),
        (10, '{"prompt":"hi","response":"yo","question":"a","answer":"b"}'),
        (11, '{"prompt":"hi","system":"be kind","response":"yo","n":[1,{"a":2}]}'),
        (12, '{"prompt":"hi"}'),
    ]
    df = spark.createDataFrame(records, "id int, record string")
    out = {r["id"]: r["turns"] for r in chat_format.canonical_json(df, "record", "id").collect()}
    for i in (1, 2, 3):
        assert [tuple(t) for t in out[i]] == [("user", "hi"), ("assistant", "yo")]
    assert [tuple(t) for t in out[4]] == [("system", "hi"), ("assistant", "yo")]
    assert out[5] is out[6] is out[7] is out[12] is None
    assert [tuple(t) for t in out[8]] == [("user", "hi"), ("assistant", "")]
    assert out[9] == [] and [tuple(t) for t in out[10]] == [("user", "hi"), ("assistant", "yo")]
    assert [t["role"] for t in out[11]] == ["system", "user", "assistant"]
    with pytest.raises(ValueError):
        chat_format.canonical_turns(df, "id")
    typed = spark.createDataFrame([(1, "hi", "yo", 5)], "id int, prompt string, response string, n int")
    row = chat_format.canonical_turns(typed, "id").first()
    assert [tuple(t) for t in row["turns"]] == [("user", "hi"), ("assistant", "yo")]


def test_a_conversation_of_20000_turns(spark):
    """Its work is far from quadratic, and its ranges are exact."""
    text = F.concat(F.lit("é<[\\ "), F.col("id").cast("string"), F.repeat(F.lit("w "), 20))
    df = spark.range(20000).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"), text.alias("text"),
        F.when(F.col("id") % 2 == 1, "assistant").otherwise("user").alias("role"),
    )
    begin = time.monotonic()
    chats = chat_format.format_chats(chat_format.canonical_turns(df).withColumn("marked_", F.lit(1)))
    row = chat_format.digests(chats, "conv_id").first()
    assert time.monotonic() - begin < 30
    loss = "".join(f"é<[\\ {i}" + "w " * 20 for i in range(1, 20000, 2))
    assert (row["n_turns"], row["loss_chars"]) == (20000, len(loss))
    assert row["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    got = chats.first()
    for s in got["loss"][::501]:
        assert got["formatted"][: s["start"]].endswith("assistant<|text|>")
        assert got["formatted"][s["start"] + s["length"] :].startswith("<|end|>")


# 10


def test_counts_after_edits(docs):
    encode = tokens.encoder(tokens.default_path(), plain=True)
    counted = token_counts.build_counts(docs.select("doc_id", "text"))
    half = "cast(length(text) / 2 as int)"
    steps = ["3, 3, '  in \\n'", f"{half}, {half} + 40, ''", "0, 2, \"can't \""]
    steps += ["100000, 100000, ' end  '", "20, 21, repeat('much 12 ', 300)"]
    named = ("named_struct('start', {}, 'stop', {}, 'text', {})".format(*x.split(", ", 2)) for x in steps)
    edits = F.expr(f"array({', '.join(named)}, null)")
    out = token_counts.apply_edits(counted.withColumn("edits", edits.cast(token_counts.EDITS)))
    for r in out.collect():
        assert r["n_tokens"] == len(encode.ids(r["text"])) // 4
        assert sum(r["chars"][len(r["chars"]) // 2 :]) == len(r["text"])
    for r in counted.collect():
        assert r["n_tokens"] == len(encode.ids(r["text"] or "")) // 4


def test_only_the_edited_region_is_encoded():
    encode = tokens.encoder(tokens.default_path(), plain=True)
    text = " ".join(f"word{i}" for i in range(20000))
    tree = token_counts.build(encode, text)
    rng = np.random.default_rng(3)
    for _ in range(60):
        at = int(rng.integers(0, len(text)))
        new = [" ", "  ", "\n", "x", "'s", " 12 ", "😀"][int(rng.integers(0, 7))]
        tree, text, n = token_counts.edit(encode, tree, text, at, at + int(rng.integers(0, 9)), new)
        assert tree.total == len(encode.ids(text)) // 4
    tree = token_counts.build(encode, text.replace("😀", ""))
    _, _, n = token_counts.edit(encode, tree, text.replace("😀", ""), 5000, 5003, "abc")
    assert n < 2000


def test_ids_are_those_of_the_tokenizer():
    plain = Tokenizer.from_file(tokens.default_path())
    encode = tokens.encoder(tokens.default_path())
    for text in ("it's  a\n\n test_1 ²½ x\x1cy", "don't <|endoftext|> \t\xa0 é", "漢字 ǅ"):
        ids = plain.encode(text, add_special_tokens=False).ids
        assert encode.ids(text) == np.array(ids, "<u4").tobytes()
