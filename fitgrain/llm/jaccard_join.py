"""Documents whose sets of word n-grams are alike: a size-aware heavy-light join.

Sets of at most ``boundary`` elements are light: such a set lists every subset of the
size that any partner must share with it, and partners meet under an equal subset.
Larger sets are heavy: they meet in inverted lists of single shingles. A set enters the
lists of only so many of its rarest shingles that no partner can miss all of them, and
a pair is a candidate only if the places of the shingle in both sets leave enough room
for the rest. The boundary is where the two kinds of list cost the least together, by
the histogram of set sizes.

Equal sets are one node. The lists of a group of near copies are as long as the group,
so pairs are not written out: each node is first compared with the node of its lists
that is in the most lists, what links is merged, and only nodes that share a list and
are still apart are compared in pairs. The components are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitgrain.llm.common import (
    CELLS,
    WORD,
    Words,
    array_sum,
    gram_counts,
    mixed,
    release,
    slices,
    write_and_read,
)
from fitgrain.llm.components import components, cut

#: Sizes that may be light, and what a heavy list entry costs against a light one.
MOST_LIGHT = 40
HEAVY_COST = 16.0
FILTER_BITS = 1 << 24


def overlap(a: int, b: int, num: int, den: int) -> int:
    """The least intersection of linked sets of sizes a and b."""
    return -(-num * (a + b) // (den + num))


def light_sizes(n: int, boundary: int, num: int, den: int) -> list[int]:
    """Subset sizes that a set of n elements lists: one for each smaller partner size."""
    least = -(-num * n // den)
    return sorted(
        {overlap(a, a, num, den) for a in range(max(1, least), min(n, boundary) + 1)}
    )


def prefix(n: int, num: int, den: int) -> int:
    """Shingles of a set of n of which any partner holds one."""
    return n - -(-num * n // den) + 1


def choose_boundary(counts: dict[int, int], num: int, den: int) -> int:
    """The largest light size with the least list entries, a heavy one counting more."""
    best, at = None, 0
    for boundary in range(MOST_LIGHT + 1):
        cost = 0.0
        for n, count in counts.items():
            light = sum(math.comb(n, c) for c in light_sizes(n, boundary, num, den))
            heavy = prefix(n, num, den) * HEAVY_COST if n > boundary else 0
            cost += count * (light + heavy)
        if best is None or cost < best:
            best, at = cost, boundary
    return at


def shingle_sets(
    batch: pa.RecordBatch, k: int
) -> Iterator[tuple[int, np.ndarray]]:
    """The sorted set of each row's shingle hashes, with the row's number."""
    text = batch["text"]
    found = Words(text, lower=True)
    gram, at = found.grams(k)
    ends = np.searchsorted(at, found.first)
    sizes = np.diff(found.first)
    for row in range(batch.num_rows):
        n = sizes[row]
        if n >= k:
            each = np.sort(gram[ends[row] : ends[row + 1]])
            fresh = np.empty(len(each), np.bool_)
            fresh[0] = True
            np.not_equal(each[1:], each[:-1], out=fresh[1:])
            yield row, each[fresh]
        elif n:
            i = found.first[row]
            whole = np.full(1, n, np.uint64)
            for j in range(n):
                whole = mixed(whole * np.uint64(0x9E3779B97F4A7C15) + found.hash[i + j])
            yield row, whole
        else:
            yield row, np.zeros(0, np.uint64)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def node_of(members: np.ndarray, seed: int) -> int:
    return _signed(xxhash.xxh3_64_intdigest(members.tobytes(), seed))


def parities(members: np.ndarray) -> bytes:
    """A bit for each cell of hashes: whether an odd number of the set is in it.

    At least as many bits as elements, a power of two. Bits in which two sets differ are
    no more than the elements in which they differ.
    """
    size = 64
    while size < len(members):
        size *= 2
    odd = np.bincount((members >> np.uint64(20)).astype(np.int64) & (size - 1), minlength=size)
    return np.packbits(odd.astype(np.uint8) & 1).tobytes()


def unlike_bits(x: bytes, y: bytes) -> int:
    """Differing bits, the longer of the two folded to the length of the other."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        # Cells of the same low bits: the halves of the longer one.
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.unpackbits(a ^ b).sum())


def _nodes(docs: DataFrame, k: int, seed: int) -> DataFrame:
    """``id, key, node, check, n, bits`` of each document; node is null for an empty set."""

    def find(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                node, check, size, bits = [], [], [], []
                for _, members in shingle_sets(batch, k):
                    size.append(len(members))
                    bits.append(parities(members) if len(members) else None)
                    node.append(node_of(members, seed) if len(members) else None)
                    check.append(node_of(members, ~seed & 0xFFFF) if len(members) else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["id"],
                        batch["key"],
                        pa.array(node, pa.int64()),
                        pa.array(check, pa.int64()),
                        pa.array(size, pa.int64()),
                        pa.array(bits, pa.binary()),
                    ],
                    names=["id", "key", "node", "check", "n", "bits"],
                )
        release()

    return docs.mapInArrow(find, "id long, key long, node long, check long, n long, bits binary")


def _entries(
    docs: DataFrame, k: int, seed: int, boundary: int, counts: np.ndarray, num: int, den: int
) -> DataFrame:
    """List entries ``sig, node, n, place``; place is -1 in a light list."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def heavy(members: np.ndarray) -> np.ndarray:
        rank = shared.value[(members & np.uint64(CELLS - 1)).astype(np.int64)]
        most = prefix(len(members), num, den)
        order = np.lexsort((members, rank))[:most]
        return members[order]

    def light(members: np.ndarray) -> list[np.ndarray]:
        n, out = len(members), []
        total = np.add.reduce(mixed(members))
        for c in light_sizes(n, boundary, num, den):
            gone = n - c
            drop = mixed(members)
            sums = (
                np.zeros(1, np.uint64)
                if not gone
                else np.array([np.add.reduce(x) for x in combinations(drop, gone)], np.uint64)
            )
            out.append(mixed((total - sums) ^ np.uint64(c << 40)))
        return out

    def find(batches):
        seen = set()
        for whole in batches:
            for batch in slices(whole, "text"):
                sigs, lengths, nodes, sizes, places = [], [], [], [], []
                for _, members in shingle_sets(batch, k):
                    n = len(members)
                    if not n:
                        continue
                    node = node_of(members, seed)
                    if node in seen:
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(node)
                    # Sizes just above the boundary may have light partners too.
                    found = light(members) if -(-num * n // den) <= boundary else []
                    at = [np.full(len(x), -1) for x in found]
                    if n > boundary:
                        found.append(heavy(members))
                        at.append(np.arange(len(found[-1])))
                    sigs += found
                    places += at
                    lengths.append(sum(map(len, found)))
                    nodes.append(node)
                    sizes.append(n)
                if not nodes:
                    continue
                repeat = np.array(lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(sigs).view(np.int64)),
                        pa.array(np.repeat(np.array(nodes, np.int64), repeat)),
                        pa.array(np.repeat(np.array(sizes, np.int32), repeat), pa.int32()),
                        pa.array(np.concatenate(places).astype(np.int32), pa.int32()),
                    ],
                    names=["sig", "node", "n", "place"],
                )
        seen.clear()
        release()

    return docs.mapInArrow(find, "sig long, node long, n int, place int")


def _may_link(n: Column, i: Column, m: Column, j: Column, num: int, den: int) -> Column:
    """Whether sizes, and places in a shared list, leave room for a link."""
    need = (n + m) * num
    return (F.least(n, m) * den >= F.greatest(n, m) * num) & (
        F.least(n - F.greatest(i, F.lit(0)), m - F.greatest(j, F.lit(0))) * (den + num) >= need
    )


def _sets_of(docs: DataFrame, classes: DataFrame, active: DataFrame, k: int, seed: int) -> DataFrame:
    """``node, members`` of the active nodes, from one row of each.

    A filter of fixed size drops most other rows before they are shuffled; the join
    after it is exact, and a full filter only lets more through.
    """
    wanted = classes.join(active, "node").select("key", "node")

    def place(values: np.ndarray) -> np.ndarray:
        return (mixed(values.view(np.uint64)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)

    def kernel(batch):
        hit = np.zeros(FILTER_BITS, np.uint8)
        hit[place(batch["key"].to_numpy(zero_copy_only=False))] = 1
        return np.packbits(hit)

    bits = array_sum(wanted.select("key"), kernel, FILTER_BITS // 8, np.uint8, np.bitwise_or)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def find(batches):
        bits = shared.value
        for whole in batches:
            at = place(np.ascontiguousarray(whole["key"].to_numpy(zero_copy_only=False)))
            keep = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
            whole = whole.filter(pa.array(keep.astype(np.bool_)))
            for batch in slices(whole, "text"):
                sets = [m for _, m in shingle_sets(batch, k)]
                nodes = [node_of(m, seed) if len(m) else None for m in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["key"],
                        pa.array(nodes, pa.int64()),
                        pa.array([m.tobytes() for m in sets], pa.binary()),
                    ],
                    names=["key", "node", "members"],
                )
        release()

    found = docs.mapInArrow(find, "key long, node long, members binary")
    # Rows may share a key by chance or because they are equal: the node is that of the
    # set, and one row of it is enough.
    found = wanted.join(found, ["key", "node"])
    return found.groupBy("node").agg(F.first("members").alias("members"))


def _near(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``a, b`` whose parity bits leave a link possible."""
    left = classes.select(F.col("node").alias("a"), F.col("n").alias("n"), F.col("bits").alias("x"))
    right = classes.select(
        F.col("node").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y")
    )

    @F.arrow_udf("long")
    def unlike(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(map(unlike_bits, x.to_pylist(), y.to_pylist()), pa.int64())

    total = F.col("n") + F.col("m")
    most = total + 2 * F.floor(-(total * num) / (den + num))
    both = pairs.join(left, "a").join(right, "b")
    return cut(both.filter(unlike("x", "y") <= most).select("a", "b"))


def _verified(
    pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, seed: int, num: int, den: int
) -> DataFrame:
    """The pairs ``a, b`` that link. Parity bits, an eighth of a byte for each element,
    rule out nearly all others; the sets of the rest travel to the pairs."""
    pairs = _near(pairs, classes, num, den)
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = write_and_read(_sets_of(docs, classes, cut(nodes), k, seed), "members")
    left = sets.select(F.col("node").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("y"))

    @F.arrow_udf("boolean")
    def linked(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for p, q in zip(x, y):
            p = np.frombuffer(p.as_buffer(), np.uint64)
            q = np.frombuffer(q.as_buffer(), np.uint64)
            at = np.searchsorted(q, p)
            at[at == len(q)] = 0
            shared = int(np.count_nonzero(q[at] == p))
            out.append(den * shared >= num * (len(p) + len(q) - shared))
        return pa.array(out, pa.bool_())

    both = pairs.join(left, "a").join(right, "b")
    return cut(both.filter(linked("x", "y")).select("a", "b"))


def jaccard_components(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    k: int = 5,
    num: int = 4,
    den: int = 5,
) -> DataFrame:
    """``id, n_shingles, component_id`` of every document.

    Two documents link when ``den * intersection >= num * union`` of their sets of k-word
    shingles (A-Z lower-cased; a shorter text is one shingle of all its words).
    ``component_id`` is the smallest id that links reach. Null and empty texts, and texts
    without words, have no shingles and stay alone. A null id is in its component but
    never names it, and a component of null ids alone has none. Repeated rows are equal
    sets. Other columns are not read. An empty table gives no rows.
    """
    nodes, classes, roots = _components(docs, id, text, k, num, den)
    named = classes.join(roots, "node").groupBy("root").agg(F.min("id").alias("component_id"))
    named = roots.join(named, "root").select("node", "component_id")
    named = classes.select("node", "id").join(named, "node", "left")
    named = named.select("node", F.coalesce("component_id", "id").alias("component_id"))
    out = nodes.join(named, "node", "left")
    return out.select(
        F.col("id").alias(id),
        F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("id"))
        .otherwise(F.col("component_id"))
        .alias("component_id"),
    )


def row_key(id: Column, text: Column) -> Column:
    """A number that rows share if their id and text agree, null or not."""
    return F.xxhash64(id.cast("long"), text.cast("string"))


def _components(
    docs: DataFrame, id: str, text: str, k: int, num: int, den: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The node of each row, the nodes, and the root of each node that has a link."""
    docs = docs.select(
        F.col(id).cast("long").alias("id"),
        F.col(text).cast("string").alias("text"),
        row_key(F.col(id), F.col(text)).alias("key"),
    )
    for seed in range(100):
        nodes = write_and_read(_nodes(docs, k, seed), "sets")
        classes = nodes.filter("node is not null").groupBy("node")
        classes = classes.agg(
            F.min("id").alias("id"),
            F.min("key").alias("key"),
            F.min("check").alias("low"),
            F.max("check").alias("high"),
            F.first("n").alias("n"),
            F.first("bits").alias("bits"),
        )
        # Another seed if two different sets have one hash.
        if classes.filter("low <> high").isEmpty():
            break
    sizes = nodes.filter(F.col("n").between(1, 2 * MOST_LIGHT)).groupBy("n").count().collect()
    boundary = choose_boundary({r["n"]: r["count"] for r in sizes}, num, den)
    counts = gram_counts(docs, "text", k, lower=True)
    entries = _entries(docs, k, seed, boundary, counts, num, den)

    lists = entries.groupBy("sig").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    lists = lists.filter("low <> high").select("sig")
    active = write_and_read(entries.join(lists, "sig").distinct(), "lists")
    score = active.groupBy("node").agg(F.count("*").alias("score"))
    members = active.join(score, "node")
    top = F.max(F.struct("score", "node", "n", "place")).alias("top")

    # First, each node against the node of its lists that is in most lists.
    heads = members.groupBy("sig").agg(top)
    pairs = members.join(heads, "sig").filter(F.col("node") != F.col("top.node"))
    pairs = pairs.filter(
        _may_link(F.col("n"), F.col("place"), F.col("top.n"), F.col("top.place"), num, den)
    )
    pairs = pairs.groupBy("node").agg(F.max(F.struct("top.score", "top.node")).alias("best"))
    pairs = cut(
        pairs.select(
            F.least("node", "best.node").alias("a"), F.greatest("node", "best.node").alias("b")
        ).distinct()
    )
    links = _verified(pairs, docs, classes, k, seed, num, den)
    roots = components(links)

    # Then whatever shares a list and is not yet together.
    placed = active.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = placed.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    placed = cut(placed.join(apart.filter("low <> high").select("sig"), "sig"))
    x, y = placed.alias("x"), placed.alias("y")
    rest = x.join(
        y,
        (F.col("x.sig") == F.col("y.sig"))
        & (F.col("x.node") < F.col("y.node"))
        & (F.col("x.root") != F.col("y.root"))
        & _may_link(F.col("x.n"), F.col("x.place"), F.col("y.n"), F.col("y.place"), num, den),
    )
    rest = rest.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    rest = rest.join(pairs, ["a", "b"], "left_anti")
    more = _verified(rest, docs, classes, k, seed, num, den)
    return nodes, classes, components(links.union(more))


def one_of_each(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    k: int = 5,
    num: int = 4,
    den: int = 5,
) -> DataFrame:
    """One row of each component: that with the smallest id, null last.

    Of rows that have that id the one with the least hash of id and text stays, and of rows that
    agree in both the least one by all columns. Rows without shingles all stay, repeated
    ones too. All columns are as they are.
    """
    nodes, _, roots = _components(docs, id, text, k, num, den)
    # Copies are one row before they meet the roots, so no large group is joined.
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    of_node = nodes.filter("node is not null").groupBy("node").agg(F.min(rank).alias("first"))
    placed = of_node.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = placed.groupBy("root").agg(F.min("first").alias("first"))
    # Names that no column has.
    key, row = (f"{name}_" + "_".join(docs.columns) for name in ("key", "row"))
    has_words = F.coalesce(F.col(text).cast("string").rlike(WORD), F.lit(False))
    keyed = docs.withColumn(key, row_key(F.col(id), F.col(text)))
    rest = keyed.filter(has_words).join(kept.select(F.col("first.key").alias(key)), key, "left_semi")
    rest = rest.groupBy(key, id, text).agg(F.min(F.struct(*docs.columns)).alias(row)).select(f"{row}.*")
    return rest.unionByName(docs.filter(~has_words)).select(docs.columns)
