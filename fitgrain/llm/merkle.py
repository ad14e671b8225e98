"""A Merkle manifest of a dataset: digests of rows, roots, proofs, and their check.

Each row is a leaf. The leaves of one tree (a language) are ordered and numbered, and 8
neighbours become one node until one is left. Leaves are worked on by superblocks of 4,096,
four levels of a tree. Going up, a superblock is reduced to its node, and these nodes are
the leaves of the next layer, until each tree is a single superblock. Going down, every
superblock is cogrouped with the nodes that its proofs need from outside it: one group
call reduces the superblock again, joins the inner part of each proof to the outer one,
and folds it. Only digests travel, never texts, and no group exceeds a superblock.

The trees' roots are the leaves of one more tree, which is worked on in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitgrain.llm.common import shuffle_parts, write_and_read

#: Children of a node, levels that a superblock has, and leaves that makes.
FAN = 8
LEVELS = 4
BLOCK = FAN**LEVELS

STEPS = "lefts array<string>, rights array<string>"


def digest(*inputs: Column) -> Column:
    """Lowercase hexadecimal sha256 of the inputs, one after the other."""
    return F.sha2(F.concat(*(x.cast("binary") for x in inputs)), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of bytes, a colon and the value as text."""
    value = value.cast("string")
    size = F.octet_length(value).cast("string")
    return F.coalesce(F.concat(size, F.lit(":"), value), F.lit("-"))


def combine(nodes: list[str]) -> list[str]:
    """One level up."""
    return [
        sha256("".join(nodes[i : i + FAN]).encode()).hexdigest()
        for i in range(0, len(nodes), FAN)
    ]


def reduce_levels(nodes: list[str], total: int) -> list[list[str]]:
    """The levels of a superblock whose tree has ``total`` nodes in this layer: all four,
    or up to the root where the tree is in one superblock."""
    levels = [nodes]
    while len(levels) <= LEVELS if total > BLOCK else len(levels[-1]) > 1:
        levels.append(combine(levels[-1]))
    return levels


def inner_steps(levels: list[list[str]], place: int) -> tuple[list[str], list[str]]:
    """What is left and right of a node in its run, level by level up to the top."""
    lefts, rights = [], []
    for nodes in levels[:-1]:
        start = place - place % FAN
        lefts.append("".join(nodes[start:place]))
        rights.append("".join(nodes[place + 1 : start + FAN]))
        place //= FAN
    return lefts, rights


def fold(leaf: str, lefts: list[str], rights: list[str]) -> str:
    """The root that a leaf has with the siblings of a proof."""
    for left, right in zip(lefts, rights):
        leaf = sha256(f"{left}{leaf}{right}".encode()).hexdigest()
    return leaf


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """The rows with ``place``, their number in their ``tree``, and ``total``, its size.

    Rows are dealt by ranges of (tree, order), so a tree that holds most of them is spread.
    Equal rows are split among ranges by a number of their own; which of them has which
    place makes no difference. ``nodes`` has to be a written table.
    """
    spark = nodes.sparkSession
    own = F.monotonically_increasing_id()
    dealt = nodes.withColumn("own", own).repartitionByRange(
        shuffle_parts(spark), "tree", *order, "own"
    )
    dealt = dealt.sortWithinPartitions("tree", *order, "own").drop("own")
    schema = nodes.select("*").schema.add("part", "integer").add("nth", "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tree, nth = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for one in batch["tree"].to_pylist():
                nth = nth + 1 if one == tree else 0
                tree = one
                places.append(nth)
            columns = [*batch.columns, pa.repeat(pa.scalar(part, pa.int32()), len(places))]
            columns.append(pa.array(places, pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    # Written, so that parts and numbers are fixed before they are counted.
    found = write_and_read(dealt.mapInArrow(count, schema), "merkle-order")
    sizes = found.groupBy("tree", "part").agg(F.count("*").alias("rows"))
    of_tree = Window.partitionBy("tree")
    before = of_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "tree",
        "part",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"),
        F.sum("rows").over(of_tree).alias("total"),
    )
    placed = found.join(starts, ["tree", "part"])
    return placed.withColumn("place", F.col("start") + F.col("nth")).drop("part", "nth", "start")


def with_block(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("place") / BLOCK).cast("long"))


def layers_of(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The layers from ``tree, place, total, node`` upwards, and ``tree, top`` of each tree."""

    def reduce(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place", ignore_index=True)
        tree, block, total = (group[name][0] for name in ("tree", "block", "total"))
        top = reduce_levels(group["node"].tolist(), total)[-1][0]
        blocks = -(-int(total) // BLOCK)
        return pd.DataFrame({"tree": [tree], "place": [block], "total": [blocks], "node": [top]})

    schema = "tree string, place long, total long, node string"
    layers = [with_block(nodes)]
    while True:
        below = layers[-1].select("tree", "block", "place", "total", "node")
        above = below.groupBy("tree", "block").applyInPandas(reduce, schema)
        above = write_and_read(above, "merkle-layer")
        if (above.agg(F.max("total")).first()[0] or 0) <= 1:
            return layers, above.select("tree", F.col("node").alias("top"))
        layers.append(with_block(above))


def down_one(layer: DataFrame, outer: DataFrame, own: list[str], kernel, schema) -> DataFrame:
    """Cogroup a layer's nodes with their outer nodes; ``own`` are the columns of the nodes
    that ``kernel`` needs. It gets nodes in order, their levels, and the outer row."""

    def one(nodes: pd.DataFrame, out: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("place", ignore_index=True)
        levels = reduce_levels(nodes["node"].tolist(), nodes["total"].iloc[0])
        return kernel(nodes, levels, out.iloc[0])

    left = layer.select("tree", "block", "place", "total", "node", *own).groupBy("tree", "block")
    return left.cogroup(outer.groupBy("tree", "block")).applyInPandas(one, schema)


def descend(layers: list[DataFrame], outer: DataFrame, keep: list[str]) -> DataFrame:
    """The outer nodes of the lowest layer's superblocks, from those of the top one's."""

    def kernel(nodes: pd.DataFrame, levels: list[list[str]], above: pd.Series) -> pd.DataFrame:
        steps = [inner_steps(levels, place) for place in range(len(nodes))]
        got = pd.DataFrame({"tree": nodes["tree"], "block": nodes["place"]})
        got["lefts"] = [left + list(above["lefts"]) for left, _ in steps]
        got["rights"] = [right + list(above["rights"]) for _, right in steps]
        for name in keep:
            got[name] = above[name]
        return got

    schema = f"tree string, block long, {STEPS}" + "".join(f", {name} string" for name in keep)
    for layer in reversed(layers[1:]):
        outer = down_one(layer, outer, [], kernel, schema)
    return outer


def _of_trees(nodes: pd.DataFrame, levels: list[list[str]], above: pd.Series) -> pd.DataFrame:
    """Each tree's outer nodes: the proof of its top among the trees."""
    steps = [inner_steps(levels, place) for place in range(len(nodes))]
    return pd.DataFrame(
        {
            "tree": nodes["name"],
            "block": 0,
            "lefts": [left + list(above["lefts"]) for left, _ in steps],
            "rights": [right + list(above["rights"]) for _, right in steps],
            "subroot": nodes["node"],
            "root": above["root"],
        }
    )


def _of_leaves(nodes: pd.DataFrame, levels: list[list[str]], above: pd.Series) -> pd.DataFrame:
    """Each leaf's whole proof, its digest, and the root that the claimed leaf folds to."""
    outer_lefts, outer_rights = list(above["lefts"]), list(above["rights"])
    outer = "".join(left + right for left, right in zip(outer_lefts, outer_rights))
    rows = []
    for place, claimed in enumerate(nodes["claimed"]):
        lefts, rights = inner_steps(levels, place)
        siblings = "".join(left + right for left, right in zip(lefts, rights)) + outer
        lefts, rights = lefts + outer_lefts, rights + outer_rights
        rows.append((sha256(siblings.encode()).hexdigest(), fold(claimed, lefts, rights), lefts, rights))
    out = nodes[["id", "node"]].copy()
    out["subroot"], out["root"] = above["subroot"], above["root"]
    for i, name in enumerate(("proof_sha256", "folded_root", "lefts", "rights")):
        out[name] = [row[i] for row in rows]
    return out


def manifest(leaves: DataFrame) -> DataFrame:
    """The proofs of ``tree, id, node, claimed``, and whether they hold.

    ``tree`` names the row's tree (a string, not null), ``node`` is the row's digest, and
    ``claimed`` the digest to check, ``node`` itself where nothing has changed. Returns
    ``id, node``, ``subroot`` (of its tree), ``root``, ``proof_sha256`` of all siblings
    from the leaf up, ``folded_root`` of ``claimed`` with those siblings, ``verified``,
    and ``lefts`` and ``rights``, the siblings on either side at each level.

    Trees are ordered by name and leaves by id, null first. Rows with one id are ordered by
    ``node`` and ``claimed``, and repeated rows are leaves of their own. Other columns are
    not read. An empty table gives no rows.
    """
    kind = leaves.schema["id"].dataType
    leaves = write_and_read(leaves.select("tree", "id", "node", "claimed"), "merkle-leaves")
    leaves = numbered(leaves, ["id", "node", "claimed"])
    # As text, since pandas has no integers that may be null.
    leaves = leaves.withColumn("id", F.col("id").cast("string"))
    layers, tops = layers_of(leaves)

    trees = tops.select(
        F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("top").alias("node")
    )
    trees = numbered(write_and_read(trees, "merkle-tops"), ["name"])
    upper, root = layers_of(trees)
    none = F.array().cast("array<string>")
    outer = root.select(
        "tree",
        F.lit(0).cast("long").alias("block"),
        none.alias("lefts"),
        none.alias("rights"),
        F.col("top").alias("root"),
    )
    schema = f"tree string, block long, {STEPS}, subroot string, root string"
    outer = down_one(upper[0], descend(upper, outer, ["root"]), ["name"], _of_trees, schema)
    outer = descend(layers, outer, ["subroot", "root"])
    schema = f"id string, node string, subroot string, root string, proof_sha256 string, folded_root string, {STEPS}"
    proved = down_one(layers[0], outer, ["id", "claimed"], _of_leaves, schema)
    return proved.select(
        F.col("id").cast(kind).alias("id"),
        "node",
        "subroot",
        "root",
        "proof_sha256",
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
        "lefts",
        "rights",
    )


def document_leaves(docs: DataFrame, claimed_text: Column | None = None) -> DataFrame:
    """``tree, id, node, claimed`` of documents; ``claimed_text`` is the text to check.

    A leaf is the digest of doc_id, source, lang, n_chars and text. The tree of a null
    language is before all others.
    """
    head = [encoded(F.col(name)) for name in ("doc_id", "source", "lang", "n_chars")]
    node = digest(*head, encoded(F.col("text")))
    claimed = node if claimed_text is None else digest(*head, encoded(claimed_text))
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    return docs.select(
        tree.alias("tree"), F.col("doc_id").alias("id"), node.alias("node"), claimed.alias("claimed")
    )


def tampered_text() -> Column:
    """The text with A to Z in lower case in a third of the rows, chosen by id; else as
    it is."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(chosen, F.translate("text", upper, upper.lower())).otherwise(F.col("text"))


def document_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of documents, of which a third is tampered with before the check."""
    out = manifest(document_leaves(docs, tampered_text())).drop("lefts", "rights")
    return out.withColumnsRenamed({"id": "doc_id", "node": "leaf"})


def _levels_sql(name: str, levels: int) -> list[str]:
    """Tables of a tree's levels: ``{name}_path0`` and ``{name}_nodes0`` go in, the paths
    of its leaves and its tops are ``{name}_path`` and ``{name}_nodes`` of the last one."""
    run = "PARTITION BY tree, place // 8 ORDER BY place ROWS BETWEEN"
    out = []
    for k in range(levels):
        out += [
            f"""{name}_side{k} AS MATERIALIZED (
    SELECT tree, place, node, count(*) OVER (PARTITION BY tree) AS total,
        coalesce(string_agg(node, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
        coalesce(string_agg(node, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM {name}_nodes{k}
)""",
            f"""{name}_nodes{k + 1} AS MATERIALIZED (
    SELECT tree, place // 8 AS place, CASE WHEN any_value(total) = 1 THEN any_value(node)
        ELSE sha256(string_agg(node, '' ORDER BY place)) END AS node
    FROM {name}_side{k} GROUP BY tree, place // 8
)""",
            f"""{name}_path{k + 1} AS MATERIALIZED (
    SELECT p.* REPLACE (
        p.place // 8 AS place,
        p.proof || s.l || s.r AS proof,
        CASE WHEN s.total = 1 THEN p.folded ELSE sha256(s.l || p.folded || s.r) END AS folded
    ) FROM {name}_path{k} p JOIN {name}_side{k} s ON p.tree = s.tree AND p.place = s.place
)""",
        ]
    return out


def manifest_sql(levels: int = 8, tree_levels: int = 3) -> str:
    """``document_manifest`` for DuckDB, for up to 8 ** ``levels`` documents a language and
    8 ** ``tree_levels`` languages."""

    def leaf(text: str) -> str:
        parts = (
            f"coalesce(CAST(strlen(CAST({x} AS VARCHAR)) AS VARCHAR) || ':' || CAST({x} AS VARCHAR), '-')"
            for x in ("doc_id", "source", "lang", "n_chars", text)
        )
        return f"sha256({' || '.join(parts)})"

    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    # A byte, then eight steps of one bit each (-1).
    crc = """xor(list_reduce(
        list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
            lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END
    ), 4294967295)"""
    ctes = [
        f"""chosen AS (
    SELECT *, coalesce('=' || lang, '') AS tree,
        CASE WHEN {crc} % 3 = 0 THEN translate("text", '{upper}', '{upper.lower()}') ELSE "text" END AS other
    FROM documents
)""",
        f"""leaves AS (SELECT doc_id, tree, {leaf('"text"')} AS leaf, {leaf('other')} AS claimed FROM chosen)""",
        """leaf_path0 AS MATERIALIZED (
    SELECT doc_id, tree, leaf, claimed AS folded, '' AS proof,
        row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, claimed) - 1 AS place
    FROM leaves
)""",
        "leaf_nodes0 AS (SELECT tree, place, leaf AS node FROM leaf_path0)",
        *_levels_sql("leaf", levels),
        f"""tree_nodes0 AS MATERIALIZED (
    SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS place, node, tree AS name
    FROM leaf_nodes{levels}
)""",
        f"""tree_path0 AS (
    SELECT p.doc_id, p.leaf, p.folded, p.proof, '' AS tree, t.place, t.node AS subroot
    FROM leaf_path{levels} p JOIN tree_nodes0 t ON p.tree = t.name
)""",
        *_levels_sql("tree", tree_levels),
    ]
    return f"""WITH {", ".join(ctes)}
SELECT p.doc_id, p.leaf, p.subroot, t.node AS root, sha256(p.proof) AS proof_sha256,
    p.folded AS folded_root, p.folded = t.node AS verified
FROM tree_path{tree_levels} p JOIN tree_nodes{tree_levels} t ON p.tree = t.tree"""
