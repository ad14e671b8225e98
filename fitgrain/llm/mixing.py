"""A mix of sources with given weights, by min-cost flow over membership patterns.

A document may belong to several sources. Documents with the same set of sources are one
pattern, and only the words of each pattern, in cells of a seeded order, are gathered.
Words flow from patterns to sources: the first copy of a pattern's words costs less than
the second, and so on, so that repeats are spread as evenly as the targets permit. The
flow says how many words each pattern gives; the seeded order says which documents.
"""

from __future__ import annotations

import json
from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fitgrain.llm.common import WORD, write_and_read

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
COPIES = 2
#: Cells of the seeded order, and cells within each; the cut between copies is made
#: exactly in one inner cell, which has one in ``CELLS ** 2`` of a pattern's documents.
CELLS = 4096
#: Bytes of driver-made rows, about, that are broadcast to join them; more are shuffled.
BROADCAST_BYTES = 64 << 20
#: Rows before and beyond the inner cell in which a pattern's extra words come to an end.
BEFORE = "(cell < outer_cut or cell = outer_cut and inner < inner_cut)"
BEYOND = "(cell > outer_cut or cell = outer_cut and inner > inner_cut)"


def targets(
    sizes: dict, weights: dict, total: float, copies: int = COPIES
) -> dict:
    """Words for each source: by weight, at most ``copies`` times what it has, the rest
    shared anew among the others until no source is above."""
    out, free, left = {}, {s for s in sizes if weights[s] > 0}, float(total)
    out = {s: 0.0 for s in sizes}
    while free:
        weight = sum(weights[s] for s in free)
        full = {s for s in free if left * weights[s] / weight > copies * sizes[s]}
        if not full:
            for s in free:
                out[s] = left * weights[s] / weight
            break
        for s in full:
            out[s] = float(copies * sizes[s])
        left -= sum(out[s] for s in full)
        free -= full
    return out


def min_cost_flow(
    supply: dict[tuple, int], quota: dict, copies: int
) -> dict[tuple, int]:
    """Words that each pattern (a tuple of sources) gives.

    Copy c of a pattern's words costs c, so each copy is sent as far as it can go before
    the next one: in rounds of blocking flow along shortest ways, which may move what
    another pattern gives to a source.
    """
    given = {p: 0 for p in sorted(supply, key=str)}
    members: dict = {s: [] for s in quota}
    for p in given:
        for s in p:
            members.setdefault(s, []).append(p)
    held: dict = {s: {} for s in members}
    need = {s: quota.get(s, 0) for s in members}
    for _ in range(copies):
        cap = {p: supply[p] for p in given}
        while _push(cap, members, held, need):
            pass
        for p, left in cap.items():
            given[p] += supply[p] - left
    return given


def _push(cap: dict, members: dict, held: dict, need: dict) -> bool:
    """Send words of ``cap`` along all ways that lead one step nearer to a source in need
    each time; whether any were sent. ``held[source][pattern]`` is what is given so far."""
    at_source = {s: 0 for s, words in need.items() if words > 0}
    at_pattern: dict = {}
    queue = deque(at_source)
    while queue:
        s = queue.popleft()
        for p in members[s]:
            if p in at_pattern:
                continue
            at_pattern[p] = at_source[s] + 1
            for t in p:
                # What the pattern gives to t can go to s instead.
                if t not in at_source and held[t].get(p, 0) > 0:
                    at_source[t] = at_pattern[p] + 1
                    queue.append(t)

    def nearer(path: list) -> list:
        """What can follow the end of a way: sources, or patterns that give to it."""
        end = path[-1]
        if len(path) % 2:
            return [s for s in end if at_source.get(s) == at_pattern[end] - 1]
        return [p for p, n in held[end].items() if n > 0 and at_pattern.get(p) == at_source[end] - 1]

    # For each end of a way what is left to try; the last one is tried first.
    left: tuple[dict, dict] = ({}, {})
    moved = False
    for start in cap:
        path = [start] if start in at_pattern else []
        while path and cap[start] > 0:
            end, odd = path[-1], len(path) % 2
            if not odd and need[end] > 0:
                givers, takers = path[0::2], path[1::2]
                freed = [held[s][p] for s, p in zip(takers, givers[1:])]
                amount = min(cap[start], need[end], *freed)
                for s, p in zip(takers, givers[1:]):
                    held[s][p] -= amount
                for p, s in zip(givers, takers):
                    held[s][p] = held[s].get(p, 0) + amount
                cap[start] -= amount
                need[end] -= amount
                moved, path = True, [start]
                continue
            tries = left[odd]
            if end not in tries:
                tries[end] = nearer(path)
            while not odd and tries[end] and held[end][tries[end][-1]] == 0:
                tries[end].pop()
            if tries[end]:
                path.append(tries[end][-1])
            else:
                path.pop()
                if path:
                    left[1 - odd][path[-1]].pop()
    return moved


def mix_sources(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    sources: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    copies: int = COPIES,
    seed: int = 11,
) -> DataFrame:
    """``id, size, source_size, target, taken`` of each document.

    ``sources`` is a string or an array of strings (a document of several sources). The
    sources in code-point order, null last, weigh ``weights`` in turn and together take
    ``share`` of all words; a source's target is at most ``copies`` times its words.
    ``taken`` is a multiple of ``size``, ``copies`` times at most, and each source's sum
    is within one document of its target as far as the flow can reach it: the seeded order
    goes as far as its documents fit, smaller ones beyond that fill what is left, and only
    if the next one were nearer to the target it is taken instead. A document of
    several sources counts for each in ``source_size``, of which the row has the sum, as
    it has of ``target``.

    Null texts have no words and are never taken. A null source, or an empty array, is a
    source of its own. Repeated rows are documents of their own; with equal ids they are
    taken together, up to the one cut of a pattern. A null id is ordered by its text. Other columns are not read. An
    empty table gives no rows.
    """
    found = _mixed(docs, id, text, sources, weights, share, copies, seed, [])
    return found.select(
        F.col("id").alias(id),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("times")).alias("taken"),
    )


def take_mix(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    sources: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    copies: int = COPIES,
    seed: int = 11,
) -> DataFrame:
    """The rows of ``docs``, all columns as they are, each as many times as the mix of
    ``mix_sources`` takes it. Rows without words are not taken. ``docs`` must give the
    same rows whenever it is read. An empty table gives no rows."""
    found = _mixed(docs, id, text, sources, weights, share, copies, seed, docs.columns)
    found = found.filter("size > 0 and times > 0")
    copy = F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy_")
    return found.select("carried", copy).select("carried.*")


def _mixed(
    docs: DataFrame,
    id: str,
    text: str,
    sources: str,
    weights: tuple[float, ...],
    share: float,
    copies: int,
    seed: int,
    carry: list[str],
) -> DataFrame:
    """``id, size, source_size, target, times``, and ``carried`` with columns of docs."""
    many = docs.schema[sources].dataType.typeName() == "array"
    label = F.col(sources) if many else F.array(F.col(sources).cast("string"))
    label = F.when(F.size(label) > 0, F.array_sort(F.array_distinct(label)))
    label = F.coalesce(label, F.array(F.lit(None).cast("string")))
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    named = F.coalesce(F.col(id).cast("string"), F.sha2(F.col(text).cast("string"), 256))
    columns = [
        F.col(id).alias("id"),
        F.to_json(label).alias("pattern"),
        size.alias("size"),
        F.xxhash64(F.lit(seed), named).alias("draw"),
    ]

    def with_cells(df: DataFrame) -> DataFrame:
        high = F.shiftrightunsigned("draw", 32)
        return df.withColumns(
            {"cell": F.pmod("draw", F.lit(CELLS)), "inner": F.pmod(high, F.lit(CELLS))}
        )

    rows = with_cells(write_and_read(docs.select(columns), "sizes"))
    cells = rows.groupBy("pattern", "cell").agg(F.sum("size").alias("size"))
    cells = write_and_read(cells, "cells")
    found = cells.groupBy("pattern").agg(F.sum("size").alias("size")).collect()
    patterns = {r["pattern"]: tuple(json.loads(r["pattern"])) for r in found}
    supply = {patterns[r["pattern"]]: r["size"] for r in found}
    names = sorted({s for p in supply for s in p}, key=lambda s: (s is None, s or ""))
    sizes = Counter({s: 0 for s in names})
    for p, n in supply.items():
        sizes.update({s: n for s in p})
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target = targets(sizes, weight, share * sum(supply.values()), copies)
    given = min_cost_flow(supply, {s: round(t) for s, t in target.items()}, copies)

    # Whole copies of a pattern, and words of one more that its first documents give.
    base = {k: given[p] // max(supply[p], 1) for k, p in patterns.items()}
    extra = {k: given[p] % max(supply[p], 1) for k, p in patterns.items()}
    spark = docs.sparkSession
    outer = _cuts(cells, extra)
    within = {k: extra[k] - before for k, (_, before) in outer.items()}
    chosen = _local(spark, [(k, c) for k, (c, _) in outer.items()], "pattern string, cell long")
    edge = write_and_read(rows.join(chosen, ["pattern", "cell"]), "edge")
    inner = edge.groupBy("pattern", "inner").agg(F.sum("size").alias("size"))
    inner = _cuts(inner.withColumnRenamed("inner", "cell"), within)
    place = _local(
        spark,
        [(k, outer[k][0], c, within[k] - before) for k, (c, before) in inner.items()],
        "pattern string, outer_cut long, inner_cut long, left long",
    )
    last = _last_draws(edge, place)
    fill, gaps = _fill(rows, {k: (outer[k][0], inner[k][0]) for k in inner}, last)
    plan = []
    for key, p in patterns.items():
        cut = (-1, -1, None, {})
        if key in last:
            draw, more = last[key].draw, fill.get(key, {})
            if gaps.get(key) and gaps[key] > last[key].over:
                draw, more = last[key].after, {}
            cut = (outer[key][0], inner[key][0], draw, more)
        plan.append(
            (key, base[key], *cut, sum(sizes[s] for s in p), float(sum(target[s] for s in p)))
        )
    plan = _local(
        spark,
        plan,
        "pattern string, base long, outer_cut long, inner_cut long, last_draw long, "
        "fill map<long,long>, source_size long, target double",
    )
    if carry:
        rows = with_cells(docs.select(*columns, F.struct(*carry).alias("carried")))
    at_cut = "cell = outer_cut and inner = inner_cut and draw <= last_draw"
    one = F.expr(f"{BEFORE} or {at_cut} or {BEYOND} and draw <= try_element_at(fill, size)")
    return rows.join(plan, "pattern").select(
        "id",
        "size",
        "source_size",
        "target",
        (F.col("base") + F.coalesce(one, F.lit(False)).cast("long")).alias("times"),
        *(["carried"] if carry else []),
    )


def _local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of rows from the driver. Its size is counted here, as Spark can't know it and
    would shuffle all documents by pattern to join a few rows."""
    entries = sum(len(x) for r in rows for x in r if isinstance(x, dict))
    many = 48 * entries + sum(128 + 4 * len(r[0]) for r in rows)
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if many <= BROADCAST_BYTES else table


def _cuts(cells: DataFrame, extra: dict[str, int]) -> dict[str, tuple[int, int]]:
    """The cell of each pattern in which its extra words come to an end, and the words of
    the cells before; no cell where there are none."""
    wanted = _local(cells.sparkSession, list(extra.items()), "pattern string, extra long")
    by = Window.partitionBy("pattern").orderBy("cell")
    ends = cells.withColumn("end", F.sum("size").over(by)).join(wanted, "pattern")
    cut = ends.filter("end >= extra and end - size < extra")
    return {r["pattern"]: (r["cell"], r["end"] - r["size"]) for r in cut.collect()}


def _last_draws(edge: DataFrame, place: DataFrame) -> dict:
    """For each pattern the last draw of the inner cell that fits into ``left`` words
    (``draw``, null if none does), what is left then (``left``), the next draw (``after``)
    and by how much it would be too large (``over``)."""
    rows = edge.join(place, "pattern").filter("inner = inner_cut")
    # Rows of one draw have one id, or one text; they are taken together.
    draws = rows.groupBy("pattern", "draw", "left").agg(F.sum("size").alias("size"))
    ends = draws.withColumn("end", F.sum("size").over(Window.partitionBy("pattern").orderBy("draw")))
    fits = F.col("end") <= F.col("left")
    found = ends.groupBy("pattern", "left").agg(
        F.max(F.when(fits, F.col("draw"))).alias("draw"),
        F.coalesce(F.max(F.when(fits, F.col("end"))), F.lit(0)).alias("taken"),
        F.min(F.when(~fits, F.struct("end", "draw"))).alias("next"),
    )
    found = found.select(
        "pattern",
        "draw",
        (F.col("left") - F.col("taken")).alias("left"),
        F.col("next.draw").alias("after"),
        (F.col("next.end") - F.col("left")).alias("over"),
    )
    return {r["pattern"]: r for r in found.collect()}


def _fill(rows: DataFrame, cuts: dict, last: dict) -> tuple[dict, dict]:
    """Documents beyond the cut that fit into the words left: for each pattern a map from
    size to the last draw taken, and the words left then.

    Sizes are taken from the largest that fits downwards, so their sum is at most the words
    left and there are few of them: their number's square is at most twice those words.
    """
    left = {k: r["left"] for k, r in last.items() if r["left"] > 0 and r["over"] is not None}
    if not left:
        return {}, {}
    spark = rows.sparkSession
    gaps = _local(
        spark,
        [(k, *cuts[k], gap) for k, gap in left.items()],
        "pattern string, outer_cut long, inner_cut long, gap long",
    )
    free = rows.join(gaps, "pattern").filter(f"{BEYOND} and size > 0 and size <= gap")

    def greedy(batches):
        # Sizes come from the largest down, so all that a task holds is what is left.
        pattern, gap = None, 0
        for batch in batches:
            out = []
            for key, most, size, n in zip(*(column.to_pylist() for column in batch.columns)):
                if key != pattern:
                    pattern, gap = key, most
                taken = min(n, gap // size)
                if taken:
                    out.append({"pattern": key, "size": size, "wanted": taken})
                    gap -= taken * size
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("pattern", pa.string()), ("size", pa.int64()), ("wanted", pa.int64())])
    counts = free.groupBy("pattern", "gap", "size").agg(F.count(F.lit(1)).alias("n"))
    dealt = counts.repartition("pattern").sortWithinPartitions("pattern", F.desc("size"))
    wanted = dealt.select("pattern", "gap", "size", "n").mapInArrow(
        greedy, "pattern string, size long, wanted long"
    )
    wanted = [tuple(r) for r in wanted.collect()]
    if not wanted:
        return {}, left
    most = max(n for _, _, n in wanted)
    chosen = _local(spark, wanted, "pattern string, size long, wanted long")
    draws = free.join(chosen, ["pattern", "size"]).groupBy("pattern", "size", "wanted", "draw")
    by = Window.partitionBy("pattern", "size").orderBy("draw")
    ends = (
        draws.agg(F.count(F.lit(1)).alias("n"))
        .withColumn("nth", F.row_number().over(by))
        .filter(F.col("nth") <= most)
        .withColumn("end", F.sum("n").over(by))
        .filter("end <= wanted")
        .groupBy("pattern", "size")
        .agg(F.max("draw").alias("draw"), F.max("end").alias("n"))
    )
    fill: dict = {}
    for r in ends.collect():
        fill.setdefault(r["pattern"], {})[r["size"]] = r["draw"]
        left[r["pattern"]] -= r["size"] * r["n"]
    return fill, left
