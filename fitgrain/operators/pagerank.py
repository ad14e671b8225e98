"""Graphs as edge tables, and PageRank to a tolerance."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitgrain.operators.rank_blocks import block_ranks, named_block_ranks
from fitgrain.session import settings, shared_folder

RESET = 0.15
LINKS_PER_PARTITION, MOST_LINKS_PER_PARTITION = 200_000, 20_000_000
#: Links that a partition may hold before there are more partitions than cores, and links
#: whose sums one task of a superstep combines, at most about.
FULL_LINKS, COMBINED_LINKS = 10_000_000, 100_000_000
#: Links that one list holds, about.
LIST_LINKS = 1_000_000
STEPS_SMALL, STEPS_LARGE = 4, 2
#: From so many links on, or about so many edges by the size of what they are read from,
#: links are packed into blocks of numbers. An edge is taken for so many bytes.
PACKED_LINKS, EDGE_BYTES = 3_000_000, 16
#: Spark takes a table of unknown size for larger than this.
UNKNOWN_BYTES = 1 << 60
_WHOLE = ("tinyint", "smallint", "int", "bigint")


def vertices(edges: DataFrame) -> DataFrame:
    """Every id that is an end of an edge."""
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def out_degrees(edges: DataFrame) -> DataFrame:
    """``id, degree`` of every vertex with an outgoing edge; parallel edges count."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def pagerank(edges: DataFrame, tolerance: float = 0.0001) -> DataFrame:
    """Ranks ``id, rank`` of ``edges(src, dst)``, summing to the number of vertices.

    Edges with a null end are left out. Rank and last change start at 0.15. In each superstep a vertex whose last change
    exceeds the tolerance sends 0.85 of it, shared over its outgoing edges; what
    arrives is the receiver's next change and is added to its rank. The loop ends when
    nothing is sent, and ranks are then scaled to a mean of 1.

    Plan: parallel edges collapse to a count once. Links are partitioned by source, put
    into lists, sorted and persisted, with one list per vertex that only links it to itself
    and carries its rank over. The state is left partitioned by id after every superstep, so
    joining it to the lists moves nothing and a superstep costs one shuffle, of sums that
    were combined map-side. Lists of sources that send nothing are dropped whole, so a late
    superstep looks at sources, not at links. A receiver gets one row from each sending task
    at most, so there are only half as many of these as the cluster has cores, if the links
    permit, and each takes several partitions. Sources with more links than a partition
    should hold are spread over several slices, and their state row is copied to each.
    """
    spark = edges.sparkSession
    shared_folder(spark)
    edges = edges.dropna(subset=["src", "dst"])
    whole = all(edges.select(end).dtypes[0][1] in _WHOLE for end in ("src", "dst"))
    likely = _likely_edges(edges) if whole else 0
    if likely >= PACKED_LINKS:
        ones = edges.select("src", "dst", F.lit(1).alias("copies"))
        return _scaled(block_ranks(ones, likely, tolerance, RESET), edges)
    counted = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("copies")).persist()
    persisted = [counted]
    try:
        links = counted.count()
        if links >= PACKED_LINKS:
            if whole:
                return _scaled(block_ranks(counted, links, tolerance, RESET), edges)
            ends = _initial_state(counted, links).select("src")
            return _scaled(named_block_ranks(counted, ends, links, tolerance, RESET), edges)
        parts = _partitions(links, int(spark.conf.get("spark.sql.shuffle.partitions")))
        cores = spark.sparkContext.defaultParallelism
        parts = min(parts, max(2, cores, ceil(links / FULL_LINKS)))
        tasks = _tasks(links, parts, cores)
        # Adaptive plans hide how cached and checkpointed tables lie; the loop depends on it.
        with settings(
            spark, spark__sql__shuffle__partitions=parts, spark__sql__adaptive__enabled="false"
        ):
            slice_size = ceil(links / parts) if links else 1
            start = _initial_state(counted, slice_size)
            if parts == 1:
                start = start.coalesce(1)
            start = start.persist()
            persisted.append(start)
            sliced = parts > 1 and not start.filter("slices > 1").isEmpty()
            linked = _links(counted, start, slice_size, sliced, parts).persist()
            persisted.append(linked)
            # Supersteps per checkpoint: the last job may run all but one for nothing.
            steps = STEPS_SMALL if parts == 1 else STEPS_LARGE
            superstep = _superstep(tolerance, sliced, tasks if tasks < parts else 0)
            state = start
            while not state.filter(F.col("change") > tolerance).isEmpty():
                for _ in range(steps):
                    state = superstep(state, linked)
                    if parts == 1:
                        state = state.coalesce(1)
                state = state.checkpoint()
        return _scaled(state.select(F.col("src").alias("id"), "rank"), edges)
    finally:
        for table in persisted:
            table.unpersist()


def _scaled(ranks: DataFrame, edges: DataFrame) -> DataFrame:
    """Ranks with a mean of 1, by ids of the type that the ends of edges have."""
    total = ranks.agg(F.sum("rank").alias("rank"), F.count(F.lit(1)).alias("n")).first()
    scale = total["n"] / total["rank"] if total["n"] else 1.0
    id_ = F.col("id").cast(vertices(edges).schema["id"].dataType)
    return ranks.select(id_.alias("id"), (F.col("rank") * F.lit(scale)).alias("rank"))


def _likely_edges(edges: DataFrame) -> int:
    """About how many edges there are by the size of the tables; 0 if a size isn't known."""
    leaves = edges._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    known = all(size < UNKNOWN_BYTES for size in sizes)
    return sum(sizes) // EDGE_BYTES if known else 0


def _partitions(links: int, session: int) -> int:
    """As many as the session uses, fewer for few links, more where partitions would burst."""
    needed = max(session, ceil(links / MOST_LINKS_PER_PARTITION))
    return max(1, min(needed, ceil(links / LINKS_PER_PARTITION)))


def _tasks(links: int, parts: int, cores: int) -> int:
    """Tasks that send in a superstep: half as many as run at once, unless links are many."""
    return min(parts, max(2, ceil(cores / 2), ceil(links / COMBINED_LINKS)))


def _initial_state(counted: DataFrame, slice_size: int) -> DataFrame:
    """One row per vertex ``src``: rank, last change, out-degree and number of slices."""
    none = F.lit(0).cast("bigint")
    one = F.lit(1).cast("bigint")
    ends = counted.select(
        "src", F.col("copies").alias("degree"), one.alias("fan")
    ).unionAll(counted.select("dst", none.alias("degree"), none.alias("fan")))
    return (
        ends.groupBy("src")
        .agg(F.sum("degree").alias("degree"), F.sum("fan").alias("fan"))
        .select(
            "src",
            F.lit(RESET).alias("rank"),
            F.lit(RESET).alias("change"),
            "degree",
            F.greatest(F.ceil(F.col("fan") / slice_size), one).cast("int").alias("slices"),
            F.greatest(
                F.ceil(F.least(F.col("fan"), F.lit(slice_size)) / LIST_LINKS), one
            ).cast("int").alias("lists"),
        )
    )


def _links(
    counted: DataFrame, state: DataFrame, slice_size: int, sliced: bool, parts: int
) -> DataFrame:
    """Lists ``src, slice, list, out`` of ``dst, copies``; list -1 is a vertex's link to
    itself, with copies 0."""
    own = state.select(
        "src",
        F.lit(0).alias("slice"),
        F.lit(-1).alias("list"),
        F.col("src").alias("dst"),
        F.lit(0).cast("bigint").alias("copies"),
    )
    slice_, list_ = F.lit(0), F.lit(0)
    if slice_size > LIST_LINKS or sliced:
        # Sources of more than a slice or a list of links: at most as many as there are
        # slices and lists, which is a few for each partition.
        large = state.filter((F.col("slices") > 1) | (F.col("lists") > 1))
        counted = counted.join(F.broadcast(large.select("src", "slices", "lists")), "src", "left")
        place = F.xxhash64("dst")
        slice_ = F.pmod(place, F.coalesce("slices", F.lit(1))).cast("int")
        list_ = F.pmod(F.shiftright(place, 32), F.coalesce("lists", F.lit(1))).cast("int")
    cut = counted.select("src", slice_.alias("slice"), list_.alias("list"), "dst", "copies")
    keys = ["src", "slice"] if sliced else ["src"]
    every = cut.unionAll(own).repartition(parts, *keys)
    lists = every.groupBy("src", "slice", "list").agg(
        F.collect_list(F.struct("dst", "copies")).alias("out")
    )
    return lists.sortWithinPartitions(*keys)


def _superstep(
    tolerance: float, sliced: bool, tasks: int = 0
) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """The step from one state to the next, sent by ``tasks`` tasks, or by one for each
    partition if that is 0; its expressions are built only once."""
    is_own = F.col("copies") == 0
    sent = F.lit(1.0 - RESET) * F.col("change") / F.col("degree") * F.col("copies")
    counts = (F.col("list") < 0) | (F.col("change") > tolerance)
    sums = [
        F.max(F.when(is_own, F.col("rank"))).alias("rank"),
        F.sum(F.when(is_own, 0.0).otherwise(sent)).alias("change"),
        F.max(F.when(is_own, F.col("degree"))).alias("degree"),
        F.max(F.when(is_own, F.col("slices"))).alias("slices"),
    ]
    receiver = F.col("dst").alias("src")
    slices = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))

    def step(state: DataFrame, linked: DataFrame) -> DataFrame:
        keys = ["src"]
        if sliced:
            state = state.withColumn("slice", slices)
            keys.append("slice")
        # Both sides already lie by key, so a merge join moves nothing; a broadcast would.
        lists = linked if sliced else linked.drop("slice")
        sending = state.drop("lists").hint("merge").join(lists, keys).filter(counts)
        carried = ("src", "rank", "change", "degree", "slices")
        sent = sending.select(*carried, F.inline("out"))
        if tasks:
            sent = sent.coalesce(tasks)
        after = sent.groupBy(receiver).agg(*sums)
        # Only the change is summed, so that a row in the shuffle has one number.
        return after.withColumn("rank", F.col("rank") + F.col("change"))

    return step


def ranks_by_name(ranks: DataFrame, names: DataFrame, column: str = "username") -> DataFrame:
    """Join ``names(id, username)`` with ranks and keep name and rank.

    An inner join: names without a rank and ranks without a name drop out, and an id
    with several names gives several rows.
    """
    return names.join(ranks, "id").select(F.col(column), F.col("rank"))
