"""PageRank supersteps over links packed into blocks of numbers, for graphs with many links."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fitgrain.session import settings

#: Links of one part, and of one block, at most, about; links that are worth a task of their own.
PART_LINKS, BLOCK_LINKS, TASK_LINKS = 100_000_000, 1_000_000, 1_000_000
#: Links that are packed in one go, and links of a row of a block. Such rows, and Arrow batches
#: of about their size, reach Python twice as fast as rows of a few megabytes.
PACK_LINKS, ROW_LINKS = 1_000_000, 125_000
BATCH = "1m"
#: Ids that are brought together in one go, with those that are known.
MERGED_IDS = 2_000_000
#: Vertices that are numbered in one window, and links of a shuffle partition meanwhile, about.
NUMBERED_VERTICES, NUMBERED_LINKS = 1_000_000, 2_000_000
STEPS = 4
#: What a row holds, in the order in which a superstep reads them: ranks of a part's vertices
#: (``a``; none at the start); sums sent from part ``other`` for those of one lane (``a``, at places
#: ``b`` or all); out-degrees (``a``); places (``a``) of the vertices that part ``other`` sends
#: to in a lane; places (``a``) of the sources of links to a lane; some of those links (``a`` for each
#: source from number ``at`` on, to ``b``; those at ``c`` have ``d`` copies); ids (``a``) of the
#: part's vertices.
RANKS, SUMS, DEGREES, RECEIVERS, SOURCES, LINKS, IDS = range(7)
_INTS = ("key", "part", "kind", "other", "lane", "at")
ROW = ", ".join([f"{name} int" for name in _INTS] + [f"{name} binary" for name in "abcd"])
_ROW = pa.schema([(name, pa.int32()) for name in _INTS] + [(name, pa.binary()) for name in "abcd"])


def block_ranks(edges: DataFrame, links: int, tolerance: float, reset: float) -> DataFrame:
    """Unscaled ranks ``id, rank`` of ``edges(src, dst, copies)`` between whole numbers.

    ``links`` says about how many edges there are; rows may repeat, and their copies add up.

    Plan: vertices are dealt by hash to lanes, a few of which make a part. Tasks pack edges as
    numbers by source's part and target's lane; those of such a block are brought together, collapsed
    and refer to sorted lists of their sources and targets. Each part learns once the places of
    those lists among its vertices. A superstep reads what was sent to a part, adds it up,
    and sends one array for each lane, with places if few have sums. So it costs one shuffle of at
    most eight bytes for a target of a block, and one of ranks; a task holds arrays over the vertices
    of a part and the targets that its blocks have. What moves and what stays lie by one key, and a
    union keeps them together; a part without its ranks is an error.
    """
    spark = edges.sparkSession
    parts, lanes = _parts(links, spark.sparkContext.defaultParallelism)
    keys = _keys(spark, parts)
    persisted = []
    try:
        with settings(spark, spark__sql__execution__arrow__maxBytesPerBatch=BATCH):
            packed = edges.select(
                *[F.col(name).cast("bigint").alias(name) for name in ("src", "dst", "copies")]
            ).mapInArrow(_trimmed(_pack(parts, lanes, keys)), ROW)
            packed = packed.repartition(parts, "key").sortWithinPartitions("lane")
            blocks = packed.mapInArrow(_trimmed(_collapse(lanes, keys)), ROW)
            blocks = blocks.repartition(parts, "key").sortWithinPartitions("kind", "lane").persist()
            persisted.append(blocks)
            # What edges come from may be planned adaptively.
            blocks.count()
        # Adaptive plans hide how tables lie; the union depends on it.
        with settings(
            spark,
            spark__sql__adaptive__enabled="false",
            spark__sql__unionOutputPartitioning="true",
            spark__sql__execution__arrow__maxBytesPerBatch=BATCH,
        ):
            ends = blocks.filter(F.col("kind") != LINKS)
            known = ends.mapInArrow(_trimmed(_vertices), ROW).repartition(parts, "key").persist()
            persisted.append(known)
            ids, degrees = known.filter(F.col("kind") == IDS), known.filter(F.col("kind") == DEGREES)
            places = ids.unionAll(ends).mapInArrow(_trimmed(_place), ROW)
            places = places.repartition(parts, "key").sortWithinPartitions("kind").persist()
            persisted.append(places)
            first = ids.select("key", "part", F.lit(RANKS).alias("kind"), "other", "lane", "at")
            nothing = [F.lit(None).cast("binary").alias(name) for name in "abcd"]
            moving = first.select("*", *nothing)
            stays = degrees, places, blocks.filter(F.col("kind") == LINKS)
            step = _trimmed(_superstep(lanes, keys, tolerance, reset))
            sent = True
            while sent:
                for _ in range(STEPS):
                    for table in stays:
                        moving = moving.unionAll(table)
                    moving = moving.mapInArrow(step, ROW).repartition(parts, "key")
                moving = moving.checkpoint()
                sent = not moving.filter(F.col("kind") == SUMS).isEmpty()
                # Shuffle files and checkpoints go when the driver collects its garbage.
                spark.sparkContext._jvm.System.gc()
            ranks = moving.filter(F.col("kind") == RANKS).unionAll(ids)
            return ranks.mapInArrow(_unpack, "id bigint, rank double").checkpoint()
    finally:
        for table in persisted:
            table.unpersist()


def named_block_ranks(
    counted: DataFrame, ends: DataFrame, links: int, tolerance: float, reset: float
) -> DataFrame:
    """The same for ids of any type, which get numbers first; ``ends`` has each vertex, ``src``, once."""
    spark = counted.sparkSession
    session = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = None
    try:
        with settings(
            spark, spark__sql__shuffle__partitions=max(session, ceil(links / NUMBERED_LINKS))
        ):
            numbered = _numbered(ends.select(F.col("src").alias("id")), links).persist()
            kind = numbered.schema["id"].dataType
            edges = counted.select(F.col("src").cast(kind), F.col("dst").cast(kind), "copies")
            for end in ("src", "dst"):
                side = numbered.select(F.col("id").alias(end), F.col("number").alias(f"{end}_number"))
                edges = edges.join(side.hint("shuffle_hash"), end).drop(end)
            edges = edges.select(
                F.col("src_number").alias("src"), F.col("dst_number").alias("dst"), "copies"
            )
            ranks = block_ranks(edges, links, tolerance, reset)
            ranks = ranks.withColumnRenamed("id", "number")
            return numbered.join(ranks, "number").select("id", "rank").checkpoint()
    finally:
        if numbered is not None:
            numbered.unpersist()


def _numbered(ends: DataFrame, links: int) -> DataFrame:
    """``id, number``: hashed groups are numbered by id, so that a second run gives the same."""
    groups = ceil(links / NUMBERED_VERTICES)
    group = F.pmod(F.xxhash64("id"), F.lit(groups))
    place = F.row_number().over(Window.partitionBy("group").orderBy("id")).cast("bigint")
    numbered = ends.withColumn("group", group).withColumn("place", place)
    return numbered.select("id", F.shiftleft("group", 32).bitwiseOR(F.col("place")).alias("number"))


def _parts(links: int, cores: int) -> tuple[int, int]:
    """Parts, one for each core if links permit, or a multiple if they would be too large,
    and lanes of each."""
    needed = max(1, ceil(links / PART_LINKS))
    if needed <= cores:
        parts = max(needed, min(cores, ceil(links / TASK_LINKS)))
    else:
        parts = cores * ceil(needed / cores)
    return parts, max(1, ceil(links / (parts * parts * BLOCK_LINKS)))


def _keys(spark: SparkSession, parts: int) -> list[int]:
    """A key for each part, so that ``repartition`` by key gives every part a partition."""
    tried = 16 * parts
    while True:
        tried *= 2
        key = F.col("id").cast("int")
        slots = spark.range(tried).select(key.alias("key"), F.pmod(F.hash(key), parts).alias("slot"))
        found = slots.groupBy("slot").agg(F.min("key").alias("key")).collect()
        if len(found) == parts:
            return [row["key"] for row in sorted(found, key=lambda row: row["slot"])]


def _trimmed(kernel: Callable) -> Callable:
    """The kernel, after which what it has freed goes back to the system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from kernel(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    run.__name__ = kernel.__name__
    return run


def _row(
    key: int, part: int, kind: int, other: int, lane: int, at: int, *cells: np.ndarray | None
) -> pa.RecordBatch:
    numbers = [pa.array([v], pa.int32()) for v in (key, part, kind, other, lane, at)]
    arrays = numbers + [_binary(cell) for cell in cells + (None,) * (4 - len(cells))]
    return pa.RecordBatch.from_arrays(arrays, schema=_ROW)


def _binary(cell: np.ndarray | None) -> pa.Array:
    # Not by way of a memoryview, which pyarrow never lets go of.
    if cell is None:
        return pa.nulls(1, pa.binary())
    cell = np.ascontiguousarray(cell)
    ends = np.array([0, cell.nbytes], "i4")
    return pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(ends), pa.py_buffer(cell)])


def _cell(batch: pa.RecordBatch, name: str, row: int, kind: str) -> np.ndarray | None:
    buffer = batch.column(name)[row].as_buffer()
    return None if buffer is None else np.frombuffer(buffer, kind)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        numbers = zip(*(batch.column(name).to_pylist() for name in _INTS[1:]))
        for row, about in enumerate(numbers):
            yield batch, row, *about


def _lane(ids: np.ndarray, lanes: int) -> np.ndarray:
    """A lane for each id, by a mix of its bits (splitmix64)."""
    mixed = ids.view("u8") + np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(31)
    return ((mixed >> np.uint64(32)) % np.uint64(lanes)).astype("i8")


def _summed(first: np.ndarray, second: np.ndarray, copies: np.ndarray):
    """Distinct pairs with the sums of their copies, in order."""
    order = np.lexsort((second, first))
    first, second, copies = first[order], second[order], copies[order]
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    starts = np.flatnonzero(new)
    return first[starts], second[starts], np.add.reduceat(copies, starts)


def _pack(parts: int, lanes: int, keys: list[int]):
    def packed(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, dst, copies = (
            np.concatenate([np.asarray(batch.column(i)) for batch in batches]) for i in range(3)
        )
        # Edges that come many times are added up before they travel.
        pairs = np.sort(src.view("u8") * np.uint64(0x9E3779B97F4A7C15) + dst.view("u8"))
        if 2 * np.count_nonzero(pairs[1:] == pairs[:-1]) > len(pairs):
            src, dst, copies = _summed(src, dst, copies)
        every = parts * lanes
        block = _lane(src, every) // lanes * every + _lane(dst, every)
        if parts * every < 1 << 16:
            block = block.astype("u2")
        order = np.argsort(block, kind="stable")
        src, dst, copies, block = src[order], dst[order], copies[order], block[order]
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        for start, end in zip(starts, np.r_[starts[1:], len(block)]):
            part, lane = divmod(int(block[start]), every)
            some = copies[start:end]
            yield _row(
                keys[part], part, LINKS, lane // lanes, lane, 0,
                src[start:end], dst[start:end], some if (some > 1).any() else None,
            )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows = [], 0
        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            if rows >= PACK_LINKS:
                yield from packed(waiting)
                waiting, rows = [], 0
        if rows:
            yield from packed(waiting)

    return pack


def _collapse(lanes: int, keys: list[int]):
    """The kernel that makes a block's links, and the ids of their ends for those who place them."""

    def block(part: int, lane: int, cells: list) -> Iterator[pa.RecordBatch]:
        src, dst, copies = (np.concatenate(column) for column in zip(*cells))
        cells.clear()
        sources, src = np.unique(src, return_inverse=True)
        targets, dst = np.unique(dst, return_inverse=True)
        degrees = np.bincount(src, copies, len(sources))
        pairs = (src << 32) | dst
        if (copies > 1).any():
            order = np.argsort(pairs)
            pairs, copies = pairs[order], copies[order]
        else:
            pairs.sort()
        starts = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
        copies = np.add.reduceat(copies, starts)
        pairs = pairs[starts]
        other = lane // lanes
        yield _row(keys[part], part, SOURCES, other, lane, 0, sources, degrees)
        yield _row(keys[other], other, RECEIVERS, part, lane, 0, targets)
        for start in range(0, len(pairs), ROW_LINKS):
            some, times = pairs[start : start + ROW_LINKS], copies[start : start + ROW_LINKS]
            first = int(some[0] >> 32)
            several = np.flatnonzero(times > 1)
            yield _row(
                keys[part], part, LINKS, other, lane, first,
                np.bincount((some >> 32) - first).astype("i4"),
                some.astype("u4").astype("i4"),
                several.astype("i4"),
                times[several].astype("f8"),
            )

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cells = None, []
        for batch, row, part, _, _, lane, _ in _rows(batches):
            if at != (part, lane):
                if cells:
                    yield from block(*at, cells)
                at = part, lane
            src, dst, copies = (_cell(batch, name, row, "i8") for name in "abc")
            cells.append((src, dst, np.ones(len(src), "i8") if copies is None else copies))
        if cells:
            yield from block(*at, cells)

    return collapse


def _vertices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of a part's vertices in order, and their out-degrees."""
    ids, degrees, waiting, size, at = np.empty(0, "i8"), np.empty(0), [], 0, None

    def merged() -> tuple[np.ndarray, np.ndarray]:
        some, numbers = (np.concatenate(column) for column in zip((ids, degrees), *waiting))
        some, places = np.unique(some, return_inverse=True)
        return some, np.bincount(places, numbers, len(some))

    for batch, row, part, *_ in _rows(batches):
        at = batch.column("key")[row].as_py(), part
        some, degree = _cell(batch, "a", row, "i8"), _cell(batch, "b", row, "f8")
        waiting.append((some, np.zeros(len(some)) if degree is None else degree))
        size += len(some)
        if size >= MERGED_IDS:
            ids, degrees = merged()
            waiting, size = [], 0
    if at:
        ids, degrees = merged()
        yield _row(*at, DEGREES, 0, 0, 0, degrees)
        yield _row(*at, IDS, 0, 0, 0, ids)


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of ids as places among the part's, which come first."""
    ids = None
    for batch, row, part, kind, other, lane, _ in _rows(batches):
        some = _cell(batch, "a", row, "i8")
        if kind == IDS:
            ids = some
        elif ids is None:
            raise RuntimeError("ids and lists of a part must lie together")
        else:
            places = np.searchsorted(ids, some).astype("i4")
            yield _row(batch.column("key")[row].as_py(), part, kind, other, lane, 0, places)


def _superstep(lanes: int, keys: list[int], tolerance: float, reset: float):
    """The kernel that takes a part's ranks and sums, then its links, and sends sums on."""

    def message(part: int, lane: int, waiting: list) -> Iterator[pa.RecordBatch]:
        if waiting:
            to, sent = (np.concatenate(column) for column in zip(*waiting))
            waiting.clear()
            other, sums = lane // lanes, np.bincount(to, sent)
            at = np.flatnonzero(sums)
            if 12 * len(at) < 8 * len(sums):
                yield _row(keys[other], other, SUMS, part, lane, 0, sums[at], at.astype("i4"))
            else:
                yield _row(keys[other], other, SUMS, part, lane, 0, sums)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = rank = change = degrees = share = sending = None
        begins = False
        came, sources, waiting = {}, {}, []
        for batch, row, here, kind, other, lane, at in _rows(batches):
            if part is None:
                part = here
            if here != part or (kind <= SUMS and degrees is not None):
                raise RuntimeError("a task must read one part, what was sent to it first")
            if kind == RANKS:
                begins, rank = True, _cell(batch, "a", row, "f8")
            elif kind == SUMS:
                came[other, lane] = _cell(batch, "a", row, "f8"), _cell(batch, "b", row, "i4")
            elif kind == DEGREES:
                degrees = _cell(batch, "a", row, "f8")
                if not begins:
                    raise RuntimeError("ranks and links of a part must lie together")
                change = np.full(len(degrees), reset if rank is None else 0.0)
                rank = np.zeros(len(degrees)) if rank is None else rank
            elif kind == RECEIVERS:
                if (other, lane) in came:
                    sums, some = came.pop((other, lane))
                    places = _cell(batch, "a", row, "i4")
                    # A lane's sums end with the last target that any were sent to.
                    places = places[: len(sums)] if some is None else places[some]
                    change[places] += sums
            elif kind == SOURCES:
                sources[lane] = _cell(batch, "a", row, "i4")
            else:
                if share is None:
                    sends = (change > tolerance) & (degrees > 0)
                    share = np.where(sends, (1.0 - reset) * change / np.maximum(degrees, 1.0), 0.0)
                if lane != sending:
                    yield from message(part, sending, waiting)
                    sending, shares = lane, share[sources.pop(lane)]
                counts = _cell(batch, "a", row, "i4")
                sent = shares[at : at + len(counts)]
                if sent.any():
                    sent = np.repeat(sent, counts)
                    several = _cell(batch, "c", row, "i4")
                    sent[several] *= _cell(batch, "d", row, "f8")
                    waiting.append((_cell(batch, "b", row, "i4"), sent))
        yield from message(part, sending, waiting)
        if part is not None:
            if degrees is None or came:
                raise RuntimeError("ranks and links of a part must lie together")
            yield _row(keys[part], part, RANKS, 0, 0, 0, rank + change)

    return step


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ranks = None
    for batch, row, _, kind, *_ in _rows(batches):
        if kind == RANKS:
            ranks = _cell(batch, "a", row, "f8")
            continue
        ids = _cell(batch, "a", row, "i8")
        if ranks is None or len(ids) != len(ranks):
            raise RuntimeError("ranks and ids of a part must lie together")
        for start in range(0, len(ids), 100_000):
            some = slice(start, start + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[some]), pa.array(ranks[some])], names=["id", "rank"]
            )
