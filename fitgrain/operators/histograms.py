"""Histograms of a tree's level, and the best split of each node.

A cell is a node, a feature, a bin and a statistic: a class, or one of count, sum and sum
of squares. A task never holds more than ``HISTOGRAM_CELLS`` of them. If the whole level has
no more, they are one array; else the cells that occur are kept by number, and sent on
when they get too many. Sparse rows add to the cells of their entries only: the bin of zero
is what the other bins leave of the node's total.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitgrain.operators.bins import CHUNK_VALUES, BinBatch, bin_batches

#: Cells of a histogram that one task holds at a time.
HISTOGRAM_CELLS = 4_000_000


def impurity(stats: np.ndarray, is_class: bool) -> np.ndarray:
    """Gini impurity of class counts, or population variance of count, sum and squares.

    Statistics are in the last axis.
    """
    if is_class:
        n = stats.sum(axis=-1, keepdims=True)
        share = stats / n
        # Classes are taken off in their order.
        return np.subtract.reduce(np.concatenate([np.ones(n.shape), share * share], axis=-1), axis=-1)
    n, s, q = np.moveaxis(stats, -1, 0)
    mean = s / n
    return q / n - mean * mean


def row_count(stats: np.ndarray, is_class: bool) -> np.ndarray:
    return stats.sum(axis=-1) if is_class else stats[..., 0]


class CellSums:
    """Sums by cell number, in arrays of at most ``limit`` cells."""

    def __init__(self, cells: int, limit: int):
        self.cells, self.limit = cells, limit
        self.dense = np.zeros(cells) if cells <= limit else None
        self.number, self.value = np.empty(0, np.int64), np.empty(0)

    def add(self, number: np.ndarray, value: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Add values; gives cells and sums that no longer fit in."""
        if self.dense is not None:
            self.dense += np.bincount(number, value, self.cells)
            return
        step = max(1, self.limit)
        for start in range(0, len(number), step):
            both = np.concatenate([self.number, number[start : start + step]])
            self.number, place = np.unique(both, return_inverse=True)
            values = np.concatenate([self.value, value[start : start + step]])
            self.value = np.bincount(place, values, len(self.number))
            if len(self.number) > self.limit // 2:
                yield from self.take()

    def take(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.dense is not None:
            full = np.flatnonzero(self.dense)
            yield full, self.dense[full]
            self.dense = np.zeros(self.cells)
        else:
            yield self.number, self.value
            self.number, self.value = np.empty(0, np.int64), np.empty(0)


@dataclass
class Router:
    """The nodes of a tree as arrays, to send rows of bins down to ``wanted`` ones."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    slot: np.ndarray
    levels: int

    @classmethod
    def to(cls, nodes: dict, wanted: list[int]) -> Router:
        order = sorted(nodes)
        place = {node: i for i, node in enumerate(order)}

        def child(node: int, at: int) -> int:
            return place[at] if nodes[node].feature is not None else place[node]

        slot = np.full(len(order), -1)
        slot[[place[node] for node in wanted]] = np.arange(len(wanted))
        return cls(
            np.array([nodes[i].feature or 0 for i in order]),
            np.array([nodes[i].bin or 0 for i in order]),
            np.array([child(i, 2 * i) for i in order]),
            np.array([child(i, 2 * i + 1) for i in order]),
            slot,
            max(nodes[node].depth for node in wanted),
        )

    def slots(self, rows: BinBatch) -> np.ndarray:
        """The number of each row's node among the wanted ones, or -1."""
        at = np.zeros(rows.rows, dtype=int)
        for _ in range(self.levels):
            low = rows.of(self.feature[at]) <= self.cut[at]
            at = np.where(low, self.left[at], self.right[at])
        return self.slot[at]


def bin_histogram(
    cells: DataFrame,
    nodes: dict,
    wanted: list[int],
    dim: int,
    bins: int,
    width: int,
    is_class: bool,
    zero: np.ndarray | None = None,
) -> DataFrame:
    """Sums per ``node, feature, bin, stat``, partitioned by node and feature.

    ``zero`` has the bin of zero of each feature for sparse rows, whose histogram lacks
    that bin.
    """
    router, ids = Router.to(nodes, wanted), np.array(wanted)
    shape = (len(wanted), dim, bins, width)
    size = 1
    for n in shape:
        size *= n
    if size >= 1 << 63:
        raise ValueError(f"a level of {shape} nodes, features, bins and classes has too many cells")

    def rows_of(number: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(number), 100_000):
            part = number[start : start + 100_000]
            node, j, b, stat = np.unravel_index(part, shape)
            keys = [pa.array(key.astype(np.int32)) for key in (ids[node], j, b, stat)]
            yield pa.RecordBatch.from_arrays(
                [*keys, pa.array(value[start : start + 100_000])],
                names=["node", "feature", "bin", "stat", "value"],
            )

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = CellSums(size, HISTOGRAM_CELLS)
        for batch in batches:
            c, n, s, q = (batch.column(k).to_numpy(zero_copy_only=False) for k in "cnsq")
            for start, part in bin_batches(batch, dim, zero):
                own = slice(start, start + part.rows)
                slot = router.slots(part)
                mine = slot[part.owner] >= 0
                owner = part.owner[mine]
                cell = (slot[owner] * dim + part.position[mine]) * bins + part.bin[mine]
                kept = [(c[own], n[own])] if is_class else [(0, n[own]), (1, s[own]), (2, q[own])]
                for stat, weight in kept:
                    number = cell * width + (stat[owner] if is_class else stat)
                    for full in total.add(number, weight[owner]):
                        yield from rows_of(*full)
        for full in total.take():
            yield from rows_of(*full)

    columns = ["bins", "c", "n", "s", "q"] if zero is None else ["at", "bins", "c", "n", "s", "q"]
    return (
        cells.select(*columns)
        .mapInArrow(per_task, "node int, feature int, bin int, stat int, value double")
        .repartition("node", "feature")
        .groupBy("node", "feature", "bin", "stat")
        .agg(F.sum("value").alias("value"))
    )


def node_totals(
    cells: DataFrame, nodes: dict, wanted: list[int], dim: int, width: int, is_class: bool, zero: np.ndarray
) -> np.ndarray:
    """Statistics of the wanted nodes, one row each."""
    router = Router.to(nodes, wanted)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, n, s, q = (batch.column(k).to_numpy(zero_copy_only=False) for k in "cnsq")
            for start, part in bin_batches(batch, dim, zero):
                own = slice(start, start + part.rows)
                slot = router.slots(part)
                mine = slot >= 0
                kept = [(c[own], n[own])] if is_class else [(0, n[own]), (1, s[own]), (2, q[own])]
                for stat, weight in kept:
                    number = slot[mine] * width + (stat[mine] if is_class else stat)
                    found, place = np.unique(number, return_inverse=True)
                    sums = np.bincount(place, weight[mine], len(found))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found.astype(np.int64)), pa.array(sums)], names=["cell", "value"]
                    )

    sums = (
        cells.select("at", "bins", "c", "n", "s", "q")
        .mapInArrow(per_task, "cell long, value double")
        .groupBy("cell")
        .agg(F.sum("value").alias("value"))
        .toArrow()
    )
    out = np.zeros(len(wanted) * width)
    out[sums["cell"].to_numpy()] = sums["value"].to_numpy()
    return out.reshape(len(wanted), width)


SPLIT = {
    "node": "int",
    "feature": "int",
    "bin": "int",
    "gain": "double",
    **{f"{side}_{what}": "double" for side in ("left", "right") for what in ("n", "value", "impurity")},
}


def best_splits(
    histogram: DataFrame,
    bins: int,
    width: int,
    is_class: bool,
    zero: np.ndarray | None = None,
    totals: dict[int, np.ndarray] | None = None,
) -> DataFrame:
    """The split of each node with the largest gain, and the rows, value and impurity of its
    sides; no row for a node that gains nothing. A class's value is its number.

    ``totals`` has the statistics of each node for sparse rows.
    """

    def side(stats: np.ndarray) -> list[np.ndarray]:
        n = row_count(stats, is_class)
        value = stats.argmax(axis=-1).astype(float) if is_class else stats[..., 1] / stats[..., 0]
        return [n, value, impurity(stats, is_class)]

    def search(node: np.ndarray, feature: np.ndarray, stats: np.ndarray) -> pa.RecordBatch:
        """``stats`` of each node and feature by bin."""
        if zero is not None:
            rest = np.stack([totals[k] for k in node.tolist()]) - stats.sum(axis=1)
            # Without rows nothing is left but rounding.
            rest[row_count(rest, is_class) == 0] = 0.0
            stats[np.arange(len(node)), zero[feature]] += rest
        left = np.cumsum(stats, axis=1)
        total = left[:, -1]
        right = total[:, None] - left
        n, n_left, n_right = (row_count(part, is_class) for part in (total, left, right))
        # After a bin without rows the split is that after the bin before it.
        may = (row_count(stats, is_class) > 0) & (n_right > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = (
                impurity(total, is_class)[:, None]
                - n_left / n[:, None] * impurity(left, is_class)
                - n_right / n[:, None] * impurity(right, is_class)
            )
        gain = np.where(may, gain, -np.inf)
        at = gain.argmax(axis=1)
        every = np.arange(len(node))
        good = gain[every, at] > 0
        every, at = every[good], at[good]
        low, high = left[every, at], right[every, at]
        columns = [node[good], feature[good], at.astype(np.int32), gain[every, at]]
        columns += side(low) + side(high)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=list(SPLIT))

    def groups(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        node, feature, bin_, stat, value = rows
        new = np.flatnonzero((node[1:] != node[:-1]) | (feature[1:] != feature[:-1])) + 1
        begin = np.concatenate([[0], new]) if len(node) else new
        number = np.zeros(len(node), np.int64)
        number[new] = 1
        number = np.cumsum(number)
        step = max(1, CHUNK_VALUES // (bins * width))
        for start in range(0, len(begin), step):
            stop = min(start + step, len(begin))
            own = slice(begin[start], begin[stop] if stop < len(begin) else len(node))
            stats = np.zeros((stop - start, bins, width))
            stats[number[own] - start, bin_[own], stat[own]] = value[own]
            first = begin[start:stop]
            yield search(node[first], feature[first], stats)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[] for _ in range(5)]
        size = 0
        for batch in batches:
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            for column, part in zip(held, new):
                column.append(part)
            size += batch.num_rows
            if size < CHUNK_VALUES // 4:
                continue
            rows = [np.concatenate(column) for column in held]
            # The last node and feature may go on.
            last = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
            cut = int(np.argmax(last))
            if cut:
                yield from groups([x[:cut] for x in rows])
            held = [[x[cut:]] for x in rows]
            size = len(rows[0]) - cut
        if size:
            yield from groups([np.concatenate(column) for column in held])

    schema = ", ".join(f"{name} {kind}" for name, kind in SPLIT.items())
    by_feature = histogram.sortWithinPartitions("node", "feature").mapInArrow(per_task, schema)
    order = F.struct(F.col("gain"), -F.col("feature"))
    chosen = F.struct(*[name for name in SPLIT if name != "node"])
    return by_feature.groupBy("node").agg(F.max_by(chosen, order).alias("best")).select(
        "node", "best.*"
    )
