"""Decision trees, grown level by level from histograms of binned rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitgrain.functions.vectors import (
    NARROW,
    dimension,
    is_vector,
    kernel_column,
    unpack,
    unusable,
    unusable_label,
)
from fitgrain.operators.bins import Cuts, dense_cuts, dense_rows, sparse_cuts, sparse_rows
from fitgrain.operators.grain import distinct_estimate, gather, worth_grouping
from fitgrain.operators.histograms import (
    best_splits,
    bin_histogram,
    impurity as impurity_of,
    node_totals,
    row_count,
)

#: Classes that a tree may have; the driver holds their list.
MOST_CLASSES = 100_000
#: Levels up to which a prediction is one CASE, which doubles with each of them.
CASE_DEPTH = 6


@dataclass
class Node:
    """A tree node; ``feature`` is None in a leaf. Children are ``2 * id`` and ``2 * id + 1``."""

    id: int
    depth: int
    rows: float
    prediction: float
    impurity: float
    feature: int | None = None
    bin: int | None = None
    threshold: float | None = None
    gain: float | None = None


@dataclass
class TreeModel:
    """Nodes by id; the root is 1, and rows at or below a threshold go left."""

    nodes: dict[int, Node] = field(default_factory=dict)

    @property
    def depth(self) -> int:
        return max(node.depth for node in self.nodes.values())

    def predict(
        self, df: DataFrame, features: str = "features", output: str = "prediction"
    ) -> DataFrame:
        """Append the leaf's value.

        A flat tree over few features is one nested CASE. Others go down their nodes as
        arrays, level by level, an Arrow batch at a time; both send a missing value to
        the right.
        """
        used = [node.feature for node in self.nodes.values() if node.feature is not None]
        width = max(used, default=-1) + 1
        if self.depth > CASE_DEPTH or (is_vector(df, features) and width > NARROW * 4):
            return df.withColumn(output, self._walk(kernel_column(df, features)))
        x = unpack(df, features, width)

        def leaf(node: Node) -> Column:
            return F.lit(node.prediction)

        def goes_left(node: Node) -> Column:
            return x[node.feature] <= F.lit(node.threshold)

        return df.withColumn(output, _route(self.nodes, 1, goes_left, leaf))

    def _walk(self, column: Column) -> Column:
        order = sorted(self.nodes)
        nodes = [self.nodes[i] for i in order]
        place = {node.id: i for i, node in enumerate(nodes)}
        inner = np.array([node.feature is not None for node in nodes])
        feature = np.array([node.feature or 0 for node in nodes])
        threshold = np.array([node.threshold if node.feature is not None else 0.0 for node in nodes])
        left = np.array([place.get(2 * node.id, 0) for node in nodes])
        right = np.array([place.get(2 * node.id + 1, 0) for node in nodes])
        value = np.array([node.prediction for node in nodes])

        @F.arrow_udf("double")
        def walk(batch: pa.Array) -> pa.Array:
            rows = RowValues(batch)
            at = np.zeros(len(batch), dtype=int)
            going = np.arange(len(batch))
            while len(going := going[inner[at[going]]]):
                node = at[going]
                low = rows.of(going, feature[node]) <= threshold[node]
                at[going] = np.where(low, left[node], right[node])
            return pa.array(value[at])

        return walk(column)

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [
            (n.id, n.depth, float(n.rows), n.feature, n.threshold, n.gain, n.prediction)
            for n in self.nodes.values()
        ]
        return spark.createDataFrame(
            rows,
            "id int, depth int, rows double, feature int, threshold double, gain double, "
            "prediction double",
        )


class RowValues:
    """Single values of a batch of arrays or vectors; NaN where a row has no such value."""

    def __init__(self, batch: pa.Array):
        self.sparse = pa.types.is_struct(batch.type)
        lists = batch.field("values") if self.sparse else batch
        valid = batch.is_valid().to_numpy(zero_copy_only=False)
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        sizes = np.where(valid, sizes, 0)
        self.begin = lists.offsets.to_numpy()[:-1].astype(np.int64)
        self.value = lists.values.to_numpy(zero_copy_only=False).astype(float)
        self.length = sizes
        if self.sparse:
            length = batch.field("size").fill_null(0).to_numpy(zero_copy_only=False)
            self.length = np.where(valid, length, 0)
            ends = np.cumsum(sizes)
            self.owner = np.repeat(np.arange(len(batch)), sizes)
            self.place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)
            self.place += np.repeat(self.begin, sizes)
            indices = batch.field("indices")
            self.position = indices.values.to_numpy(zero_copy_only=False).astype(np.int64)[self.place]
            self.span = int(self.length.max(initial=0)) + 1
            self.key = self.owner * self.span + self.position

    def of(self, row: np.ndarray, j: np.ndarray) -> np.ndarray:
        there = j < self.length[row]
        out = np.full(len(row), np.nan)
        if not self.sparse:
            out[there] = self.value[self.begin[row[there]] + j[there]]
            return out
        out[there] = 0.0
        wanted = row[there] * self.span + j[there]
        if len(self.key):
            at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            found = self.key[at] == wanted
            out[np.flatnonzero(there)[found]] = self.value[self.place[at[found]]]
        return out


def fit_tree(
    df: DataFrame,
    impurity: str = "gini",
    max_depth: int = 5,
    max_bins: int = 32,
    label: str = "label",
    features: str = "features",
) -> TreeModel:
    """Grow a classifier (``gini``) or a regressor (``variance``).

    Candidate thresholds are the midpoints between neighbouring values of a feature
    over the whole table if it has at most ``max_bins`` values, else quantiles of all
    rows. Each node takes the split with the largest gain; the first feature and then
    the smallest threshold win a tie, and a node without a positive gain is a leaf. A
    leaf predicts its majority class (the lowest on a tie) or its mean. Any numbers may
    be class labels; more than ``MOST_CLASSES`` of them are an error.

    Rows are binned once and grouped when few bin combinations exist. Each task then
    adds up a level's histogram over its rows, and one shuffle brings a node's feature
    together, where its best split is found. Vectors of more than 64 features are never
    made dense: their rows, thresholds and histograms come from their entries alone.
    """
    if impurity not in ("gini", "variance"):
        raise ValueError(f"impurity must be 'gini' or 'variance', not {impurity!r}")
    dim = dimension(df, features)
    y = F.col(label).cast("double")
    profile = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(unusable(df, features, dim) | unusable_label(label)).alias("wrong"),
    ).first()
    if profile["wrong"]:
        raise ValueError(
            f"{profile['wrong']} rows do not have {dim} features without nulls, or no label"
        )
    points = df.select(y.alias("y"), kernel_column(df, features).alias("x"))
    classes = None
    if impurity == "gini":
        found = points.select((F.col("y") + F.lit(0.0)).alias("y")).distinct()
        classes = sorted(row["y"] for row in found.limit(MOST_CLASSES + 1).collect())
        if len(classes) > MOST_CLASSES:
            raise ValueError(f"more than {MOST_CLASSES} classes")
    rows = profile["rows"]
    sparse = is_vector(df, features) and dim > NARROW * 4
    if sparse:
        cuts = sparse_cuts(points, dim, rows, max_bins)
        binned = sparse_rows(points, cuts, classes)
    else:
        cuts = dense_cuts(df, points, features, dim, rows, max_bins)
        binned = dense_rows(points, cuts, classes)
    cells = _grouped(binned, rows, classes, cuts).persist()
    try:
        return _grow(cells, cuts, classes, max_depth, cuts.zero_bins() if sparse else None)
    finally:
        cells.unpersist()


def _grouped(
    binned: DataFrame, rows: int, classes: list[float] | None, cuts: Cuts
) -> DataFrame:
    """Rows of bins, ``c, n, s, q``: count, sum and sum of squares of the labels of equal
    bins and class; grouped only where that shrinks the table."""
    key = [name for name in binned.columns if name != "y"]
    bound = np.exp(min(np.log(np.diff(cuts.start) + 1.0).sum(), 700.0)) * len(classes or [0])
    if not worth_grouping(rows, bound):
        estimate = distinct_estimate([F.col(name) for name in key]).alias("distinct")
        bound = binned.agg(estimate).first()["distinct"]
    square = F.col("y") * F.col("y")
    if not worth_grouping(rows, bound):
        one = F.lit(1.0).alias("n")
        return binned.select(*key, one, F.col("y").alias("s"), square.alias("q"))
    cells = binned.groupBy(*key).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum("y").alias("s"),
        F.sum(square).alias("q"),
    )
    return gather(cells, bound)


def _grow(
    cells: DataFrame,
    cuts: Cuts,
    classes: list[float] | None,
    max_depth: int,
    zero: np.ndarray | None = None,
) -> TreeModel:
    is_class = classes is not None
    width = len(classes) if is_class else 3
    dim, bins = cuts.dim, cuts.most
    model = TreeModel()

    def add(id: int, depth: int, n: float, value: float, impurity: float) -> None:
        prediction = classes[int(value)] if is_class else value
        model.nodes[id] = Node(id, depth, float(n), float(prediction), float(impurity))

    sums = [F.sum(name).alias(name) for name in ("n", "s", "q")]
    root = np.zeros(width)
    for row in cells.groupBy("c").agg(*sums).collect():
        if is_class:
            root[row["c"]] = row["n"]
        else:
            root[:] = row["n"], row["s"], row["q"]
    value = np.argmax(root) if is_class else root[1] / root[0]
    add(1, 0, row_count(root, is_class), value, impurity_of(root, is_class))
    for depth in range(max_depth):
        frontier = sorted(n.id for n in model.nodes.values() if n.depth == depth)
        if not frontier or not dim:
            break
        totals = None
        if zero is not None:
            found = [root] if depth == 0 else node_totals(
                cells, model.nodes, frontier, dim, width, is_class, zero
            )
            totals = dict(zip(frontier, found))
        histogram = bin_histogram(cells, model.nodes, frontier, dim, bins, width, is_class, zero)
        for row in best_splits(histogram, bins, width, is_class, zero, totals).collect():
            node = model.nodes[row["node"]]
            node.feature, node.bin, node.gain = row["feature"], row["bin"], row["gain"]
            node.threshold = float(cuts.flat[cuts.start[node.feature] + node.bin])
            for id, side in ((2 * node.id, "left"), (2 * node.id + 1, "right")):
                add(id, depth + 1, *(row[f"{side}_{x}"] for x in ("n", "value", "impurity")))
    return model


def _route(
    nodes: dict[int, Node],
    at: int,
    goes_left: Callable[[Node], Column],
    leaf: Callable[[Node], Column],
) -> Column:
    node = nodes[at]
    if node.feature is None:
        return leaf(node)
    return F.when(goes_left(node), _route(nodes, 2 * at, goes_left, leaf)).otherwise(
        _route(nodes, 2 * at + 1, goes_left, leaf)
    )
