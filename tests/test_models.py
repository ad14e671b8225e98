import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.mllib.classification import NaiveBayes, SVMWithSGD
from pyspark.mllib.clustering import KMeans, KMeansModel
from pyspark.mllib.linalg import Vectors as OldVectors
from pyspark.mllib.regression import LabeledPoint, LinearRegressionWithSGD
from pyspark.sql import functions as F

from fitgrain.functions import vectors
from fitgrain.functions.vectors import kernel_column
from fitgrain.operators import bins, grain, histograms, trees
from fitgrain.operators.kmeans import fit_kmeans
from fitgrain.operators.linear import fit_least_squares, fit_svm
from fitgrain.operators.naive_bayes import fit_naive_bayes
from fitgrain.operators.splits import hash_split, random_split, row_split
from fitgrain.operators.trees import fit_tree

random = np.random.default_rng(5)
N, WIDE = 400, 24


def frame(spark, x, y, parts=3):
    data = [(float(b), [float(v) for v in a]) for a, b in zip(x, y)]
    return spark.createDataFrame(data, "label double, features array<double>").repartition(parts)


def old_points(df):
    return df.rdd.map(lambda row: LabeledPoint(row.label, OldVectors.dense(row.features)))


@pytest.fixture(scope="module")
def data():
    x = random.normal(size=(N, 3))
    y = (x @ [1.0, -2.0, 0.5] + random.normal(scale=0.3, size=N) > 0).astype(float)
    return x, y


@pytest.fixture(scope="module")
def wide():
    x = random.normal(size=(N, WIDE)) * (random.random((N, WIDE)) < 0.3)
    return x, (x @ random.normal(size=WIDE) > 0).astype(float)


def as_sparse(df):
    return df.withColumn(
        "features",
        F.udf(lambda a: Vectors.sparse(len(a), [(j, v) for j, v in enumerate(a) if v]),
              vectors.VectorUDT())("features"),
    )


@pytest.mark.parametrize("rounds", [3, 20])
def test_least_squares_equals_mllib(spark, data, rounds):
    x, _ = data
    df = frame(spark, x, x @ [0.3, 0.1, -0.2] + 0.05)
    expected = LinearRegressionWithSGD.train(old_points(df), rounds)
    model = fit_least_squares(df, rounds)
    assert np.allclose(model.weights, expected.weights.toArray(), atol=1e-10)
    row = model.predict(df).first()
    assert row.prediction == pytest.approx(expected.predict(row.features))


@pytest.mark.parametrize("rounds", [3, 20, 100])
def test_svm_equals_mllib(spark, data, rounds):
    df = frame(spark, *data)
    expected = SVMWithSGD.train(old_points(df), rounds)
    model = fit_svm(df, rounds)
    assert np.allclose(model.weights, expected.weights.toArray(), atol=1e-10)
    scored = model.predict(df).collect()
    assert all(row.prediction == expected.predict(row.features) for row in scored)
    assert {row.prediction for row in scored} == {0.0, 1.0}


def test_wide_linear_models_equal_mllib_dense_and_sparse(spark, wide):
    df = frame(spark, *wide)
    points = old_points(df)
    svm = SVMWithSGD.train(points, 15)
    least = LinearRegressionWithSGD.train(points, 15)
    for table in (df, as_sparse(df)):
        model = fit_svm(table, 15)
        assert np.allclose(model.weights, svm.weights.toArray(), atol=1e-10)
        assert np.allclose(
            fit_least_squares(table, 15).weights, least.weights.toArray(), atol=1e-10
        )
        margins = model.clear_threshold().predict(table, output="score")
        want = {round(float(a @ svm.weights.toArray()), 9) for a in wide[0]}
        assert {round(row.score, 9) for row in margins.collect()} == want


def test_grouping_equal_rows_changes_nothing(spark, data, monkeypatch):
    x, y = np.round(data[0]), data[1]
    df = frame(spark, x, y)
    grouped = [fit_svm(df, 20).weights, fit_kmeans(df, 2, centres=x[:2]).centres]
    monkeypatch.setattr(grain, "SHRINK", 10**9)
    single = [fit_svm(df, 20).weights, fit_kmeans(df, 2, centres=x[:2]).centres]
    for a, b in zip(grouped, single):
        assert np.allclose(a, b, atol=1e-12)


def test_svm_rejects_other_labels(spark):
    for label in (-1.0, 2.0, None):
        df = spark.createDataFrame(
            [(label, [1.0]), (1.0, [2.0])], "label double, features array<double>"
        )
        with pytest.raises(ValueError, match="validation failed"):
            fit_svm(df)


def test_empty_and_ragged_tables_are_errors(spark):
    empty = spark.createDataFrame([], "label double, features array<double>")
    ragged = frame(spark, [[1.0, 2.0], [3.0, 4.0]], [1.0, 0.0], 1).union(
        frame(spark, [[5.0]], [1.0], 1)
    )
    for fit in (fit_svm, fit_least_squares, fit_naive_bayes, fit_tree, fit_kmeans):
        with pytest.raises(ValueError):
            fit(empty)
        with pytest.raises(ValueError):
            fit(ragged)


def test_fits_do_not_depend_on_partitions(spark, data):
    df = frame(spark, *data)
    found = [
        (fit_svm(p).weights, fit_least_squares(p).weights, fit_tree(p).to_df(spark).collect())
        for p in (df.repartition(n) for n in (1, 3, 8))
    ]
    for svm, least, tree in found[1:]:
        assert np.allclose(svm, found[0][0], atol=1e-12)
        assert np.allclose(least, found[0][1], atol=1e-12)
        assert tree == found[0][2]


def test_naive_bayes_equals_mllib(spark):
    x = random.poisson(2.0, size=(N, 5)).astype(float)
    y = random.integers(0, 3, N).astype(float)
    for features in (x, np.repeat(x, 20, axis=1)):
        df = frame(spark, features, y)
        expected = NaiveBayes.train(old_points(df), 1.0)
        for table in (df, as_sparse(df)):
            model = fit_naive_bayes(table)
            assert model.labels == list(expected.labels)
            assert np.allclose(model.pi, expected.pi, atol=1e-12)
            assert np.allclose(model.theta, expected.theta, atol=1e-12)
        for row in model.predict(as_sparse(df)).collect():
            assert row.prediction == expected.predict(row.features.toArray())
        for row in model.predict(df).collect():
            assert row.prediction == expected.predict(row.features)


@pytest.mark.parametrize("bad", [-1.0, float("nan"), float("inf")])
@pytest.mark.parametrize("dim", [2, 80])
def test_naive_bayes_rejects_unusable_features(spark, bad, dim):
    df = frame(spark, [[1.0] * dim, [bad] + [1.0] * (dim - 1)], [0.0, 1.0])
    with pytest.raises(ValueError):
        fit_naive_bayes(df)


@pytest.mark.parametrize("dim", [2, 40])
def test_kmeans_equals_mllib(spark, dim):
    x = random.normal(size=(N, dim)) + (random.random((N, 1)) < 0.4) * 3
    df = frame(spark, x, np.zeros(N))
    points = df.rdd.map(lambda row: OldVectors.dense(row.features))
    expected = KMeans.train(points, 3, 20, initialModel=KMeansModel(x[:3]))
    for table in (df, as_sparse(df)):
        model = fit_kmeans(table, 3, 20, centres=x[:3])
        assert np.allclose(model.centres, expected.centers, atol=1e-9)
        cost = model.cost(table).first().value
        assert cost == pytest.approx(expected.computeCost(points))
    for row in model.predict(df).collect():
        assert row.prediction == expected.predict(row.features)


def test_kmeans_ties_and_empty_clusters(spark):
    df = frame(spark, [[0.0], [2.0]], [0.0, 0.0])
    model = fit_kmeans(df, 3, 1, centres=[[0.0], [2.0], [50.0]])
    assert model.centres.tolist() == [[0.0], [2.0], [50.0]]
    middle = frame(spark, [[1.0]], [0.0])
    assert model.predict(middle).first().prediction == 0


def test_kmeans_without_centres_is_seeded(spark):
    x = np.concatenate([random.normal(size=(50, 2)), random.normal(size=(50, 2)) + 20])
    df = frame(spark, x, np.zeros(100), 2).persist()
    a, b = fit_kmeans(df, 2, seed=3), fit_kmeans(df, 2, seed=3)
    assert np.allclose(a.centres, b.centres)
    assert sorted(round(c[0] / 20) for c in a.centres) == [0, 1]
    for other in (df.repartition(7), df.union(df).union(df.limit(30)), as_sparse(df)):
        points = other.select("features")
        again = fit_kmeans(points, 2, seed=3)
        assert again.centres.shape == (2, 2)
    for table in (df, df.union(df).repartition(5)):
        start = fit_kmeans(table, 20, 0, seed=5).centres
        assert len(np.unique(start, axis=0)) == 20
        assert np.array_equal(start, fit_kmeans(df, 20, 0, seed=5).centres)
    wide = frame(spark, np.hstack([x, np.zeros((100, 70))]), np.zeros(100))
    start = [fit_kmeans(t, 9, 0, seed=5).centres for t in (wide, as_sparse(wide))]
    assert np.array_equal(*start) and len(np.unique(start[0], axis=0)) == 9
    few = frame(spark, np.repeat([[1.0, 2.0], [3.0, 4.0]], 5, axis=0), np.zeros(10))
    assert len(fit_kmeans(few, 4).centres) == 2


def tree_frame(spark, values, seed):
    r = np.random.default_rng(seed)
    x = np.stack([r.integers(0, v, 600) for v in values], axis=1).astype(float)
    y = (x[:, 0] * 2 + x[:, 1] + r.normal(scale=3, size=600) > 12).astype(float)
    return x, y


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("grouped", [True, False])
def test_trees_predict_like_spark_ml(spark, seed, grouped, monkeypatch):
    if not grouped:
        monkeypatch.setattr(grain, "SHRINK", 10**9)
    x, y = tree_frame(spark, [8, 12, 3], seed)
    price = x[:, 0] * 3 - x[:, 1] + np.random.default_rng(seed).normal(size=600)
    for labels, impurity, learner in (
        (y, "gini", DecisionTreeClassifier),
        (price, "variance", DecisionTreeRegressor),
    ):
        df = frame(spark, x, labels)
        model = fit_tree(df, impurity)
        expected = learner(maxDepth=5, featuresCol="v").fit(
            df.withColumn("v", array_to_vector("features"))
        )
        assert model.depth == expected.depth
        both = expected.setPredictionCol("expected").transform(
            model.predict(df).withColumn("v", array_to_vector("features"))
        )
        gap = both.agg(F.max(F.abs(F.col("prediction") - F.col("expected")))).first()[0]
        assert gap < 1e-9


def test_tree_threshold_is_a_midpoint(spark):
    x = np.arange(6.0).reshape(-1, 1)
    model = fit_tree(frame(spark, x, (x[:, 0] >= 3).astype(float)))
    assert model.depth == 1
    assert model.nodes[1].threshold == 2.5
    assert [model.nodes[i].prediction for i in (2, 3)] == [0.0, 1.0]


def test_tree_with_one_class_or_constant_features_is_a_leaf(spark):
    for y in (np.zeros(4), np.array([0.0, 1.0, 1.0, 0.0])):
        model = fit_tree(frame(spark, np.ones((4, 2)), y))
        assert model.depth == 0
        assert model.predict(frame(spark, [[1.0, 5.0]], [0.0])).first().prediction == 0.0


def test_tree_with_many_values_uses_quantiles(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(3000, 2))
    y = (x[:, 0] > 0.1).astype(float)
    df = frame(spark, x, y)
    model = fit_tree(df)
    wrong = model.predict(df).filter("label <> prediction").count()
    assert model.nodes[1].feature == 0
    assert wrong < 150


def test_a_tree_is_the_same_at_any_width(spark):
    x, y = tree_frame(spark, [8, 12, 3], 1)
    for labels, impurity in ((y, "gini"), (np.where(y == 1, 5.5, -1.0), "gini"), (y * 3, "variance")):
        narrow = fit_tree(frame(spark, x, labels), impurity)
        for width in (60, 70):
            padded = np.hstack([x, np.zeros((len(x), width - 3))])
            df = frame(spark, padded, labels)
            for table in (df, as_sparse(df)):
                wide = fit_tree(table, impurity)
                assert wide.nodes.keys() == narrow.nodes.keys()
                for i, node in wide.nodes.items():
                    same = narrow.nodes[i]
                    assert (node.feature, node.threshold) == (same.feature, same.threshold)
                    assert abs(node.prediction - same.prediction) < 1e-9
            found = wide.predict(df)
            assert found.columns == ["label", "features", "prediction"]


def test_a_tree_with_small_histograms_is_the_same(spark, monkeypatch):
    x, y = tree_frame(spark, [8, 12, 3], 2)
    df = frame(spark, x, y)
    expected = fit_tree(df).to_df(spark).collect()
    for cells in (9, 40):
        monkeypatch.setattr(histograms, "HISTOGRAM_CELLS", cells)
        for module in (bins, histograms):
            monkeypatch.setattr(module, "CHUNK_VALUES", 7)
        assert fit_tree(df).to_df(spark).collect() == expected


def test_no_task_holds_more_cells_than_it_may():
    rng = np.random.default_rng(1)
    number, value = rng.integers(0, 10**12, 5000), rng.normal(size=5000)
    number[::3] = number[0]
    sums, found, limit = histograms.CellSums(10**12, 300), {}, 300
    assert sums.dense is None

    def put(full):
        assert len(full[0]) <= 2 * limit
        for k, v in zip(*full):
            found[k] = found.get(k, 0.0) + v

    for start in range(0, 5000, 700):
        for full in sums.add(number[start : start + 700], value[start : start + 700]):
            put(full)
        assert len(sums.number) <= limit // 2
    for full in sums.take():
        put(full)
    assert found.keys() == set(number)
    assert found[number[0]] == pytest.approx(value[number == number[0]].sum())


def sparse_frame(spark, rows, dim, filled, seed, digits=None):
    """A few entries in each row; the label depends on three of the features."""
    r = np.random.default_rng(seed)
    x = np.zeros((rows, dim))
    for row in x:
        at = r.choice(dim, filled, replace=False)
        row[at] = r.normal(size=filled) if digits is None else r.integers(-digits, digits, filled)
    x[:, 3] = np.where(r.random(rows) < 0.5, r.integers(1, 9, rows), 0)
    y = (x[:, 3] > 4) * 1.0 + (x[:, 5] < 0) * (x[:, dim - 1] <= 0)
    return x, y


@pytest.mark.parametrize("digits, dim", [(3, 70), (None, 8), (40, 8)])
def test_a_sparse_tree_is_the_dense_one(spark, digits, dim, monkeypatch):
    monkeypatch.setattr(trees, "NARROW", dim // 4 - 1)
    x, y = sparse_frame(spark, 600, dim, 3 if dim == 8 else 9, 4, digits)
    # Whole numbers, so that equal labels leave no variance to split.
    for labels, impurity in ((y, "gini"), (y * 3 - 1 + (x[:, 2] > 0), "variance")):
        df = frame(spark, x, labels)
        dense, sparse = fit_tree(df, impurity), fit_tree(as_sparse(df), impurity)
        assert sparse.nodes.keys() == dense.nodes.keys() and dense.depth >= 3
        for i, node in dense.nodes.items():
            same = sparse.nodes[i]
            assert same.prediction == pytest.approx(node.prediction, abs=1e-9)
            assert (node.feature, node.threshold, node.rows) == (same.feature, same.threshold, same.rows)
        a = dense.predict(df).select("prediction").collect()
        assert a == dense.predict(as_sparse(df)).select("prediction").collect()


def test_sketched_thresholds_are_near_exact_ones(spark, monkeypatch):
    x, y = sparse_frame(spark, 2000, 8, 3, 6)
    df = as_sparse(frame(spark, x, y))
    points = df.select(kernel_column(df, "features").alias("x"))
    exact = bins.sparse_cuts(points, 8, 2000, 32)
    monkeypatch.setattr(bins, "EXACT_VALUES", 50)
    near = bins.sparse_cuts(points, 8, 2000, 32)
    for j in (0, 5, 7):
        a, b = (c.flat[c.start[j] : c.start[j + 1]] for c in (exact, near))
        rank = [np.searchsorted(np.sort(x[:, j]), t) / 2000 for t in (a, b)]
        assert abs(len(a) - len(b)) <= 1 and np.abs(rank[0][-1] - rank[1][-1]) < 0.01
    assert np.array_equal(exact.flat[exact.start[3] : exact.start[4]], near.flat[near.start[3] : near.start[4]])


def test_a_tree_of_a_hundred_thousand_sparse_features(spark, monkeypatch):
    dim, r = 100_000, np.random.default_rng(2)

    def refuse(*_):
        raise AssertionError("rows were made dense")

    monkeypatch.setattr(bins, "matrices", refuse)
    monkeypatch.setattr(histograms, "HISTOGRAM_CELLS", 20_000)
    rows, narrow, labels = [], [], []
    for i in range(800):
        own = {int(j): float(r.integers(1, 50)) for j in r.integers(100, dim, 40)}
        signal = r.integers(0, 4, 2) * 1.0
        own |= {7: signal[0], 99_999: signal[1]}
        label = float(signal[0] > 1) + float(signal[1] > 2)
        rows.append((label, Vectors.sparse(dim, sorted(own.items()))))
        narrow.append(signal)
        labels.append(label)
    df = spark.createDataFrame(rows, ["label", "features"])
    model = fit_tree(df, max_depth=2)
    monkeypatch.undo()
    small = fit_tree(frame(spark, np.array(narrow), np.array(labels)), max_depth=2)
    assert [(n.id, {7: 0, 99_999: 1}.get(n.feature), n.threshold, n.rows) for n in model.nodes.values()] == [
        (n.id, n.feature, n.threshold, n.rows) for n in small.nodes.values()
    ]
    assert model.predict(df).filter("label <> prediction").count() == 0


def test_a_tree_takes_many_classes(spark, monkeypatch):
    x = np.arange(110.0).repeat(2).reshape(-1, 1)
    model = fit_tree(frame(spark, x, x[:, 0]), max_depth=2, max_bins=128)
    assert abs(model.nodes[1].impurity - (1 - 1 / 110)) < 1e-12
    assert model.depth == 2
    many = spark.range(50_000).select(
        F.col("id").cast("double").alias("label"), F.array((F.col("id") % 8).cast("double")).alias("features")
    )
    model = fit_tree(many, max_depth=2)
    assert model.depth == 2 and model.nodes[2].rows + model.nodes[3].rows == 50_000
    assert model.nodes[1].prediction == 0.0 and abs(model.nodes[1].impurity - (1 - 1 / 50_000)) < 1e-9
    monkeypatch.setattr(trees, "MOST_CLASSES", 100)
    with pytest.raises(ValueError, match="classes"):
        fit_tree(many)


def test_a_deep_tree_predicts(spark, monkeypatch):
    x = np.arange(3000.0).reshape(-1, 1)
    y = (np.arange(3000) * 7919 % 13 > 5).astype(float)
    df = frame(spark, x, y)
    model = fit_tree(df, max_depth=16, max_bins=3000)
    assert model.depth > 10
    rows = [(0.0, r.tolist()) for r in x[::7]] + [(0.0, None), (0.0, []), (0.0, [None]), (0.0, [float("nan")])]
    odd = spark.createDataFrame(rows, "label double, features array<double>")
    walked = model.predict(odd).collect()
    monkeypatch.setattr(trees, "CASE_DEPTH", 99)
    assert [r["prediction"] for r in walked] == [r["prediction"] for r in model.predict(odd).collect()]
    monkeypatch.setattr(trees, "CASE_DEPTH", 0)
    x, y = sparse_frame(spark, 300, 70, 9, 4, 5)
    df = as_sparse(frame(spark, x, y))
    model = fit_tree(df, "variance")
    walked = model.predict(df).collect()
    monkeypatch.setattr(trees, "CASE_DEPTH", 99)
    monkeypatch.setattr(trees, "NARROW", 99)
    assert walked == model.predict(df).collect()


def test_tree_thresholds_are_midpoints_up_to_the_number_of_bins(spark):
    x = np.arange(100.0).repeat(3).reshape(-1, 1)
    model = fit_tree(frame(spark, x, (x[:, 0] >= 98).astype(float)), max_bins=128)
    assert model.nodes[1].threshold == 97.5


def test_a_tree_refuses_nulls(spark):
    kind = "label double, features array<double>"
    for bad in ((None, [1.0]), (1.0, None), (1.0, [None]), (1.0, [float("nan")])):
        df = spark.createDataFrame([(0.0, [1.0]), bad], kind)
        for impurity in ("gini", "variance"):
            with pytest.raises(ValueError):
                fit_tree(df, impurity)


def test_a_level_of_a_tree_has_one_wide_shuffle(spark):
    cells = spark.createDataFrame(
        [([0, 1, 2], 0, 1.0, 0.0, 0.0)], "bins array<int>, c int, n double, s double, q double"
    )
    root = {1: trees.Node(1, 0, 1.0, 0.0, 0.5)}
    histogram = trees.bin_histogram(cells, root, [1], 3, 12, 2, True)
    plan = trees.best_splits(histogram, 12, 2, True)._jdf.queryExecution().executedPlan().toString()
    # The histogram by node and feature, then one best row per task and node.
    assert plan.count("Exchange hashpartitioning(node") == 2
    assert plan.count("Exchange") == 2


def test_splits(spark):
    df = spark.range(1000)
    for parts in (1, 3):
        training, test = hash_split(df.repartition(parts), "id", [0.6, 0.4])
        assert training.count() + test.count() == 1000 and 550 < training.count() < 650
        assert training.intersect(test).count() == 0
    three = hash_split(df, "id", [1, 1, 2])
    assert all(abs(p.count() - n) < 50 for p, n in zip(three, (250, 250, 500)))
    for step in (10, 50, 100):
        strided = spark.range(1000).select((F.col("id") * step).alias("id"))
        training, test = hash_split(strided, "id", [0.6, 0.4])
        assert 550 < training.count() < 650
    many = hash_split(spark.range(100_000), "id", [0.999, 0.001])
    assert 50 < many[1].count() < 200
    nulls = spark.createDataFrame([(None,), (1,), (2,)], "id long")
    assert sum(p.count() for p in hash_split(nulls, "id", [0.6, 0.4])) == 3
    a, b = random_split(df, [0.6, 0.4], 11)
    assert a.count() + b.count() == 1000


@pytest.mark.parametrize("dim", [30, 80, 10_000])
def test_sparse_kmeans_far_from_zero(spark, dim):
    """Values near a million that differ by about one: the cost is that of dense rows."""
    r = np.random.default_rng(8)
    x = np.zeros((200, dim))
    x[:, :30] = 1e6 + r.normal(scale=0.1, size=(200, 30)) + (np.arange(200) % 2)[:, None]
    centres = np.stack([x[0], x[1]])
    rows = [(Vectors.sparse(dim, list(range(30)), row[:30].tolist()),) for row in x]
    df = spark.createDataFrame(rows, ["features"])
    model = fit_kmeans(df, 2, centres=centres)
    expected = np.stack([x[0::2].mean(axis=0), x[1::2].mean(axis=0)])
    assert np.abs(model.centres - expected).max() < 1e-8
    nearest = np.stack([np.square(x - c).sum(axis=1) for c in expected], axis=1)
    assert model.cost(df).first()["value"] == pytest.approx(nearest.min(axis=1).sum(), rel=1e-7)
    assert [r["prediction"] for r in model.predict(df).collect()] == nearest.argmin(axis=1).tolist()


def test_sums_reach_the_driver_by_groups(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_CELLS", 5)
    df = spark.range(1000).repartition(23)

    def kernel(batch):
        return np.full((3, 4), float(batch.num_rows)) + np.arange(12.0).reshape(3, 4) * batch.num_rows

    for _ in range(2):
        got = vectors.partition_sums(df, kernel, (3, 4))
        assert np.array_equal(got, 1000 * (1 + np.arange(12.0).reshape(3, 4)))


def test_clashing_names_and_wide_nulls(spark):
    x = np.arange(160.0).reshape(2, 80)
    wide = frame(spark, x, [0.0, 1.0])
    null = spark.createDataFrame([(0.0, None)], wide.schema)
    for df in (wide.union(null), as_sparse(wide).union(as_sparse(wide).select("label", F.lit(None)))):
        with pytest.raises(ValueError):
            fit_naive_bayes(df)
    model = fit_naive_bayes(wide)
    named = wide.withColumn("_scores", F.lit(1)).withColumn("_nearest", F.lit(2))
    assert model.predict(named).select("_scores", "_nearest").distinct().collect() == [(1, 2)]
    near = fit_kmeans(wide, 2, centres=x).predict(named)
    assert near.select("_scores", "_nearest").distinct().collect() == [(1, 2)]


def test_rows_are_split_alike_on_any_partitioning(spark, monkeypatch):
    from fitgrain.operators import splits

    monkeypatch.setattr(splits, "EQUAL_ROWS", 40)
    df = spark.range(1500).select(
        F.when(F.col("id") > 4, F.col("id") % 7).alias("a"),
        F.when(F.col("id") % 3 > 0, F.lit("x")).alias("b"),
        F.array(F.lit(0.5), (F.col("id") % 2).cast("double")).alias("n"),
    )
    df = df.withColumn("v", array_to_vector("n")).withColumn("part", F.lit(3))
    parts = [[sorted(map(str, p.collect())) for p in row_split(df.repartition(n), [0.6, 0.4])] for n in (1, 3, 8)]
    assert parts[0] == parts[1] == parts[2]
    assert sorted(parts[0][0] + parts[0][1]) == sorted(map(str, df.collect()))
    assert 840 < len(parts[0][0]) < 960
    other = row_split(df, [0.6, 0.4], seed=12)[0]
    assert sorted(map(str, other.collect())) != parts[0][0]
    assert [p.count() for p in row_split(df.limit(0), [1, 1, 1])] == [0, 0, 0]
    assert dict(row_split(df, [1])[0].dtypes) == dict(df.dtypes)


def test_equal_rows_are_dealt_out_by_many_tasks_unsorted(spark, monkeypatch):
    from fitgrain.operators import splits

    monkeypatch.setattr(splits, "EQUAL_ROWS", 40)
    df = spark.range(4000).select((F.col("id") % 2).alias("k"), F.lit("x").alias("s"))
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    parts = row_split(df, [0.6, 0.4])
    for part in parts:
        # 100 blocks over 8 tasks, each with a file in every part's folder.
        files = part.groupBy(F.input_file_name()).count().collect()
        assert len(files) == 8
        assert max(f["count"] for f in files) < part.count() / 2
    assert sum(p.count() for p in parts) == 4000
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before


def test_rows_of_exact_types_are_split_as_by_their_json(spark):
    df = spark.range(600).select(
        F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("k"),
        F.when(F.col("id") % 4 > 0, (F.col("id") % 2).cast("string")).alias("s"),
    )
    # The draws from each row's JSON, as the SQL of split_by_rows has them.
    text = F.to_json(F.struct("k", "s"), {"ignoreNullFields": "false"})
    digests = df.groupBy("k", "s", F.md5(text.cast("binary")).alias("m")).count()
    rows = digests.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("count") - 1)))
    draws = rows.select("k", "s", F.conv(F.substring(
        F.md5(F.concat_ws("|", F.lit("11"), "m", F.col("nth").cast("string")).cast("binary")), 1, 8
    ), 16, 10).cast("bigint").alias("draw"))
    first, second = row_split(df, [0.6, 0.4])
    edge = round((1 << 32) * 0.6)
    for part, expected in ((first, draws.filter(F.col("draw") < edge)), (second, draws.filter(F.col("draw") >= edge))):
        assert sorted(map(str, part.collect())) == sorted(map(str, expected.select("k", "s").collect()))
