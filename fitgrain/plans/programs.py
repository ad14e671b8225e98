"""The end-to-end programs: read text, parse, fit, score, report.

Each takes paths and returns a DataFrame: one captioned number, or the ranked names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fitgrain.functions.parsing import (
    parse_id_name,
    parse_labelled_csv,
    parse_labelled_nested,
    parse_labelled_spaces,
    parse_vectors,
)
from fitgrain.operators.kmeans import fit_kmeans
from fitgrain.operators.linear import fit_least_squares, fit_svm
from fitgrain.operators.metrics import (
    accuracy,
    area_under_roc,
    mean_squared_error,
    training_error,
)
from fitgrain.operators.naive_bayes import fit_naive_bayes
from fitgrain.operators.pagerank import pagerank, ranks_by_name
from fitgrain.operators.splits import row_split
from fitgrain.operators.trees import fit_tree
from fitgrain.sources.text import read_edge_list, read_libsvm, read_lines

Split = Callable[[DataFrame, list[float], int], list[DataFrame]]


def tree_training_error(spark: SparkSession, path: str, max_depth: int = 5) -> DataFrame:
    """Classify ``label,f1,f2,...`` lines with a Gini tree; share of wrong training rows."""
    points = parse_labelled_csv(read_lines(spark, path))
    model = fit_tree(points, "gini", max_depth)
    return training_error(model.predict(points))


def tree_training_mse(spark: SparkSession, path: str, max_depth: int = 5) -> DataFrame:
    """Regress the same lines with a variance tree; mean squared training error."""
    points = parse_labelled_csv(read_lines(spark, path))
    model = fit_tree(points, "variance", max_depth)
    return mean_squared_error(model.predict(points))


def least_squares_training_mse(
    spark: SparkSession, path: str, iterations: int = 20
) -> DataFrame:
    """Fit ``label,f1 f2 ...`` lines by gradient descent; mean squared training error."""
    points = parse_labelled_nested(read_lines(spark, path))
    model = fit_least_squares(points, iterations)
    return mean_squared_error(model.predict(points), form="sum")


def svm_training_error(
    spark: SparkSession, path: str, iterations: int = 20, features: str = "first"
) -> DataFrame:
    """Linear SVM on ``label f1 f2 ...`` lines; share of wrong training rows."""
    points = parse_labelled_spaces(read_lines(spark, path), features)
    model = fit_svm(points, iterations)
    return training_error(model.predict(points))


def svm_area_under_roc(
    spark: SparkSession,
    path: str,
    iterations: int = 100,
    seed: int = 11,
    split: Split = row_split,
) -> DataFrame:
    """Linear SVM on 60% of a LIBSVM file; area under the ROC curve on the other 40%.

    ``split`` takes the points, the weights and the seed.
    """
    points = read_libsvm(spark, path)
    training, test = split(points, [0.6, 0.4], seed)
    model = fit_svm(training, iterations).clear_threshold()
    return area_under_roc(model.predict(test, output="score"))


def naive_bayes_accuracy(
    spark: SparkSession,
    path: str,
    smoothing: float = 1.0,
    seed: int = 11,
    split: Split = row_split,
) -> DataFrame:
    """Naive Bayes on 60% of ``label,f1 f2 ...`` lines; accuracy on the other 40%.

    ``split`` takes the points, the weights and the seed.
    """
    points = parse_labelled_nested(read_lines(spark, path))
    training, test = split(points, [0.6, 0.4], seed)
    model = fit_naive_bayes(training, smoothing)
    return accuracy(model.predict(test))


def kmeans_cost(
    spark: SparkSession,
    path: str,
    k: int = 2,
    iterations: int = 20,
    seed: int = 1,
    centres: list[list[float]] | None = None,
) -> DataFrame:
    """k-means on ``x1 x2 ...`` lines; within-set sum of squared errors.

    It starts from ``centres``, or from seeded ones.
    """
    points = parse_vectors(read_lines(spark, path))
    return fit_kmeans(points, k, iterations, seed=seed, centres=centres).cost(points)


def ranks_by_username(
    spark: SparkSession, edges_path: str, users_path: str, tolerance: float = 0.0001
) -> DataFrame:
    """PageRank of a follower list, joined with ``id,name`` lines."""
    ranks = pagerank(read_edge_list(spark, edges_path), tolerance)
    users = parse_id_name(read_lines(spark, users_path))
    return ranks_by_name(ranks, users)
