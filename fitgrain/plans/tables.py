"""Queries over the given tables, one per operator or program.

Text inputs are lines that Spark builds from table columns, so every query's work
grows with the tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitgrain.functions import parsing
from fitgrain.functions.vectors import unpack
from fitgrain.operators.kmeans import KMeansModel, fit_kmeans
from fitgrain.operators.linear import LinearModel, fit_least_squares, fit_svm
from fitgrain.operators.metrics import (
    accuracy,
    area_under_roc,
    correct,
    mean_squared_error,
    misclassified,
    training_error,
)
from fitgrain.operators.naive_bayes import BayesModel, fit_naive_bayes
from fitgrain.operators.pagerank import out_degrees, pagerank, ranks_by_name, vertices
from fitgrain.operators.splits import hash_split, random_split, row_split
from fitgrain.operators.trees import TreeModel, fit_tree
from fitgrain.plans import programs
from fitgrain.session import fresh_path
from fitgrain.sources.text import read_libsvm, read_lines, stage_dataset

LETTERS = ["e", "n", "o", "u", "s", "l"]
PART_CENTRES = [[0.25, 0.025], [0.75, 0.075]]
DIGITS = 6


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = DIGITS) -> DataFrame:
    return df.withColumns({name: F.round(F.col(name), digits) for name in columns})


def whole(name: str) -> Column:
    return F.col(name).cast("bigint").cast("string")


# Lines and what the parsers make of them.


def csv_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``linenumber,quantity,partkey,suppkey``; every seventh line number ends in a comma."""
    parts = [whole(c) for c in ("l_linenumber", "l_quantity", "l_partkey", "l_suppkey")]
    end = F.when(F.col("l_linenumber") == 7, F.lit(",")).otherwise(F.lit(""))
    return table(spark, folder, "lineitem").select(
        F.concat(F.concat_ws(",", *parts), end).alias("value")
    )


def space_lines(spark: SparkSession, folder: str) -> DataFrame:
    parts = [whole(c) for c in ("l_linenumber", "l_quantity", "l_suppkey")]
    return table(spark, folder, "lineitem").select(F.concat_ws(" ", *parts).alias("value"))


def edge_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order and supplier keys, with comment and empty lines among them."""
    gap = F.when(F.col("l_linenumber") == 1, F.lit("\t")).otherwise(F.lit(" "))
    pair = F.concat(whole("l_orderkey"), gap, whole("l_suppkey"))
    line = (
        F.when(F.col("l_linenumber") == 7, F.concat(F.lit("# "), pair))
        .when(F.col("l_linenumber") == 6, F.lit(""))
        .otherwise(pair)
    )
    return table(spark, folder, "lineitem").select(line.alias("value"))


def spread(points: DataFrame, count: int) -> DataFrame:
    """Array features as columns ``f1..``, with their number."""
    lead = [c for c in points.columns if c != "features"]
    return points.select(
        *lead,
        F.size("features").cast("int").alias("n_features"),
        *[F.get("features", F.lit(j)).alias(f"f{j + 1}") for j in range(count)],
    )


def parse_csv(spark: SparkSession, folder: str) -> DataFrame:
    return spread(parsing.parse_labelled_csv(csv_lines(spark, folder)), 3)


def parse_nested(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(
        F.concat_ws(
            ",", whole("l_linenumber"), F.concat_ws(" ", whole("l_quantity"), whole("l_suppkey"))
        ).alias("value")
    )
    return spread(parsing.parse_labelled_nested(lines), 2)


def parse_space_first(spark: SparkSession, folder: str) -> DataFrame:
    return spread(parsing.parse_labelled_spaces(space_lines(spark, folder), "first"), 1)


def parse_space_all(spark: SparkSession, folder: str) -> DataFrame:
    return spread(parsing.parse_labelled_spaces(space_lines(spark, folder), "all"), 2)


def parse_vector(spark: SparkSession, folder: str) -> DataFrame:
    return spread(parsing.parse_vectors(space_lines(spark, folder)), 3)


def user_lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.concat_ws(",", whole("c_custkey"), "c_name", "c_mktsegment").alias("value")
    )


def parse_pair(spark: SparkSession, folder: str) -> DataFrame:
    return parsing.parse_id_name(user_lines(spark, folder))


def parse_edges(spark: SparkSession, folder: str) -> DataFrame:
    return parsing.parse_edges(edge_lines(spark, folder))


# Sources and staging.


def stage_lines(spark: SparkSession, lines: DataFrame, name: str) -> str:
    return stage_dataset(lines.select("value"), fresh_path(spark, name), "text")


def text_scan(spark: SparkSession, folder: str) -> DataFrame:
    path = stage_lines(spark, user_lines(spark, folder), "users")
    return parsing.parse_id_name(read_lines(spark, path))


def libsvm(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse lines staged as text and read back; zero entries are left out."""
    label = F.when(F.col("l_returnflag") == "R", "1").when(
        F.col("l_returnflag") == "A", "-1"
    ).otherwise("0")
    discount = F.round(F.col("l_discount") * 100).cast("bigint")
    entries = F.array(
        label,
        F.concat(F.lit("1:"), whole("l_quantity")),
        F.when(discount != 0, F.concat(F.lit("3:"), discount.cast("string"))),
        F.concat(F.lit("4:"), whole("l_linenumber")),
    )
    lines = table(spark, folder, "lineitem").select(
        F.array_join(entries, " ").alias("value")
    )
    points = read_libsvm(spark, stage_lines(spark, lines, "libsvm"))
    return spread(points.withColumn("features", vector_to_array("features")), 4)


def stage(spark: SparkSession, folder: str) -> DataFrame:
    path = stage_dataset(table(spark, folder, "customer"), fresh_path(spark, "customer"))
    return spark.read.parquet(path)


def split_by_key(spark: SparkSession, folder: str) -> DataFrame:
    parts = hash_split(table(spark, folder, "documents").select("doc_id"), "doc_id", [0.6, 0.4])
    numbered = [df.select("doc_id", F.lit(i).alias("part")) for i, df in enumerate(parts)]
    return numbered[0].unionAll(numbered[1])


def split_by_rows(spark: SparkSession, folder: str) -> DataFrame:
    """How many of the equal rows of a table without a key go to each part."""
    rows = table(spark, folder, "orders").select(
        (F.col("o_custkey") % 50).alias("k"), F.col("o_orderstatus").alias("s")
    )
    first, second = row_split(rows, [0.6, 0.4])
    parts = first.withColumn("part", F.lit(0)).unionByName(second.withColumn("part", F.lit(1)))
    return parts.groupBy("part", "k", "s").agg(F.count(F.lit(1)).alias("n"))


def split_seeded(spark: SparkSession, folder: str) -> DataFrame:
    """Both parts of the seeded split: every row once, whichever part it is in."""
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    first, second = random_split(docs, [0.6, 0.4])
    return first.unionAll(second)


# Naive Bayes: the language of a document from its letter counts.


def letter_points(spark: SparkSession, folder: str) -> DataFrame:
    counts = [
        (F.length("text") - F.length(F.replace(F.col("text"), F.lit(c), F.lit("")))).cast("double")
        for c in LETTERS
    ]
    return table(spark, folder, "documents").select(
        "doc_id", F.col("lang").alias("label"), F.array(*counts).alias("features")
    )


def bayes(spark: SparkSession, folder: str) -> tuple[BayesModel, DataFrame]:
    training, test = hash_split(letter_points(spark, folder), "doc_id", [0.6, 0.4])
    return fit_naive_bayes(training, 1.0, dim=len(LETTERS)), test


def nb_model(spark: SparkSession, folder: str) -> DataFrame:
    model, _ = bayes(spark, folder)
    return rounded(model.to_df(spark), "pi", "theta")


def nb_predict(spark: SparkSession, folder: str) -> DataFrame:
    model, test = bayes(spark, folder)
    return model.predict(test).select("doc_id", "label", "prediction")


def nb_correct(spark: SparkSession, folder: str) -> DataFrame:
    return correct(nb_predict(spark, folder)).select("doc_id", "label")


def nb_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(accuracy(nb_predict(spark, folder)), "value")


# Gradient models on lineitem.


def price_points(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        (F.col("l_extendedprice") / 100000).alias("label"),
        F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10).alias("features"),
    )


def margin_points(spark: SparkSession, folder: str, dim: int = 2) -> DataFrame:
    values = [F.col("l_quantity") * 2 / 50 - 1, F.col("l_discount") * 2 * 10 - 1][:dim]
    return table(spark, folder, "lineitem").select(
        F.when(F.col("l_extendedprice") > 50000, 1.0).otherwise(0.0).alias("label"),
        F.array(*values).alias("features"),
        (F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("key"),
    )


def weights(model: LinearModel, spark: SparkSession) -> DataFrame:
    return rounded(model.to_df(spark), "weight")


def linreg_weights(spark: SparkSession, folder: str) -> DataFrame:
    return weights(fit_least_squares(price_points(spark, folder), 20, dim=2), spark)


def linreg_scored(spark: SparkSession, folder: str) -> DataFrame:
    points = price_points(spark, folder)
    return fit_least_squares(points, 20, dim=2).predict(points)


def linreg_predict(spark: SparkSession, folder: str) -> DataFrame:
    scored = spread(linreg_scored(spark, folder), 2).drop("n_features")
    return rounded(scored, "prediction")


def linreg_mse(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(mean_squared_error(linreg_scored(spark, folder), form="sum"), "value")


def svm20_weights(spark: SparkSession, folder: str) -> DataFrame:
    return weights(fit_svm(margin_points(spark, folder), 20, dim=2), spark)


def svm20_scored(spark: SparkSession, folder: str) -> DataFrame:
    points = margin_points(spark, folder)
    return fit_svm(points, 20, dim=2).predict(points)


def svm20_error(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(training_error(svm20_scored(spark, folder)), "value")


def svm20_misclassified(spark: SparkSession, folder: str) -> DataFrame:
    wrong = spread(misclassified(svm20_scored(spark, folder)), 2)
    return rounded(wrong.drop("n_features"), "f1", "f2")


def svm_first_feature(spark: SparkSession, folder: str) -> DataFrame:
    """The one-feature SVM, from lines that hold both features."""
    points = margin_points(spark, folder)
    lines = points.select(
        F.concat_ws(
            " ", F.col("label").cast("string"), F.col("features").cast("array<string>")
        ).alias("value")
    )
    parsed = parsing.parse_labelled_spaces(lines, "first")
    return rounded(training_error(fit_svm(parsed, 20, dim=1).predict(parsed)), "value")


def svm100(spark: SparkSession, folder: str) -> DataFrame:
    training, test = hash_split(margin_points(spark, folder), "key", [0.6, 0.4])
    model = fit_svm(training, 100, dim=2).clear_threshold()
    return model.predict(test, output="score")


def svm100_margin(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(svm100(spark, folder).select("key", "label", "score"), "score")


def svm100_auc(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(area_under_roc(svm100(spark, folder)), "value")


def auc_ties(spark: SparkSession, folder: str) -> DataFrame:
    scored = table(spark, folder, "lineitem").select(
        F.col("l_linenumber").cast("double").alias("score"),
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("label"),
    )
    return rounded(area_under_roc(scored), "value")


# k-means.


def part_points(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        "p_partkey",
        F.array(F.col("p_size") / 50, (F.col("p_retailprice") - 900) / 1000).alias("features"),
    )


def part_clusters(spark: SparkSession, folder: str) -> tuple[KMeansModel, DataFrame]:
    points = part_points(spark, folder)
    return fit_kmeans(points, 2, 20, centres=PART_CENTRES), points


def kmeans_centers(spark: SparkSession, folder: str) -> DataFrame:
    model, _ = part_clusters(spark, folder)
    return rounded(model.to_df(spark), "x")


def kmeans_assign(spark: SparkSession, folder: str) -> DataFrame:
    model, points = part_clusters(spark, folder)
    return model.predict(points).select("p_partkey", F.col("prediction").alias("cluster"))


def kmeans_wssse(spark: SparkSession, folder: str) -> DataFrame:
    model, points = part_clusters(spark, folder)
    return rounded(model.cost(points), "value")


def kmeans_seeded_centers(spark: SparkSession, folder: str) -> DataFrame:
    """Centres from a seeded start."""
    model = fit_kmeans(part_points(spark, folder), 2, 20, seed=1)
    return rounded(model.to_df(spark), "x")


def embedding_clusters(spark: SparkSession, folder: str) -> tuple[KMeansModel, DataFrame]:
    points = table(spark, folder, "embeddings").select(
        "vec_id", F.col("embedding").alias("features")
    )
    first_two = points.filter(F.col("vec_id").isin(0, 1)).orderBy("vec_id").collect()
    centres = [row["features"] for row in first_two]
    return fit_kmeans(points, 2, 20, centres=centres), points


def kmeans_embeddings_centers(spark: SparkSession, folder: str) -> DataFrame:
    model, _ = embedding_clusters(spark, folder)
    return rounded(model.to_df(spark), "x")


def kmeans_embeddings_wssse(spark: SparkSession, folder: str) -> DataFrame:
    model, points = embedding_clusters(spark, folder)
    return rounded(model.cost(points), "value")


# Graphs.


def trade_edges(spark: SparkSession, folder: str) -> DataFrame:
    """One edge per line item, from the customer's nation to the supplier's."""
    lineitem = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders")
    customer = table(spark, folder, "customer")
    supplier = table(spark, folder, "supplier")
    return (
        lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("c_nationkey").cast("bigint").alias("src"),
            F.col("s_nationkey").cast("bigint").alias("dst"),
        )
    )


def supply_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Parts and suppliers linked both ways per line item; suppliers have negative ids."""
    pairs = table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("part"), (F.lit(-1) - F.col("l_suppkey")).alias("supplier")
    )
    return pairs.select(F.col("part").alias("src"), F.col("supplier").alias("dst")).unionAll(
        pairs.select("supplier", "part")
    )


def page_edges(spark: SparkSession, folder: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return table(spark, folder, "pages").select(
        F.col("page_id").cast("string").alias("src"), F.explode(links).alias("dst")
    )


def outdegree(spark: SparkSession, folder: str) -> DataFrame:
    return out_degrees(supply_edges(spark, folder))


def graph_vertices(spark: SparkSession, folder: str) -> DataFrame:
    return vertices(supply_edges(spark, folder))


def pagerank_trade(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(pagerank(trade_edges(spark, folder)), "rank")


def pagerank_names(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("username")
    )
    return rounded(ranks_by_name(pagerank(trade_edges(spark, folder)), names), "rank")


def pagerank_pages(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(pagerank(page_edges(spark, folder)), "rank")


def pagerank_supply(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(pagerank(supply_edges(spark, folder)), "rank")


# Trees.


def tree_points(spark: SparkSession, folder: str, label: str = "class") -> DataFrame:
    price = F.col("l_extendedprice")
    target = price if label == "price" else F.when(price > 50000, 1.0).otherwise(0.0)
    values = [
        F.floor(F.col("l_quantity") / 2).cast("double"),
        F.col("l_linenumber").cast("double"),
        F.round(F.col("l_discount") * 100),
    ]
    return table(spark, folder, "lineitem").select(
        target.alias("label"), F.array(*values).alias("features")
    )


def tree_scored(spark: SparkSession, folder: str, label: str) -> DataFrame:
    points = tree_points(spark, folder, label)
    model = fit_tree(points, "variance" if label == "price" else "gini", 5)
    return model.predict(points)


def tree_class_predict(spark: SparkSession, folder: str) -> DataFrame:
    return spread(tree_scored(spark, folder, "class"), 3).drop("n_features")


def tree_class_error(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(training_error(tree_scored(spark, folder, "class")), "value")


def tree_reg_predict(spark: SparkSession, folder: str) -> DataFrame:
    scored = spread(tree_scored(spark, folder, "price"), 3).drop("n_features")
    return rounded(scored, "prediction", digits=3)


def tree_reg_mse(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(mean_squared_error(tree_scored(spark, folder, "price")), "value", digits=1)


def root_split(model: TreeModel, spark: SparkSession, digits: int) -> DataFrame:
    nodes = model.to_df(spark).filter("id = 1").select("feature", "threshold", "gain")
    return rounded(nodes, "gain", digits=digits)


def best_split_gini(spark: SparkSession, folder: str) -> DataFrame:
    return root_split(fit_tree(tree_points(spark, folder), "gini", 1), spark, 9)


def best_split_variance(spark: SparkSession, folder: str) -> DataFrame:
    return root_split(fit_tree(tree_points(spark, folder, "price"), "variance", 1), spark, 1)


def best_split_wide(spark: SparkSession, folder: str) -> DataFrame:
    """The first split of 128 features for ten classes."""
    x = F.col("embedding").cast("array<double>")
    tenths = F.transform(x, lambda v: F.floor(v * 10.0).cast("double"))
    squares = F.transform(x, lambda v: F.floor(v * v * 200.0).cast("double"))
    points = table(spark, folder, "embeddings").select(
        F.col("label").cast("double").alias("label"), F.concat(tenths, squares).alias("features")
    )
    return root_split(fit_tree(points, "gini", 1), spark, 9)


def best_split_libsvm(spark: SparkSession, folder: str) -> DataFrame:
    """The first split of 120 sparse features, read from LIBSVM lines with three entries."""
    half = F.floor(F.col("l_quantity") / 2)
    entries = F.array(
        F.when(F.col("l_extendedprice") > 50000, "1").otherwise("0"),
        F.when(half != 0, F.concat_ws(":", 1 + F.col("l_partkey") % 90, half)),
        F.concat(F.lit("100:"), whole("l_linenumber")),
        F.concat((101 + F.col("l_suppkey") % 20).cast("string"), F.lit(":1")),
    )
    lines = table(spark, folder, "lineitem").select(F.array_join(entries, " ").alias("value"))
    points = read_libsvm(spark, stage_lines(spark, lines, "sparse-tree"))
    return root_split(fit_tree(points, "gini", 1), spark, 9)


# The end-to-end programs, on text staged from the tables.


def point_lines(points: DataFrame, outer: str, inner: str) -> DataFrame:
    values = F.array_join(F.col("features").cast("array<string>"), inner)
    return points.select(
        F.concat(F.col("label").cast("string"), F.lit(outer), values).alias("value")
    )


def program_tree_error(spark: SparkSession, folder: str) -> DataFrame:
    lines = point_lines(tree_points(spark, folder), ",", ",")
    path = stage_lines(spark, lines, "tree")
    return rounded(programs.tree_training_error(spark, path), "value")


def program_tree_mse(spark: SparkSession, folder: str) -> DataFrame:
    lines = point_lines(tree_points(spark, folder, "price"), ",", ",")
    path = stage_lines(spark, lines, "tree")
    return rounded(programs.tree_training_mse(spark, path), "value", digits=1)


def program_least_squares_mse(spark: SparkSession, folder: str) -> DataFrame:
    lines = point_lines(price_points(spark, folder), ",", " ")
    path = stage_lines(spark, lines, "regression")
    return rounded(programs.least_squares_training_mse(spark, path), "value")


def program_svm_error(spark: SparkSession, folder: str) -> DataFrame:
    lines = point_lines(margin_points(spark, folder), " ", " ")
    path = stage_lines(spark, lines, "svm")
    return rounded(programs.svm_training_error(spark, path), "value")


def split_by_margins(points: DataFrame, weights: list[float], seed: int) -> list[DataFrame]:
    x = unpack(points, "features", 2)
    key = F.round((x[0] + 1) * 25) * 100 + F.round((x[1] + 1) * 5)
    return hash_split(points, key, weights, seed)


def split_by_letters(points: DataFrame, weights: list[float], seed: int) -> list[DataFrame]:
    x = unpack(points, "features", len(LETTERS))
    key = sum((c * (j + 1) for j, c in enumerate(x)), F.lit(0.0))
    return hash_split(points, key, weights, seed)


def program_svm_auc(spark: SparkSession, folder: str) -> DataFrame:
    numbered = F.transform(
        "features", lambda x, j: F.concat((j + 1).cast("string"), F.lit(":"), x.cast("string"))
    )
    points = margin_points(spark, folder).withColumn("features", numbered)
    path = stage_lines(spark, point_lines(points, " ", " "), "libsvm")
    return rounded(programs.svm_area_under_roc(spark, path, split=split_by_margins), "value")


def program_naive_bayes_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    lines = point_lines(
        letter_points(spark, folder).withColumn(
            "label", (F.col("label") == "en").cast("double")
        ),
        ",",
        " ",
    )
    path = stage_lines(spark, lines, "bayes")
    return rounded(programs.naive_bayes_accuracy(spark, path, split=split_by_letters), "value")


def program_kmeans_cost(spark: SparkSession, folder: str) -> DataFrame:
    lines = part_points(spark, folder).select(
        F.array_join(F.col("features").cast("array<string>"), " ").alias("value")
    )
    path = stage_lines(spark, lines, "points")
    return rounded(programs.kmeans_cost(spark, path, centres=PART_CENTRES), "value")


def program_ranks_by_username(spark: SparkSession, folder: str) -> DataFrame:
    edges = trade_edges(spark, folder).select(F.concat_ws(" ", "src", "dst").alias("value"))
    users = table(spark, folder, "nation").select(
        F.concat_ws(",", whole("n_nationkey"), "n_name").alias("value")
    )
    ranked = programs.ranks_by_username(
        spark, stage_lines(spark, edges, "followers"), stage_lines(spark, users, "users")
    )
    return rounded(ranked, "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        parse_csv,
        parse_nested,
        parse_space_first,
        parse_space_all,
        parse_vector,
        parse_pair,
        parse_edges,
        text_scan,
        libsvm,
        stage,
        split_by_key,
        split_by_rows,
        split_seeded,
        nb_model,
        nb_predict,
        nb_correct,
        nb_accuracy,
        linreg_weights,
        linreg_predict,
        linreg_mse,
        svm20_weights,
        svm20_error,
        svm20_misclassified,
        svm_first_feature,
        svm100_margin,
        svm100_auc,
        auc_ties,
        kmeans_centers,
        kmeans_seeded_centers,
        kmeans_assign,
        kmeans_wssse,
        kmeans_embeddings_centers,
        kmeans_embeddings_wssse,
        outdegree,
        graph_vertices,
        pagerank_trade,
        pagerank_names,
        pagerank_pages,
        pagerank_supply,
        tree_class_predict,
        tree_class_error,
        tree_reg_predict,
        tree_reg_mse,
        best_split_gini,
        best_split_variance,
        best_split_wide,
        best_split_libsvm,
        program_tree_error,
        program_tree_mse,
        program_least_squares_mse,
        program_svm_error,
        program_svm_auc,
        program_naive_bayes_accuracy,
        program_kmeans_cost,
        program_ranks_by_username,
    )
}
