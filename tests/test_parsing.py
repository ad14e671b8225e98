import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fitgrain.functions import parsing
from fitgrain.session import fresh_path
from fitgrain.sources.text import read_edge_list, read_libsvm, read_lines, stage_dataset


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def rows(df):
    return [tuple(row) for row in df.collect()]


def test_labelled_csv_drops_trailing_separators(spark):
    parsed = parsing.parse_labelled_csv(lines(spark, "1,2,", "0,1.5,-3e2,4", "7"))
    assert rows(parsed) == [(1.0, [2.0]), (0.0, [1.5, -300.0, 4.0]), (7.0, [])]


@pytest.mark.parametrize("bad", ["", "1,,2", "1,x", "x,1"])
@pytest.mark.parametrize("ansi", ["true", "false"])
def test_labelled_csv_rejects_what_is_not_a_number(spark, bad, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(PySparkException, match="not a number"):
            parsing.parse_labelled_csv(lines(spark, "1,2", bad)).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_nested(spark):
    parsed = parsing.parse_labelled_nested(lines(spark, "-0.43,-1.6 2 -1.8", "1,0 "))
    assert rows(parsed) == [(-0.43, [-1.6, 2.0, -1.8]), (1.0, [0.0])]
    with pytest.raises(PySparkException):
        parsing.parse_labelled_nested(lines(spark, "1")).collect()


def test_spaces_first_and_all(spark):
    given = lines(spark, "1 0 2.5 0")
    assert rows(parsing.parse_labelled_spaces(given)) == [(1.0, [0.0])]
    assert rows(parsing.parse_labelled_spaces(given, "all")) == [(1.0, [0.0, 2.5, 0.0])]
    with pytest.raises(ValueError):
        parsing.parse_labelled_spaces(given, "some")


def test_vectors_and_pairs(spark):
    assert rows(parsing.parse_vectors(lines(spark, "0.0 0.1 9"))) == [([0.0, 0.1, 9.0],)]
    parsed = parsing.parse_id_name(lines(spark, "1,alice,Alice A", "7,bob"))
    assert rows(parsed) == [(1, "alice"), (7, "bob")]
    for bad in ("x,alice", "1", " 3,alice"):
        with pytest.raises(PySparkException):
            parsing.parse_id_name(lines(spark, bad)).collect()


def test_edges(spark):
    given = lines(spark, "# comment", "", "2 1", "3\t7", "3 9 extra", "3 9", "5  5")
    assert rows(parsing.parse_edges(given)) == [(2, 1), (3, 7), (3, 9), (3, 9), (5, 5)]
    for bad in ("3", "3 ", " 3 4", "a b"):
        with pytest.raises(PySparkException, match="not an integer"):
            parsing.parse_edges(lines(spark, bad)).collect()


def test_separator_is_literal(spark):
    df = lines(spark, "1|2||").select(parsing.split_fields(F.col("value"), "|").alias("f"))
    assert df.first().f == ["1", "2"]


def test_text_and_edge_files(spark):
    path = stage_dataset(lines(spark, "# c", "1 2", "2 1"), fresh_path(spark, "edges"), "text")
    assert read_lines(spark, path).count() == 3
    assert sorted(rows(read_edge_list(spark, path))) == [(1, 2), (2, 1)]


def test_libsvm(spark):
    given = lines(spark, "1 1:0.5 3:2", "-1 2:1", "# x", "", "0 1:1.5 4:1")
    path = stage_dataset(given, fresh_path(spark, "libsvm"), "text")
    for dimension in (None, 4):
        found = read_libsvm(spark, path, dimension).collect()
        assert sorted(row.label for row in found) == [-1.0, 0.0, 1.0]
        assert {row.features.size for row in found} == {4}


def test_staging_refuses_an_existing_target(spark):
    df = spark.range(3)
    path = stage_dataset(df, fresh_path(spark, "stage"))
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(PySparkException):
        stage_dataset(df, path)


def test_parsers_apply_to_a_stream(spark):
    path = stage_dataset(lines(spark, "1,2", "0,3"), fresh_path(spark, "stream"), "text")
    stream = spark.readStream.schema("value string").text(path)
    query = (
        parsing.parse_labelled_csv(stream)
        .writeStream.format("memory")
        .queryName("parsed_lines")
        .option("checkpointLocation", fresh_path(spark, "stream-state"))
        .trigger(availableNow=True)
        .start()
    )
    try:
        query.awaitTermination(120)
        assert spark.table("parsed_lines").count() == 2
    finally:
        query.stop()
