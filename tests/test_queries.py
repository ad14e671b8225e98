import pytest
from pyspark.sql import DataFrame

import __spark_entry__
from fitgrain.plans.oracles import SQL
from fitgrain.plans.tables import QUERIES
from tests import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_the_driver_sees_them_all():
    assert QUERIES.items() <= __spark_entry__.queries().items()
    assert SQL.items() <= __spark_entry__.oracle_sql().items()


def test_entry(spark):
    result = __spark_entry__.entry(spark)
    assert isinstance(result, DataFrame)
    assert result.columns == ["name", "value"]
    assert result.first().value > 0.9


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    columns, found = compare.spark_rows(QUERIES[name](spark, FOLDER))
    expected_columns, expected, _ = compare.sql_rows(duck, SQL[name])
    assert columns == expected_columns
    assert found == expected
