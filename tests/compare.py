"""Compare a query's rows with its SQL's rows on DuckDB, as a multiset."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')"
        )
    return connection


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(cell(row[i]) for i in order) for row in rows),
        key=lambda row: tuple(map(str, row)),
    )


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def spark_rows(df):
    return sorted(df.columns), normal([tuple(row) for row in df.collect()], df.columns)


def sql_rows(connection, sql):
    result = connection.execute(sql)
    columns = [entry[0] for entry in result.description]
    types = {name: str(kind) for name, kind in zip(columns, (d[1] for d in result.description))}
    return sorted(columns), normal(result.fetchall(), columns), types
