"""Numeric text to typed columns, as Catalyst expressions.

Bad input fails the job whatever the session's ANSI setting is: a field that is
not a number raises instead of turning into null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_double(text: Column) -> Column:
    """Text to double; anything that is not a number raises."""
    message = F.concat(F.lit("not a number: "), F.coalesce(text, F.lit("missing field")))
    return F.coalesce(text.try_cast("double"), F.raise_error(message).cast("double"))


def to_long(text: Column) -> Column:
    """Text of digits with an optional sign to bigint; anything else, spaces included, raises."""
    digits = F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint"))
    message = F.concat(F.lit("not an integer: "), F.coalesce(text, F.lit("missing field")))
    return F.coalesce(digits, F.raise_error(message).cast("bigint"))


def split_fields(text: Column, separator: str) -> Column:
    """Split on a literal separator and drop trailing empty fields.

    Spark's own split keeps trailing empties, which would make ``1,2,`` fail the
    numeric cast.
    """
    literal = "\\Q" + separator + "\\E"
    return F.split(F.regexp_replace(text, f"(?:{literal})+$", ""), literal)


def field(fields: Column, position: int) -> Column:
    """Zero-based field, null when the line is too short."""
    return F.get(fields, F.lit(position))


def tail(fields: Column) -> Column:
    """All elements but the first."""
    return F.slice(fields, F.lit(2), F.greatest(F.size(fields) - 1, F.lit(0)))


def with_numbers(lines: DataFrame, fields: Column, *others: Column) -> DataFrame:
    """Fields as ``numbers array<double>``; a missing or non-numeric field raises.

    The cast of a whole array is generated code and runs once, in a step of its own
    below the check.
    """
    cast = lines.select(
        fields.alias("fields"), fields.try_cast("array<double>").alias("numbers"), *others
    )
    numbers = F.col("numbers")
    bad = numbers.isNull() | F.exists(numbers, lambda number: number.isNull())
    shown = F.coalesce(F.array_join("fields", "|"), F.lit("missing field"))
    message = F.concat(F.lit("not a number among: "), shown)
    checked = F.when(bad, F.raise_error(message).cast("array<double>")).otherwise(numbers)
    return cast.withColumn("numbers", checked).drop("fields")


def parse_labelled_csv(lines: DataFrame, column: str = "value") -> DataFrame:
    """``label,f1,f2,...`` to ``label double, features array<double>``."""
    return _label_first(lines, split_fields(F.col(column), ","))


def parse_labelled_nested(lines: DataFrame, column: str = "value") -> DataFrame:
    """``label,f1 f2 ...`` to ``label double, features array<double>``."""
    outer = split_fields(F.col(column), ",")
    label = field(outer, 0).alias("label_text")
    read = with_numbers(lines, split_fields(field(outer, 1), " "), label)
    return read.select(
        to_double(F.col("label_text")).alias("label"), F.col("numbers").alias("features")
    )


def parse_labelled_spaces(
    lines: DataFrame, features: str = "first", column: str = "value"
) -> DataFrame:
    """``label f1 f2 ...`` to ``label double, features array<double>``.

    ``features="first"`` keeps only ``f1``, which is what splitting the line on
    spaces and then the second field on spaces yields; ``"all"`` keeps every one.
    """
    fields = split_fields(F.col(column), " ")
    if features == "all":
        return _label_first(lines, fields)
    if features != "first":
        raise ValueError(f"features must be 'first' or 'all', not {features!r}")
    return lines.select(
        to_double(field(fields, 0)).alias("label"),
        F.array(to_double(field(fields, 1))).alias("features"),
    )


def parse_vectors(lines: DataFrame, column: str = "value") -> DataFrame:
    """``x1 x2 ...`` to ``features array<double>``."""
    read = with_numbers(lines, split_fields(F.col(column), " "))
    return read.select(F.col("numbers").alias("features"))


def parse_id_name(lines: DataFrame, column: str = "value") -> DataFrame:
    """``id,name[,...]`` to ``id bigint, username string``; further fields are dropped."""
    fields = split_fields(F.col(column), ",")
    return lines.select(
        to_long(field(fields, 0)).alias("id"), _required(field(fields, 1)).alias("username")
    )


def parse_edges(lines: DataFrame, column: str = "value") -> DataFrame:
    """``src dst`` split on white space to ``src bigint, dst bigint``.

    Empty lines and lines starting with ``#`` are skipped; parallel edges and
    self-loops are kept; a line with one field raises.
    """
    text = F.col(column)
    fields = F.split(text, "\\s+")
    kept = lines.filter((F.length(text) > 0) & ~F.startswith(text, F.lit("#")))
    return kept.select(
        to_long(field(fields, 0)).alias("src"), to_long(field(fields, 1)).alias("dst")
    )


def _label_first(lines: DataFrame, fields: Column) -> DataFrame:
    numbers = F.col("numbers")
    return with_numbers(lines, fields).select(
        field(numbers, 0).alias("label"), tail(numbers).alias("features")
    )


def _required(value: Column) -> Column:
    return F.coalesce(value, F.raise_error(F.lit("missing field")))
