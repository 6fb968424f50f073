"""Column expressions over single cells: text rendering, missing tokens, numbers, clamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Besides SQL NULL, these texts (case-sensitive) mean "no value".
MISSING_TOKENS = ("", "nan", "null")

INVALID_POLICIES = ("fail", "skip")


def data_type(df: DataFrame, name: str) -> T.DataType:
    """Type of a top-level column; names are matched exactly."""
    for field in df.schema.fields:
        if field.name == name:
            return field.dataType
    raise ValueError(f"column {name!r} is not in {df.columns}")


def column(name: str) -> Column:
    """Reference to a top-level column whose name may hold dots or parentheses."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_missing(df: DataFrame, name: str) -> Column:
    """TRUE when the cell is NULL or one of the missing tokens.

    Only text can hold a token, so typed columns need no rendering.
    """
    cell = column(name)
    if isinstance(data_type(df, name), (T.StringType, T.VarcharType, T.CharType)):
        return cell.isNull() | cell.isin(*MISSING_TOKENS)
    return cell.isNull()


def is_missing_text(text: Column) -> Column:
    """Missing test for a rendered, never-NULL key part."""
    return text.isin(*MISSING_TOKENS)


def complete_row(columns: list[str]) -> Column:
    """TRUE when none of the columns is SQL NULL (text tokens count as present here)."""
    test = F.lit(True)
    for name in columns:
        test = test & column(name).isNotNull()
    return test


def key_part(cell: Column) -> Column:
    """One component of a grouping key as never-NULL text."""
    return F.coalesce(cell.cast("string"), F.lit("null"))


def group_cell(df: DataFrame, name: str) -> Column:
    """A key component to group on; ``key_part`` renders it afterwards.

    Numbers, dates and booleans group as they are: their texts are one-to-one and never
    "null". Text maps NULL to "null" first, so the two fall into one group.
    """
    kind = data_type(df, name)
    if isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)):
        return column(name)
    return key_part(column(name))


def key_text(columns: list[str]) -> Column:
    """Displayed key: rendered components joined by a comma."""
    return F.concat_ws(",", *[key_part(column(name)) for name in columns])


def to_number(df: DataFrame, name: str, on_invalid: str = "fail") -> Column:
    """Double value of a cell; text may use a decimal comma.

    ``fail`` raises on text that is no number (ANSI cast), ``skip`` yields NULL.
    """
    if on_invalid not in INVALID_POLICIES:
        raise ValueError(f"on_invalid must be one of {INVALID_POLICIES}")
    cell = column(name)
    if isinstance(data_type(df, name), T.NumericType):
        return cell.cast("double")
    dotted = F.translate(cell.cast("string"), ",", ".")
    return dotted.cast("double") if on_invalid == "fail" else dotted.try_cast("double")


def at_least_zero(x: Column) -> Column:
    """Raise negatives and NaN to 0; NULL stays NULL."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.nanvl(x, F.lit(0.0))))


def at_most_one(x: Column) -> Column:
    """Cut values above 1; NULL stays NULL."""
    return F.when(x.isNotNull(), F.least(F.lit(1.0), x))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Float division that gives NULL for a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def strip_quotes(text: Column) -> Column:
    return F.replace(text, F.lit('"'), F.lit(""))


def strip_backslashes(text: Column) -> Column:
    return F.replace(text, F.lit("\\"), F.lit(""))


def decimal_commas_to_dots(text: Column) -> Column:
    """``1,5`` -> ``1.5``; matches do not overlap, so ``1,2,3`` -> ``1.2,3``."""
    return F.regexp_replace(text, r"(\d+),(\d+)", "$1.$2")
