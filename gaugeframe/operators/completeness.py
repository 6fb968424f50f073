"""Completeness_Missing: the share of cells that hold a value."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import is_missing, is_missing_text, key_part, column, ratio
from .grouping import Keys, group_by_keys, label_of, usable_keys


def present_cells(df: DataFrame, columns: Sequence[str]) -> Column:
    """Number of non-missing cells of a row among the columns."""
    total = F.lit(0)
    for name in columns:
        total = total + F.when(is_missing(df, name), 0).otherwise(1)
    return total


def missing_inputs(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    return [present_cells(df, columns).alias("cmi_present")]


def missing_measures() -> list[Column]:
    return [F.sum("cmi_present").alias("cmi_present"), F.count(F.lit(1)).alias("cmi_rows")]


def missing_metrics(columns: Sequence[str]) -> list[Column]:
    cells = F.col("cmi_rows") * len(columns)
    return [ratio(F.col("cmi_present"), cells).alias("Completeness_Missing")]


def completeness_missing_global(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: non-missing cells over all cells."""
    return (
        rows.select(*missing_inputs(rows, columns))
        .agg(*missing_measures())
        .select(*missing_metrics(columns))
    )


def key_presence_inputs(keys: Keys) -> list[Column]:
    """1 per row whose key text is present, for each key.

    The text of a composite key holds a comma, so it never equals a missing token.
    """
    flags = [
        F.lit(1) if len(key) > 1 else F.when(is_missing_text(key_part(column(key[0]))), 0).otherwise(1)
        for key in keys
    ]
    return [flag.alias(f"key_present_{i}") for i, flag in enumerate(flags)]


def key_presence_measures(keys: Keys) -> list[Column]:
    return [F.sum(f"key_present_{i}").alias(f"key_present_{i}") for i in range(len(keys))]


def completeness_missing_attributes(totals: DataFrame, keys: Keys, confidence: float = 1.0) -> DataFrame:
    """A row per key from one row of totals (cmi_rows and key_present_i)."""
    lines = [
        F.struct(
            F.lit(label_of(key)).alias("Attribute"),
            (F.col("cmi_rows") - F.col(f"key_present_{i}")).alias("MissingValues"),
            ratio(F.col(f"key_present_{i}"), F.col("cmi_rows")).alias("CompletenessMissingValue"),
            F.lit(float(confidence)).alias("Confidence"),
        )
        for i, key in enumerate(keys)
    ]
    return totals.select(F.inline(F.array(*lines)))


def completeness_missing_attribute(rows: DataFrame, keys: Keys, confidence: float = 1.0) -> DataFrame:
    """Missing and present share of each key itself, all keys in one aggregation."""
    keys = usable_keys(keys)
    totals = rows.select(*key_presence_inputs(keys)).agg(
        F.count(F.lit(1)).alias("cmi_rows"), *key_presence_measures(keys)
    )
    return completeness_missing_attributes(totals, keys, confidence)


def completeness_missing_values(groups: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Shape grouped measures into the value table: the group's cells outside its key.

    All rows of a group share their key components, so the present cells of the key are
    ``rows x non-missing components`` and need no aggregate of their own.
    """
    in_key = F.size(F.filter("Parts", lambda part: ~is_missing_text(part)))
    shaped = groups.filter(~is_missing_text(F.col("Value"))).select(
        "Attribute",
        "Value",
        (F.col("cmi_rows") * (F.lit(len(columns)) - F.size("Parts"))).alias("cells"),
        (F.col("cmi_present") - F.col("cmi_rows") * in_key).alias("present"),
    )
    return shaped.select(
        "Attribute",
        "Value",
        (F.col("cells") - F.col("present")).alias("MissingValues"),
        ratio(F.col("present"), F.col("cells")).alias("CompletenessMissingValue"),
    )


def completeness_missing_value(
    rows: DataFrame,
    columns: Sequence[str],
    keys: Keys,
    timestamps: Iterable[str] = (),
    apart: Iterable[int] = (),
) -> DataFrame:
    """Missing cells and present share of the other columns, per key value."""
    keys = usable_keys(keys, timestamps)
    groups = group_by_keys(rows, keys, missing_inputs(rows, columns), missing_measures(), apart=apart)
    return completeness_missing_values(groups, columns)


def row_completeness(
    df: DataFrame, columns: Sequence[str] | None = None, name: str = "COMPLETENESS_MISSING"
) -> DataFrame:
    """Per-row share of non-missing cells, as text like every per-row quality column."""
    columns = list(columns or df.columns)
    share = ratio(present_cells(df, columns), F.lit(len(columns)))
    return df.withColumn(name, share.cast("string"))
