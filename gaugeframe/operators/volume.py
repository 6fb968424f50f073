"""Volume: rows left by the selection against the rows of the source."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import at_most_one, ratio
from .grouping import Keys, group_by_keys, usable_keys


def total_rows(source: DataFrame) -> Column:
    """Row count of the source as a scalar subquery; parquet answers it from footers."""
    return source.agg(F.count(F.lit(1)).alias("total")).scalar()


def volume_measures(when: Column | None = None) -> list[Column]:
    return [F.count(F.lit(1) if when is None else F.when(when, 1)).alias("vol_rows")]


def volume_metrics() -> list[Column]:
    """Final global columns from the row count and ``vol_total``."""
    return [
        at_most_one(ratio(F.col("vol_rows"), F.col("vol_total"))).alias("Volume"),
        F.col("vol_rows").alias("Volume(TotalRows)"),
    ]


def volume_global(rows: DataFrame, source: DataFrame) -> DataFrame:
    """One row: share of the source's rows, and their number."""
    counted = rows.agg(*volume_measures()).withColumn("vol_total", total_rows(source))
    return counted.select(*volume_metrics())


def volume_values(groups: DataFrame, total: Column) -> DataFrame:
    return groups.select(
        "Attribute",
        "Value",
        F.col("vol_rows").alias("Count"),
        ratio(F.col("vol_rows"), total).alias("VolumeValue"),
    )


def volume_value(
    rows: DataFrame,
    source: DataFrame,
    keys: Keys,
    timestamps: Iterable[str] = (),
    apart: Iterable[int] = (),
) -> DataFrame:
    """Rows and share of the source's rows per key value."""
    groups = group_by_keys(rows, usable_keys(keys, timestamps), [], volume_measures(), apart=apart)
    return volume_values(groups, total_rows(source))
