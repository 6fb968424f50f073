"""Precision: one minus the relative (population) deviation of a number.

A column with both signs is shifted by ``|min|`` first, where the minimum is taken over
all rows seen.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import at_least_zero, ratio, to_number
from .grouping import Keys, group_by_keys, per_column, skipped_labels, usable_keys


def precision_inputs(
    df: DataFrame, columns: Sequence[str], on_invalid: str = "fail", when: Column | None = None
) -> list[Column]:
    numbers = [to_number(df, name, on_invalid) for name in columns]
    return [
        (x if when is None else F.when(when, x)).alias(f"pre_{i}") for i, x in enumerate(numbers)
    ]


def precision_measures(columns: Sequence[str]) -> list[Column]:
    out = []
    for i in range(len(columns)):
        x = F.col(f"pre_{i}")
        out += [
            F.avg(x).alias(f"pre_mean_{i}"),
            F.stddev_pop(x).alias(f"pre_dev_{i}"),
            F.min(x).alias(f"pre_low_{i}"),
            F.max(x).alias(f"pre_high_{i}"),
        ]
    return out


def _shift(low: Column, high: Column) -> Column:
    return F.when((low < 0.0) & (high > 0.0), F.abs(low)).otherwise(F.lit(0.0))


def precision_metrics(columns: Sequence[str]) -> list[Column]:
    out = []
    for i, name in enumerate(columns):
        mean, dev = F.col(f"pre_mean_{i}"), F.col(f"pre_dev_{i}")
        shift = _shift(F.col(f"pre_low_{i}"), F.col(f"pre_high_{i}"))
        score = at_least_zero(F.lit(1.0) - ratio(dev, F.abs(mean) + shift))
        out += [score.alias(f"Precision_{name}"), dev.alias(f"Precision(Deviation)_{name}")]
    return out


def precision_global(rows: DataFrame, columns: Sequence[str], on_invalid: str = "fail") -> DataFrame:
    """One row: precision and deviation per column."""
    return (
        rows.select(*precision_inputs(rows, columns, on_invalid))
        .agg(*precision_measures(columns))
        .select(*precision_metrics(columns))
    )


def precision_values(
    groups: DataFrame, columns: Sequence[str], keys: Keys, extremes: DataFrame
) -> DataFrame:
    """Shape grouped measures into the value table.

    ``extremes`` holds one row with ``pre_low_i``/``pre_high_i`` over all rows. The shifts
    of all columns enter as one scalar subquery: no join, no collect.
    """
    shifts = extremes.select(
        F.struct(
            *[_shift(F.col(f"pre_low_{i}"), F.col(f"pre_high_{i}")).alias(f"of_{i}") for i in range(len(columns))]
        ).alias("shifts")
    )
    entries = {}
    for i, name in enumerate(columns):
        mean, dev = F.col(f"pre_mean_{i}"), F.col(f"pre_dev_{i}")
        entries[name] = [
            mean.alias("Mean"),
            at_least_zero(F.lit(1.0) - ratio(dev, F.abs(mean + F.col(f"pre_shifts.of_{i}")))).alias("Precision"),
            dev.alias("StandardDeviation"),
        ]
    shifted = groups.withColumn("pre_shifts", shifts.scalar())
    return per_column(shifted, entries, skipped_labels(columns, keys))


def precision_value(
    rows: DataFrame,
    columns: Sequence[str],
    keys: Keys,
    timestamps: Iterable[str] = (),
    on_invalid: str = "fail",
    apart: Iterable[int] = (),
) -> DataFrame:
    """Mean, precision and deviation per column and key value."""
    keys = usable_keys(keys, timestamps)
    inputs = precision_inputs(rows, columns, on_invalid)
    measures = precision_measures(columns)
    groups = group_by_keys(rows, keys, inputs, measures, apart=apart)
    return precision_values(groups, columns, keys, rows.select(*inputs).agg(*measures))


def precision_attribute(values: DataFrame, confidence: float = 1.0) -> DataFrame:
    """Unweighted means over the key's groups, from the value table."""
    return values.groupBy("Column", "Attribute").agg(
        F.avg("Mean").alias("Mean"),
        F.avg("Precision").alias("Precision"),
        F.avg("StandardDeviation").alias("Standard_Deviation"),
        F.lit(float(confidence)).alias("Confidence"),
    )
