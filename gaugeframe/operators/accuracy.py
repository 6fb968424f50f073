"""Accuracy: closeness of a number to an expected mean within an interval.

``d = max(0, 1 - |x - mean| / (width / 2))`` is the dynamic score of a cell, ``ceil(d)``
the static one (inside the interval or not).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import at_least_zero, to_number
from .grouping import Keys, group_by_keys, per_column, skipped_labels, usable_keys


@dataclass(frozen=True)
class AccuracyTarget:
    column: str
    mean: float
    width: float

    def __post_init__(self):
        if not self.width > 0:
            raise ValueError(f"the accuracy interval of {self.column!r} must be wider than 0")


def accuracy_inputs(
    df: DataFrame, targets: Sequence[AccuracyTarget], on_invalid: str = "fail", when: Column | None = None
) -> list[Column]:
    """Dynamic score per target, NULL for rows outside ``when``."""
    out = []
    for i, t in enumerate(targets):
        distance = F.abs(to_number(df, t.column, on_invalid) - F.lit(float(t.mean)))
        score = at_least_zero(F.lit(1.0) - distance / F.lit(float(t.width) / 2))
        out.append((score if when is None else F.when(when, score)).alias(f"acc_{i}"))
    return out


def accuracy_measures(targets: Sequence[AccuracyTarget]) -> list[Column]:
    out = []
    for i in range(len(targets)):
        score = F.col(f"acc_{i}")
        out.append(F.avg(score).alias(f"acc_dynamic_{i}"))
        out.append(F.avg(F.ceil(score).cast("double")).alias(f"acc_static_{i}"))
    return out


def accuracy_metrics(targets: Sequence[AccuracyTarget]) -> list[Column]:
    """Final global columns from the measures."""
    out = []
    for i, t in enumerate(targets):
        out.append(F.col(f"acc_static_{i}").alias(f"Accuracy_Static_{t.column}"))
        out.append(F.col(f"acc_dynamic_{i}").alias(f"Accuracy_Dynamic_{t.column}"))
    return out


def accuracy_global(rows: DataFrame, targets: Sequence[AccuracyTarget], on_invalid: str = "fail") -> DataFrame:
    """One row: static and dynamic accuracy per target."""
    return (
        rows.select(*accuracy_inputs(rows, targets, on_invalid))
        .agg(*accuracy_measures(targets))
        .select(*accuracy_metrics(targets))
    )


def accuracy_values(groups: DataFrame, targets: Sequence[AccuracyTarget], keys: Keys) -> DataFrame:
    """Shape grouped measures into the value table."""
    return per_column(
        groups,
        {
            t.column: [
                F.col(f"acc_dynamic_{i}").alias("AccuracyDynamic"),
                F.col(f"acc_static_{i}").alias("AccuracyStatic"),
            ]
            for i, t in enumerate(targets)
        },
        skipped_labels([t.column for t in targets], keys),
    )


def accuracy_value(
    rows: DataFrame,
    targets: Sequence[AccuracyTarget],
    keys: Keys,
    timestamps: Iterable[str] = (),
    on_invalid: str = "fail",
    apart: Iterable[int] = (),
) -> DataFrame:
    """Accuracy per target and key value."""
    keys = usable_keys(keys, timestamps)
    inputs = accuracy_inputs(rows, targets, on_invalid)
    groups = group_by_keys(rows, keys, inputs, accuracy_measures(targets), apart=apart)
    return accuracy_values(groups, targets, keys)


def accuracy_attribute(values: DataFrame, confidence: float = 1.0) -> DataFrame:
    """Unweighted mean over the key's groups, from the value table."""
    return values.groupBy("Column", "Attribute").agg(
        F.avg("AccuracyDynamic").alias("AccuracyDynamic"),
        F.avg("AccuracyStatic").alias("AccuracyStatic"),
        F.lit(float(confidence)).alias("Confidence"),
    )
