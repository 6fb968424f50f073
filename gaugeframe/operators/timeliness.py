"""Timeliness: how fresh an instant is, ``t = 1 - age / volatility``.

``t`` is signed per row; clamping at 0 happens after aggregation, except per tuple.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import at_least_zero, format_instant, instant_literal, seconds_between, to_instant
from .grouping import Keys, group_by_keys, per_column, skipped_labels, usable_keys

DEFAULT_VOLATILITY_HOURS = 17520.0


@dataclass(frozen=True)
class TimeColumn:
    column: str
    volatility_hours: float = DEFAULT_VOLATILITY_HOURS
    format: str | None = None

    def __post_init__(self):
        if not self.volatility_hours > 0:
            raise ValueError(f"the volatility of {self.column!r} must be above 0 hours")


def freshness(df: DataFrame, spec: TimeColumn, now: dt.datetime | str, on_invalid: str = "fail") -> Column:
    age = seconds_between(to_instant(df, spec.column, spec.format, on_invalid), instant_literal(now))
    return F.lit(1.0) - age / F.lit(float(spec.volatility_hours) * 3600.0)


def analysis_time(spec: TimeColumn, now: dt.datetime | str) -> Column:
    """The analysis instant in the column's own format."""
    return format_instant(instant_literal(now), spec.format)


def timeliness_inputs(
    df: DataFrame,
    specs: Sequence[TimeColumn],
    now: dt.datetime | str,
    on_invalid: str = "fail",
    when: Column | None = None,
) -> list[Column]:
    scores = [freshness(df, spec, now, on_invalid) for spec in specs]
    return [(t if when is None else F.when(when, t)).alias(f"tim_{i}") for i, t in enumerate(scores)]


def timeliness_measures(specs: Sequence[TimeColumn]) -> list[Column]:
    out = []
    for i in range(len(specs)):
        out += [
            F.avg(f"tim_{i}").alias(f"tim_mean_{i}"),
            F.max(f"tim_{i}").alias(f"tim_max_{i}"),
            F.min(f"tim_{i}").alias(f"tim_min_{i}"),
        ]
    return out


def timeliness_metrics(specs: Sequence[TimeColumn], now: dt.datetime | str) -> list[Column]:
    out = []
    for i, spec in enumerate(specs):
        for statistic in ("Mean", "Max", "Min"):
            score = at_least_zero(F.col(f"tim_{statistic.lower()}_{i}"))
            out.append(score.alias(f"Timeliness_{statistic}_{spec.column}"))
        out.append(analysis_time(spec, now).alias(f"Last_Analysis_Timestamp_{spec.column}"))
    return out


def timeliness_global(
    rows: DataFrame, specs: Sequence[TimeColumn], now: dt.datetime | str, on_invalid: str = "fail"
) -> DataFrame:
    """One row: mean, max and min freshness and the analysis time per column."""
    return (
        rows.select(*timeliness_inputs(rows, specs, now, on_invalid))
        .agg(*timeliness_measures(specs))
        .select(*timeliness_metrics(specs, now))
    )


def timeliness_signed(
    groups: DataFrame, specs: Sequence[TimeColumn], keys: Keys, now: dt.datetime | str
) -> DataFrame:
    """Group statistics before clamping; both published tables derive from it."""
    return per_column(
        groups,
        {
            spec.column: [
                F.col(f"tim_mean_{i}").alias("TimelinessMean"),
                F.col(f"tim_max_{i}").alias("TimelinessMax"),
                F.col(f"tim_min_{i}").alias("TimelinessMin"),
                analysis_time(spec, now).alias("AnalysisTime"),
            ]
            for i, spec in enumerate(specs)
        },
        skipped_labels([spec.column for spec in specs], keys),
    )


def timeliness_groups(
    rows: DataFrame,
    specs: Sequence[TimeColumn],
    keys: Keys,
    now: dt.datetime | str,
    timestamps: Iterable[str] | None = None,
    on_invalid: str = "fail",
    apart: Iterable[int] = (),
) -> DataFrame:
    """Signed group statistics; ``timestamps`` defaults to the analysed columns."""
    keys = usable_keys(keys, [s.column for s in specs] if timestamps is None else timestamps)
    inputs = timeliness_inputs(rows, specs, now, on_invalid)
    groups = group_by_keys(rows, keys, inputs, timeliness_measures(specs), apart=apart)
    return timeliness_signed(groups, specs, keys, now)


def timeliness_value(signed: DataFrame) -> DataFrame:
    """Value table from the signed group statistics: each statistic clamped at 0."""
    return signed.select(
        "Column",
        "Attribute",
        "Value",
        *[at_least_zero(F.col(c)).alias(c) for c in ("TimelinessMean", "TimelinessMax", "TimelinessMin")],
        "AnalysisTime",
    )


def timeliness_attribute(signed: DataFrame, confidence: float = 1.0) -> DataFrame:
    """Mean of group means, max of maxima, min of minima; clamped once at the end."""
    return signed.groupBy("Column", "Attribute", "AnalysisTime").agg(
        at_least_zero(F.avg("TimelinessMean")).alias("TimelinessMean"),
        at_least_zero(F.max("TimelinessMax")).alias("TimelinessMax"),
        at_least_zero(F.min("TimelinessMin")).alias("TimelinessMin"),
        F.lit(float(confidence)).alias("Confidence"),
    )


def timeliness_tuple(
    source: DataFrame, specs: Sequence[TimeColumn], now: dt.datetime | str, on_invalid: str = "fail"
) -> DataFrame:
    """Set ``TIMELINESS_<column>`` on every row of the source; no shuffle."""
    return source.withColumns(
        {
            f"TIMELINESS_{spec.column}": at_least_zero(freshness(source, spec, now, on_invalid)).cast("string")
            for spec in specs
        }
    )
