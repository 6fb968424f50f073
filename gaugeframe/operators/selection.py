"""Which rows an assessment sees: projection, intervals, value lists, nulls, sampling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bound_instant, column, data_type, key_part, to_instant

COMPARE_MODES = ("string", "typed")
# Bits of the hash that decides a sample by key.
SAMPLE_BITS = 60


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[column(name) for name in columns])


def _open(bound) -> bool:
    return bound is None or bound == ""


def _within(value: Column, low: Column | None, high: Column | None) -> Column:
    test = F.lit(True)
    if low is not None:
        test = test & (value >= low)
    if high is not None:
        test = test & (value <= high)
    return test


def interval_condition(
    df: DataFrame,
    name: str,
    intervals: Sequence[tuple],
    compare: str = "string",
    time_format: str | None = None,
    timestamp: bool = False,
    on_invalid: str = "fail",
) -> Column:
    """The column is not NULL and lies in one of the closed intervals.

    Bounds may be open (None or ""). Timestamp columns compare instants (text that is none
    raises, or with ``on_invalid="skip"`` lies in no interval); others compare as text,
    which keeps a numeric column's filter from the scan, or in the column's own type with
    ``compare="typed"``.
    """
    if compare not in COMPARE_MODES:
        raise ValueError(f"compare must be one of {COMPARE_MODES}")
    if timestamp:
        value, literal = to_instant(df, name, time_format, on_invalid), bound_instant
    elif compare == "typed":
        kind = data_type(df, name)
        value, literal = column(name), lambda b: F.lit(b).cast(kind)
    else:
        value, literal = column(name).cast("string"), lambda b: F.lit(str(b))
    any_of = F.lit(False)
    for low, high in intervals:
        any_of = any_of | _within(
            value,
            None if _open(low) else literal(low),
            None if _open(high) else literal(high),
        )
    return column(name).isNotNull() & any_of


def filter_intervals(
    df: DataFrame,
    intervals: Mapping[str, Sequence[tuple]],
    compare: str | Mapping[str, str] = "string",
    timestamps: Mapping[str, str | None] | None = None,
    on_invalid: str = "fail",
) -> DataFrame:
    """Alternatives within a column, conjunction across columns, in a single filter."""
    timestamps = timestamps or {}
    for name, pairs in intervals.items():
        if not pairs:
            continue
        mode = compare if isinstance(compare, str) else compare.get(name, "string")
        df = df.filter(
            interval_condition(df, name, pairs, mode, timestamps.get(name), name in timestamps, on_invalid)
        )
    return df


def filter_values(df: DataFrame, values: Mapping[str, Sequence | DataFrame]) -> DataFrame:
    """Keep rows whose columns hold allowed values.

    A Python list becomes an IN predicate, which reaches the scan. A list too long for
    the plan comes as a one-column DataFrame and is a left-semi join, whose strategy
    Spark picks from the size of that table.
    """
    for name, allowed in values.items():
        if isinstance(allowed, DataFrame):
            listed = allowed.select(column(allowed.columns[0]).alias(name))
            df = df.join(listed, on=name, how="left_semi")
        elif allowed:
            df = df.filter(column(name).isNotNull() & column(name).isin(*allowed))
    return df


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a SQL NULL; the text tokens "", nan, null survive."""
    return df.dropna(how="any", subset=list(columns) if columns else None)


def null_to_text(df: DataFrame) -> DataFrame:
    """Every column as text, NULL spelled "null"."""
    return df.select(
        *[F.coalesce(column(c).cast("string"), F.lit("null")).alias(c) for c in df.columns]
    )


def sample_rows(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Bernoulli sample without replacement.

    Scans of the same files pick the same rows. After a join or shuffle they may not:
    store the rows, or sample by key.
    """
    check_fraction(fraction)
    return df if fraction == 1 else df.sample(False, float(fraction), seed)


def sample_by_key(df: DataFrame, name: str, fraction: float) -> DataFrame:
    """Sample decided by a hash of one column's text: equal keys (NULL included) are kept
    or dropped together, and a rerun or a recomputed partition picks the same rows."""
    check_fraction(fraction)
    prefix = F.substring(F.md5(key_part(column(name))), 1, SAMPLE_BITS // 4)
    return df.filter(F.conv(prefix, 16, 10).cast("bigint") < int(fraction * 2**SAMPLE_BITS))


def check_fraction(fraction: float) -> None:
    if not 0 < fraction <= 1:
        raise ValueError("the sample fraction must lie in (0, 1]")


def select_rows(
    df: DataFrame,
    columns: Sequence[str],
    intervals: Mapping[str, Sequence[tuple]] | None = None,
    values: Mapping[str, Sequence | DataFrame] | None = None,
    compare: str | Mapping[str, str] = "string",
    timestamps: Mapping[str, str | None] | None = None,
    fraction: float = 1.0,
    seed: int = 42,
    sample_key: str | None = None,
    on_invalid: str = "fail",
) -> DataFrame:
    """The selection stage: projection, intervals, value lists, then sampling."""
    rows = select_columns(df, columns)
    rows = filter_intervals(rows, intervals or {}, compare, timestamps, on_invalid)
    rows = filter_values(rows, values or {})
    if sample_key:
        return sample_by_key(rows, sample_key, fraction)
    return sample_rows(rows, fraction, seed)
