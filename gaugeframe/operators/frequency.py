"""Completeness_Frequency: observed against expected records, and the update rates.

Everything starts from one aggregate: records and first/last instant per hour of day
(and key value). Rates, global and per-value frequency are small steps on top of it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import at_least_zero, at_most_one, ratio, seconds_between, to_instant
from .grouping import Keys, group_by_keys, usable_keys

INSTANT = "instant"


def _measures() -> list[Column]:
    return [
        F.count(INSTANT).alias("RecordNumber"),
        F.min(INSTANT).alias("First"),
        F.max(INSTANT).alias("Last"),
    ]


def hour_counts(
    rows: DataFrame, timestamp: str, time_format: str | None = None, on_invalid: str = "fail"
) -> DataFrame:
    """Records, first and last instant per hour of day: at most 24 rows."""
    instant = to_instant(rows, timestamp, time_format, on_invalid)
    return (
        rows.select(instant.alias(INSTANT))
        .filter(F.col(INSTANT).isNotNull())
        .groupBy(F.hour(INSTANT).alias("Hour"))
        .agg(*_measures())
    )


def value_hour_counts(
    rows: DataFrame,
    timestamp: str,
    keys: Keys,
    timestamps: Iterable[str] | None = None,
    time_format: str | None = None,
    on_invalid: str = "fail",
    apart: Iterable[int] = (),
) -> DataFrame:
    """The same per key value and hour, for all keys."""
    keys = usable_keys(keys, [timestamp, *(timestamps or ())])
    instant = to_instant(rows, timestamp, time_format, on_invalid)
    groups = group_by_keys(
        rows, keys, [instant.alias(INSTANT)], _measures(), within={"Hour": F.hour(instant)}, apart=apart
    )
    return groups.filter(F.col("Hour").isNotNull())


def roll_up_hours(counts: DataFrame, key: str) -> DataFrame:
    """hour_counts from value_hour_counts: every key's groups cover all rows."""
    return (
        counts.filter(F.col("Attribute") == key)
        .groupBy("Hour")
        .agg(
            F.sum("RecordNumber").alias("RecordNumber"),
            F.min("First").alias("First"),
            F.max("Last").alias("Last"),
        )
    )


def _days() -> Column:
    return F.datediff(F.to_date("Last"), F.to_date("First")) + 1


def _rate() -> Column:
    return ratio(F.col("RecordNumber"), _days() * 3600)


def update_rate_global(counts: DataFrame) -> DataFrame:
    """Records per second in each hour of day, from hour_counts."""
    return counts.select("Hour", _rate().alias("Frequency"))


def update_rate_values(counts: DataFrame) -> DataFrame:
    """Records per second per key value and hour of day, from value_hour_counts.

    ``Parts`` holds the components of the value, which tell values with commas apart.
    """
    return counts.select(F.col("Attribute").alias("Key"), "Value", "Parts", "Hour", _rate().alias("Frequency"))


def _met(counts: DataFrame, rates: DataFrame) -> DataFrame:
    """The counts with the rate of their value and hour; no row is ever multiplied.

    Rates are met on the parts of a value. Stored rates that only have the display text
    are met on that; then two values of one display text, and in either case two rates of
    one value and hour, raise.
    """
    by = "Parts" if "Parts" in rates.columns else "Value"
    once = rates.groupBy(F.col("Key").alias("Attribute"), by, "Hour").agg(
        F.min("Frequency").alias("Frequency"), F.count(F.lit(1)).alias("rates")
    )
    rated = counts.join(once, ["Attribute", by, "Hour"])
    failed = F.when(F.col("rates") > 1, F.raise_error(F.lit("two rates for one key value and hour")))
    rated = rated.withColumn("Frequency", F.coalesce(failed.cast("double"), F.col("Frequency"))).drop("rates")
    if by == "Parts":
        return rated
    shown = rated.groupBy("Attribute", "Value", "Hour").agg(
        F.min("Parts").alias("Parts"),
        F.max("Parts").alias("other"),
        *[F.min(c).alias(c) for c in ("RecordNumber", "First", "Last", "Frequency")],
    )
    clash = F.raise_error(F.lit("two key values have one display text: their rates need Parts"))
    parts = F.when(F.col("Parts") == F.col("other"), F.col("Parts")).otherwise(clash.cast("array<string>"))
    return shown.withColumn("Parts", parts).drop("other")


def frequency_hour(counts: DataFrame, rates: DataFrame, confidence: float = 1.0) -> DataFrame:
    """Observed over expected records per hour of day; hours without a rate vanish."""
    expected = F.col("Frequency") * _days() * F.lit(float(confidence)) * F.lit(3600.0)
    score = at_most_one(at_least_zero(ratio(F.col("RecordNumber"), expected)))
    return counts.join(rates.select("Hour", "Frequency"), "Hour").select(
        "Hour", "RecordNumber", score.alias("CompletenessFrequency")
    )


def frequency_global(hours: DataFrame, timestamp: str) -> DataFrame:
    """Unweighted mean over the hours."""
    return hours.agg(F.avg("CompletenessFrequency").alias(f"Completeness_Frequency_{timestamp}"))


def frequency_groups(counts: DataFrame, rates: DataFrame, confidence: float = 1.0) -> DataFrame:
    """Per key value: records and their share of ``elapsed seconds x mean rate``.

    The rows meet the rates only after they are counted per value and hour, so the join
    moves at most 24 rows per value on each side. A value without elapsed time or rate
    has NULL and belongs to neither published table.
    """
    rolled = _met(counts, rates).groupBy("Attribute", "Parts").agg(
        F.sum("RecordNumber").alias("RecordNumber"),
        F.min("First").alias("First"),
        F.max("Last").alias("Last"),
        F.avg("Frequency").alias("Rate"),
    )
    elapsed = seconds_between(F.col("First"), F.col("Last"))
    expected = elapsed * F.lit(float(confidence)) * F.col("Rate")
    return rolled.select(
        "Attribute",
        F.array_join("Parts", ",").alias("Value"),
        "RecordNumber",
        at_most_one(ratio(F.col("RecordNumber"), expected)).alias("CompletenessFrequencyValue"),
    )


def frequency_value(groups: DataFrame) -> DataFrame:
    return groups.filter(F.col("CompletenessFrequencyValue").isNotNull())


def frequency_attribute(groups: DataFrame, confidence: float = 1.0) -> DataFrame:
    """Records and unweighted mean over the kept values; 0 when none was kept."""
    kept = F.col("CompletenessFrequencyValue").isNotNull()
    return groups.groupBy("Attribute").agg(
        F.coalesce(F.sum(F.when(kept, F.col("RecordNumber"))), F.lit(0).cast("bigint")).alias("RecordNumber"),
        F.coalesce(F.avg("CompletenessFrequencyValue"), F.lit(0.0)).alias("CompletenessFrequencyValue"),
        F.lit(float(confidence)).alias("Confidence"),
    )
