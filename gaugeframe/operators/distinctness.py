"""Distinctness and Completeness_Population."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import at_least_zero, at_most_one, column, ratio
from .grouping import Keys, group_by_keys, label_of, usable_keys
from .volume import volume_measures

def _cells(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The compared cells under names of our own."""
    return rows.select(*[column(name).alias(f"cell_{i}") for i, name in enumerate(columns)])


def _distinctness(copies: DataFrame) -> DataFrame:
    """The metric from groups of equal rows: column ``copies`` holds their sizes.

    A group of ``c`` equal rows weighs ``c / 2`` when that exceeds 1: pairs count as
    distinct.
    """
    weight = F.col("copies") / F.lit(2.0)
    counted = copies.agg(
        F.sum("copies").alias("n"),
        F.coalesce(F.sum(F.when(weight > 1.0, weight)), F.lit(0.0)).alias("mass"),
    )
    return counted.select(
        at_least_zero(F.lit(1.0) - ratio(F.col("mass"), F.col("n"))).alias("Distinctness")
    )


def distinctness_global(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: 1 minus the duplicate mass over the rows.

    Equal rows collapse map-side, so a row copied very often costs one shuffled record
    per map task; rows without copies are shuffled whole.
    """
    cells = _cells(rows, columns)
    copies = cells.groupBy(*cells.columns).agg(F.count(F.lit(1)).alias("copies"))
    return _distinctness(copies)


def key_cardinality(groups: DataFrame) -> DataFrame:
    """Distinct key values and rows per key, from grouped row counts."""
    return groups.groupBy("Attribute").agg(
        F.count(F.lit(1)).alias("DistinctCount"), F.sum("vol_rows").alias("Rows")
    )


def distinctness_attributes(cardinality: DataFrame, confidence: float = 1.0) -> DataFrame:
    return cardinality.select(
        "Attribute",
        "DistinctCount",
        ratio(F.col("DistinctCount"), F.col("Rows")).alias("Distinctness"),
        F.lit(float(confidence)).alias("Confidence"),
    )


def distinctness_attribute(
    rows: DataFrame,
    keys: Keys,
    timestamps: Iterable[str] = (),
    confidence: float = 1.0,
    apart: Iterable[int] = (),
) -> DataFrame:
    """Exact distinct key values over rows, per key.

    Two levels: group by the key (partial aggregation before the shuffle), then count the
    groups; no task ever holds a set of values.
    """
    groups = group_by_keys(rows, usable_keys(keys, timestamps), [], volume_measures(), apart=apart)
    return distinctness_attributes(key_cardinality(groups), confidence)


def population_attributes(
    cardinality: DataFrame, known: DataFrame, labels: Sequence[str], confidence: float = 1.0
) -> DataFrame:
    """``known`` is the source_distinctness table: Attribute, Count."""
    return (
        cardinality.filter(F.col("Attribute").isin(*labels))
        .join(known.select("Attribute", "Count"), "Attribute")
        .select(
            "Attribute",
            "DistinctCount",
            at_most_one(ratio(F.col("DistinctCount"), F.col("Count"))).alias("CompletenessPopulationValue"),
            F.lit(float(confidence)).alias("Confidence"),
        )
    )


def completeness_population(
    rows: DataFrame,
    known: DataFrame,
    keys: Keys,
    timestamps: Iterable[str] = (),
    confidence: float = 1.0,
    apart: Iterable[int] = (),
) -> DataFrame:
    """Distinct values now over distinct values known, per single-column key.

    ``apart`` counts positions among the single-column keys.
    """
    single = [key for key in usable_keys(keys, timestamps) if len(key) == 1]
    groups = group_by_keys(rows, single, [], volume_measures(), apart=apart)
    return population_attributes(
        key_cardinality(groups), known, [label_of(key) for key in single], confidence
    )


def source_distinctness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Exact distinct non-NULL values per column: Attribute, Count.

    One scan: each row yields its (column, value) pairs, which collapse map-side. This
    shuffles narrow pairs, where several COUNT(DISTINCT) shuffle rows as wide as the list.
    """
    pairs = [
        F.struct(F.lit(name).alias("Attribute"), column(name).cast("string").alias("Value"))
        for name in (columns or df.columns)
    ]
    values = df.select(F.inline(F.array(*pairs))).distinct()
    return values.groupBy("Attribute").agg(F.count("Value").alias("Count"))
