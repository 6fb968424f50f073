"""Small helpers that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import column
from ..sources.writers import store

#: The characters 9 to 13 and 32, which part words.
GAPS = "\t\n\x0b\x0c\r"

__all__ = ["GAPS", "payload", "read", "store", "words"]


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def payload(df: DataFrame) -> Column:
    """All columns of a row as one struct, so that no name of theirs meets one of ours."""
    return F.struct(*[column(name) for name in df.columns])


def words(text: Column) -> Column:
    """Runs of characters other than white space; none for a null text."""
    parts = F.split(F.translate(text, GAPS, " " * len(GAPS)), " ")
    return F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda w: w != "")
