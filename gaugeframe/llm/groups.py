"""Whole groups from sorted Arrow batches, and connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import store


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows, which bounds what a step holds."""
    for batch in batches:
        yield from (batch.slice(k, rows) for k in range(0, batch.num_rows, rows))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 2048) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables in which no group is cut, with the first row of each group.

    The batches come sorted by the keys. What is held is a part of a batch and the group at its end.
    """
    rest: pa.Table | None = None

    def firsts(table: pa.Table) -> np.ndarray:
        change = np.zeros(table.num_rows, bool)
        change[:1] = True
        for key in keys:
            column = table.column(key).combine_chunks()
            change[1:] |= pa.compute.fill_null(pa.compute.not_equal(column.slice(1), column.slice(0, len(column) - 1)), True).to_numpy(False)
        return np.flatnonzero(change)

    for batch in sliced(batches, rows):
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        first = firsts(table)
        if first.size > 1:
            yield table.slice(0, int(first[-1])), first[:-1]
        rest = table.slice(int(first[-1]))
    if rest is not None:
        yield rest, np.zeros(1, np.int64)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for all nodes of ``links`` (a, b); the root is the smallest node of the component.

    Large-star and small-star steps in turn, until the links no longer change: each node takes its
    neighbours over to the smallest of them. Every step is a map-side combined minimum and a join, so a
    node with very many neighbours is no bottleneck; each round is stored.
    """
    pairs = store(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    before = None
    while True:
        state = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("b")).select("u", F.least("u", "b").alias("m"))
        large = both.join(low, F.col("a") == F.col("u")).where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # Each link now runs from the larger node b down to a.
        down = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        met = large.join(down, F.col("b") == F.col("u"))
        small = met.select(F.col("m").alias("a"), F.col("a").alias("b")).union(met.select(F.col("m").alias("a"), "b"))
        pairs = store(small.where("a < b").distinct(), "links")
    roots = pairs.groupBy("b").agg(F.min("a").alias("root")).select(F.col("b").alias("node"), "root")
    return roots.union(pairs.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
