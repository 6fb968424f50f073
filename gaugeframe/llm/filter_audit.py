"""Audit of how quality filters act together, over one byte transducer (operator 13).

Five filters judge each text: A too few words, B too few different words, C too many capitals, D a symbol, E the
text of a smaller doc_id. The audit tells, for each part (source) and each order in which the filters may be applied, what
every step removes, what it would remove again, what only it finds, what is lost of labelled rows, and each
filter's Shapley value: its removals summed over all orders.

A text is read once, as UTF-8 bytes, by a finite-state transducer given as a table: (state, byte) -> (next state, outputs).
The states are inside and outside of a word; the outputs are word begins, word has ended, capital, further byte of a code point,
symbol. The next state hangs on the byte alone, so numpy runs the table over a block of bytes at a time. Word spans go into
an open-addressing hash table of the block, under a 64-bit hash of document and bytes; a span that meets an equal
hash is compared byte by byte and goes on to the next place if it differs. The spans that found a free place are the different words.

Only counts leave the pass. Text copies are recognised by SHA-256; the least doc_id of each text meets the rows by a join
that Spark may split at a hot text. What each step removes then follows from how many documents fail each set of filters: at most
32 numbers a part, so the 120 orders cost nothing that grows with the documents.

Defined cases: a null text is empty; a null source is the empty string; a null doc_id has no labels and is neither smaller nor
larger than another one; a document is good (toxic) if any of its labels says 1; repeated rows count each, and equal doc_ids
are not smaller than each other; texts larger than a block are read in pieces cut at white space; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .frames import store

MIN_WORDS = 50
#: Least percentage of different words, and greatest percentage of capitals.
MIN_DIFFERENT, MAX_CAPITALS = 65, 5
SYMBOLS = b"#$%&*|"
FILTERS = "ABCDE"
#: Bytes that are read at a time.
BLOCK = 1 << 20
#: Outputs of the transducer, and the bit of its next state.
BEGINS, ENDED, CAPITAL, FURTHER, SYMBOL, INSIDE = 1, 2, 4, 8, 16, 128
_U = np.uint64


def transducer() -> np.ndarray:
    """Next state (INSIDE or not) and outputs of each (state, byte)."""
    table = np.zeros((2, 256), np.uint8)
    gap = np.zeros(256, bool)
    gap[[32, *range(9, 14)]] = True
    table[:, ~gap] |= INSIDE
    table[0, ~gap] |= BEGINS
    table[1, gap] |= ENDED
    table[:, ord("A") : ord("Z") + 1] |= CAPITAL
    table[:, 0x80:0xC0] |= FURTHER
    table[:, list(SYMBOLS)] |= SYMBOL
    return table


TABLE = transducer()
_RNG = np.random.default_rng(13)
_BYTES = _RNG.integers(0, 2**63, 256, dtype=_U) * _U(2) + _U(1)
_BASE = int(_RNG.integers(0, 2**62)) * 4 + 3


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Hashes:
    """Hashes of byte spans from prefix sums; powers of the base are kept from block to block."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, _U)

    def __call__(self, data: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        if data.size > self.up.size:
            self.up, self.down = _powers(_BASE, 2 * data.size), _powers(pow(_BASE, -1, 1 << 64), 2 * data.size)
        sums = np.zeros(data.size + 1, _U)
        np.cumsum(_BYTES[data] * self.up[: data.size], out=sums[1:])
        return (sums[high] - sums[low]) * self.down[low]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans of equal sizes that start at a and b hold the same bytes."""
    upto = np.cumsum(size)
    inside = np.arange(upto[-1] if upto.size else 0) - np.repeat(upto - size, size)
    differ = data[np.repeat(a, size) + inside] != data[np.repeat(b, size) + inside]
    out = np.ones(size.size, bool)
    out[np.searchsorted(upto, np.flatnonzero(differ), side="right")] = False
    return out


def first_spans(data: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which spans are the first of their bytes to enter the hash table of their document."""
    hashes = _mixed(hashes ^ _mixed(doc.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(1)))
    room = 1 << max(4, (2 * low.size).bit_length())
    slots = np.full(room, -1, np.int64)
    first = np.zeros(low.size, bool)
    left = np.arange(low.size)
    at = (hashes & _U(room - 1)).astype(np.int64)
    while left.size:
        free = slots[at] < 0
        slots[at[free]] = left[free]  # of several spans one stays
        holder = slots[at]
        first[left[holder == left]] = True
        same = (hashes[holder] == hashes[left]) & (doc[holder] == doc[left]) & (high[holder] - low[holder] == high[left] - low[left])
        met = np.flatnonzero(same & (holder != left))
        same[met] = _same_bytes(data, low[holder[met]], low[left[met]], (high - low)[left[met]])
        on = ~same
        left, at = left[on], at[on] + 1 & room - 1
    return first


COUNTS = ["n_words", "n_different", "n_capitals", "n_points", "n_symbols"]


class Reader:
    """Runs the transducer over blocks of whole texts."""

    def __init__(self) -> None:
        self.hashes = Hashes()

    def spans(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Outputs per byte, and begin, end and document of each word; ``ends`` has 0 and the end of each text."""
        state = np.zeros(data.size, np.int64)
        state[1:] = TABLE[0][data[:-1]] >> 7
        state[ends[:-1][ends[:-1] < data.size]] = 0
        out = TABLE.ravel()[state << 8 | data]
        low = np.flatnonzero(out & BEGINS)
        closed = np.zeros(data.size + 1, bool)
        closed[:-1] = out & ENDED
        filled = ends[1:][ends[1:] > ends[:-1]]
        closed[filled[out[filled - 1] >= INSIDE]] = True
        return out, low, np.flatnonzero(closed), np.searchsorted(ends, low, side="right") - 1

    def counts(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """COUNTS of each text, and the different words of the last one."""
        out, low, high, doc = self.spans(data, ends)
        first = first_spans(data, doc, low, high, self.hashes(data, low, high)) if low.size else np.zeros(0, bool)
        n = ends.size - 1
        each = lambda bit: np.diff(np.searchsorted(np.flatnonzero(out & bit), ends))
        words = np.flatnonzero(first & (doc == n - 1)) if n == 1 else []
        return np.stack(
            [np.bincount(doc, minlength=n), np.bincount(doc[first], minlength=n), each(CAPITAL), np.diff(ends) - each(FURTHER), each(SYMBOL)], axis=1
        ).astype(np.int64), [data[low[k] : high[k]].tobytes() for k in words]

    def long_text(self, data: np.ndarray) -> np.ndarray:
        """The counts of one text of any length, piece by piece; the different words of all pieces are held."""
        total, words, at = np.zeros(len(COUNTS), np.int64), set(), 0
        while at < data.size:
            end = min(at + BLOCK, data.size)
            while end < data.size and not np.any(gaps := TABLE[0][data[end : end + BLOCK]] < INSIDE):
                end = min(end + BLOCK, data.size)
            end += int(np.argmax(gaps)) if end < data.size else 0
            counts, found = self.counts(data[at:end], np.array([0, end - at]))
            total += counts[0]
            words.update(found)
            at = end
        total[COUNTS.index("n_different")] = len(words)
        return total

    def texts(self, texts: pa.Array) -> np.ndarray:
        """The counts of all texts, in blocks of whole ones."""
        held = texts.fill_null("").cast(pa.large_binary())
        ends = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
        data = np.frombuffer(held.buffers()[2] or b"", np.uint8)
        out, at = np.zeros((len(held), len(COUNTS)), np.int64), 0
        while at < len(held):
            upto = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK, side="right")) - 1)
            part = data[ends[at] : ends[upto]]
            out[at:upto] = self.counts(part, ends[at : upto + 1] - ends[at])[0] if part.size <= BLOCK else self.long_text(part)
            at = upto
        return out


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns with the COUNTS of ``text``. No shuffle."""
    source = docs.select(*keep, "text")
    kind = StructType([*[source.schema[c] for c in keep], *[StructField(c, LongType()) for c in COUNTS]])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            counts = reader.texts(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(c) for c in counts.T.copy()]], kind.names)

    return source.mapInArrow(counted, kind)


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document doc_id, part, good, toxic and ``mask``, whose bit k tells that filter k of FILTERS fails it."""
    # Names of our own, since the documents may have any others.
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("same"), "text")
    counted = store(measured(rows, ["doc_id", "part", "same"]), "audit-counts")
    copies = counted.groupBy(F.col("same").alias("of_same")).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("times"))
    # Stored, so that the join has a plain shuffle on either side, whose hot texts Spark can split.
    least = store(copies.where("times > 1").drop("times"), "audit-copies")
    says = lambda c: F.max((F.col(c) == 1).cast("int")).alias(c)
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("of_id")).agg(says("quality"), says("toxic"))
    met = counted.join(least, F.col("same") == F.col("of_same"), "left").join(marks, F.col("doc_id") == F.col("of_id"), "left")
    fails = [
        F.col("n_words") < MIN_WORDS,
        F.col("n_different") * 100 < F.col("n_words") * MIN_DIFFERENT,
        F.col("n_capitals") * 100 > F.col("n_points") * MAX_CAPITALS,
        F.col("n_symbols") > 0,
        F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)),
    ]
    mask = reduce(Column.bitwiseOR, [F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)])
    one = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return met.select("doc_id", "part", one("quality").alias("good"), one("toxic").alias("toxic"), mask.alias("mask"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, with what the step does (see the module)."""
    cells = failures(docs, labels).groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 32
    orders = ["".join(p) for p in permutations(FILTERS)]
    bits = F.create_map(*[F.lit(x) for k, letter in enumerate(FILTERS) for x in (letter, 1 << k)])
    steps = parts.select("part", "cells", F.explode(F.lit(orders)).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    steps = steps.withColumn("bits", F.transform(F.split("filter_order", ""), lambda letter: bits[letter]))
    steps = steps.withColumn("own", F.get("bits", F.col("step") - 1))
    steps = steps.withColumn("earlier", F.aggregate(F.slice("bits", F.lit(1), F.col("step") - 1), F.lit(0), lambda a, b: a + b))
    fails = lambda c: c["mask"].bitwiseAND(F.col("own")) != 0
    gone = lambda c: c["mask"].bitwiseAND(F.col("earlier")) != 0
    total = lambda value, which: F.aggregate(
        F.filter("cells", which), F.lit(0).cast("bigint"), lambda a, c: a + value(c)
    )
    n = lambda c: c["n"]
    removed = lambda c: fails(c) & ~gone(c)
    # Of all orders, each failing filter comes first of them in the same share.
    share = lambda c: c["n"] * F.floor(F.lit(len(orders)) / F.bit_count(c["mask"]))
    return steps.select(
        "part",
        "filter_order",
        "step",
        total(n, lambda c: ~fails(c) & ~gone(c)).alias("kept"),
        total(n, removed).alias("removed"),
        total(n, lambda c: fails(c) & gone(c)).alias("redundant"),
        total(n, lambda c: c["mask"] == F.col("own")).alias("unique_fails"),
        total(lambda c: c["good"], removed).alias("good_lost"),
        total(lambda c: c["toxic"], removed).alias("toxic_lost"),
        total(share, fails).alias("shapley"),
    )
