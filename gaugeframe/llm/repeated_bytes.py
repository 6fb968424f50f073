"""Removal of byte strings that occur twice, by a depth-limited radix sort (operator 9).

A byte goes if a string of ``DEPTH`` bytes that covers it also starts anywhere else in the corpus. Suffixes are ordered only
through their first DEPTH bytes, most significant digit first, and a pass only sees the suffixes that are not yet alone
in their group. Digits are long, and equal digits are recognised by hash:

1. The first digit of a suffix is a ``GRAM``-byte string inside its first DEPTH bytes, the one with the least hash. Equal suffixes
   choose the same one at the same distance, and neighbouring suffixes mostly share theirs, so the suffixes of a text fall
   into runs (one row for about 77 suffixes). Runs whose digit occurs nowhere else are done: they are alone.
2. The second digit is the whole stretch of bytes that a run covers. Where it occurs again, all suffixes of the run are repeated.
3. What is left are different runs with one first digit. Their stretches, one row per different stretch, are gathered by first digit,
   and the last digit, all DEPTH bytes of each suffix, is compared there. If a first digit has more than ``HOT`` different
   stretches, its suffixes are instead counted as rows by an aggregation, which splits over tasks.

Hashes of 64 bits are only ever compared between runs with one first digit, so a false match needs 128 equal bits.

Texts are read twice to make runs, shuffled once to fetch stretches and once to meet the list of what goes.

Defined cases: a null text is empty; texts shorter than DEPTH lose nothing; rows with equal doc_id and text are
different places, so each is a repeat of the other; a null doc_id is an id like any other; texts of any
length are read in blocks; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .frames import store
from .groups import sliced, whole_groups

DEPTH = 200
GRAM = 48
#: Grams per suffix among which the first digit is chosen.
CHOICE = DEPTH - GRAM + 1
HOT = 4000
#: Suffixes that are read at a time.
BLOCK = 1 << 18
_U = np.uint64
_RNG = np.random.default_rng(5)
_BYTES = _RNG.integers(0, 2**63, 256, dtype=_U) * _U(2) + _U(1)
_BASE = int(_RNG.integers(0, 2**62)) * 4 + 3


def _powers(base: int, n: int) -> np.ndarray:
    out, done = np.ones(n, _U), 1
    while done < n:
        out[done : 2 * done] = out[: min(done, n - done)] * _U(pow(base, done, 1 << 64))
        done *= 2
    return out


class Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as are asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, _U)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.up.size:
            size = max(1 << 12, 1 << (n - 1).bit_length())
            self.up, self.down = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
        return self.up[:n], self.down[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def _prefix_sums(data: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Sums from which the hash of bytes a..b is (sums[b] - sums[a]) * down[a]."""
    up, down = powers(data.size + 1)
    sums = np.zeros(data.size + 1, _U)
    np.cumsum(_BYTES[data] * up[: data.size], out=sums[1:])
    return sums, down


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of each stretch of ``width`` values."""
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[: values.size - (width - done)], values[width - done :]) if done < width else values


def runs(data: np.ndarray, powers: Powers) -> tuple[np.ndarray, ...]:
    """First digit, second digit, first suffix, number of further suffixes and distance to the digit of each run."""
    sums, down = _prefix_sums(data, powers)
    grams = _mixed((sums[GRAM:] - sums[:-GRAM]) * down[: data.size - GRAM + 1])
    least = _least(grams, CHOICE)
    low = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    high = np.concatenate([low[1:], [least.size]]) - 1
    # The leftmost gram with that hash in the run's first suffix; where it falls out of the suffix while
    # an equal one follows, the run is cut.
    starts, ends, at = [], [], []
    open_low, open_high = low, high
    chosen = _leftmost(grams, least, open_low)
    while open_low.size:
        end = np.minimum(open_high, chosen)
        starts.append(open_low)
        ends.append(end)
        at.append(chosen)
        more = end < open_high
        open_low, open_high = end[more] + 1, open_high[more]
        chosen = _leftmost(grams, least, open_low)
    low, high, at = (np.concatenate(x) for x in (starts, ends, at))
    whole = (sums[high + DEPTH] - sums[low]) * down[low]
    further, gap = high - low, at - low
    second = _mixed(whole ^ _mixed((further * 256 + gap).astype(_U) * _U(0x9E3779B97F4A7C15)))
    return least[low], second, low, further, gap


def _leftmost(grams: np.ndarray, least: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For suffixes ``at`` the first gram that has the least hash."""
    if not at.size:
        return at
    out = np.full(at.size, -1, np.int64)
    for step in range(0, CHOICE, 17):
        todo = np.flatnonzero(out < 0)
        if not todo.size:
            break
        width = min(17, CHOICE - step)
        hit = grams[at[todo, None] + np.arange(step, step + width)] == least[at[todo], None]
        found = hit.any(axis=1)
        out[todo[found]] = at[todo[found]] + step + hit[found].argmax(axis=1)
    return out


RUNS = StructType([StructField(c, LongType()) for c in ("g", "c", "th", "place")])


def _runs(docs: DataFrame) -> DataFrame:
    """All runs of all documents: first digit g, second digit c, document (doc_id, th) and packed place."""
    source = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in sliced(batches, 512):
            rows, parts = [], []
            for k, text in enumerate(batch.column("text")):
                data = np.frombuffer((text.as_py() or "").encode(), np.uint8)
                for at in range(0, max(0, data.size - DEPTH + 1), BLOCK):
                    g, c, low, further, gap = runs(data[at : at + BLOCK + DEPTH - 1], powers)
                    parts.append(np.stack([g.view(np.int64), c.view(np.int64), (low + at) << 16 | further << 8 | gap]))
                    rows.append(np.full(g.size, k))
            if rows:
                where, (g, c, place) = pa.array(np.concatenate(rows)), np.concatenate(parts, axis=1)
                columns = [pa.array(g), pa.array(c), batch.column("th").take(where), pa.array(place), batch.column("doc_id").take(where)]
                yield pa.RecordBatch.from_arrays(columns, ["g", "c", "th", "place", "doc_id"])

    return source.mapInArrow(cut, StructType([*RUNS.fields, source.schema["doc_id"]]))


def _stretches(docs: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """The bytes of the runs in ``ambiguous`` (g, c, n, total and place of one such run)."""
    lists = ambiguous.groupBy(F.col("rep.doc_id").alias("of_id"), F.col("rep.th").alias("of_th")).agg(
        F.collect_list(F.struct("g", "c", "n", "total", F.col("rep.place").alias("place"))).alias("asked")
    )
    source = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("th") == F.col("of_th"))
    met = source.join(lists, same).select("doc_id", "th", "text", "asked")
    longs = [StructField(c, LongType()) for c in ("g", "c", "n", "total", "place")]
    kind = StructType([*longs, source.schema["doc_id"], StructField("th", LongType()), StructField("bytes", BinaryType())])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 512):
            rows, parts, asked = [], [], batch.column("asked")
            values = asked.flatten()
            sizes = pa.compute.list_value_length(asked).to_numpy()
            place = values.field("place").to_numpy()
            at = 0
            for k, text in enumerate(batch.column("text")):
                data = (text.as_py() or "").encode()
                for p in place[at : at + sizes[k]]:
                    parts.append(data[p >> 16 : (p >> 16) + (p >> 8 & 255) + DEPTH])
                rows.append(np.full(sizes[k], k))
                at += sizes[k]
            where = pa.array(np.concatenate(rows))
            columns = [*[values.field(c) for c in ("g", "c", "n", "total", "place")], batch.column("doc_id").take(where), batch.column("th").take(where)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(parts, pa.binary())], kind.names)

    return met.mapInArrow(fetch, kind)


def _last_digits(parts: list[bytes], place: np.ndarray, powers: Powers) -> tuple[np.ndarray, ...]:
    """For all suffixes of the stretches: number of the stretch, position in it, distance to the digit, hash."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    sums, down = _prefix_sums(data, powers)
    sizes = np.array([len(p) for p in parts])
    count = sizes - DEPTH + 1
    row = np.repeat(np.arange(len(parts)), count)
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = np.repeat(np.cumsum(sizes) - sizes, count) + inside
    return row, inside, (place & 255)[row] - inside, _mixed((sums[at + DEPTH] - sums[at]) * down[at])


def _spans(row: np.ndarray, inside: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring suffixes of a row joined into byte spans: row, from, to."""
    first = np.concatenate([[True], (row[1:] != row[:-1]) | (inside[1:] != inside[:-1] + 1)])[: row.size]
    a = np.flatnonzero(first)
    b = np.concatenate([a[1:], [row.size]])[: a.size] - 1
    base = place[row[a]] >> 16
    return row[a], base + inside[a], base + inside[b] + DEPTH


def _resolved(stretches: DataFrame) -> DataFrame:
    """Repeated spans of the stretches that occur once, by comparing the last digit within each first digit."""
    kind = StructType([stretches.schema["doc_id"], *[StructField(c, LongType()) for c in ("th", "a", "b")]])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for table, firsts in whole_groups(batches, ["g"]):
            g, c = (table.column(k).to_numpy() for k in ("g", "c"))
            # A document that is there more than once gives each of its stretches as often.
            keep = np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])])
            table = table.filter(pa.array(keep))
            g, place = g[keep], table.column("place").to_numpy()
            row, inside, gap, h = _last_digits(table.column("bytes").to_pylist(), place, powers)
            order = np.lexsort((h, gap, g[row]))
            r, d, x = g[row[order]], gap[order], h[order]
            same = (r[1:] == r[:-1]) & (d[1:] == d[:-1]) & (x[1:] == x[:-1])
            again = np.zeros(row.size, bool)
            again[order[1:][same]] = True
            again[order[:-1][same]] = True
            again &= (table.column("n").to_numpy() == 1)[row]
            who, a, b = _spans(row[again], inside[again], place)
            where = pa.array(who)
            ids = [table.column(k).combine_chunks().take(where) for k in ("doc_id", "th")]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(a), pa.array(b)], kind.names)

    return stretches.repartition("g").sortWithinPartitions("g", "c").mapInArrow(compared, kind)


def _counted(stretches: DataFrame) -> DataFrame:
    """The same for first digits with very many stretches: a row per suffix, counted by aggregation."""
    longs = [StructField(c, LongType()) for c in ("g", "gap", "h", "n", "at")]
    kind = StructType([*longs, stretches.schema["doc_id"], StructField("th", LongType())])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in sliced(batches, 1024):
            place = batch.column("place").to_numpy()
            row, inside, gap, h = _last_digits(batch.column("bytes").to_pylist(), place, powers)
            where = pa.array(row)
            told = [batch.column("g").take(where), pa.array(gap), pa.array(h.view(np.int64)), batch.column("n").take(where), pa.array((place[row] >> 16) + inside)]
            yield pa.RecordBatch.from_arrays([*told, batch.column("doc_id").take(where), batch.column("th").take(where)], kind.names)

    rows = stretches.dropDuplicates(["g", "c"]).mapInArrow(opened, kind)
    again = rows.groupBy("g", "gap", "h").agg(F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    found = rows.where("n = 1").join(again, ["g", "gap", "h"], "left_semi")
    return found.select("doc_id", "th", F.col("at").alias("a"), (F.col("at") + DEPTH).alias("b"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Byte spans (a, b) to remove, by document (doc_id, th); spans may overlap or repeat."""
    every = _runs(docs)
    # Stored, as ``several`` below: a join of two plain shuffles can be split at a hot first digit.
    shared = store(every.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g"), "byte-digits")
    left = store(every.join(shared, "g", "left_semi"), "byte-runs")
    second = left.groupBy("g", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "th", "place")).alias("rep"))
    second = store(second, "byte-stretches")
    several = second.groupBy(F.col("g").alias("of_g")).agg(F.count(F.lit(1)).alias("total")).where("total > 1")
    several = store(several, "byte-digits")
    ambiguous = second.join(several, F.col("g") == F.col("of_g")).select("g", "c", "n", "total", "rep")
    stretches = store(_stretches(docs, ambiguous), "byte-fetched")
    whole = left.join(second.where("n > 1").select("g", "c"), ["g", "c"], "left_semi")
    low, further = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(F.lit(255))
    whole = whole.select("doc_id", "th", low.alias("a"), (low + further + DEPTH).alias("b"))
    few, many = stretches.where(F.col("total") <= HOT), stretches.where(F.col("total") > HOT)
    return whole.unionByName(_resolved(few)).unionByName(_counted(many))


def cleaned(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes on request."""
    docs = docs.select("doc_id", "text")
    lists = repeated_spans(docs).groupBy(F.col("doc_id").alias("of_id"), F.col("th").alias("of_th"))
    lists = lists.agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    source = docs.withColumn("th", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("th") == F.col("of_th"))
    met = source.join(lists, same, "left").select("doc_id", "text", "spans")
    longs = [StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    kind = StructType([source.schema["doc_id"], *longs, StructField("kept_sha256", StringType()), *[StructField("kept", BinaryType())] * with_text])

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 512):
            rows, kept = [], []
            for text, spans in zip(batch.column("text"), batch.column("spans")):
                data = (text.as_py() or "").encode()
                merged = merge(spans.values) if spans.is_valid else []
                parts, at = [], 0
                for a, b in merged:
                    parts.append(data[at:a])
                    at = b
                rest = b"".join([*parts, data[at:]])
                rows.append((len(data), len(data) - len(rest), len(merged), hashlib.sha256(rest).hexdigest()))
                kept.append(rest)
            columns = [pa.array(c, f) for c, f in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            columns += [pa.array(kept, pa.binary())] if with_text else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], kind.names)

    return met.mapInArrow(removed, kind)


def merge(spans: pa.StructArray) -> list[tuple[int, int]]:
    """Overlapping and touching spans joined, in order."""
    a, b = spans.field("a").to_numpy(), spans.field("b").to_numpy()
    order = np.argsort(a, kind="stable")
    a, reach = a[order], np.maximum.accumulate(b[order])
    first = np.flatnonzero(np.concatenate([[True], a[1:] > reach[:-1]]))
    last = np.concatenate([first[1:], [a.size]]) - 1
    return list(zip(a[first].tolist(), reach[last].tolist()))
