"""Jaccard join on word shingles with Bayesian pruning of candidates (operator 4).

Shingles are runs of ``SHINGLE`` lower-cased words (all words of a shorter text); two texts are linked if at least
``THRESHOLD`` (4/5) of their different shingles are common. The steps:

1. Each document gets its shingle set's 128-bit hash and ``HASHES`` MinHash values. Documents with equal sets form a
   class; from here on there is one row per class.
2. Classes that agree in one of ``BANDS`` bands of ``ROWS`` values are candidates. A pair at the threshold is missed by
   all bands with probability 3e-6. Bands whose buckets hold the same classes are taken once.
3. Inside a bucket MinHash values are compared ``STEP`` at a time. With a uniform prior, agreement in m of n values gives
   the similarity a Beta(m + 1, n - m + 1) posterior; once the chance of reaching the threshold falls below
   ``TOLERANCE``, the pair is dropped. A bucket yields a spanning forest of what is left, not all its pairs.
4. The forests' components are sets of classes beyond which no link leads. Inside each component all pairs are
   verified on the whole shingle sets; again only counts per class and a spanning forest leave the task.
5. The components of the verified links are the groups.

Large buckets and components are dealt to tasks as pairs of blocks of at most about ``BLOCK`` classes, so no task holds a
whole group. A document's row never stands for a pair, so groups of copies cost rows in proportion.

Defined cases: a text without words (null, empty or blank) has no shingles and no links, and is a class
and a group of its own; rows with equal doc_id and text are one document in ``keep_one``; a null doc_id sorts first;
an empty table gives an empty table; other columns are carried along (``keep_one``).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .frames import payload, store
from .groups import components, sliced, whole_groups

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-6
BLOCK = 2048
#: Words a worker remembers.
KNOWN = 400_000
WORD = re.compile(r"\S+")
_RNG = np.random.default_rng(11)
_ODD = _RNG.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_ODD = _RNG.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def identity() -> Column:
    """Hash of doc_id and text: rows that share it are the same document."""
    known = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return F.md5(F.concat(known, F.when(F.col("text").isNull(), F.lit("-")).otherwise(F.concat(F.lit(":"), F.col("text")))))


class Hashes(dict):
    """64-bit hash of each word."""

    def __missing__(self, word: str) -> int:
        if len(self) > KNOWN:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, known: Hashes) -> np.ndarray:
    """The different shingles of a text as sorted 64-bit numbers."""
    found = WORD.findall((text or "").lower())
    h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    size = min(SHINGLE, h.size)
    if not size:
        return h
    total = sum(h[k : h.size - size + 1 + k] * _ODD[k] for k in range(size))
    return np.unique(_mixed(total ^ np.uint64(size)))


def signature(found: np.ndarray) -> np.ndarray:
    """MinHash values of a shingle set."""
    out = np.full(HASHES, np.uint32(2**32 - 1))
    for k in range(0, found.size, 4096):
        part = found[k : k + 4096, None] * _FACTORS
        np.minimum(out, (part >> np.uint64(32)).astype(np.uint32).min(axis=0), out=out)
    return out


def least_matches(tolerance: float = TOLERANCE) -> list[int]:
    """By the number of compared steps: agreements below which the threshold is out of reach.

    For whole m and n the Beta posterior's tail beyond t is the chance of at most m successes in n + 1 draws of t.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail = 0.0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * THRESHOLD**m * (1 - THRESHOLD) ** (n + 1 - m)
            if tail >= tolerance:
                break
        out.append(m)
    return out


_LEAST = least_matches()


def plausible(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of the other signatures may still reach the threshold."""
    alive, matches = np.arange(len(others)), np.zeros(len(others), np.int64)
    for k, least in enumerate(_LEAST):
        s = slice(k * STEP, (k + 1) * STEP)
        matches[alive] += (others[alive, s] == one[s]).sum(axis=1)
        alive = alive[matches[alive] >= least]
        if not alive.size:
            break
    out = np.zeros(len(others), bool)
    out[alive] = True
    return out


def _forest(size: int, near) -> list[tuple[int, int]]:
    """Links of a spanning forest; near(i, rest) says which of the rest are linked to i."""
    links, rest, queue = [], np.arange(size), []
    while rest.size:
        if queue:
            node = queue.pop()
        else:
            node, rest = int(rest[0]), rest[1:]
        hit = near(node, rest)
        links += [(node, int(k)) for k in rest[hit]]
        queue += rest[hit].tolist()
        rest = rest[~hit]
    return links


def signed(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, k (identity), c (hash of its shingle set), n (its size) and the signature."""
    source = docs.select("doc_id", identity().alias("k"), "text")
    fields = [StructField("c", BinaryType()), StructField("n", LongType()), StructField("signature", BinaryType())]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in sliced(batches, 512):
            sets = [shingles(t.as_py(), known) for t in batch.column("text")]
            ids = batch.column("k").to_pylist()
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if s.size else i.encode() for s, i in zip(sets, ids)]
            values = [signature(s).tobytes() if s.size else b"" for s in sets]
            columns = [pa.array(keys, pa.binary()), pa.array([s.size for s in sets], pa.int64()), pa.array(values, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k"), *columns], ["doc_id", "k", "c", "n", "signature"])

    return source.mapInArrow(sign, StructType([source.schema["doc_id"], StructField("k", StringType()), *fields]))


def _bands(classes: DataFrame) -> DataFrame:
    """A row per class and band: (band, c)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 512):
            values = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, BANDS, ROWS)
            keys = _mixed((values.astype(np.uint64) * _BAND_ODD).sum(axis=2) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            rows = np.repeat(np.arange(batch.num_rows), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), batch.column("c").take(pa.array(rows))], ["band", "c"])

    kind = StructType([StructField("band", LongType()), StructField("c", BinaryType())])
    return classes.where("n > 0").select("c", "signature").mapInArrow(cut, kind)


def _dealt(rows: DataFrame, group: str, total: str) -> DataFrame:
    """Rows with the pairs of blocks (i, j), i <= j, of their group that they belong to.

    ``side`` tells in which block of the pair a row is.
    """
    blocks = F.ceil(F.col(total) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("c", F.lit(3)), blocks).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    i, j = F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    dealt = rows.select("*", i, j, (F.col("own") > F.col("other")).alias("side")).drop("own", "other")
    # In a pair of one block with itself each row is there once: own = other.
    return dealt.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j")


def _links(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], ["a", "b"])


LINKS = StructType([StructField("a", BinaryType()), StructField("b", BinaryType())])


def candidates(classes: DataFrame) -> DataFrame:
    """Spanning forests of the plausible pairs of all buckets: links (a, b) between classes."""
    bands = _bands(classes)
    buckets = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("c")).alias("who")).where("n > 1")
    chosen = buckets.groupBy("n", "who").agg(F.min("band").alias("of_band"))
    members = store(bands.join(chosen, F.col("band") == F.col("of_band")).select("band", F.col("n").alias("total"), "c"), "near-buckets")
    rows = members.join(classes.select("c", "signature"), "c").select("band", "total", "c", "signature")

    def pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, firsts in whole_groups(batches, ["band", "i", "j"]):
            names = table.column("c").to_pylist()
            values = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(-1, HASHES)
            found = []
            for a, b in zip(firsts, [*firsts[1:], table.num_rows]):
                own = values[a:b]
                links = _forest(b - a, lambda k, rest: plausible(own[k], own[rest]))
                found += [(names[a + x], names[a + y]) for x, y in links]
            yield _links(found)

    return _dealt(rows, "band", "total").mapInArrow(pruned, LINKS)


def intersections(sets: list[np.ndarray]):
    """A function that gives the sizes of one set's intersections with all sets."""
    sizes = np.array([s.size for s in sets])
    whole = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(whole, kind="stable")
    owner = owner[order]
    _, inverse, count = np.unique(whole, return_inverse=True, return_counts=True)
    starts = np.concatenate([[0], np.cumsum(count)])
    ends = np.cumsum(sizes)

    def common(k: int) -> np.ndarray:
        own = inverse[ends[k] - sizes[k] : ends[k]]
        n = count[own]
        upto = np.cumsum(n)
        at = np.repeat(starts[own] - upto + n, n) + np.arange(upto[-1])
        return np.bincount(owner[at], minlength=len(sets))

    return common, sizes


def verified(docs: DataFrame, classes: DataFrame, parts: DataFrame) -> DataFrame:
    """Exact links inside the components ``parts`` (node, root), on whole shingle sets.

    Rows (c, n_links, a, b): the number of links of a class found in one pair of blocks, or a link of a forest.
    """
    total = parts.groupBy(F.col("root").alias("of_root")).agg(F.count(F.lit(1)).alias("total"))
    sized = parts.join(total, F.col("root") == F.col("of_root")).select(F.col("node").alias("c"), "root", "total")
    wanted = sized.join(classes.select("c", F.col("rep.k").alias("of_k")), "c")
    met = docs.select(identity().alias("k"), "text").join(wanted, F.col("k") == F.col("of_k"))
    met = met.select("root", "total", "c", "text").dropDuplicates(["c"])
    kind = StructType([StructField("root", BinaryType()), StructField("total", LongType()), StructField("c", BinaryType()), StructField("shingles", BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in sliced(batches, 512):
            found = pa.array([shingles(t.as_py(), known).tobytes() for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("root", "total", "c")], found], kind.names)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, firsts in whole_groups(batches, ["root", "i", "j"]):
            names, data = table.column("c").to_pylist(), table.column("shingles").to_pylist()
            side = table.column("side").to_numpy()
            crossing = table.column("i").to_numpy() != table.column("j").to_numpy()
            out = []
            for a, b in zip(firsts, [*firsts[1:], table.num_rows]):
                common, sizes = intersections([np.frombuffer(d, np.uint64) for d in data[a:b]])
                across, links = side[a:b], np.zeros(b - a, np.int64)
                near = np.zeros((b - a, b - a), bool)
                for k in range(b - a):
                    hit = 9 * common(k) >= 4 * (sizes + sizes[k])
                    hit[k] = False
                    if crossing[a]:
                        hit &= across != across[k]
                    near[k] = hit
                    links[k] = hit.sum()
                out += [(names[a + k], int(links[k]), None, None) for k in np.flatnonzero(links)]
                out += [(None, None, names[a + x], names[a + y]) for x, y in _forest(b - a, lambda k, rest: near[k][rest])]
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.binary(), pa.binary()))], ["c", "n_links", "a", "b"])

    dealt = _dealt(met.mapInArrow(cut, kind), "root", "total")
    return dealt.mapInArrow(counted, StructType([StructField("c", BinaryType()), StructField("n_links", LongType()), *LINKS.fields]))


def grouped(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, k, c, the smallest (doc_id, k) of its group as ``first``, n_links and n_copies."""
    docs = docs.select("doc_id", "text")
    rows = store(signed(docs), "near-signatures")
    classes = rows.groupBy("c").agg(
        F.max("n").alias("n"), F.max("signature").alias("signature"), F.min(F.struct("doc_id", "k")).alias("rep"), F.count(F.lit(1)).alias("n_copies")
    )
    classes = store(classes, "near-classes")
    parts = store(components(candidates(classes)), "near-parts")
    exact = store(verified(docs, classes, parts), "near-links")
    links = exact.where("c IS NOT NULL").groupBy("c").agg(F.sum("n_links").alias("n_links"))
    roots = components(exact.where("a IS NOT NULL").select("a", "b"))
    own = classes.select("c", "rep", "n_copies").join(roots, F.col("c") == F.col("node"), "left")
    own = store(own.select("c", "rep", "n_copies", F.coalesce("root", "c").alias("root")), "near-roots")
    firsts = own.groupBy("root").agg(F.min("rep").alias("first"))
    known = own.join(firsts, "root").join(links, "c", "left").select("c", "first", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return rows.select("doc_id", "k", "c").join(known, "c")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: class_id (the smallest doc_id of its group), n_links (other texts it is linked
    with directly) and n_copies (documents with the same shingles, itself included)."""
    return grouped(docs).select("doc_id", F.col("first.doc_id").alias("class_id"), "n_links", "n_copies")


def keep_one(docs: DataFrame) -> DataFrame:
    """The first document of each group, with its own columns; documents without words all stay."""
    first = grouped(docs).where(F.col("k") == F.col("first.k")).select(F.col("k").alias("of_k")).distinct()
    rows = docs.select(payload(docs).alias("doc"), identity().alias("k"))
    return rows.join(first, F.col("k") == F.col("of_k")).dropDuplicates(["k"]).select("doc.*")
