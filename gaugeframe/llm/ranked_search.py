"""Ranked lexical search over a length-stratified index (operator 11).

A term is a maximal run of ASCII letters and digits and of all characters beyond ASCII, with A-Z lower-cased. A term of a
query weighs w = floor(1000 ln((2N + 2) / (2df + 1))), and a document that holds it tf times gains w * (10^9 tf div
(1000 tf + 8m)), where m = 10 + 90 n N div L is its length normaliser (N documents with terms, L terms in all, n of its own).

All documents of a stratum have one m, so a posting's impact hangs on tf alone there. In a stratum the postings of a term
lie by falling tf: the impact is computed once for each tf, and the first one bounds what the term can add. The
bounds of a query's terms add up to that of the stratum. Strata are visited by falling bound, and no more of them once the
bound is below the score of the query's last place; ties are visited, since they may have a smaller doc_id.

1. Documents are read once per block of queries; a block's terms are bounded (``QUERY_BYTES``), so its vocabulary goes to the
   workers. Every document gives n and its postings of terms that are asked for; these are stored, without texts.
2. N, L and df come from the stored postings by aggregation, and then m of every document.
3. Postings are dealt by ranges of (m, doc_id): strata stay whole, and one with very many documents is split over tasks. A
   task indexes some ``POSTINGS`` at a time, searches all queries of the block and gives its best ``TOP`` of each on.
4. A window over (query, score, doc_id), which Spark limits per task before the shuffle, leaves the best of all.

Defined cases: null and empty texts have no terms, so such documents don't count in N and such queries find nothing; equal rows
of queries are one query, different texts with one item_id are ranked by themselves; repeated documents are ranked each;
equal scores go by doc_id, null last; an empty table on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .frames import store

TOP = 10
#: Bytes of query texts, and queries, that are searched for at a time.
QUERY_BYTES, QUERIES = 8 << 20, 1 << 14
#: Postings that are indexed at a time.
POSTINGS = 1 << 20
#: Each byte's lower-cased form, or a blank where it parts terms.
TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TERM_BYTES).split()


def normaliser(n: str = "n", documents: str = "n_docs", total: str = "n_terms") -> str:
    """m of a document as SQL; the product may be beyond 64 bits."""
    return f"cast(10 + (cast(90 as decimal(38,0)) * {n} * {documents}) div {total} as bigint)"


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Per document doc_id, n and the numbers (term) and occurrences (tf) of the terms in the vocabulary. Stored."""
    source = docs.select("doc_id", "text")
    lists = [StructField(c, ArrayType(IntegerType())) for c in ("term", "tf")]
    kind = StructType([source.schema["doc_id"], StructField("n", LongType()), *lists])
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value.get
        for whole in batches:
            for batch in (whole.slice(k, 512) for k in range(0, whole.num_rows, 512)):
                n, sizes, parts, counts = [], [0], [], []
                for text in batch.column("text"):
                    found = terms(text.as_py())
                    n.append(len(found))
                    ids = np.array([k for k in map(number, found) if k is not None], np.int32)
                    ids, times = np.unique(ids, return_counts=True)
                    parts.append(ids)
                    counts.append(times)
                    sizes.append(sizes[-1] + ids.size)
                upto = pa.array(sizes, pa.int32())
                flat = [np.concatenate(x).astype(np.int32) for x in (parts, counts)]
                columns = [pa.ListArray.from_arrays(upto, pa.array(x)) for x in flat]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *columns], kind.names)

    return store(source.mapInArrow(told, kind).where("n > 0"), "search-postings")


class Stratified:
    """Postings of some documents by term, stratum and tf; documents come in the order (m, doc_id)."""

    def __init__(self, m: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray):
        self.n_docs = m.size
        self.stratum = np.cumsum(np.diff(m, prepend=m[:1]) != 0)
        self.n_strata = int(self.stratum[-1]) + 1
        doc = np.repeat(np.arange(m.size), sizes)
        order = np.lexsort((-tf, self.stratum[doc], term))
        self.doc, term, tf = doc[order], term[order], tf[order].astype(np.int64)
        stratum = self.stratum[self.doc]
        new_list = np.ones(term.size, bool)
        new_list[1:] = (term[1:] != term[:-1]) | (stratum[1:] != stratum[:-1])
        new_tf = new_list.copy()
        new_tf[1:] |= tf[1:] != tf[:-1]
        # One impact for each tf of a list; the first one is the list's bound.
        at = np.flatnonzero(new_tf)
        impact = weights[term[at]] * (1_000_000_000 * tf[at] // (1000 * tf[at] + 8 * m[self.doc[at]]))
        self.impact = impact[np.cumsum(new_tf) - 1]
        self.low = np.flatnonzero(new_list)
        self.high = np.append(self.low[1:], term.size)
        self.list_stratum, self.bound = stratum[self.low], self.impact[self.low]
        list_term = term[self.low]
        self.of_term = np.searchsorted(list_term, np.arange(weights.size + 1))

    def visits(self, query: np.ndarray, floor: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Documents and scores, strata by falling bound; ``floor`` may be raised by send()."""
        lists = np.concatenate([np.zeros(0, np.int64), *[np.arange(self.of_term[t], self.of_term[t + 1]) for t in query]]).astype(np.int64)
        bounds = np.zeros(self.n_strata, np.int64)
        np.add.at(bounds, self.list_stratum[lists], self.bound[lists])
        order = np.argsort(-bounds, kind="stable")
        place = np.empty(self.n_strata, np.int64)
        place[order] = np.arange(order.size)
        lists = lists[np.argsort(place[self.list_stratum[lists]], kind="stable")]
        turn = place[self.list_stratum[lists]]
        at, step, scores = 0, 1, np.zeros(self.n_docs, np.int64)
        while at < order.size and bounds[order[at]] >= floor:
            end = min(at + step, int(np.searchsorted(-bounds[order], -floor, side="right")))
            own = lists[np.searchsorted(turn, at) : np.searchsorted(turn, end)]
            sizes = self.high[own] - self.low[own]
            upto = np.cumsum(sizes)
            met = np.repeat(self.low[own] - upto + sizes, sizes) + np.arange(upto[-1] if upto.size else 0)
            np.add.at(scores, self.doc[met], self.impact[met])
            docs = np.unique(self.doc[met])
            floor = yield docs, scores[docs]
            at, step = end, 2 * step


class Best:
    """The best documents of a query so far: falling scores, equal ones by doc_id (null last)."""

    def __init__(self, top: int):
        self.top, self.score, self.key, self.null = top, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def floor(self) -> int:
        return int(self.score[-1]) if self.score.size == self.top else 1

    def add(self, score: np.ndarray, key: np.ndarray, null: np.ndarray) -> None:
        high = score >= self.floor
        score, key, null = (np.concatenate([a, b[high]]) for a, b in ((self.score, score), (self.key, key), (self.null, null)))
        order = np.lexsort((key, null, -score))[: self.top]
        self.score, self.key, self.null = score[order], key[order], null[order]


def _ranked(index: DataFrame, queries: list[np.ndarray], weights: np.ndarray, top: int) -> DataFrame:
    """The best documents of each task for each query: (query, doc_id, score)."""
    kind = StructType([StructField("query", IntegerType()), StructField("doc_id", LongType()), StructField("score", LongType())])
    told = index.sparkSession.sparkContext.broadcast((queries, weights))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = told.value
        best = [Best(top) for _ in queries]
        held: list[tuple] = []

        def search() -> None:
            m, key, null, sizes, term, tf = (np.concatenate(x) for x in zip(*held))
            held.clear()
            block = Stratified(m, sizes, term, tf, weights)
            for query, found in zip(queries, best):
                visits, floor = block.visits(query, found.floor), None
                while True:
                    try:
                        docs, scores = visits.send(floor)
                    except StopIteration:
                        break
                    found.add(scores, key[docs], null[docs])
                    floor = found.floor

        size = 0
        for batch in batches:
            ids = batch.column("doc_id")
            lists = [batch.column(c) for c in ("term", "tf")]
            flat = [x.flatten().to_numpy() for x in lists]
            null = ids.is_null().to_numpy(False)
            sizes = pa.compute.list_value_length(lists[0]).to_numpy()
            held.append((batch.column("m").to_numpy(), ids.fill_null(0).to_numpy(), null, sizes, *flat))
            size += flat[0].size
            if size >= POSTINGS:
                search()
                size = 0
        if size:
            search()
        counts = [b.score.size for b in best]
        if sum(counts):
            number, score, key, null = (
                np.concatenate(x) for x in (np.split(np.repeat(np.arange(len(best)), counts), 1), *zip(*((b.score, b.key, b.null) for b in best)))
            )
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(key, mask=null), pa.array(score)], kind.names)

    return index.mapInArrow(searched, kind)


def _block(docs: DataFrame, items: list, top: int) -> DataFrame:
    """The best documents for a block of queries (rows with item_id and text)."""
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    queries = [np.array(sorted({vocabulary.setdefault(t, len(vocabulary)) for t in terms(r["text"])}), np.int64) for r in items]
    held = postings(docs, vocabulary)
    n_docs, n_terms = held.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in held.select(F.explode("term").alias("term")).groupBy("term").count().collect():  # one row a term of the block
        df[r["term"]] = r["count"]
    weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    sized = held.where(F.size("term") > 0).withColumn("m", F.expr(normaliser(documents=f"{n_docs}", total=f"{n_terms or 1}")))
    dealt = sized.repartitionByRange("m", "doc_id").sortWithinPartitions("m", "doc_id")
    found = _ranked(dealt, queries, weights, top)
    names = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(items)], "query int, item_id long")
    place = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    return best.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")  # at most QUERIES names


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` best documents with a score above 0 for each query."""
    asked = store(items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("text IS NOT NULL").distinct(), "search-items")
    n, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-size // QUERY_BYTES), -(-n // QUERIES))
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    out = None
    for k in range(blocks):
        found = _block(docs.select("doc_id", "text"), asked.where(place == k).collect(), top)  # about QUERY_BYTES
        out = found if out is None else out.unionByName(store(found, "search-found"))
    return out
