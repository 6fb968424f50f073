"""Toxicity scores by an FTRL-proximal logistic regression (operator 5).

Features are the different words, word pairs and pairs with one word left out (skip-grams) of a text, lower-cased,
hashed to ``1 << BITS`` numbers. FTRL-proximal keeps a learning rate per coordinate and an L1 penalty, so most
weights are exactly zero; the rest is a table of at most ``1 << BITS`` numbers that goes to all tasks.

Scores are shifted so that the cut that best tells the two labels apart comes to lie at ``PREDICTED``: each of ``FOLDS``
parts of the sample is scored by a model of the other parts, and the cut with the best F1 is taken. The shift is
part of the bias; the order of the scores does not change.

The model is fitted in one task on at most ``MAX_ROWS`` labelled rows, taken in the order of a hash of
their doc_id; their features are computed in parallel. The sample of the labels is bounded, so it is broadcast to the
documents. Scoring reads each document once, without a shuffle, over its whole text.

Defined cases: a null or empty text has no features and gets the score of the bias; a null doc_id is
never held out; labels with null doc_id or toxic are ignored, of contrary labels the toxic one holds; of rows that
repeat a labelled doc_id the one of the least text hash counts; without labels every score is that of the
empty model, 0.5; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from .groups import sliced

BITS = 20
#: Bound of the training sample.
MAX_ROWS = 16_000
EPOCHS = 3
FOLDS = 5
PREDICTED = 0.7
#: Words a worker remembers.
KNOWN = 400_000
WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Ftrl:
    """Rates and penalties: alpha and beta set the rate of a coordinate, l1 what it must earn to count."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 5.0
    l2: float = 0.0


class Hashes(dict):
    """CRC-32 of each word."""

    def __missing__(self, word: str) -> int:
        if len(self) > KNOWN:
            self.clear()
        self[word] = value = zlib.crc32(word.encode())
        return value


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: str, known: Hashes) -> np.ndarray:
    """Numbers of the words, pairs and skip-grams of a text, with repeats."""
    found = WORD.findall(text.lower())
    h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found)) + np.uint64(1)
    first = h * np.uint64(0xD6E8FEB86659FD93)
    parts = [_spread(first)]
    for gap, odd in ((1, 0xA0761D6478BD642F), (2, 0xE7037ED1A0B428DB)):
        parts.append(_spread(first[:-gap] ^ (h[gap:] * np.uint64(odd))) if h.size > gap else np.zeros(0, np.int64))
    return np.concatenate(parts)


def fit(rows: list[np.ndarray], labels: np.ndarray, how: Ftrl = Ftrl(), epochs: int = EPOCHS) -> np.ndarray:
    """Weights after ``epochs`` passes over rows of different feature numbers; the last weight is the bias."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(i):
        w = -(z[i] - np.sign(z[i]) * how.l1) / ((how.beta + np.sqrt(n[i])) / how.alpha + how.l2)
        return np.where(np.abs(z[i]) <= how.l1, 0.0, w)

    for _ in range(epochs):
        for row, label in zip(rows, labels):
            i = np.append(row, size - 1)
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            rate = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / how.alpha
            z[i] += g - rate * w
            n[i] += g * g
    return weights(slice(None))


def logits(rows: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    return np.array([weights[r].sum() for r in rows]) + weights[-1]


def best_cut(values: np.ndarray, labels: np.ndarray) -> float | None:
    """The cut between two neighbouring values with the best F1; None where one label is missing."""
    if not 0 < labels.sum() < labels.size:
        return None
    order = np.argsort(-values, kind="stable")
    values, hits = values[order], np.cumsum(labels[order])
    f1 = np.where(values == np.append(values[1:], -np.inf), 0, 2 * hits / (np.arange(1, hits.size + 1) + labels.sum()))
    k = int(f1[:-1].argmax())
    return float(values[k] + values[k + 1]) / 2


def fit_shifted(rows: list[np.ndarray], labels: np.ndarray, how: Ftrl) -> np.ndarray:
    """Weights of all rows, with the bias shifted by the cut that models of the other folds need."""
    fold = np.arange(len(rows)) % FOLDS
    pick = lambda which: [r for r, x in zip(rows, which) if x]
    unseen = np.zeros(len(rows))
    for k in range(FOLDS if 0 < labels.sum() < labels.size else 0):
        unseen[fold == k] = logits(pick(fold == k), fit(pick(fold != k), labels[fold != k], how))
    cut = best_cut(unseen, labels)
    weights = fit(rows, labels, how)
    weights[-1] += 0 if cut is None else np.log(PREDICTED / (1 - PREDICTED)) - cut
    return weights


def held_out(doc_id: Column) -> Column:
    """The third of the documents that never teaches."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, how: Ftrl = Ftrl(), max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and weights of the features that count."""
    usable = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    marked = usable.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    order = F.xxhash64("doc_id")
    # Bounded: max_rows rows of two numbers.
    sample = marked.orderBy(order, "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", F.md5(F.coalesce("text", F.lit(""))).alias("th"), "text")
    kind = StructType([*rows.schema.fields[:3], StructField("features", ArrayType(IntegerType()))])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in sliced(batches, 512):
            found = [np.unique(features(t or "", known)).astype(np.int32) for t in batch.column("text").to_pylist()]
            lists = pa.array(found, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], ["doc_id", "toxic", "th", "features"])

    # Of several texts with one id the one with the least hash teaches, in whatever order tasks end.
    one = F.min_by(F.struct("toxic", "features"), "th").alias("one")
    once = rows.mapInArrow(numbered, kind).groupBy("doc_id").agg(one).select("doc_id", "one.*")
    picked = once.select("doc_id", "toxic", "features", order.alias("place"))

    def fitted(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["place", "doc_id"])
        w = fit_shifted([np.asarray(f, np.int64) for f in part["features"]], part["toxic"].to_numpy(float), how)
        at = np.flatnonzero(w)
        return pd.DataFrame({"feature": at, "weight": w[at]})

    out = StructType([StructField("feature", LongType()), StructField("weight", DoubleType())])
    found = picked.groupBy(F.lit(1).alias("one")).applyInPandas(fitted, out).toPandas()
    return found["feature"].to_numpy(np.int64), found["weight"].to_numpy(float)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id and score of each document."""
    source = docs.select("doc_id", "text")
    size = (1 << BITS) + 1

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = Hashes(), np.zeros(size)
        table[model[0]] = model[1]
        for batch in sliced(batches, 512):
            sums = np.empty(batch.num_rows)
            for k, text in enumerate(batch.column("text")):
                found = features(text.as_py() or "", known)
                sums[k] = table[np.unique(found[table[found] != 0])].sum() + table[-1]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(sums, -35, 35))))], ["doc_id", "score"])

    return source.mapInArrow(scored, StructType([source.schema["doc_id"], StructField("score", DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= PREDICTED).cast("int").alias("predicted"))
