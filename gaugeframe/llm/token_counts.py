"""Token counts by a two-tier lookup on the map side (operator 12).

A byte-level tokenizer parts a text into pre-tokens and encodes each by itself, so the count of a text is the sum
of the counts of its pre-tokens. Two tiers know them:

1. A table of the ``TABLE`` most frequent pre-tokens of the corpus with their numbers of tokens, broadcast to the workers. Its size
   is bounded by ``TABLE`` times ``LONGEST`` characters. It is found by a pass over all documents in which each task keeps
   a Misra-Gries summary of ``SUMMARY`` counters and gives on its ``HEAD`` highest; only these summaries are shuffled, so
   what travels hangs on the number of tasks and not on the text. Which pre-tokens are in the table changes the time
   and never a result.
2. A cache in each worker for all others: those that are not in it are encoded by the library in one call per block of text.
   A full cache starts anew with the first tier.

The second pass reads each document where it lies and gives its counts: no pre-token is shuffled.

Texts of code points below U+02B0 are parted by a pattern of this module. Other texts, and those with a special string of
the tokenizer, are first cut before each run of white space, where pre-tokens always end; a part with such a character or
string goes to the library as it is. So its Unicode tables and its handling of special strings hold.

Defined cases: a null text is empty and has 0 bytes and 0 tokens; texts of any length are read in blocks, which are cut where
a pre-token ends; repeated rows are counted each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Pre-tokens of the first tier.
TABLE = 1 << 16
#: Counters of a task's summary, and how many of them it gives on.
SUMMARY, HEAD = 1 << 17, 1 << 12
#: Pre-tokens a worker knows, and characters up to which it keeps one.
KNOWN, LONGEST = 500_000, 64
#: Characters that are parted at a time.
BLOCK = 1 << 20
#: More tokens than this are over the limit.
LIMIT = 512

# Letters and numbers below U+02B0; all code points from U+00F8 on are letters there.
_L = "A-Za-zªµºÀ-ÖØ-öø-ʯ"
_N = "0-9²³¹¼-¾"
#: Pre-tokens of a plain text, as the tokenizer file's kind of pre-tokenizer defines them.
PRETOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
#: U+001C to U+001F are white space for Python and not for the tokenizer.
PLAIN = re.compile("[\u0000-\u001b -ʯ]*")
PART = regex.compile(r"\s*\S+|\s+")
EDGE = regex.compile(r"\S(?=\s)")


class PreTokens:
    """Parts texts into pre-tokens, and into larger parts where the library has to look, and counts their tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path) as file:
            kind = json.load(file)
        split = kind["pre_tokenizer"]
        added = kind["added_tokens"]
        loose = [t for t in added if t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])]
        if kind["normalizer"] or split["type"] != "ByteLevel" or not split["use_regex"] or split["add_prefix_space"] or loose:
            raise ValueError(f"{path}: only byte-level tokenizers without normalizer and prefix space are known here")
        self.special = [t["content"] for t in added]
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def plain(self, text: str) -> bool:
        return PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special)

    def parts(self, text: str) -> list[str]:
        if self.plain(text):
            return PRETOKEN.findall(text)
        return list(chain.from_iterable(PRETOKEN.findall(p) if self.plain(p) else (p,) for p in PART.findall(text)))

    def sizes(self, words: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]


@lru_cache(maxsize=2)
def _pretokens(path: str) -> PreTokens:
    return PreTokens(path)


def segments(text: str, size: int = 0) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut before white space that follows something else."""
    at, size = 0, size or BLOCK
    while len(text) - at > size:
        edge = EDGE.search(text, at + size - 1)
        end = edge.end() if edge else len(text)
        yield text[at:end]
        at = end
    if at < len(text):
        yield text[at:]


def blocks(texts: pa.Array) -> Iterator[list[tuple[int, str]]]:
    """Row numbers and segments of the texts, about BLOCK characters at a time."""
    held: list[tuple[int, str]] = []
    size = 0
    for row, text in enumerate(texts):
        for segment in segments(text.as_py() or ""):
            held.append((row, segment))
            size += len(segment)
            if size >= BLOCK:
                yield held
                held, size = [], 0
    yield held


def lowered(seen: Counter[str], most: int) -> Counter[str]:
    """At most so many counters, each lowered by the highest count that goes, which is the bound of the error."""
    cut = sorted(seen.values(), reverse=True)[most] if len(seen) > most else 0
    return Counter({w: n - cut for w, n in seen.items() if n > cut})


def frequent(docs: DataFrame, path: str, table: int = TABLE) -> list[str]:
    """The most frequent pre-tokens of all documents, up to the error of the summaries; at most ``table`` words."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = _pretokens(path), Counter()
        for batch in batches:
            for block in blocks(batch.column("text")):
                for _, segment in block:
                    seen.update(known.parts(segment))
                if len(seen) > SUMMARY:
                    seen = lowered(seen, SUMMARY // 2)
        head = [(w, n) for w, n in seen.most_common(HEAD) if len(w) <= LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in head], pa.string()), pa.array([n for _, n in head], pa.int64())], ["word", "n"])

    words = docs.select("text").mapInArrow(told, StructType([StructField("word", StringType()), StructField("n", LongType())]))
    merged = words.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(table)
    return [r["word"] for r in merged.collect()]  # at most ``table`` rows


class Counts(dict):
    """Tokens of each pre-token: the first tier for good, others until the table is full."""

    def __init__(self, known: PreTokens, first: dict[str, int]):
        super().__init__(first)
        self.known, self.first = known, first

    def of(self, words: list[str]) -> np.ndarray:
        found = list(map(self.get, words))
        if None in found:
            missed = list({w for w, n in zip(words, found) if n is None})
            self.update(zip(missed, self.known.sizes(missed)))
            found = list(map(self.__getitem__, words))
            for word in missed:
                if len(word) > LONGEST:
                    del self[word]
            if len(self) > KNOWN:
                self.clear()
                self.update(self.first)
        return np.array(found, np.int64)


def n_tokens(texts: pa.Array, counts: Counts) -> np.ndarray:
    """The number of tokens of each text."""
    sums = np.zeros(len(texts), np.int64)
    for block in blocks(texts):
        split = [counts.known.parts(segment) for _, segment in block]
        upto = np.cumsum([0, *counts.of(list(chain.from_iterable(split)))])
        ends = np.cumsum([0, *map(len, split)])
        np.add.at(sums, np.array([row for row, _ in block], np.int64), np.diff(upto[ends]))
    return sums


#: The table of this worker: it lives on from task to task.
_WORKER: dict[tuple, Counts] = {}


def _counts(path: str, first: dict[str, int]) -> Counts:
    key = (path, len(first), hash(frozenset(first.items())))
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Counts(_pretokens(path), first)
    return _WORKER[key]


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, table: int = TABLE) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of each document.

    ``tokenizer`` is the path of a byte-level tokenizer file that every executor can open.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    source = docs.select("doc_id", "text")
    words = frequent(source, path, table)
    first = docs.sparkSession.sparkContext.broadcast(dict(zip(words, _pretokens(path).sizes(words))))
    kind = StructType([source.schema["doc_id"], StructField("n_bytes", LongType()), StructField("n_tokens", LongType())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counts(path, first.value)
        for batch in batches:
            texts = batch.column("text")
            n_bytes = pc.cast(pc.fill_null(pc.binary_length(texts), 0), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n_bytes, pa.array(n_tokens(texts, counts))], kind.names)

    return source.mapInArrow(counted, kind).withColumn("over_limit", F.col("n_tokens") > limit)
