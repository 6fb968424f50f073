"""Packing without padding by power-of-two decomposition (operator 8).

A document is tokenised, its end mark is added, and its ids are cut into pieces of ``MAX_LENGTH`` followed by one
piece for each bit of what is left, longest first. Every piece is a sequence of its own, so no sequence
crosses documents, and since its length is a power of two it is never padded. The length is the bucket: a
trainer takes batches of equal lengths (``write_buckets`` stores one folder per length).

Documents are cut where they are read: no shuffle. A sequence id is the number of the piece within the
scan; it is the same each time the same files are scanned, and unique but not gapless.

White space parts tokens, so texts are split at blanks and line ends and each different word is
tokenised once per worker, which remembers two tables of ``KNOWN`` words.

Defined cases: null and empty texts have the end mark as their only id; repeated rows are packed each; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

MAX_LENGTH = 4096
#: Id of the end mark, added to each document.
END = 2
#: Words a worker remembers.
KNOWN = 600_000
#: Texts that need no more than lower case and blanks around their marks.
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ., \\n]*")
DOUBLE_MARKS = ("..", ",,", ".,", ",.")
#: Characters of a text that are split into words at a time.
SEGMENT = 1 << 20


class WordTokens(dict):
    """Ids of each word, kept in one growing array; numbers words as they come.

    Full tables are kept as the older half: its words are taken over when they come again.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer
        self.old: tuple[dict, np.ndarray, np.ndarray] = ({}, np.zeros(0, np.uint32), np.zeros(1, np.int64))
        self._empty()

    def _empty(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.flat = np.zeros(0, np.uint32)
        self.ends = np.zeros(1, np.int64)

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number

    def make_room(self) -> None:
        if len(self) > KNOWN:
            self.old = (dict(self), self.flat, self.ends)
            self._empty()

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def learn(self) -> None:
        """Ids of the words that are new since the last call."""
        table, flat, ends = self.old
        taken = np.array([table.get(w, -1) for w in self.new], np.int64)
        unknown = [w for w, at in zip(self.new, taken.tolist()) if at < 0]
        encoded = self.tokenizer.encode(unknown, is_pretokenized=True, add_special_tokens=False)
        sizes = np.zeros(taken.size, np.int64)
        fresh = taken < 0
        sizes[fresh] = np.bincount(np.array(encoded.word_ids, np.int64), minlength=len(unknown))
        sizes[~fresh] = ends[taken[~fresh] + 1] - ends[taken[~fresh]]
        ids = np.empty(sizes.sum(), np.uint32)
        of_fresh = np.repeat(fresh, sizes)
        ids[of_fresh] = np.array(encoded.ids, np.uint32)
        ids[~of_fresh] = _gathered(flat, ends, taken[~fresh])
        self.ends = np.concatenate([self.ends, np.cumsum(sizes) + self.ends[-1]])
        self.flat = np.concatenate([self.flat, ids])
        self.new = []

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        return _gathered(self.flat, self.ends, numbers)


def _gathered(flat: np.ndarray, ends: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` with the given numbers, one after the other."""
    starts, sizes = ends[numbers], ends[numbers + 1] - ends[numbers]
    upto = np.cumsum(sizes)
    return flat[np.repeat(starts - upto + sizes, sizes) + np.arange(upto[-1] if upto.size else 0)]


class Tokens:
    """Ids of texts. Words of Latin-1 letters with single points and commas, as most texts are made of, are lower-cased and parted
    here, as the tokenizer would, so that one entry stands for all forms of a word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        bare = Tokenizer.from_file(path)
        # Lower-case words are left alone by these steps, so only the merges are left to do.
        bare.normalizer = normalizers.Sequence([])
        bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.odd, self.plain = WordTokens(Tokenizer.from_file(path)), WordTokens(bare)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        for table in (self.odd, self.plain):
            table.make_room()
        numbers = [self._numbers(t) for t in texts]
        for table in (self.odd, self.plain):
            table.learn()
        return [np.concatenate([np.zeros(0, np.uint32), *(table.ids(n) for table, n in parts)]) for parts in numbers]

    def _numbers(self, text: str) -> list[tuple[WordTokens, np.ndarray]]:
        """Tables and word numbers of the text's parts: whole segments if they are plain, else line by line."""
        out = []
        for segment in segments(text):
            for part in [segment] if plain(segment) else segment.split("\n"):
                if plain(part):
                    out.append((self.plain, self.plain.numbers(part.lower().replace(".", " . ").replace(",", " , ").split())))
                else:
                    out.append((self.odd, self.odd.numbers(part.split(" "))))
        return out


def plain(text: str) -> bool:
    return PLAIN.fullmatch(text) is not None and not any(x in text for x in DOUBLE_MARKS)


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut at blanks or line ends."""
    at = 0
    while len(text) - at > size:
        cuts = [text.find(c, at + size) for c in " \n"]
        end = min((c for c in cuts if c >= 0), default=len(text))
        yield text[at:end]
        at = end + 1
    if text and at < len(text):
        yield text[at:]


def piece_lengths(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """Lengths of the pieces of n ids: ``longest`` (a power of two) as often as it fits, then the bits of the rest."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


@lru_cache(maxsize=2)
def _tokens(path: str) -> Tokens:
    return Tokens(path)


def pieces(docs: DataFrame, tokenizer: str | None = None, with_ids: bool = True, at_once: int = 256) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids on request.

    ``tokenizer`` is the path of a file that every executor can open.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    longs = ["start", "length", "ids_crc32", "doc_tokens"]
    source = docs.select("doc_id", "text")
    fields = [source.schema["doc_id"], *[StructField(c, LongType()) for c in longs]]
    fields += [StructField("ids", ArrayType(IntegerType()))] if with_ids else []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _tokens(path)
        for whole in batches:
            for batch in (whole.slice(k, at_once) for k in range(0, whole.num_rows, at_once)):
                rows: list[tuple[int, int, int, int, int]] = []
                lists = []
                for k, ids in enumerate(known([t or "" for t in batch.column("text").to_pylist()])):
                    ids = np.append(ids, np.uint32(END)).astype("<u4")
                    at = 0
                    for size in piece_lengths(ids.size):
                        part = ids[at : at + size]
                        rows.append((k, at, size, zlib.crc32(part.tobytes()), ids.size))
                        lists.append(part)
                        at += size
                table = np.array(rows, np.int64).reshape(-1, 5)
                columns = [batch.column("doc_id").take(pa.array(table[:, 0]))]
                columns += [pa.array(table[:, k]) for k in range(1, 5)]
                names = ["doc_id", *longs]
                if with_ids:
                    flat = np.concatenate([*lists, np.zeros(0, "<u4")]).astype(np.int32)
                    offsets = np.concatenate([[0], np.cumsum(table[:, 2])]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    cut_up = source.mapInArrow(cut, StructType(fields))
    numbered = cut_up.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("bigint"))
    return numbered.select("doc_id", *longs, "sequence_id", "offset", *(["ids"] if with_ids else []))


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder per length, from which a trainer draws batches of equal lengths."""
    packed.write.mode("overwrite").partitionBy("length").parquet(path)
