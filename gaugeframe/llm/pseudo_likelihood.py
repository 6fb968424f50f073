"""Scores by masked pseudo-likelihood (operator 2).

A small network predicts each token of a text from the ``REACH`` tokens on either side of it: their embeddings, one
table per place, are added up, go through tanh and then through a two-step softmax (a class of the vocabulary,
then the token within its class). The score of a document is the sum of the logarithms of the probabilities of all its
tokens, each given both its sides.

Tokens are lower-cased words. All words of the corpus are counted in Spark and their counts are kept as a table, which grows with
the corpus. The ``TOP`` most frequent words have numbers of their own; all others share ``OTHERS`` numbers by hash. A word without
a number of its own has the probability of its shared number times its share of that number's occurrences in the corpus, with one
occurrence set aside for all words that the corpus does not have. The counts of the ``MIDDLE`` next frequent words are
told to the workers, those of all others meet the documents by a join on the word; a word that occurs once adds log 1 = 0.
What the driver and the workers hold is of fixed size: the network, and ``TOP + MIDDLE`` words of at most ``LONGEST`` characters.

Training does not hang on how the documents lie in files. They are dealt to shards of about ``SHARD`` tokens by a hash of id and text
and ordered by it; in each of ``ROUNDS`` rounds the shards of that round (every ``ROUNDS``-th) each train a copy of the current network, so every
position of every document is a target once. The copies are averaged, weighted by their positions, in a tree of fixed fan-in: a step holds
``FAN_IN`` pieces of ``PIECE`` values, however many shards there are, and only one network reaches the driver.

Defined cases: a null or empty text has no tokens, the sum 0.0 and a null mean; repeated rows are scored each; texts
of any length are cut into words in blocks; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from .frames import store
from .packing import segments

#: Numbers of the vocabulary are CLASSES x CLASSES: the most frequent words, then shared ones. The last number plus 1 is beyond the border.
CLASSES = 48
VOCABULARY = CLASSES * CLASSES
OTHERS = 512
TOP = VOCABULARY - OTHERS
#: Words whose counts the workers know besides, and the most characters of a word that they know.
MIDDLE, LONGEST = 1 << 16, 64
#: Tokens of a shard, copies that are averaged at a time, and values of a network that travel in one row.
SHARD, FAN_IN, PIECE = 2_000_000, 16, 4096
REACH = 2
WIDTH = 16
ROUNDS = 2
RATE = 0.2
BATCH = 4096
#: Positions whose probabilities are computed at a time.
BLOCK = 1 << 15
#: Documents that are trained on or scored at a time.
AT_ONCE = 256
#: Characters after which a task numbers the documents that it holds, and after which it gives its word counts on.
NUMBERED = COUNTED = 1 << 22

Network = dict[str, np.ndarray]
PLACES = [*range(-REACH, 0), *range(1, REACH + 1)]
#: Outputs have a last row for the bias.
SHAPES = {
    "embed": (VOCABULARY + 1, len(PLACES), WIDTH),
    "bias": (WIDTH,),
    "outer": (WIDTH + 1, CLASSES),
    "inner": (CLASSES, WIDTH + 1, CLASSES),
}


def new_network() -> Network:
    rng = np.random.default_rng(7)
    net = {k: rng.normal(0, 0.1, s).astype(np.float32) for k, s in SHAPES.items()}
    net["bias"][:] = net["outer"][-1] = net["inner"][:, -1] = 0
    return net


def flat(net: Network) -> np.ndarray:
    return np.concatenate([net[k].ravel() for k in SHAPES])


def shaped(values: np.ndarray) -> Network:
    ends = np.cumsum([int(np.prod(s)) for s in SHAPES.values()])
    return {k: part.reshape(s).astype(np.float32) for (k, s), part in zip(SHAPES.items(), np.split(values, ends[:-1]))}


class Vocabulary(NamedTuple):
    """The words with numbers of their own, and what the corpus says about all other words."""

    top: list[str]
    #: log n of the more frequent words without a number.
    middle: dict[str, float]
    #: For each shared number log(its occurrences + 1).
    shared: np.ndarray
    #: Stored counts (word, n) of all words.
    counts: DataFrame
    n_tokens: int


class Numbers:
    """Places of words in two tables: their vocabulary numbers, and the logarithms of the counts of those that share one (NaN: not known).

    The words that the workers know come first; all others have the place of their shared number.
    """

    def __init__(self, top: list[str], middle: dict[str, float] | None = None):
        counts = middle or {}
        self.words = pa.array([*top, *counts], pa.large_string())
        shared = [TOP + zlib.crc32(w.encode()) % OTHERS for w in counts]
        self.number = np.array([*range(len(top)), *shared, *range(TOP, VOCABULARY)], np.uint16)
        self.log_count = np.array([*[0.0] * len(top), *counts.values(), *[np.nan] * OTHERS])

    def places(self, words: pa.Array) -> np.ndarray:
        out = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)
        others = np.flatnonzero(out < 0)
        raw = words.take(pa.array(others)).cast(pa.large_binary()).to_numpy(zero_copy_only=False)
        out[others] = len(self.words) + np.fromiter(map(zlib.crc32, raw), np.int64, others.size) % OTHERS
        return out


def tokens(parts: Iterable[str]) -> pa.ListArray:
    """The lower-cased words of each part of a text. Arrow's white space is that of ``str.split``, but it leaves empty words at the ends."""
    plain = pa.array([part.lower().strip() or None for part in parts], pa.large_string())
    return pc.utf8_split_whitespace(plain)


class Numbered(NamedTuple):
    """The tokens of some texts."""

    #: Numbers of all tokens with REACH borders before, between and after the texts.
    ids: np.ndarray
    #: Starts of the texts there, and the end.
    starts: np.ndarray
    #: Where the tokens are in ids, their places, and themselves.
    at: np.ndarray
    places: np.ndarray
    words: pa.Array


def numbered(texts: list[str | None], known: Numbers) -> Numbered:
    parts, owners = [], []
    for k, text in enumerate(texts):
        for part in segments(text or ""):
            parts.append(part)
            owners.append(k)
    lists = tokens(parts)
    words = lists.flatten()
    sizes = np.bincount(owners, lists.value_lengths().fill_null(0).to_numpy(), len(texts)).astype(np.int64)
    starts = REACH + np.append(0, np.cumsum(sizes + REACH))
    at = np.arange(len(words)) + np.repeat(REACH * np.arange(1, len(texts) + 1), sizes)
    places = known.places(words)
    ids = np.full(starts[-1], VOCABULARY, np.uint16)
    ids[at] = known.number[places]
    return Numbered(ids, starts, at, places, words)


def by_documents(starts: np.ndarray) -> Iterator[slice]:
    """The ids of AT_ONCE texts at a time, with the borders around them."""
    last = starts.size - 1
    for k in range(0, last, AT_ONCE):
        yield slice(starts[k] - REACH, starts[min(k + AT_ONCE, last)])


ONES = np.ones((CLASSES, 1), np.float32)


def _softmax(x: np.ndarray) -> np.ndarray:
    """In place."""
    x -= x.max(axis=-1, keepdims=True)
    np.exp(x, out=x)
    x /= x @ ONES
    return x


def _log_softmax(x: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Of one value per row; x is used up."""
    x -= x.max(axis=-1, keepdims=True)
    own = x.ravel().take(np.arange(0, x.size, CLASSES) + which)
    return own - np.log(np.exp(x, out=x) @ ONES)[:, 0]


def _hidden(net: Network, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The hidden layer at some places, with a last column of ones."""
    rows, first = net["embed"].reshape(-1, WIDTH), ids.astype(np.int64) * len(PLACES)
    h = net["bias"] + rows.take(first[at + PLACES[0]], axis=0)
    for k, place in list(enumerate(PLACES))[1:]:
        h += rows.take(first[at + place] + k, axis=0)
    out = np.ones((at.size, WIDTH + 1), np.float32)
    np.tanh(h, out=out[:, :-1])
    return out


class Targets(NamedTuple):
    """The tokens of some places, in the order of their numbers, without borders."""

    at: np.ndarray
    group: np.ndarray
    within: np.ndarray
    #: Where each class begins.
    cuts: np.ndarray


def _targets(ids: np.ndarray, low: int, high: int) -> Targets:
    at = np.argsort(ids[low:high], kind="stable")
    token = ids[low:high][at].astype(np.int64)
    n = np.searchsorted(token, VOCABULARY)
    group, within = np.divmod(token[:n], CLASSES)
    return Targets(at[:n], group, within, np.searchsorted(group, np.arange(CLASSES + 1)))


def _inner(net: Network, h: np.ndarray, t: Targets) -> np.ndarray:
    """Scores of the tokens of each target's class."""
    e = np.empty((t.at.size, CLASSES), np.float32)
    for c in np.flatnonzero(np.diff(t.cuts)):
        np.matmul(h[t.cuts[c] : t.cuts[c + 1]], net["inner"][c], out=e[t.cuts[c] : t.cuts[c + 1]])
    return e


def segment_sums(rows: np.ndarray, firsts: np.ndarray, few: int = 8) -> np.ndarray:
    """The sum of each segment of rows: long segments one by one, all short ones together, row by row."""
    sizes = np.diff(firsts, append=rows.shape[0])
    out = rows.take(firsts, axis=0)
    for k in np.flatnonzero(sizes > few):
        np.add.reduce(rows[firsts[k] : firsts[k] + sizes[k]], axis=0, out=out[k])
    # The longer ones first, so that each step adds to the first so many.
    short = np.flatnonzero((sizes > 1) & (sizes <= few))
    short = short[np.argsort(-sizes[short], kind="stable")]
    sums, next_rows, ends = out.take(short, axis=0), firsts[short], -sizes[short]
    for step in range(1, few):
        n = np.searchsorted(ends, -step)
        sums[:n] += rows.take(next_rows[:n] + step, axis=0)
    out[short] = sums
    return out


def log_probabilities(net: Network, ids: np.ndarray) -> np.ndarray:
    """log p of each token given both its sides; 0 at the borders."""
    out = np.zeros(ids.size)
    for low in range(REACH, ids.size - REACH, BLOCK):
        high = min(low + BLOCK, ids.size - REACH)
        t = _targets(ids, low, high)
        h = _hidden(net, ids, low + t.at)
        out[low + t.at] = _log_softmax(h @ net["outer"], t.group) + _log_softmax(_inner(net, h, t), t.within)
    return out


def learn(net: Network, squares: Network, ids: np.ndarray) -> int:
    """One pass of Adagrad over all tokens, in place; their number."""

    def step(name: str, grad: np.ndarray, where=slice(None)) -> None:
        seen = squares[name][where] + grad * grad
        squares[name][where] = seen
        seen += 1e-6
        np.sqrt(seen, out=seen)
        np.divide(grad, seen, out=seen)
        seen *= RATE
        net[name][where] -= seen

    places = 0
    for low in range(REACH, ids.size - REACH, BATCH):
        high = min(low + BATCH, ids.size - REACH)
        t = _targets(ids, low, high)
        n, rows = t.at.size, np.arange(t.at.size)
        if not n:
            continue
        places += n
        h = _hidden(net, ids, low + t.at)
        d = _softmax(h @ net["outer"])
        d[rows, t.group] -= 1
        d /= n
        back = d @ net["outer"].T
        e = _softmax(_inner(net, h, t))
        e[rows, t.within] -= 1
        e /= n
        met = np.flatnonzero(np.diff(t.cuts))
        inner = np.empty((met.size, WIDTH + 1, CLASSES), np.float32)
        for k, c in enumerate(met):
            s = slice(t.cuts[c], t.cuts[c + 1])
            back[s] += e[s] @ net["inner"][c].T
            np.matmul(h[s].T, e[s], out=inner[k])
        step("outer", h.T @ d)
        step("inner", inner, met)
        h = h[:, :-1]
        back = back[:, :-1] * (1 - h * h)
        step("bias", back.sum(0))
        # A token at one place is context of its neighbours: shifted gradients, added up by token.
        own = np.zeros((high - low, WIDTH), np.float32)
        own[t.at] = back
        near = np.zeros((high - low + 2 * REACH, len(PLACES), WIDTH), np.float32)
        for k, place in enumerate(PLACES):
            near[REACH + place : REACH + place + high - low, k] = own
        around = ids[low - REACH : high + REACH]
        order = np.argsort(around, kind="stable")
        firsts = np.flatnonzero(np.diff(around[order].astype(np.int64), prepend=-1))
        sums = segment_sums(near.reshape(len(near), -1).take(order, axis=0), firsts)
        step("embed", sums.reshape(-1, len(PLACES), WIDTH), around[order[firsts]])
    return places


def counted(docs: DataFrame) -> DataFrame:
    """All different words of all documents with their counts (word, n). Stored."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        size = 0

        def sums() -> pa.RecordBatch:
            found = pc.value_counts(tokens(held).flatten())
            return pa.RecordBatch.from_arrays([found.field(0).cast(pa.string()), found.field(1)], ["word", "n"])

        for batch in batches:
            for text in batch.column("text"):
                for part in segments(text.as_py() or ""):
                    held.append(part)
                    size += len(part)
                    if size > COUNTED:
                        yield sums()
                        held, size = [], 0
        yield sums()

    words = docs.select("text").mapInArrow(told, StructType([StructField("word", StringType()), StructField("n", LongType())]))
    return store(words.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def _frequent(counts: DataFrame) -> DataFrame:
    """The words above a count that at most TOP + MIDDLE words exceed. Counts are told apart by their six leading bits."""
    short = counts.where(F.length("word") <= LONGEST)
    cut = F.greatest(F.length(F.bin("n")) - 6, F.lit(0))
    sizes = short.select("n", cut.alias("cut")).groupBy(F.expr("shiftleft(shiftright(n, cut), cut)").alias("least")).agg(F.count(F.lit(1)).alias("words"))
    least, room = None, TOP + MIDDLE
    for r in sorted(sizes.collect(), key=lambda r: -r["least"]):  # at most 64 numbers for each power of two
        room -= r["words"]
        if room < 0:
            break
        least = r["least"]
    return short.where(F.col("n") >= least) if least else short.limit(0)


def vocabulary(docs: DataFrame) -> Vocabulary:
    """The vocabulary of all documents; equally frequent words come in alphabetical order, and are told to the workers all or none."""
    counts = counted(docs)
    often = sorted(_frequent(counts).collect(), key=lambda r: (-r["n"], r["word"]))  # at most TOP + MIDDLE
    top = [r["word"] for r in often[:TOP]]
    shared = np.zeros(OTHERS)
    for r in counts.groupBy(F.pmod(F.crc32("word"), F.lit(OTHERS)).alias("k")).agg(F.sum("n").alias("n")).collect():  # one row a number
        shared[r["k"]] = r["n"]
    n_tokens = int(shared.sum())
    for r in often[:TOP]:
        shared[zlib.crc32(r["word"].encode()) % OTHERS] -= r["n"]
    middle = {r["word"]: float(np.log(r["n"])) for r in often[TOP:]}
    return Vocabulary(top, middle, np.log(shared + 1), counts, n_tokens)


def dealt(docs: DataFrame, shards: int, number: int) -> DataFrame:
    """The texts of a round with their shard, each shard in one partition and in the order of a hash."""
    mark = F.xxhash64("doc_id", "text")
    rows = docs.where("text IS NOT NULL").select("text", mark.alias("mark"), F.pmod(mark, F.lit(shards)).alias("shard"))
    own = rows.where(F.col("shard") % ROUNDS == number)
    number = F.floor(F.col("shard") / ROUNDS).cast("int")
    return own.repartitionById(-(-shards // ROUNDS), number).sortWithinPartitions("shard", "mark")


COPY = StructType([StructField("k", IntegerType()), StructField("t", LongType()), StructField("v", BinaryType()), StructField("n", LongType())])


def averaged(copies: pa.Table, fan_in: int) -> pa.Table:
    """The weighted mean of a piece of some copies, in their order."""
    order = np.argsort(copies.column("t").to_numpy())
    n, v = copies.column("n").to_numpy()[order], copies.column("v").take(pa.array(order))
    mean = sum(np.frombuffer(x.as_py(), np.float32) * (m / n.sum()) for x, m in zip(v, n)).astype(np.float32)
    t = copies.column("t").to_numpy()[order[:1]] // fan_in
    return pa.table({"k": copies.column("k").slice(0, 1), "t": t, "v": pa.array([mean.tobytes()], pa.binary()), "n": pa.array([n.sum()], pa.int64())})


def merged(copies: DataFrame, n: int, fan_in: int = FAN_IN) -> DataFrame:
    """One copy from ``n`` with numbers from 0, level by level."""

    def mean(group: pa.Table) -> pa.Table:
        return averaged(group, fan_in)

    while n > 1:
        copies = copies.groupBy("k", F.expr(f"t div {fan_in}").alias("g")).applyInArrow(mean, COPY)
        n = -(-n // fan_in)
    return copies


def _round(docs: DataFrame, words: Vocabulary, start: Network, shards: int, number: int) -> Network:
    """A copy of the network per shard of this round, trained on its documents; the weighted mean of all copies."""
    told = docs.sparkSession.sparkContext.broadcast((words.top, words.middle, start))

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, middle, start = told.value
        known, shard, places = Numbers(top, middle), None, 0

        def learned() -> int:
            texts = numbered(held, known)
            return sum(learn(net, squares, texts.ids[part]) for part in by_documents(texts.starts))

        def copy() -> Iterator[pa.RecordBatch]:
            if places:
                values = flat(net)
                parts = [values[k : k + PIECE].tobytes() for k in range(0, values.size, PIECE)]
                each = lambda x: pa.array([x] * len(parts), pa.int64())
                columns = [pa.array(range(len(parts)), pa.int32()), each(shard // ROUNDS), pa.array(parts, pa.binary()), each(places)]
                yield pa.RecordBatch.from_arrays(columns, COPY.names)

        for batch in batches:
            # In steps of so many documents from the shard's first one on, however the batches fall.
            for text, own in zip(batch.column("text"), batch.column("shard").to_pylist()):
                if own != shard:
                    if shard is not None:
                        places += learned()
                        yield from copy()
                    shard, places, held, size = own, 0, [], 0
                    net = {k: v.copy() for k, v in start.items()}
                    squares = {k: np.zeros_like(v) for k, v in net.items()}
                held.append(text.as_py())
                size += len(held[-1])
                if len(held) % AT_ONCE == 0 and size > NUMBERED:
                    places += learned()
                    held, size = [], 0
        if shard is not None:
            places += learned()
            yield from copy()

    copies = dealt(docs, shards, number).select("text", "shard").mapInArrow(trained, COPY)
    found = merged(copies, -(-shards // ROUNDS)).select("k", "v").collect()  # one network
    if not found:
        return start
    return shaped(np.concatenate([np.frombuffer(r["v"], np.float32) for r in sorted(found, key=lambda r: r["k"])]))


def train(docs: DataFrame) -> tuple[Vocabulary, Network]:
    words = vocabulary(docs)
    net = new_network()
    shards = max(ROUNDS, -(-words.n_tokens // SHARD))
    for number in range(ROUNDS):
        net = _round(docs.select("doc_id", "text"), words, net, shards, number)
    return words, net


def score(docs: DataFrame, model: tuple[Vocabulary, Network]) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (the sum) and mean_log_likelihood of each document."""
    source, (words, net) = docs.select("doc_id", "text"), model
    model_data = docs.sparkSession.sparkContext.broadcast((words.top, words.middle, words.shared, net))

    def blocks(whole: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
        low, size, held = 0, 0, []
        for text in whole.column("text"):
            held.append(text.as_py())
            size += len(held[-1] or "")
            if len(held) % AT_ONCE == 0 and size > NUMBERED:
                yield whole.slice(low, len(held)), held
                low, size, held = low + len(held), 0, []
        if held:
            yield whole.slice(low), held

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, middle, shared, net = model_data.value
        known = Numbers(top, middle)
        for whole in batches:
            for batch, texts in blocks(whole):
                ids, starts, at, places, words = numbered(texts, known)
                logs = np.zeros(ids.size + 1)
                for part in by_documents(starts):
                    logs[part] = log_probabilities(net, ids[part])
                numbers = ids[at]
                without = np.flatnonzero(numbers >= TOP)
                own = known.log_count[places[without]]
                far = np.isnan(own)
                logs[at[without]] += np.where(far, 0, own) - shared[numbers[without].astype(np.int64) - TOP]
                far = without[far]
                n = np.diff(starts) - REACH
                sums = np.add.reduceat(logs, starts)[:-1]
                sums[n == 0] = 0.0
                firsts = np.searchsorted(far, np.append(0, np.cumsum(n)))
                rare = pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), words.take(pa.array(far)).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(sums), rare], ["doc_id", "n_tokens", "part", "rare"])

    kind = [source.schema["doc_id"], StructField("n_tokens", LongType()), StructField("part", DoubleType()), StructField("rare", ArrayType(StringType()))]
    # Stored, so that the numbers of the rows stay.
    held = store(source.mapInArrow(scored, StructType(kind)).withColumn("row", F.monotonically_increasing_id()), "likelihood-parts")
    met = held.select("row", F.explode("rare").alias("word")).join(words.counts.where("n > 1"), "word")
    more = met.groupBy("row").agg(F.sum(F.log("n")).alias("more"))
    out = held.drop("rare").join(more, "row", "left")
    whole = F.col("part") + F.coalesce("more", F.lit(0.0))
    mean = F.when(F.col("n_tokens") > 0, whole / F.col("n_tokens"))
    return out.select("doc_id", "n_tokens", whole.alias("log_likelihood"), mean.alias("mean_log_likelihood"))


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """All documents scored by a network trained on all of them."""
    return score(docs, train(docs))
