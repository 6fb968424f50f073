"""Quality rules whose cutoffs come from the corpus (operator 10).

Per document four signals are computed: symbols per thousand words, repeated lines per thousand
lines, words in repeated 3-word windows per thousand words, and hundredths of the mean word length.
Each (lang, source) group gets one quantile sketch per signal: counts of log-linear buckets (a bucket
keeps the seven leading bits of a value, so a quantile is at most 1/64 too low). Sketches are merged
by adding counts, which also gives the sketches of a language and of the whole corpus; they stand in
for groups of fewer than ``MIN_GROUP`` documents. The fences are joined to the documents, and a
document outside of a fence is rejected.

A fence lies where a tail of the group's own scale would leave the share ``OUTSIDE`` of the documents. Beyond the quartile the
tail is taken as exponential, and its scale is the greatest of three that the sketches give: that of the middle (from
the quantiles 50 and 75), that of the tail (from 75 and 90, but not more than the tail of the whole language has, since junk
may be a tenth of a source), and the least that can be told apart. The last one decides where quantiles coincide, as for signals that
most documents do not have: it is what the least possible occurrence (``LEAST`` words or lines) makes up in a document of
the group's lower quartile of sizes, which has a sketch too, and for the word length the width of the sketch's bucket at the median.
The lower fence of the word length is built alike from the quantiles 50, 25 and 10. No cutoff is fixed.

Defined cases: a null text counts as empty, has no words and fails the base rules; null ``lang`` or
``source`` are groups of their own; repeated rows are judged each by itself; an empty table gives an
empty table; columns other than the four needed may have any name.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import payload, store, words

MIN_WORDS = 50
#: More than this percentage of words in repeated windows fails.
MAX_REPEAT = 50
SYMBOLS = "#*$%&|<>"
#: Groups with fewer documents use the sketch of their language, or of the corpus.
MIN_GROUP = 30
#: Share of a group's documents that an exponential tail of its scale has beyond the fence.
OUTSIDE = 1e-4
SIGNALS = ["symbols", "lines", "repeats", "length"]
#: The least occurrence of a signal (a symbol, a line, two windows of three words), and the size it is measured by.
LEAST = {"symbols": (1, "words"), "lines": (1, "line_count"), "repeats": (6, "words")}
SIZES = ["words", "line_count"]
QUANTILES = [10, 25, 50, 75, 90]
#: Hundredths by which quantile distances 50 to 75, 75 to 90, and a scale itself, are multiplied to get from the quartile to the fence.
MIDDLE, TAIL, SCALE = (round(100 * math.log(0.25 / OUTSIDE) / part) for part in (math.log(2), math.log(2.5), 1))
#: Leading bits that a bucket keeps.
BITS = 7


def _neighbours(items: Column, key: str) -> Column:
    """The items of a sorted array whose key equals that of the item before or after."""
    same = lambda x, k: F.coalesce(F.get(items, k)[key] == x[key], F.lit(False))
    return F.filter(items, lambda x, k: same(x, k - 1) | same(x, k + 1))


def measured(docs: DataFrame) -> DataFrame:
    """The rows as ``doc`` with their counts. Everything happens inside the row: no shuffle.

    Windows are first compared by hash; those whose hash repeats are compared by their words.
    """
    none = F.array().cast("array<bigint>")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split("t", "\n"), lambda x: F.trim(F.translate(x, "\t\x0b\x0c\r", "    ")) != "")
    step = docs.select(payload(docs).alias("doc"), F.col("lang"), F.col("source"), text.alias("t"))
    step = step.select(
        "doc", "lang", "source", "t", words(F.col("t")).alias("w"), lines.alias("l"),
    )
    three = lambda i: (F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))
    at = F.when(F.size("w") >= 3, F.sequence(F.lit(0), F.size("w") - 3)).otherwise(F.array().cast("array<int>"))
    step = step.withColumn("h", F.transform(at, lambda i: F.xxhash64(*three(i))))
    pairs = F.array_sort(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct("h")) < F.size("h")
    step = step.withColumn("s", F.when(repeats, pairs)).withColumn("s", _neighbours(F.col("s"), "h"))
    spelt = F.transform("s", lambda x: F.struct(F.concat_ws(" ", *three(x["i"])).alias("v"), x["i"].alias("i")))
    step = step.withColumn("s", F.array_sort(spelt))
    found = F.transform(_neighbours(F.col("s"), "v"), lambda x: x["i"].cast("bigint"))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).cast("bigint").alias("last"))
    covered = F.aggregate(
        F.array_sort(F.coalesce(found, none)),
        start,
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    n = lambda c: F.length(c).cast("bigint")
    return step.select(
        "doc",
        "lang",
        "source",
        F.size("w").cast("bigint").alias("n_words"),
        n(F.translate("t", " \t\n\x0b\x0c\r", "")).alias("word_chars"),
        (n(F.col("t")) - n(F.translate("t", SYMBOLS, ""))).alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("bigint").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size("l").cast("bigint").alias("n_lines"),
    )


def _signals() -> dict[str, Column]:
    share = lambda part, whole, unit: F.floor(F.col(part) * unit / F.greatest(F.col(whole), F.lit(1)))
    return {
        "symbols": share("n_symbols", "n_words", 1000),
        "lines": share("n_dup_lines", "n_lines", 1000),
        "repeats": share("n_repeat_words", "n_words", 1000),
        "length": share("word_chars", "n_words", 100),
    }


def sketches(counted: DataFrame) -> DataFrame:
    """One row per group, signal (or size) and bucket with the number of documents; partial sums come first."""
    sketched = {**_signals(), "words": F.col("n_words"), "line_count": F.col("n_lines")}
    each = F.array(*[F.struct(F.lit(k).alias("signal"), v.cast("bigint").alias("v")) for k, v in sketched.items()])
    cut = F.greatest(F.length(F.bin("v")) - BITS, F.lit(0))
    return (
        counted.select("lang", "source", F.explode(each).alias("x"))
        .select("lang", "source", "x.*")
        .withColumn("cut", cut)
        .groupBy("lang", "source", "signal", F.expr("shiftleft(shiftright(v, cut), cut)").alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Per group the document count and the QUANTILES of each signal and size (``symbols_25`` and so on).

    A group has at most some thousand buckets, so the running sum over them is bounded.
    """
    merged = sketch.groupBy(*by, "signal", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "signal")
    ranked = merged.withColumn("total", F.sum("n").over(group)).withColumn("upto", F.sum("n").over(group.orderBy("bucket")))
    at = lambda s, q: F.min(F.when((F.col("signal") == s) & (F.col("upto") * 100 >= F.col("total") * q), F.col("bucket")))
    return ranked.groupBy(*by).agg(
        F.max("total").alias("n_docs"),
        *[at(s, q).alias(f"{s}_{q}") for s in SIGNALS + SIZES for q in QUANTILES],
    )


def fences(sketch: DataFrame) -> DataFrame:
    """Per (lang, source) the lowest and highest value that is kept of each signal."""
    names = [f"{s}_{q}" for s in SIGNALS + SIZES for q in QUANTILES]
    own = quantiles(sketch, ["lang", "source"])
    rename = lambda df, mark: df.select(*[F.col(c).alias(f"{mark}_{c}") for c in df.columns])
    of_lang = rename(quantiles(sketch, ["lang"]), "lang")
    of_all = quantiles(sketch.withColumn("every", F.lit(1)), ["every"]).first()  # one row
    joined = own.join(of_lang, F.col("lang").eqNullSafe(F.col("lang_lang")), "left")
    whole = lambda c: F.lit(of_all[c] if of_all else None).cast("bigint")
    above = lambda c: F.when(F.col("lang_n_docs") >= MIN_GROUP, F.col(f"lang_{c}")).otherwise(whole(c))
    picked = joined.select(
        "lang",
        "source",
        *[F.when(F.col("n_docs") >= MIN_GROUP, F.col(c)).otherwise(above(c)).alias(c) for c in names],
        *[above(c).alias(f"up_{c}") for c in names],
    )

    def room(signal: str, median: int, quartile: int, tail: int) -> Column:
        apart = lambda a, b, mark="": F.abs(F.col(f"{mark}{signal}_{a}") - F.col(f"{mark}{signal}_{b}"))
        part = lambda c, n: F.floor(c * n / 100)
        if signal in LEAST:
            count, size = LEAST[signal]
            least = F.floor(F.lit(1000 * count) / F.greatest(F.col(f"{size}_25"), F.lit(1)))
        else:
            least = F.shiftright(f"{signal}_50", BITS - 1)
        thin = F.least(apart(tail, quartile), apart(tail, quartile, "up_"))
        return F.greatest(part(apart(quartile, median), MIDDLE), part(thin, TAIL), part(least, SCALE))

    return picked.select(
        F.col("lang").alias("of_lang"),
        F.col("source").alias("of_source"),
        *[(F.col(f"{s}_75") + room(s, 50, 75, 90)).alias(f"max_{s}") for s in SIGNALS],
        (F.col("length_25") - room("length", 50, 25, 10)).alias("min_length"),
    )


def judged(counted: DataFrame) -> DataFrame:
    """The measured rows with ``base_failed`` and ``kept``.

    Fences meet the documents by an equi-join that Spark may broadcast or, for a dominant source,
    split. Reads its input twice; give it a stored table when that is dear.
    """
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT)
    same = F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source"))
    inside = reduce(lambda a, b: a & b, [v <= F.col(f"max_{s}") for s, v in _signals().items()])
    inside = inside & (_signals()["length"] >= F.col("min_length"))
    # Stored, the fences have a size that Spark knows: below its threshold no document is shuffled.
    limits = store(fences(sketches(counted)), "quality-fences")
    joined = counted.withColumn("base_failed", base).join(limits, same, "left")
    verdict = F.when(F.col("base_failed"), False).otherwise(inside)
    shown = [f"max_{s}" for s in SIGNALS] + ["min_length"]
    return joined.withColumn("kept", F.coalesce(verdict, F.lit(False))).select(*counted.columns, "base_failed", "kept", *shown)


def quality_report(docs: DataFrame) -> DataFrame:
    """Per document its counts, ``base_failed`` and ``kept``. The counts are stored, without the text."""
    counted = measured(docs.select("doc_id", "text", "lang", "source"))
    counted = store(counted.withColumn("doc_id", F.col("doc.doc_id")).drop("doc"), "quality-counts")
    out = judged(counted)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        *[c for c in out.columns if c.startswith(("max_", "min_"))],
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns."""
    return judged(store(measured(docs), "quality-rows")).where("kept").select("doc.*")
