"""Removal of repeated runs of lines by content-defined line chunks (operator 6).

A document is cut into lines (at ``\\n``); lines of white space only stand aside and part nothing. A hash is rolled
over the line hashes: the lesser one of every two neighbouring lines is a boundary. So a boundary hangs on two lines of text only
and text inserted before a shared passage does not move those inside it, and every two neighbouring lines hold
one: a passage of two lines or more has a boundary that its copies have too, wherever it stands.

1. Seeds: only the 64-bit hashes of boundary lines are shuffled (two thirds of the lines), to find those that occur again.
2. Growth: each repeated boundary is grown by the line before and the line after it, whose hashes it carries along. A chunk of two lines
   (known by both hashes) that occurs again is repeated; longer passages are chains of such chunks.
3. Texts are shuffled once, to meet the list of their repeated chunks, and stored with it. Chunks of one hash are
   compared by their bytes; where they differ, each is judged by its whole text.

A repeated chunk is kept where it comes first, in the order (doc_id, md5 of the text, line), and its lines are removed elsewhere. So
a line goes if it and a line next to it stand together at an earlier place, and each line's text stays where it comes first
in the corpus. Neither hashes nor boundaries show in the result: it is that of comparing all lines.

Defined cases: a null text stays null and has no lines; an empty text is one empty line; rows with
equal doc_id and text are one document, so they lose the same lines and none on account of each other;
a null doc_id comes first in the order; an empty table gives an empty table; other columns are carried
along under any names (``keep_lines``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import payload, store

#: Hash of a line; tests put a weak one in its place.
Hash = Callable[[Column], Column]


def line_hash(line: Column) -> Column:
    return F.xxhash64(line)


def text_key(text: Column) -> Column:
    """60 bits of the md5 of a text as a number, in the order of its digits."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def with_lines(rows: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """The kept columns with ``lines`` and ``solid``, the numbers of the lines that are not blank."""
    step = rows.select(*keep, F.split(text, "\n").alias("lines"))
    numbered = F.transform("lines", lambda x, i: F.when(x.rlike(r"\S"), i))
    return step.select(*keep, "lines", F.filter(numbered, lambda i: i.isNotNull()).alias("solid"))


def boundaries(rows: DataFrame, key: Hash = line_hash) -> DataFrame:
    """One row per boundary line: doc_id, th, at (its number among the solid lines), its hash and those of its neighbours."""
    step = with_lines(rows, F.col("text"), ["doc_id", "th"])
    step = step.select("doc_id", "th", F.transform("solid", lambda i: key(F.get("lines", i))).alias("h"))
    near = lambda x, k: F.coalesce(x <= F.get("h", k), F.lit(False))
    seeds = F.transform(
        "h",
        lambda x, i: F.when(
            near(x, i - 1) | near(x, i + 1),
            F.struct(i.alias("at"), x.alias("hash"), F.get("h", i - 1).alias("before"), F.get("h", i + 1).alias("after")),
        ),
    )
    # The outer form: for the inner one Spark infers a filter on the array and computes it a second time.
    told = step.select("doc_id", "th", F.explode_outer(F.filter(seeds, lambda s: s.isNotNull())).alias("s"))
    return told.where("s IS NOT NULL").select("doc_id", "th", "s.*")


def repeated_chunks(docs: DataFrame, key: Hash = line_hash) -> DataFrame:
    """Per document (of_id, of_th) the list ``found`` of its repeated chunks: start, a and b (both hashes), again (not the first)."""
    seeds = store(boundaries(docs, key), "line-seeds")
    # Stored, as the lists below: a join of two plain shuffles can be split at a hot line.
    known = store(seeds.groupBy(F.col("hash").alias("of_hash")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("of_hash"), "line-repeats")
    met = seeds.join(known, F.col("hash") == F.col("of_hash"), "left_semi")
    sides = F.array(
        F.struct((F.col("at") - 1).alias("start"), F.col("before").alias("a"), F.col("hash").alias("b")),
        F.struct(F.col("at").alias("start"), F.col("hash").alias("a"), F.col("after").alias("b")),
    )
    grown = met.select("doc_id", "th", F.explode(sides).alias("c")).select("doc_id", "th", "c.*").where("a IS NOT NULL AND b IS NOT NULL")
    grown = store(grown, "line-grown")
    place = F.struct("doc_id", "th", "start")
    firsts = grown.groupBy(F.col("a").alias("of_a"), F.col("b").alias("of_b")).agg(F.min(place).alias("first"), F.max(place).alias("latest"))
    firsts = store(firsts.where("first <> latest").drop("latest"), "line-chunk-firsts")
    judged = grown.join(firsts, (F.col("a") == F.col("of_a")) & (F.col("b") == F.col("of_b")))
    return judged.groupBy(F.col("doc_id").alias("of_id"), F.col("th").alias("of_th")).agg(
        F.collect_set(F.struct("start", "a", "b", (place != F.col("first")).alias("again"))).alias("found")
    )


def _mended(spelt: DataFrame) -> DataFrame:
    """For hashes that stand for different chunks: per document the chunks to remove, judged by their whole text."""
    shared = spelt.groupBy("a", "b").agg(F.min("body").alias("low"), F.max("body").alias("high")).where("low <> high").select("a", "b")
    own = spelt.join(shared, ["a", "b"], "left_semi")
    place = F.struct("of_id", "of_th", "start")
    firsts = own.groupBy(F.col("body").alias("of_body")).agg(F.min(place).alias("first"))
    judged = own.join(firsts, F.col("body") == F.col("of_body"))
    return judged.groupBy(F.col("of_id").alias("m_id"), F.col("of_th").alias("m_th")).agg(
        F.collect_set("start").alias("told"),
        F.collect_set(F.when(place != F.col("first"), F.col("start"))).alias("again"),
    )


def marked(docs: DataFrame, key: Hash = line_hash) -> DataFrame:
    """The rows as ``doc`` with ``lines``, ``solid`` and ``gone``, the sorted numbers (among the solid ones) of the lines that go."""
    same = lambda a, b: F.col(f"{a}_id").eqNullSafe(F.col(f"{b}_id")) & F.col(f"{a}_th").eqNullSafe(F.col(f"{b}_th"))
    listed = repeated_chunks(docs.select("doc_id", text_key(F.col("text")).alias("th"), "text"), key)
    rows = docs.select(payload(docs).alias("doc"), F.col("doc_id").alias("d_id"), text_key(F.col("text")).alias("d_th"))
    met = store(rows.join(listed, same("d", "of"), "left").drop("of_id", "of_th"), "line-chunks")
    found = with_lines(met.where("found IS NOT NULL"), F.col("doc.text"), ["d_id", "d_th", "found"])
    found = found.select(F.col("d_id").alias("of_id"), F.col("d_th").alias("of_th"), "lines", "solid", F.explode("found").alias("f"))
    line = lambda k: F.get("lines", F.get("solid", k))
    body = F.concat(line(F.col("f.start")), F.lit("\n"), line(F.col("f.start") + 1))
    spelt = found.select("of_id", "of_th", F.col("f.start").alias("start"), F.col("f.a").alias("a"), F.col("f.b").alias("b"), body.alias("body"))
    mended = store(_mended(spelt), "line-chunks-mended")
    none = F.array().cast("array<int>")
    plain = F.filter("found", lambda f: f["again"] & ~F.coalesce(F.array_contains("told", f["start"]), F.lit(False)))
    starts = F.concat(F.coalesce(F.transform(plain, lambda f: f["start"]), none), F.coalesce(F.col("again"), none))
    both = with_lines(met.join(mended, same("d", "m"), "left").withColumn("starts", starts), F.col("doc.text"), ["doc", "starts"])
    gone = F.array_sort(F.array_union("starts", F.transform("starts", lambda k: k + 1)))
    return both.select("doc", "lines", "solid", gone.alias("gone"))


def _cleaned(rows: DataFrame) -> DataFrame:
    """``marked`` rows with the kept text and the numbers of lines, removed lines and runs of these."""
    numbers = F.transform("gone", lambda k: F.get("solid", k))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), numbers)
    text = F.when(F.size("gone") == 0, F.col("doc.text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    runs = F.filter("gone", lambda k, i: (i == 0) | (F.get("gone", i - 1) < k - 1))
    return rows.select(
        "doc",
        F.coalesce(F.when(F.col("lines").isNotNull(), F.size("lines")), F.lit(0)).cast("bigint").alias("n_lines"),
        F.size("gone").cast("bigint").alias("n_removed_lines"),
        F.size(runs).cast("bigint").alias("n_removed_chunks"),
        text.alias("kept_text"),
    )


def line_report(docs: DataFrame, key: Hash = line_hash) -> DataFrame:
    """Per document the kept text, how many lines went and in how many chunks (runs of removed lines)."""
    return _cleaned(marked(docs.select("doc_id", "text"), key)).select(
        F.col("doc.doc_id").alias("doc_id"), "n_lines", "n_removed_lines", "n_removed_chunks", F.col("kept_text").alias("text")
    )


def keep_lines(docs: DataFrame) -> DataFrame:
    """The documents without the lines of repeated chunks, with their own columns.

    Documents that lose all lines but blank ones go; those that were null or blank before stay.
    """
    cleaned = _cleaned(marked(docs))
    left = cleaned.where(F.expr(r"n_removed_lines = 0") | F.col("kept_text").rlike(r"\S"))
    own = [F.col("kept_text").alias("text") if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns]
    return left.select(*own)
