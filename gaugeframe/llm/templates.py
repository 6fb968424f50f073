"""Benchmark decontamination by question templates (operator 7).

Text becomes tokens: runs of letters and digits, numbers with their inner points and commas as one token,
digits parted from letters. In the template a number becomes ``<num>``, a word with a capital inside a
sentence ``<name>`` (line breaks and other white space count like a blank) and a unit after a number
``<unit>``; other tokens are lower-cased. Windows of
``WINDOW`` template tokens of the benchmark (whole items where they are shorter, from ``SHORTEST`` tokens on)
are joined by hash with the windows of the documents. A hit must then have the same template token by
token, at least ``LITERALS`` tokens that are no placeholder, and consistent slots: within the window each
value of the item stands for one value of the document, per type. So a question with other numbers and names
is found, also where two of them become the same, and one that only shares its skeleton by chance is not.

Before the join, windows are tried against a table of bits of fixed size that marks the benchmark's hashes, so
only hits and few others bring their tokens to the join, whatever its kind: the documents are read once, and
their texts are never shuffled. Tokens are hashed once each, and a window's hash chains those of its tokens in
generated code, one row a window that ends at the filter. The benchmark's windows are stored, so Spark knows their size and broadcasts
them below its threshold.

Defined cases: null and empty texts have no tokens and match nothing; items of fewer than ``SHORTEST``
tokens match nothing; rows with equal doc_id and text are one document; null ids are ids of their own;
an empty table on either side gives no hits; other columns are carried along (``keep_clean``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import payload, store

WINDOW = 13
SHORTEST = 8
LITERALS = 5
#: Size of the table of known hashes: 1 << FILTER_BITS bits.
FILTER_BITS = 20
#: Unit words that follow a number.
UNITS = (
    "mg g kg t mm cm m km ml cl l s sec min h hr hrs kmh mph hz khz mhz ghz kb mb gb tb w kw mw v a j kj cal kcal pa bar "
    "percent dollars dollar euros euro cents cent pounds pound ounces ounce miles mile yards yard feet foot inches inch "
    "meters meter metres metre grams gram litres litre liters liter seconds second minutes minute hours hour days day "
    "weeks week months month years year degrees degree"
).split()
#: Marks a name, and a point or comma inside a number, while punctuation goes.
NAME, POINT = "\u0001", "\u0002"


def canonical(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns with ``raw`` and ``template`` token arrays; the steps on digits are for texts that have some."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # translate() looks at each character of a text, which the few texts with marks of their own are worth.
    text = F.when(text.contains(NAME) | text.contains(POINT), F.translate(text, NAME + POINT, "  ")).otherwise(text)
    capitals = r"\s(?=\s*\p{Lu})(?<=[\p{Ll}\p{N},;]\s)\s*"
    step = rows.select(*keep, F.regexp_replace(text, capitals, f" {NAME}").alias("t"))
    step = step.withColumn("digits", F.col("t").rlike(r"\p{Nd}"))
    digits = lambda changed: F.when(F.col("digits"), changed).otherwise(F.col("t"))
    step = step.withColumn("t", digits(F.regexp_replace("t", r"(?<=\p{Nd})[.,](?=\p{Nd})", POINT)))
    step = step.withColumn("t", F.regexp_replace("t", f"[^\\p{{L}}\\p{{M}}\\p{{N}}{NAME}{POINT}]+", " "))
    step = step.withColumn("t", digits(F.regexp_replace("t", r"(?<=\p{Nd})(?=\p{L})|(?<=\p{L})(?=\p{Nd})", " ")))
    step = step.withColumn("t", F.lower(F.trim("t")))
    # Single blanks part the tokens by now; only an empty text would give an empty one.
    some = lambda x: F.when(F.col("t") != "", F.split(x, " ")).otherwise(F.array().cast("array<string>"))
    step = step.withColumn("raw", some(F.col("t")))
    shape = F.regexp_replace("t", f"{NAME}[^ ]+", "<name>")
    numbers = F.regexp_replace(shape, f"(?<=^| )\\p{{Nd}}[\\p{{Nd}}{POINT}]*(?= |$)", "<num>")
    numbers = F.regexp_replace(numbers, f"(?<=<num> )(?:{'|'.join(UNITS)})(?= |$)", "<unit>")
    template = F.when(F.col("digits"), some(numbers)).when(F.col("t").contains(NAME), some(shape)).otherwise(F.col("raw"))
    return step.select(*keep, "raw", template.alias("template"))


def window_hash(hashes: Column | str, start: Column, size: Column | int) -> Column:
    """The hash of the window of ``size`` tokens from ``start`` (0 is the first), from the hashes of the tokens."""
    return F.xxhash64(F.slice(hashes, start + 1, size))


def _windows(rows: DataFrame, keep: list[str], sizes: list[int], known: DataFrame) -> DataFrame:
    """One row per window that may be known: its start, size and hash."""
    rows = rows.withColumn("h", F.transform("template", lambda t: F.xxhash64(t)))
    # The outer form: for the inner one Spark infers a filter on the array and computes it a second time.
    starts = rows.select(*keep, "h", F.posexplode_outer("h").alias("start", "first"))
    if len(sizes) == 1:
        each = starts.withColumn("size", F.lit(sizes[0]))
    else:
        each = starts.select("*", F.explode_outer(F.lit(sizes)).alias("size"))
    hashed = each.where(F.col("start") <= F.size("h") - F.col("size")).withColumn("hash", window_hash("h", F.col("start"), F.col("size")))
    return hashed.where(_known(known)(F.col("hash"))).select(*keep, "start", "size", "hash")


def _known(known: DataFrame) -> Callable[[Column], Column]:
    """Whether a hash may be that of a benchmark window: a table of ``1 << FILTER_BITS`` bits."""
    size = 1 << FILTER_BITS
    word = lambda hashed: F.shiftright(hashed.bitwiseAND(F.lit(size - 1)), 6).cast("int")
    bit = lambda hashed: hashed.bitwiseAND(F.lit(63)).cast("int")
    rows = known.select(word(F.col("hash")).alias("word"), F.expr("shiftleft(1L, cast(pmod(hash, 64) AS int))").alias("bit"))
    words = [0] * (size // 64)
    for r in rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():  # at most size / 64 rows
        words[r["word"]] = r["bits"]
    # One literal that Spark folds to an array, instead of one for each word.
    table = F.split(F.lit(" ".join(map(str, words))), " ").cast("array<bigint>")
    return lambda hashed: F.getbit(F.get(table, word(hashed)), bit(hashed)) == 1


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """The stored windows of the benchmark, with their tokens.

    An item may be quoted in the middle of a sentence, where its first capital looks like a name, so
    each item is also taken as it would look there.
    """
    items = canonical(benchmark, ["item_id"])
    quoted = canonical(benchmark.withColumn("text", F.concat(F.lit("a "), "text")), ["item_id"])
    rest = [F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))).alias(c) for c in ("raw", "template")]
    # Stored, so that the generated code of what follows does not hold that of the tokens several times.
    items = store(items.unionByName(quoted.select("item_id", *rest)), "benchmark-tokens")
    sized = items.withColumn("size", F.least(F.size("template"), F.lit(WINDOW))).where(F.col("size") >= SHORTEST)
    starts = sized.select("*", F.explode(F.sequence(F.lit(0), F.size("template") - F.col("size"))).alias("at"))
    part = lambda c: F.expr(f"slice({c}, at + 1, size)")
    cut = starts.select("item_id", "at", "size", part("raw").alias("i_raw"), part("template").alias("i_template"))
    literals = F.filter("i_template", lambda t: ~t.startswith("<"))
    cut = cut.where(F.size(literals) >= LITERALS).distinct()
    hashes = cut.withColumn("h", F.transform("i_template", lambda t: F.xxhash64(t)))
    return store(hashes.withColumn("hash", window_hash("h", F.lit(0), WINDOW)).drop("h"), "benchmark-windows")


def consistent(theirs: Column, ours: Column, template: Column) -> Column:
    """Whether each slot value of ``theirs`` stands for one value of ``ours``, type by type, in two equal templates."""
    pairs = F.filter(
        F.zip_with(
            F.arrays_zip(template.alias("t"), theirs.alias("a")), ours, lambda x, b: F.struct(x["t"].alias("t"), x["a"].alias("a"), b.alias("b"))
        ),
        lambda x: x["t"].startswith("<"),
    )
    n = lambda f: F.size(F.array_distinct(F.transform(pairs, f)))
    return n(lambda x: F.struct(x["t"], x["a"])) == n(lambda x: x)


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Verified pairs of a document window and an item window: doc_id, th, item_id, at, start, size, changed."""
    known = benchmark_windows(benchmark)
    # At most WINDOW - SHORTEST + 1 numbers.
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect()) or [WINDOW]
    keyed = docs.select("doc_id", F.md5(F.col("text")).alias("th"), "text")
    cut = _windows(canonical(keyed, ["doc_id", "th"]), ["doc_id", "th", "raw", "template"], sizes, known)
    part = lambda c: F.expr(f"slice({c}, start + 1, size)")
    spelt = cut.select("doc_id", "th", "start", "size", "hash", part("raw").alias("raw"), part("template").alias("template"))
    pairs = spelt.join(known, ["hash", "size"]).where("template = i_template")
    fits = consistent(F.col("i_raw"), F.col("raw"), F.col("template"))
    return pairs.where(fits).select("doc_id", "th", "item_id", "at", "start", "size", (F.col("raw") != F.col("i_raw")).alias("changed"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per contaminated document and item: matched windows, first place, whether slots differ."""
    return hits(docs, benchmark).groupBy("doc_id", "th", "item_id").agg(
        F.count_distinct("at").alias("n_windows"),
        F.min("start").cast("bigint").alias("first_token"),
        F.max("changed").alias("reparameterised"),
    ).drop("th")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit, with their own columns."""
    bad = hits(docs.select("doc_id", "text"), benchmark).select(F.col("doc_id").alias("of_id"), F.col("th").alias("of_th")).distinct()
    bad = store(bad, "contaminated")
    rows = docs.select(payload(docs).alias("doc"), F.col("doc_id").alias("d_id"), F.md5(F.col("text")).alias("d_th"))
    same = F.col("d_id").eqNullSafe(F.col("of_id")) & F.col("d_th").eqNullSafe(F.col("of_th"))
    return rows.join(bad, same, "left_anti").select("doc.*")
