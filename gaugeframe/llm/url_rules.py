"""URL filtering by mined token rules (operator 3).

Explicit rules (host and path prefix) come first; the longest that fits decides. Other urls are judged
by rules that FP-growth mines from labelled urls: items are the url's tokens and, for unwanted rows,
``BAD``. A set of tokens becomes a rule if it occurs with ``BAD`` in at least ``MIN_SUPPORT`` of the labelled rows, and
in ``MIN_ROWS`` rows at any size of the table, and at least ``MIN_CONFIDENCE`` of the rows with these tokens are
unwanted; rules with a subset that is a rule of at least the same confidence are pruned. Tokens of every labelled url tell nothing and take no part: with or without
them a set holds the same rows. A url is blocked if it holds all items of a rule.

Tokens that stand in the very same labelled rows, as the fixed parts of a site's template do, are one item for the miner: equal
counts and equal sums of row hashes find them, and a count per row checks them. Of n such tokens FP-growth would give 2^n sets
with the same rows. A url holds an item if it holds any of its tokens, which is what the rules of all single tokens would
say. Of the sets found only generators go on: those that lose rows with each of their items.

Rules are matched through an inverted index: each rule is filed under the tokens of its rarest item, so a url meets
only the rules filed under its own tokens and a rule's other items are then looked up in the url's list. Each
different url is judged once, and the verdicts are joined back on the url.

Defined cases: a null url, or one without ``://``, has empty host and path, no tokens and the verdict allow;
labels that are null or belong to no url are ignored, several labels of a page each count; repeated
rows get the same verdict; without labels there are no mined rules; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import store

#: Item that marks an unwanted row; tokens hold letters and digits only.
BAD = "!bad"
MIN_SUPPORT = 0.005
#: Unwanted rows that a rule needs at least, however few rows are labelled.
MIN_ROWS = 5
MIN_CONFIDENCE = 0.7
#: Share of the labelled urls from which on a token takes no part: only those of all urls.
MAX_SHARE = 1
#: (host, path, verdict) of the explicit rules.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``, or empty."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def explicit(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The rule that fits columns host and path as text, and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == name) | F.col("host").endswith(f".{name}")) & F.col("path").startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """Different runs of letters and digits of host, path, query and fragment; pure numbers are left out."""
    parts = F.split(F.translate(F.coalesce(_rest(url), F.lit("")), UPPER, LOWER), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(parts, lambda x: (x != "") & ~x.rlike(r"^\p{N}+$")))


def condensed(held: DataFrame, useful: DataFrame) -> DataFrame:
    """The useful tokens with their item: (token, item, members, n). Stored.

    ``held`` has a row for each labelled row and token. Tokens of equal count and equal hashes of their rows are taken for one
    item, and parted again if any row holds some of them only.
    """
    found = useful.groupBy("n", "x", "y").agg(F.array_sort(F.collect_list("token")).alias("members"))
    found = found.select("n", "members", F.col("members")[0].alias("item"))
    listed = store(found.select("item", "members", "n", F.explode("members").alias("token")), "url-same-rows")
    met = held.join(listed.where(F.size("members") > 1), "token").groupBy("row", "item").agg(F.count(F.lit(1)).alias("here"), F.first(F.size("members")).alias("all"))
    torn = met.where(F.col("here") != F.col("all")).select("item").distinct().withColumn("torn", F.lit(True))
    told = listed.join(torn, "item", "left")
    alone = F.col("torn").isNotNull()
    return store(
        told.select(
            "token",
            F.when(alone, F.col("token")).otherwise(F.col("item")).alias("item"),
            F.when(alone, F.array("token")).otherwise(F.col("members")).alias("members"),
            "n",
        ),
        "url-items",
    )


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (tokens, members, anchor, support, confidence) from rows with url and bad (boolean). Stored.

    ``tokens`` are the first tokens of the rule's items and ``members`` all tokens of each; ``anchor`` is the rarest item.
    """
    rows = labelled.where("bad IS NOT NULL").select("bad", tokens(F.col("url")).alias("tokens"))
    rows = store(rows.withColumn("row", F.monotonically_increasing_id()), "url-labelled")
    total = rows.count()
    held = rows.select("row", F.explode("tokens").alias("token"))
    counts = held.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y")
    )
    # At most (mean number of tokens of a url) / min_support tokens are that frequent.
    useful = store(counts.where((F.col("n") >= max(total * min_support, MIN_ROWS)) & (F.col("n") < total * MAX_SHARE)), "url-tokens")
    if total == 0:
        none = rows.select("tokens", F.array("tokens").alias("members"), F.lit(0).cast("bigint").alias("support"))
        return none.withColumn("confidence", F.lit(0.0)).withColumn("anchor", F.lit(""))
    items = condensed(held, useful)
    kept = held.join(items.select("token", "item"), "token").groupBy("row").agg(F.collect_set("item").alias("items"))
    none = F.array().cast("array<string>")
    both = F.concat(F.coalesce("items", none), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(none))
    # Half a row less, since FP-growth rounds the product with the number of rows up.
    least = min(1.0, max(min_support, (MIN_ROWS - 0.5) / total))
    model = FPGrowth(itemsCol="items", minSupport=least).fit(rows.join(kept, "row", "left").select(both.alias("items")))
    sets = store(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "url-itemsets")
    bad = sets.where(F.array_contains("items", BAD) & (F.size("items") > 1) & (F.col("freq") >= MIN_ROWS))
    bad = bad.select(F.array_remove("items", BAD).alias("tokens"), F.col("freq").alias("support"))
    sure = bad.join(sets, F.col("tokens") == F.col("items")).withColumn("confidence", F.col("support") / F.col("freq"))
    sure = store(sure.where(F.col("confidence") >= min_confidence).select("tokens", "freq", "support", "confidence"), "url-sure")
    return _pruned(_generators(sure, sets), items.select("item", "members", "n").distinct())


def _generators(sure: DataFrame, sets: DataFrame) -> DataFrame:
    """The sets that hold fewer rows than each set with one item less; others say the same as the smaller one."""
    smaller = sure.where(F.size("tokens") > 1).select("tokens", "freq", F.explode("tokens").alias("less"))
    smaller = smaller.select("tokens", F.array_remove("tokens", F.col("less")).alias("items"), F.col("freq").alias("of_freq"))
    same = smaller.join(sets, "items").where(F.col("freq") == F.col("of_freq")).select("tokens").distinct()
    return store(sure.join(same, "tokens", "left_anti").drop("freq"), "url-generators")


def _pruned(sure: DataFrame, items: DataFrame) -> DataFrame:
    """Rules that no smaller rule covers, each with its rarest item as anchor.

    A covering rule's items are all items of the covered one, so the two meet on the smaller one's
    anchor, which is an item of the larger one.
    """
    each = sure.select("*", F.explode("tokens").alias("item")).join(items, "item")
    filed = each.groupBy("tokens", "support", "confidence").agg(
        F.min(F.struct("n", "item"))["item"].alias("anchor"),
        F.transform(F.array_sort(F.collect_list(F.struct("item", "members"))), lambda x: x["members"]).alias("members"),
    )
    filed = store(filed, "url-rules")
    small = filed.select(F.col("anchor").alias("a"), F.col("tokens").alias("s"), F.col("confidence").alias("c"))
    large = filed.select("tokens", "confidence", F.explode("tokens").alias("a"))
    covers = (F.size("s") < F.size("tokens")) & (F.size(F.array_except("s", "tokens")) == 0) & (F.col("c") >= F.col("confidence"))
    covered = large.join(small, "a").where(covers).select("tokens").distinct()
    left = filed.join(covered, "tokens", "left_anti")
    return store(left.select("tokens", "members", "support", "confidence", "anchor"), "url-pruned")


def blocked(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Each different url that holds a token of every item of a rule: url, confidence of the surest."""
    seen = urls.select("url").distinct().select("url", tokens(F.col("url")).alias("of_url"))
    at = F.explode(F.get("members", F.array_position("tokens", F.col("anchor")).cast("int") - 1))
    filed = rules.select("members", "confidence", at.alias("anchor"))
    met = seen.select("url", "of_url", F.explode_outer("of_url").alias("anchor")).join(filed, "anchor")
    holds = F.forall("members", lambda m: F.arrays_overlap(m, F.col("of_url")))
    return met.where(holds).groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the confidence of the mined rule that blocks.

    ``labels`` has doc_id and quality; a page whose number is labelled with quality 0 is unwanted.
    """
    bad = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))
    rows = pages.select("page_id", "url")
    mined = mine(rows.join(bad, "page_id").select("url", "bad"))
    found = store(blocked(rows, mined), "url-blocked").withColumnRenamed("url", "of_url")
    out = rows.join(found, F.col("url") == F.col("of_url"), "left")
    out = out.select("page_id", "confidence", F.coalesce("url", F.lit("")).alias("url"))
    out = out.select("page_id", "confidence", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, verdict = explicit(rules)
    mined_verdict = F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, mined_verdict).alias("verdict"), "confidence")
