"""Chat logs: collapse of cumulative snapshots, then rendering (operator 1).

A logger that writes the whole conversation after each turn leaves every state as a conversation of its
own. Per conversation the turns are ordered by (turn, role, text), and each is hashed with its place. The running sum (exclusive or)
of these hashes after turn k stands for the first k turns. A conversation whose last hash is an earlier hash of
another one is a prefix of it and goes by an anti-join; of equal conversations the one with the smallest
conv_id stays. What is left is rendered as one text. Turn numbers only give the order.

A hash is 120 bits of the SHA-256 of place, role and text, as two numbers. The sums are a window over rows of numbers, so their cost
grows with the turns of a conversation and not with the square. Only conversation ids and hashes meet in the joins; every
hash is reduced to one row before them, so an opening that a third of the conversations share is one row
per task. Texts are shuffled once, to gather the turns of a conversation.

Defined cases: turns without conv_id belong to no conversation and are left out; null role or text
count as empty, but differ from empty ones for the comparison; a null turn comes first; repeated rows are
repeated turns; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import store


def _turn_hash(turn: Column, place: Column) -> Column:
    """120 bits of place, role and text; the lengths keep their borders apart, -1 marks null."""
    part = lambda x: F.concat(F.coalesce(F.length(x), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(x, F.lit("")))
    digits = F.sha2(F.concat(place.cast("string"), F.lit(":"), part(turn["role"]), part(turn["text"])), 256)
    number = lambda at: F.conv(F.substring(digits, at, 15), 16, 10).cast("bigint")
    return F.struct(number(1).alias("a"), number(16).alias("b"))


def conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: its ordered ``turns`` and the hash of ``each``."""
    told = (
        turns.where("conv_id IS NOT NULL")
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    )
    return told.select("conv_id", "turns", F.transform("turns", _turn_hash).alias("each"))


def prefixes(told: DataFrame) -> DataFrame:
    """One row per turn: the hash (a, b) of the conversation up to it, and whether it is the last one."""
    rows = told.select("conv_id", F.size("each").alias("n"), F.posexplode("each").alias("k", "h"))
    so_far = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select(
        "conv_id", (F.col("k") == F.col("n") - 1).alias("last"), *[F.bit_xor(F.col("h")[c]).over(so_far).alias(c) for c in ("a", "b")]
    )


def render(turns: Column) -> Column:
    """The turns as one text, each between start and end marks with its role."""
    line = lambda t: F.concat(
        F.lit("<|im_start|>"), F.coalesce(t["role"], F.lit("")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit("<|im_end|>")
    )
    return F.array_join(F.transform(turns, line), "\n")


def collapse(turns: DataFrame) -> DataFrame:
    """The maximal conversations: conv_id, n_turns, n_copies (equal ones, itself included), rendered."""
    told = store(conversations(turns), "conversations")
    marks = store(prefixes(told), "conversation-prefixes")
    copies = marks.where("last").groupBy("a", "b").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    earlier = marks.where("NOT last").select("a", "b").distinct()
    maximal = copies.join(earlier, ["a", "b"], "left_anti").select("conv_id", "n_copies")
    return told.join(maximal, "conv_id").select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), "n_copies", render(F.col("turns")).alias("text")
    )
