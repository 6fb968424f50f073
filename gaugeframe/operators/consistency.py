"""Consistency of column rules (X -> Y) and of rows against lists of valid bindings."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import column, data_type, group_cell, key_part, ratio
from .grouping import aggregate_sets, split_passes

Rule = tuple[tuple[str, ...], tuple[str, ...]]


def parse_rule(rule) -> Rule | None:
    """``"a,b:c"`` or ``(("a", "b"), ("c",))``; blank text gives None."""
    if isinstance(rule, str):
        if not rule.strip():
            return None
        antecedent, separator, consequent = rule.partition(":")
        if not separator:
            raise ValueError(f"rule {rule!r} must look like 'a,b:c'")
        rule = (antecedent, consequent)
    sides = []
    for side in rule:
        names = side.split(",") if isinstance(side, str) else side
        sides.append(tuple(name.strip() for name in names if name.strip()))
    if len(sides) != 2 or not all(sides):
        raise ValueError(f"rule {rule!r} needs columns on both sides")
    return sides[0], sides[1]


def rule_set(custom: Iterable = (), stored: Iterable = ()) -> list[Rule]:
    """Stored rules, then custom ones; duplicates are kept, blanks dropped."""
    parsed = [parse_rule(rule) for rule in [*stored, *custom]]
    return [rule for rule in parsed if rule is not None]


def rule_table(stored: DataFrame | None, custom: DataFrame | None = None) -> DataFrame | None:
    """The same union for rules held as tables (Antecedent, Consequent)."""
    tables = [t.select("Antecedent", "Consequent") for t in (stored, custom) if t is not None]
    if not tables:
        return None
    return tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1])


def rule_keys(rules: Sequence[Rule]) -> list[tuple[str, ...]]:
    """The columns each rule groups by."""
    return [x + y for x, y in rules]


def rule_scores(rows: DataFrame, rules: Sequence[Rule], apart: Iterable[int] = ()) -> DataFrame:
    """Majority share of the consequent per rule and antecedent value.

    Pair counts of the rules come from one pass, but for those in ``apart`` (see
    group_by_keys); the roll-up to the antecedent moves counts only and combines them
    map-side, so a dominant antecedent is harmless. Values are rendered at the end.
    """
    out = None
    for positions in split_passes(rule_keys(rules), apart):
        scores = _scores_in_one_pass(rows, {i: rules[i] for i in positions})
        out = scores if out is None else out.unionByName(scores)
    return out


def _scores_in_one_pass(rows: DataFrame, rules: dict[int, Rule]) -> DataFrame:
    names = list(dict.fromkeys(name for x, y in rules.values() for name in x + y))
    part = {name: f"part_{i}" for i, name in enumerate(names)}
    columns_of = {i: frozenset(part[name] for name in x + y) for i, (x, y) in rules.items()}
    pairs, set_ids = aggregate_sets(
        rows.select(*[group_cell(rows, name).alias(part[name]) for name in names]),
        list(part.values()),
        columns_of.values(),
        [F.count(F.lit(1)).alias("n")],
    )

    def numbers(members: frozenset) -> Column:
        return F.array(*[F.lit(i) for i in rules if columns_of[i] == members])

    applicable = F.coalesce(*[F.when(F.col("key_set") == number, numbers(s)) for s, number in set_ids.items()])
    rule = F.col("rule")
    antecedent = {
        part[name]: F.when(rule.isin([i for i, (x, _) in rules.items() if name in x]), F.col(part[name]))
        for name in dict.fromkeys(name for x, _ in rules.values() for name in x)
    }
    scored = (
        pairs.select(F.explode(applicable).alias("rule"), *part.values(), "n")
        .select("rule", *[cell.alias(name) for name, cell in antecedent.items()], "n")
        .groupBy("rule", *antecedent)
        .agg(F.sum("n").alias("n"), F.max("n").alias("top"))
    )

    def text(of) -> Column:
        return F.coalesce(*[F.when(rule == i, of(x, y)) for i, (x, y) in rules.items()])

    return scored.select(
        "rule",
        text(lambda x, y: F.lit(",".join(x))).alias("RuleAntecedent"),
        text(lambda x, y: F.lit(",".join(y))).alias("RuleConsequent"),
        text(lambda x, y: F.concat_ws(",", *[key_part(F.col(part[name])) for name in x])).alias("AntecedentValue"),
        ratio(F.col("top"), F.col("n")).alias("ConsistencyValue"),
    )


def consistency_value(scores: DataFrame) -> DataFrame:
    return scores.select(
        "AntecedentValue",
        F.concat_ws(" -> ", "RuleAntecedent", "RuleConsequent").alias("Rule"),
        "ConsistencyValue",
    )


def consistency_attribute(scores: DataFrame, confidence: float = 1.0) -> DataFrame:
    """Unweighted mean over antecedent values, per rule."""
    return (
        scores.groupBy("rule", "RuleAntecedent", "RuleConsequent")
        .agg(F.avg("ConsistencyValue").alias("ConsistencyValue"))
        .select(
            "RuleAntecedent",
            "RuleConsequent",
            "ConsistencyValue",
            F.lit(float(confidence)).alias("Confidence"),
        )
    )


def usable_allow_lists(allow_lists: Sequence[DataFrame], columns: Sequence[str]) -> list[DataFrame]:
    """Lists whose columns are all among the assessed columns."""
    return [a for a in allow_lists if a.columns and set(a.columns) <= set(columns)]


def _as_source(source: DataFrame, name: str) -> Column:
    """A list's cell in the source column's type; NULL where its text is no such value."""
    kind = data_type(source, name)
    return column(name) if isinstance(kind, StringType) else column(name).cast("string").try_cast(kind)


def association_consistency(
    source: DataFrame,
    allow_lists: Sequence[DataFrame],
    columns: Sequence[str],
    name: str = "ASSOCIATION_CONSISTENCY",
) -> DataFrame:
    """Per-row share of usable allow-lists that contain the row's binding.

    A list's text is cast to the source column's type before both are compared, so "1"
    matches the double 1.0; text that cannot be cast matches nothing. Lists over the same
    columns are merged to one table of (binding, lists that hold it), so k lists cost one
    join per set of columns, and rows never multiply. Nothing is forced to broadcast: a
    table below Spark's broadcast threshold is broadcast and the source is not shuffled.
    A larger one is a sort-merge join on the binding as one array; since the table is
    grouped on its columns but joined on the array, both join inputs are plain
    shuffles, which lets adaptive execution split a binding that dominates the source.
    """
    usable = usable_allow_lists(allow_lists, columns)
    if not usable:
        return source
    merged: dict[tuple[str, ...], list[DataFrame]] = {}
    for allowed in usable:
        merged.setdefault(tuple(sorted(allowed.columns)), []).append(allowed)
    out, hits = source, F.lit(0.0)
    for i, (names, lists) in enumerate(merged.items()):
        binding, listed = f"__binding_{i}", f"__listed_{i}"
        parts = [f"binding_part_{j}" for j in range(len(names))]
        cells = None
        for number, allowed in enumerate(lists):
            cast = [key_part(_as_source(source, c)).alias(p) for c, p in zip(names, parts)]
            # Text that the source's type cannot hold becomes NULL, which would match a NULL cell.
            sound = allowed.filter(reduce(and_, [column(c).isNull() | _as_source(source, c).isNotNull() for c in names]))
            own = sound.select(*cast, F.lit(number).alias("list")).distinct()
            cells = own if cells is None else cells.unionByName(own)
        marks = cells.groupBy(*parts).agg(F.count(F.lit(1)).cast("double").alias(listed))
        marks = marks.select(F.array(*parts).alias(binding), listed)
        out = out.withColumn(binding, F.array(*[key_part(column(c)) for c in names]))
        out = out.join(marks, on=binding, how="left").drop(binding)
        hits = hits + F.coalesce(F.col(listed), F.lit(0.0))
    share = ratio(hits, F.lit(float(len(usable)))).cast("string")
    return out.withColumn(name, share).select(
        *[column(c) for c in dict.fromkeys([*source.columns, name])]
    )
