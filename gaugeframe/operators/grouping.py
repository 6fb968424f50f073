"""Aggregation by many grouping keys in as few scans as pay off."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import group_cell, key_part

Keys = Sequence[Sequence[str]]


def label_of(key: Sequence[str]) -> str:
    return "_".join(key)


def usable_keys(keys: Keys, excluded: Iterable[str] = ()) -> list[tuple[str, ...]]:
    """Distinct keys that touch none of the excluded columns, in the given order."""
    excluded = set(excluded)
    usable = [k for k in dict.fromkeys(tuple(key) for key in keys) if not excluded & set(k)]
    if len({label_of(key) for key in usable}) != len(usable):
        raise ValueError(f"two keys of {usable} have the same label")
    return usable


def group_by_keys(
    rows: DataFrame,
    keys: Keys,
    inputs: Sequence[Column],
    measures: Sequence[Column],
    labels: Sequence[str] | None = None,
    within: Mapping[str, Column] | None = None,
    total: bool = False,
    apart: Iterable[int] = (),
) -> DataFrame:
    """Aggregate ``rows`` by every key, in one scan unless ``apart`` says otherwise.

    ``inputs`` are aliased expressions evaluated once per row; ``measures`` are aggregates
    over them; ``within`` names extra grouping columns shared by all keys. The result has
    ``Attribute`` (the key's label), ``Parts`` (its rendered components; groups with
    different components never merge), ``Value`` (the components joined for display),
    the ``within`` columns and the measures. With ``total`` one more row, whose Attribute
    is NULL, holds the measures over all rows.

    Typed components are grouped as they are and rendered per group, not per row. Several
    keys become GROUPING SETS. Partial aggregation runs before the shuffle, so a
    hot key value reaches the reducers as one row per map task.

    Keys at the positions in ``apart`` get a scan of their own (keys over the same columns
    share it). That pays for keys with so many values that a map task cannot combine
    them: in a shared pass they crowd out the other keys and make the whole partial
    aggregation spill and sort.
    """
    keys = [tuple(key) for key in keys]
    if not keys:
        raise ValueError("at least one grouping key is needed")
    labels = list(labels) if labels is not None else [label_of(key) for key in keys]
    out = None
    for positions in split_passes(keys, apart):
        grouped = _one_pass(
            rows,
            [keys[i] for i in positions],
            [labels[i] for i in positions],
            inputs,
            measures,
            dict(within or {}),
            total and out is None,
        )
        out = grouped if out is None else out.unionByName(grouped)
    return out


def _one_pass(
    rows: DataFrame,
    keys: Keys,
    labels: Sequence[str],
    inputs: Sequence[Column],
    measures: Sequence[Column],
    within: Mapping[str, Column],
    total: bool,
) -> DataFrame:
    names = list(dict.fromkeys(name for key in keys for name in key))
    part = {name: f"part_{i}" for i, name in enumerate(names)}
    staged = rows.select(
        *[group_cell(rows, name).alias(part[name]) for name in names],
        *[expression.alias(name) for name, expression in within.items()],
        *inputs,
    )

    whole = frozenset()
    sets = [frozenset(part[name] for name in key) for key in keys] + ([whole] if total else [])
    grouped, set_ids = aggregate_sets(staged, list(part.values()), sets, measures, list(within))

    def views(members: frozenset) -> Column:
        """The keys over these columns (in any order) with their rendered components."""
        if members == whole:
            unnamed = F.lit(None).cast("string").alias("Attribute")
            return F.array(F.struct(unnamed, F.array().cast("array<string>").alias("Parts")))
        return F.array(
            *[
                F.struct(
                    F.lit(label).alias("Attribute"),
                    F.array(*[key_part(F.col(part[name])) for name in key]).alias("Parts"),
                )
                for key, label in zip(keys, labels)
                if frozenset(part[name] for name in key) == members
            ]
        )

    view = F.coalesce(*[F.when(F.col("key_set") == number, views(s)) for s, number in set_ids.items()])
    dropped = {*part.values(), *within, "key_set"}
    return grouped.select(F.inline(view), "*").select(
        "Attribute",
        "Parts",
        F.array_join("Parts", ",").alias("Value"),
        *within,
        *[name for name in grouped.columns if name not in dropped],
    )


def aggregate_sets(
    staged: DataFrame,
    columns: Sequence[str],
    sets: Iterable[frozenset],
    measures: Sequence[Column],
    common: Sequence[str] = (),
) -> tuple[DataFrame, dict[frozenset, int]]:
    """Aggregate by several subsets of ``columns`` (each with the ``common`` ones) at once.

    Returns the groups, with ``key_set`` telling the subset, and its number per subset:
    grouping_id() has a bit per grouping column, the first highest, 1 for "not grouped".
    """
    sets = list(dict.fromkeys(sets))
    everything = [*columns, *common]
    if len(sets) == 1:
        return staged.groupBy(*everything).agg(F.lit(0).alias("key_set"), *measures), {sets[0]: 0}
    grouped = staged.groupingSets(
        [[name for name in columns if name in members] + list(common) for members in sets], *everything
    ).agg(F.grouping_id().alias("key_set"), *measures)
    ids = {}
    for members in sets:
        bits = ["0" if name in members or name in common else "1" for name in everything]
        ids[members] = int("".join(bits), 2)
    return grouped, ids


def split_passes(keys: Keys, apart: Iterable[int]) -> list[list[int]]:
    """Positions of keys to aggregate together; keys over the same columns share a pass."""
    columns_apart = {frozenset(keys[i]) for i in apart}
    passes: dict[frozenset, list[int]] = {}
    for i, key in enumerate(keys):
        columns = frozenset(key)
        passes.setdefault(columns if columns in columns_apart else frozenset(), []).append(i)
    return list(passes.values())


def per_column(
    groups: DataFrame,
    entries: Mapping[str, Sequence[Column]],
    skipped: Mapping[str, Sequence[str]] | None = None,
    keep: Sequence[str] = ("Attribute", "Value"),
) -> DataFrame:
    """Unpivot grouped measures to one row per analysed column and group.

    ``entries`` maps an analysed column to its aliased result expressions; ``skipped``
    lists the key labels that do not apply to a column.
    """
    skipped = skipped or {}
    rows = []
    for name, expressions in entries.items():
        row = F.struct(F.lit(name).alias("Column"), *expressions)
        labels = list(skipped.get(name, ()))
        rows.append(F.when(~F.col("Attribute").isin(*labels), row) if labels else row)
    lines = F.array(*rows)
    if any(skipped.get(name) for name in entries):
        lines = F.array_compact(lines)
    shaped = groups.select(*keep, F.inline(lines))
    return shaped.select("Column", *[c for c in shaped.columns if c != "Column"])


def skipped_labels(columns: Iterable[str], keys: Keys) -> dict[str, list[str]]:
    """A key that contains the analysed column says nothing about it."""
    return {name: [label_of(k) for k in keys if name in k] for name in columns}
