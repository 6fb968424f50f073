"""A whole assessment in a handful of scans.

The source is read once for the totals and the key values of all dimensions, and once
each for frequency, rules and duplicates. These aggregates are stored in the shared
folder; every published table is a small step on top of them.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import column, complete_row
from ..operators.accuracy import (
    accuracy_attribute,
    accuracy_inputs,
    accuracy_measures,
    accuracy_metrics,
    accuracy_values,
)
from ..operators.completeness import (
    completeness_missing_attributes,
    completeness_missing_values,
    key_presence_inputs,
    key_presence_measures,
    missing_inputs,
    missing_measures,
    missing_metrics,
    row_completeness,
)
from ..operators.consistency import (
    association_consistency,
    consistency_attribute,
    consistency_value,
    rule_keys,
    rule_scores,
)
from ..operators.distinctness import (
    distinctness_attributes,
    distinctness_global,
    key_cardinality,
    population_attributes,
)
from ..operators.frequency import (
    frequency_attribute,
    frequency_global,
    frequency_groups,
    frequency_hour,
    frequency_value,
    hour_counts,
    roll_up_hours,
    value_hour_counts,
)
from ..operators.grouping import group_by_keys, label_of, usable_keys
from ..operators.precision import (
    precision_attribute,
    precision_inputs,
    precision_measures,
    precision_metrics,
    precision_values,
)
from ..operators.selection import drop_incomplete, null_to_text, select_rows
from ..operators.timeliness import (
    timeliness_attribute,
    timeliness_inputs,
    timeliness_measures,
    timeliness_metrics,
    timeliness_signed,
    timeliness_tuple,
    timeliness_value,
)
from ..operators.volume import volume_measures, volume_metrics, volume_values
from ..sources.writers import store, write_extended, write_json
from .config import AssessmentConfig

# Tables whose size is set by the configuration, not by the data.
BOUNDED_TABLES = (
    "final_quality",
    "accuracy_attributes",
    "precision_attributes",
    "completeness_missing_attributes",
    "completeness_frequency_attributes",
    "completeness_frequency_global_hour",
    "timeliness_attributes",
    "completeness_population_attributes",
    "distinctness_attributes",
    "consistency_attributes_mean_per_rule",
)


@dataclass(frozen=True)
class SourceMetadata:
    """Tables a profiling step keeps beside the data; each may be absent.

    ``update_rate_global`` and ``update_rate_values`` are per timestamp column;
    ``association_rules`` is a table (Antecedent, Consequent) or a list of pairs.
    """

    update_rate_global: Mapping[str, DataFrame] = field(default_factory=dict)
    update_rate_values: Mapping[str, DataFrame] = field(default_factory=dict)
    source_distinctness: DataFrame | None = None
    association_rules: DataFrame | Sequence | None = None

    def stored_rules(self) -> list:
        rules = self.association_rules
        if isinstance(rules, DataFrame):
            return [
                (row.Antecedent, row.Consequent)
                for row in rules.select("Antecedent", "Consequent").toLocalIterator()
            ]
        return list(rules or ())


class _Run:
    """Shared inputs of the steps of one assessment."""

    def __init__(
        self,
        source: DataFrame,
        config: AssessmentConfig,
        now: dt.datetime | str,
        metadata: SourceMetadata,
        stored: bool,
        store_rows: bool = False,
    ):
        self.source, self.config, self.now, self.metadata = source, config, now, metadata
        self.columns = list(config.columns)
        self.rows = select_rows(
            source,
            self.columns,
            config.intervals,
            config.values,
            config.compare,
            config.timestamps,
            config.sample_fraction,
            config.sample_seed,
            config.sample_key,
            config.on_invalid,
        )
        drawn = config.sample_fraction < 1 and not config.sample_key
        if drawn and any(isinstance(v, DataFrame) for v in config.values.values()):
            # Behind a join two scans may draw different rows.
            if not stored:
                raise ValueError("a random sample of rows met by a value table must be stored, or sampled by key")
            store_rows = True
        if store_rows:
            self.rows = store(self.rows, "rows")
        self.complete_rows = drop_incomplete(self.rows)
        self.complete = complete_row(self.columns)
        self.confidence = float(config.sample_fraction)
        self.all_keys = usable_keys(config.keys)
        self.keys = usable_keys(config.keys, config.timestamps)
        self.targets = config.accuracy_targets()
        self.numbers = config.precision_columns()
        self.times = config.time_columns()
        self.stored = stored
        self.counted: DataFrame | None = None

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Store a shared aggregate, or leave it lazy."""
        return store(df, name) if self.stored else df

    def total(self) -> Column:
        """Rows of the source before selection, as a scalar subquery; counted once when stored."""
        if self.counted is None:
            counted = self.source.agg(F.count(F.lit(1)).alias("total"))
            self.counted = self.keep(counted, "source-rows")
        return self.counted.scalar()

    def large(self, keys: Sequence[Sequence[str]]) -> list[int]:
        """Positions of the keys that the configuration declares to have very many values."""
        declared = {frozenset(key) for key in self.config.large_keys}
        return [i for i, key in enumerate(keys) if frozenset(key) in declared]

    def wants(self, dimension: str, *levels: str) -> bool:
        return any(self.config.wants(dimension, level) for level in levels)

    def with_column(self, table: DataFrame, name: str) -> DataFrame:
        return table.select(F.lit(name).alias("Column"), "*")


def _measures(run: _Run, levels: Sequence[str]) -> tuple[list[Column], list[Column]]:
    """Row inputs and aggregates of every dimension wanted at one of the levels."""
    inputs, measures = [run.complete.alias("complete")], volume_measures(F.col("complete"))
    policy = run.config.on_invalid
    if run.targets and run.wants("Accuracy", *levels):
        inputs += accuracy_inputs(run.rows, run.targets, policy, run.complete)
        measures += accuracy_measures(run.targets)
    if run.numbers and run.wants("Precision", *levels):
        inputs += precision_inputs(run.rows, run.numbers, policy, run.complete)
        measures += precision_measures(run.numbers)
    if run.times and run.wants("Timeliness", *levels):
        inputs += timeliness_inputs(run.rows, run.times, run.now, policy, run.complete)
        measures += timeliness_measures(run.times)
    if run.wants("Completeness_Missing", *levels):
        inputs += missing_inputs(run.rows, run.columns)
        measures += missing_measures()
        if "attribute" in levels and run.wants("Completeness_Missing", "attribute"):
            inputs += key_presence_inputs(run.all_keys)
            measures += key_presence_measures(run.all_keys)
    return inputs, measures


def _totalled(run: _Run) -> bool:
    """Whether some wanted number comes from the totals over all rows."""
    return (
        (bool(run.targets) and run.wants("Accuracy", "global"))
        or (bool(run.numbers) and run.wants("Precision", "global"))
        or (bool(run.times) and run.wants("Timeliness", "global"))
        or (bool(run.all_keys) and run.wants("Completeness_Missing", "attribute"))
        or run.wants("Completeness_Missing", "global")
        or run.wants("Volume", "global")
    )


def _grouped(run: _Run) -> bool:
    """Whether some wanted table is per key or key value."""
    return bool(run.keys) and (
        (bool(run.targets) and run.wants("Accuracy", "attribute", "value"))
        or (bool(run.numbers) and run.wants("Precision", "attribute", "value"))
        or (bool(run.times) and run.wants("Timeliness", "attribute", "value"))
        or run.wants("Completeness_Missing", "value")
        or run.wants("Volume", "value")
        or run.wants("Distinctness", "attribute")
        or run.wants("Completeness_Population", "attribute")
    )


def _aggregates(run: _Run) -> tuple[DataFrame, DataFrame | None]:
    """One row of totals, and the measures per key value (None when no table needs them).

    A stored run gets both from a single scan: the totals are one more grouping set.
    """
    if not _grouped(run):
        if not _totalled(run):
            return run.source.sparkSession.range(1), None
        inputs, measures = _measures(run, ("global", "attribute"))
        return run.keep(run.rows.select(*inputs).agg(*measures), "totals"), None
    if run.stored:
        inputs, measures = _measures(run, ("global", "attribute", "value"))
        grouped = group_by_keys(run.rows, run.keys, inputs, measures, total=True, apart=run.large(run.keys))
        table = run.keep(grouped, "key-groups")
        return table.filter(F.col("Attribute").isNull()), table.filter(F.col("Attribute").isNotNull())
    inputs, measures = _measures(run, ("global", "attribute"))
    totals = run.rows.select(*inputs).agg(*measures)
    inputs, measures = _measures(run, ("attribute", "value"))
    return totals, group_by_keys(run.rows, run.keys, inputs, measures, apart=run.large(run.keys))


def _frequency(run: _Run) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Frequency per hour of day and per key value, by timestamp column with known rates."""
    hours, values = {}, {}
    for i, spec in enumerate(run.times):
        global_rates = run.metadata.update_rate_global.get(spec.column)
        value_rates = run.metadata.update_rate_values.get(spec.column)
        counts = None
        if run.keys and value_rates is not None and run.wants("Completeness_Frequency", "attribute", "value"):
            counts = value_hour_counts(
                run.complete_rows,
                spec.column,
                run.keys,
                run.config.timestamps,
                spec.format,
                run.config.on_invalid,
                run.large(run.keys),
            )
            counts = run.keep(counts, f"hour-counts-{i}")
            values[spec.column] = run.keep(
                frequency_groups(counts, value_rates, run.confidence), f"frequency-{i}"
            )
        if global_rates is not None and run.wants("Completeness_Frequency", "global"):
            if counts is not None and run.stored:
                per_hour = roll_up_hours(counts, label_of(run.keys[0]))
            else:
                per_hour = hour_counts(run.complete_rows, spec.column, spec.format, run.config.on_invalid)
            hours[spec.column] = run.keep(frequency_hour(per_hour, global_rates, run.confidence), f"hours-{i}")
    return hours, values


def _distinctness(run: _Run) -> DataFrame:
    """Duplicates of whole rows."""
    return distinctness_global(run.complete_rows, run.columns)


def _final_quality(run: _Run, totals: DataFrame, hours: Mapping[str, DataFrame]) -> DataFrame:
    """One wide row of global metrics; each has the run's confidence, so their mean is it."""
    metrics, row = [], totals
    if run.wants("Volume", "global"):
        row = row.withColumn("vol_total", run.total())
        metrics += volume_metrics()
    if run.targets and run.wants("Accuracy", "global"):
        metrics += accuracy_metrics(run.targets)
    if run.numbers and run.wants("Precision", "global"):
        metrics += precision_metrics(run.numbers)
    if run.wants("Completeness_Missing", "global"):
        metrics += missing_metrics(run.columns)
    if run.times and run.wants("Timeliness", "global"):
        metrics += timeliness_metrics(run.times, run.now)
    if run.wants("Distinctness", "global"):
        metrics.append(_distinctness(run).scalar().alias("Distinctness"))
    for name, table in hours.items():
        metrics.append(frequency_global(table, name).scalar().alias(f"Completeness_Frequency_{name}"))
    if not metrics:
        return run.source.sparkSession.range(1).select(F.lit(None).cast("double").alias("Confidence"))
    return run.keep(row.select(*metrics, F.lit(run.confidence).alias("Confidence")), "final-quality")


def _key_tables(run: _Run, totals: DataFrame, groups: DataFrame | None) -> dict[str, DataFrame]:
    """Attribute and value tables that come from the totals and the grouped measures."""
    out: dict[str, DataFrame] = {}
    if run.all_keys and run.wants("Completeness_Missing", "attribute"):
        out["completeness_missing_attributes"] = completeness_missing_attributes(
            totals, run.all_keys, run.confidence
        )
    if run.wants("Completeness_Population", "attribute") and run.metadata.source_distinctness is None:
        raise ValueError("Completeness_Population needs the source_distinctness table")
    if groups is None:
        return out
    seen = groups.filter(F.col("vol_rows") > 0)

    if run.wants("Completeness_Missing", "value"):
        out["completeness_missing_values"] = completeness_missing_values(groups, run.columns)
    if run.targets and run.wants("Accuracy", "attribute", "value"):
        values = accuracy_values(seen, run.targets, run.keys)
        if run.wants("Accuracy", "value"):
            out["accuracy_values"] = values
        if run.wants("Accuracy", "attribute"):
            out["accuracy_attributes"] = accuracy_attribute(values, run.confidence)
    if run.numbers and run.wants("Precision", "attribute", "value"):
        extremes = totals
        if not run.stored:
            numbers = precision_inputs(run.rows, run.numbers, run.config.on_invalid, run.complete)
            extremes = run.rows.select(*numbers).agg(*precision_measures(run.numbers))
        values = precision_values(seen, run.numbers, run.keys, extremes)
        if run.wants("Precision", "value"):
            out["precision_values"] = values
        if run.wants("Precision", "attribute"):
            out["precision_attributes"] = precision_attribute(values, run.confidence)
    if run.times and run.wants("Timeliness", "attribute", "value"):
        signed = timeliness_signed(seen, run.times, run.keys, run.now)
        if run.wants("Timeliness", "value"):
            out["timeliness_values"] = timeliness_value(signed)
        if run.wants("Timeliness", "attribute"):
            out["timeliness_attributes"] = timeliness_attribute(signed, run.confidence)
    if run.wants("Volume", "value"):
        out["volume_values"] = volume_values(seen, run.total())
    cardinality = key_cardinality(seen)
    if run.wants("Distinctness", "attribute"):
        out["distinctness_attributes"] = distinctness_attributes(cardinality, run.confidence)
    single = [label_of(key) for key in run.keys if len(key) == 1]
    if single and run.wants("Completeness_Population", "attribute"):
        out["completeness_population_attributes"] = population_attributes(
            cardinality, run.metadata.source_distinctness, single, run.confidence
        )
    return out


def _frequency_tables(
    run: _Run, hours: Mapping[str, DataFrame], values: Mapping[str, DataFrame]
) -> dict[str, DataFrame]:
    out = {}
    if hours:
        out["completeness_frequency_global_hour"] = _union(
            [run.with_column(table, name) for name, table in hours.items()]
        )
    if values and run.wants("Completeness_Frequency", "value"):
        out["completeness_frequency_values"] = _union(
            [run.with_column(frequency_value(groups), name) for name, groups in values.items()]
        )
    if values and run.wants("Completeness_Frequency", "attribute"):
        out["completeness_frequency_attributes"] = _union(
            [run.with_column(frequency_attribute(groups, run.confidence), name) for name, groups in values.items()]
        )
    return out


def _rule_tables(run: _Run) -> dict[str, DataFrame]:
    if not run.wants("Consistency", "attribute", "value"):
        return {}
    rules = run.config.rule_list(run.metadata.stored_rules())
    unknown = sorted({c for x, y in rules for c in x + y} - set(run.columns))
    if unknown:
        raise ValueError(f"rule columns {unknown} are not among the assessed columns")
    if not rules:
        return {}
    apart = run.large(rule_keys(rules))
    scores = run.keep(rule_scores(run.complete_rows, rules, apart), "rules")
    out = {}
    if run.wants("Consistency", "value"):
        out["consistency_values"] = consistency_value(scores)
    if run.wants("Consistency", "attribute"):
        out["consistency_attributes_mean_per_rule"] = consistency_attribute(scores, run.confidence)
    return out


def _union(tables: Sequence[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def extended_dataset(
    source: DataFrame,
    config: AssessmentConfig,
    now: dt.datetime | str,
    allow_lists: Sequence[DataFrame] = (),
) -> DataFrame:
    """The whole source as text with refreshed per-row quality columns.

    Selection and sampling do not apply. ``COMPLETENESS_MISSING`` is kept when the source
    has it and computed over the source's data columns otherwise.
    """
    quality = {"COMPLETENESS_MISSING", "ASSOCIATION_CONSISTENCY"}
    data = [c for c in source.columns if c not in quality and not c.startswith("TIMELINESS_")]
    out = source
    if config.wants("Completeness_Missing", "tuple") and "COMPLETENESS_MISSING" not in source.columns:
        out = row_completeness(out, data)
    if config.wants("Timeliness", "tuple") and config.time_columns():
        out = timeliness_tuple(out, config.time_columns(), now, config.on_invalid)
    if config.wants("Consistency", "tuple") and config.refresh_consistency():
        out = association_consistency(out, allow_lists, config.columns)
    return null_to_text(out)


def assess(
    source: DataFrame,
    config: AssessmentConfig,
    now: dt.datetime | str,
    metadata: SourceMetadata | None = None,
    allow_lists: Sequence[DataFrame] = (),
    stored: bool = True,
    store_rows: bool = False,
) -> dict[str, DataFrame]:
    """All tables the configuration asks for, by name.

    With ``stored`` the shared aggregates are computed here, once, and written to the
    shared folder. Without it everything stays lazy and each table plans its own scan.
    ``store_rows`` also writes the selected rows first: for sources that are slow to read
    (JSON, regex text) and for selections and samples much smaller than the source.
    """
    run = _Run(source, config, now, metadata or SourceMetadata(), stored, store_rows)
    totals, groups = _aggregates(run)
    hours, values = _frequency(run)
    tables = {"final_quality": _final_quality(run, totals, hours)}
    tables.update(_key_tables(run, totals, groups))
    tables.update(_frequency_tables(run, hours, values))
    tables.update(_rule_tables(run))
    if any(config.wants(d, "tuple") for d in ("Completeness_Missing", "Timeliness", "Consistency")):
        tables["extended_dataset"] = extended_dataset(source, config, now, allow_lists)
    return tables


def final_quality(
    source: DataFrame,
    config: AssessmentConfig,
    now: dt.datetime | str,
    metadata: SourceMetadata | None = None,
) -> DataFrame:
    """Only the wide row of global metrics, lazily."""
    run = _Run(source, config, now, metadata or SourceMetadata(), stored=False)
    totals = source.sparkSession.range(1)
    if _totalled(run):
        inputs, measures = _measures(run, ("global",))
        totals = run.rows.select(*inputs).agg(*measures)
    hours, _ = _frequency(run)
    return _final_quality(run, totals, hours)


def long_report(wide: DataFrame) -> DataFrame:
    """The wide row as (Metric, Value, Confidence); values as text."""
    metrics = [c for c in wide.columns if c != "Confidence"]
    lines = [
        F.struct(F.lit(name).alias("Metric"), column(name).cast("string").alias("Value")) for name in metrics
    ]
    return wide.select("Confidence", F.inline(F.array(*lines))).select("Metric", "Value", "Confidence")


def mean_confidence(report: DataFrame) -> DataFrame:
    """Mean confidence over the metrics of a long report; NULL without metrics."""
    return report.agg(F.avg("Confidence").alias("Confidence"))


def write_assessment(tables: Mapping[str, DataFrame], output: str, mode: str = "overwrite") -> None:
    """One JSON folder per table.

    ``mode="keep"`` leaves an existing per-value frequency table as it is, for folders that
    belong to one run; by default no table of an earlier run stays beside new ones.
    """
    if mode not in ("overwrite", "keep"):
        raise ValueError("mode must be overwrite or keep")
    for name, table in tables.items():
        if name == "extended_dataset":
            write_extended(table, f"{output}/{name}")
        else:
            kept = mode == "keep" and name == "completeness_frequency_values"
            write_json(table, f"{output}/{name}", "ignore" if kept else "overwrite", single_file=name in BOUNDED_TABLES)
