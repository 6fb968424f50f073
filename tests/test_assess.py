"""The fused assessment gives the tables of the separate operators."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gaugeframe import AssessmentConfig, SourceMetadata, assess, final_quality, write_assessment
from gaugeframe import operators as op
from gaugeframe.plans import DIMENSIONS, extended_dataset, long_report, mean_confidence
from helpers import one, rows

NOW = dt.datetime(2024, 2, 1)
ALL = ["global", "attribute", "value", "tuple"]
KEYS = [["event_type"], ["user_id", "event_type"], ["ts"]]


@pytest.fixture(scope="module")
def events(spark, small):
    """Events with some NULL users and empty types."""
    table = spark.read.parquet(f"{small}/events.parquet").drop("props")
    return table.select(
        "event_id",
        "ts",
        F.when(F.col("user_id") != 7, F.col("user_id")).alias("user_id"),
        F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("event_type"),
        "value",
    )


def settings(**changes):
    base = dict(
        columns=["ts", "user_id", "event_type", "value"],
        keys=KEYS,
        granularity={name: ALL for name in DIMENSIONS},
        intervals={"value": [(5, 300)]},
        compare="typed",
        expected_mean={"value": 50},
        interval_width={"value": 100},
        timestamps={"ts": None},
        volatility_hours={"ts": 720},
        rules=["user_id:event_type"],
    )
    return AssessmentConfig(**{**base, **changes})


@pytest.fixture(scope="module")
def metadata(events):
    complete = op.drop_incomplete(events)
    return SourceMetadata(
        update_rate_global={"ts": op.update_rate_global(op.hour_counts(complete, "ts"))},
        update_rate_values={"ts": op.update_rate_values(op.value_hour_counts(complete, "ts", KEYS))},
        source_distinctness=op.source_distinctness(complete, ["event_type", "user_id"]),
        association_rules=[("event_type", "user_id")],
    )


@pytest.fixture(scope="module")
def allowed(events):
    return events.filter("value > 200 AND user_id IS NOT NULL").select("user_id")


@pytest.fixture(scope="module")
def tables(events, metadata, allowed):
    return assess(events, settings(), NOW, metadata, [allowed])


@pytest.fixture(scope="module")
def seen(events):
    return op.select_rows(events, settings().columns, {"value": [(5, 300)]}, compare="typed")


def test_every_table_is_there(tables):
    assert set(tables) == {
        "final_quality",
        "accuracy_values",
        "accuracy_attributes",
        "precision_values",
        "precision_attributes",
        "completeness_missing_values",
        "completeness_missing_attributes",
        "completeness_frequency_values",
        "completeness_frequency_attributes",
        "completeness_frequency_global_hour",
        "timeliness_values",
        "timeliness_attributes",
        "volume_values",
        "completeness_population_attributes",
        "distinctness_attributes",
        "consistency_values",
        "consistency_attributes_mean_per_rule",
        "extended_dataset",
    }


def same(left, right):
    """Equal columns and rows, doubles to 12 places."""

    def rounded(df):
        return df.select(*[F.round(c, 12).alias(c) if t == "double" else F.col(c) for c, t in sorted(df.dtypes)])

    a, b = rounded(left), rounded(right)
    assert a.dtypes == b.dtypes
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_fused_tables_equal_separate_operators(tables, seen, events, metadata):
    complete = op.drop_incomplete(seen)
    target = [op.AccuracyTarget("value", 50, 100)]
    times = [op.TimeColumn("ts", 720.0)]
    values = op.accuracy_value(complete, target, KEYS, ["ts"])
    same(tables["accuracy_values"], values)
    same(tables["accuracy_attributes"], op.accuracy_attribute(values))
    values = op.precision_value(complete, ["value"], KEYS, ["ts"])
    same(tables["precision_values"], values)
    same(tables["precision_attributes"], op.precision_attribute(values))
    same(tables["completeness_missing_values"], op.completeness_missing_value(seen, seen.columns, KEYS, ["ts"]))
    same(tables["completeness_missing_attributes"], op.completeness_missing_attribute(seen, KEYS))
    signed = op.timeliness_groups(complete, times, KEYS, NOW)
    same(tables["timeliness_values"], op.timeliness_value(signed))
    same(tables["timeliness_attributes"], op.timeliness_attribute(signed))
    same(tables["volume_values"], op.volume_value(complete, events, KEYS, ["ts"]))
    same(tables["distinctness_attributes"], op.distinctness_attribute(complete, KEYS, ["ts"]))
    same(
        tables["completeness_population_attributes"],
        op.completeness_population(complete, metadata.source_distinctness, KEYS, ["ts"]),
    )
    counts = op.value_hour_counts(complete, "ts", KEYS)
    groups = op.frequency_groups(counts, metadata.update_rate_values["ts"])
    same(tables["completeness_frequency_values"].drop("Column"), op.frequency_value(groups))
    same(tables["completeness_frequency_attributes"].drop("Column"), op.frequency_attribute(groups))
    hours = op.frequency_hour(op.hour_counts(complete, "ts"), metadata.update_rate_global["ts"])
    same(tables["completeness_frequency_global_hour"].drop("Column"), hours)
    scores = op.rule_scores(complete, op.rule_set(["user_id:event_type"], [("event_type", "user_id")]))
    same(tables["consistency_values"], op.consistency_value(scores))
    same(tables["consistency_attributes_mean_per_rule"], op.consistency_attribute(scores))


def test_final_quality_equals_separate_operators(tables, seen, events, metadata):
    complete = op.drop_incomplete(seen)
    hours = op.frequency_hour(op.hour_counts(complete, "ts"), metadata.update_rate_global["ts"])
    expected = {"Confidence": 1.0}
    for df in (
        op.volume_global(complete, events),
        op.accuracy_global(complete, [op.AccuracyTarget("value", 50, 100)]),
        op.precision_global(complete, ["value"]),
        op.completeness_missing_global(seen, seen.columns),
        op.timeliness_global(complete, [op.TimeColumn("ts", 720.0)], NOW),
        op.distinctness_global(complete, complete.columns),
        op.frequency_global(hours, "ts"),
    ):
        expected.update(one(df))
    got = one(tables["final_quality"])
    assert set(got) == set(expected)
    for name, value in expected.items():
        assert got[name] == (pytest.approx(value) if isinstance(value, float) else value), name


def test_lazy_and_stored_assessments_agree(tables, events, metadata, allowed):
    lazy = assess(events, settings(), NOW, metadata, [allowed], stored=False)
    for name in ("final_quality", "precision_values", "consistency_values"):
        same(tables[name], lazy[name])


def test_large_keys_apart_do_not_change_an_assessment(tables, events, metadata):
    apart = assess(events, settings(large_keys=KEYS), NOW, metadata)
    for name in set(tables) - {"extended_dataset"}:
        same(tables[name], apart[name])


def test_duplicates_of_rows(spark):
    draw = random.Random(4)
    cells = [("a", None), ("a", 1), ("b", 1), ("b", 2), ("c", 3)]
    records = [draw.choice(cells) for _ in range(40)] + [("x", n) for n in range(30)] + [("y", 1)] * 2
    df = spark.createDataFrame(records, "k string, n int").repartition(3)
    sizes = Counter(r for r in records if r[1] is not None)
    expected = 1 - sum(n / 2 for n in sizes.values() if n > 2) / sum(sizes.values())
    config = AssessmentConfig(columns=["k", "n"], dimensions=["Distinctness"])
    for stored in (True, False):
        found = one(assess(df, config, NOW, stored=stored)["final_quality"])["Distinctness"]
        assert found == pytest.approx(expected)


def test_stored_rows_do_not_change_an_assessment(tables, events, metadata, allowed):
    kept = assess(events, settings(), NOW, metadata, [allowed], store_rows=True)
    for name in tables:
        same(tables[name], kept[name])


def test_counts_of_a_key_add_up(tables):
    total = one(tables["final_quality"])["Volume(TotalRows)"]
    sums = tables["volume_values"].groupBy("Attribute").agg(F.sum("Count").alias("n"))
    assert {r["n"] for r in rows(sums)} == {total}


def test_global_accuracy_is_the_weighted_mean_of_groups(tables):
    weighted = (
        tables["accuracy_values"]
        .join(tables["volume_values"], ["Attribute", "Value"])
        .groupBy("Attribute")
        .agg((F.sum(F.col("AccuracyDynamic") * F.col("Count")) / F.sum("Count")).alias("x"))
    )
    expected = one(tables["final_quality"])["Accuracy_Dynamic_value"]
    assert [r["x"] for r in rows(weighted)] == [pytest.approx(expected)] * 2


def test_a_dependency_is_fully_consistent(events):
    scores = op.rule_scores(events.dropna(), op.rule_set(["event_id:event_type"]))
    assert one(op.consistency_attribute(scores))["ConsistencyValue"] == 1.0


def test_sampling_sets_the_confidence(events, metadata):
    config = settings(
        columns=["event_id", *settings().columns],
        dimensions=["Volume", "Accuracy"],
        granularity={"Accuracy": ["attribute", "global"]},
        sample_fraction=0.5,
        sample_key="event_id",
    )
    tables = assess(events, config, NOW)
    assert one(tables["final_quality"])["Confidence"] == 0.5
    assert {r["Confidence"] for r in rows(tables["accuracy_attributes"])} == {0.5}
    report = long_report(tables["final_quality"])
    assert {r["Metric"] for r in rows(report)} == {
        "Volume", "Volume(TotalRows)", "Accuracy_Static_value", "Accuracy_Dynamic_value",
    }
    assert one(mean_confidence(report))["Confidence"] == 0.5


def test_no_global_metric_gives_null_confidence(events):
    config = settings(dimensions=["Volume"], granularity={"Volume": ["value"]})
    tables = assess(events, config, NOW)
    assert set(tables) == {"final_quality", "volume_values"}
    assert one(tables["final_quality"]) == {"Confidence": None}


def test_only_distinctness(events):
    out = one(final_quality(events, settings(dimensions=["Distinctness"], granularity={}), NOW))
    assert set(out) == {"Distinctness", "Confidence"}


def test_levels_without_effect_give_no_table(events):
    config = settings(
        dimensions=["Volume", "Distinctness", "Consistency"],
        granularity={"Volume": ["attribute"], "Distinctness": ["value"], "Consistency": ["global"]},
    )
    assert set(assess(events, config, NOW)) == {"final_quality"}


def test_granularity_defaults_to_global():
    config = settings(granularity={"Volume": [""], "Accuracy": ["value"]})
    assert config.levels("Volume") == {"global"}
    assert config.levels("Precision") == {"global"}
    assert config.levels("Accuracy") == {"value"}
    assert settings(dimensions=["Volume"]).levels("Accuracy") == set()


def test_extended_dataset(events, allowed, tables):
    out = tables["extended_dataset"]
    assert out.columns == [*events.columns, "COMPLETENESS_MISSING", "TIMELINESS_ts", "ASSOCIATION_CONSISTENCY"]
    assert {t for _, t in out.dtypes} == {"string"}
    assert out.count() == events.count()
    users = {r["user_id"] for r in allowed.collect()}
    for row in rows(out):
        user = None if row["user_id"] == "null" else int(row["user_id"])
        assert row["ASSOCIATION_CONSISTENCY"] == ("1.0" if user in users else "0.0")
        missing = (user is None) + (row["event_type"] == "")
        assert float(row["COMPLETENESS_MISSING"]) == pytest.approx(1 - missing / 5)


def test_association_is_kept_unless_lists_changed_or_forced(spark, events, allowed):
    stored = events.withColumn("ASSOCIATION_CONSISTENCY", F.lit("0.25"))

    def found(**changes):
        config = settings(
            dimensions=changes.pop("dimensions", ["Consistency"]), allow_list_names=["a", "b"], **changes
        )
        out = extended_dataset(stored, config, NOW, [allowed])
        return {r["ASSOCIATION_CONSISTENCY"] for r in out.collect()}

    assert found(refreshed_allow_list_names=["b", "a"]) == {"0.25"}
    assert found(refreshed_allow_list_names=["b"]) == {"0.0", "1.0"}
    assert found(refreshed_allow_list_names=["b", "a"], force_consistency=True) == {"0.0", "1.0"}
    assert found(refreshed_allow_list_names=["b", "a"], dimensions=["Consistency-R"]) == {"0.0", "1.0"}
    assert found() == {"0.0", "1.0"}


def test_written_tables(spark, tables, tmp_path):
    wanted = ("final_quality", "volume_values", "extended_dataset", "completeness_frequency_values")
    output = str(tmp_path / "out")
    write_assessment({name: tables[name] for name in wanted}, output)
    for name in wanted:
        back = spark.read.json(f"{output}/{name}")
        assert back.count() == tables[name].count()
        assert set(back.columns) == set(tables[name].columns)
    write_assessment({name: tables[name].limit(0) for name in wanted[1:]}, output)
    for name in wanted[1:]:
        assert spark.read.text(f"{output}/{name}").count() == 0
    write_assessment({name: tables[name] for name in wanted}, output)
    write_assessment({name: tables[name].limit(0) for name in wanted[1:]}, output, mode="keep")
    assert spark.read.text(f"{output}/volume_values").count() == 0
    assert spark.read.text(f"{output}/completeness_frequency_values").count() > 0


def test_random_samples_behind_a_value_table_are_stored(spark, events):
    users = events.select("user_id").distinct()
    config = settings(values={"user_id": users}, sample_fraction=0.5)
    with pytest.raises(ValueError):
        assess(events, config, NOW, stored=False)


@pytest.mark.parametrize(
    "changes",
    [
        {"columns": []},
        {"columns": ["ts", "ts"]},
        {"keys": [["nowhere"]]},
        {"keys": [[]]},
        {"intervals": {"nowhere": [(1, 2)]}},
        {"values": {"nowhere": ["x"]}},
        {"rules": ["user_id:nowhere"]},
        {"rules": ["user_id"]},
        {"interval_width": {"value": 0}},
        {"interval_width": {}},
        {"dimensions": ["Beauty"]},
        {"granularity": {"Volume": ["row"]}},
        {"granularity": {"Beauty": ["global"]}},
        {"volatility_hours": {"ts": -1}},
        {"sample_fraction": 0},
        {"sample_key": "nowhere"},
    ],
)
def test_bad_settings_are_rejected_before_any_job(changes):
    with pytest.raises(ValueError):
        settings(**changes)


def test_blank_volatility_takes_the_default():
    assert settings(volatility_hours={}).time_columns()[0].volatility_hours == 17520.0


def test_stored_rule_on_an_unselected_column_is_rejected(spark, events):
    rules = spark.createDataFrame([("user_id", "nowhere")], "Antecedent string, Consequent string")
    with pytest.raises(ValueError):
        assess(events, settings(dimensions=["Consistency"]), NOW, SourceMetadata(association_rules=rules))


def test_population_needs_the_known_counts(events):
    with pytest.raises(ValueError):
        assess(events, settings(dimensions=["Completeness_Population"]), NOW)
