"""Plans: native expressions only, few scans, pushed filters, skew handled."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from gaugeframe import AssessmentConfig, assess
from gaugeframe import operators as op
from helpers import plan_of, rows

# The optional subpackage tests its own queries.
QUERIES = {name: q for name, q in driver.queries().items() if not re.match(r"op\d+_|pipeline$", name)}

# Scans of the table being assessed, where it is not one.
SCANS = {
    # the key that grows with the data has its own scan
    "accuracy_value": 2,
    "accuracy_attribute": 2,
    "timeliness_value": 2,
    "timeliness_attribute": 2,
    "update_rate_values": 2,
    # one more scan reads the analysed columns only, for their extremes; both branches of
    # the union show this subquery, which has one id and runs once
    "precision_value": 4,
    "precision_attribute": 4,
    "precision_shift_value": 2,
    "precision_shift_attribute": 2,
    # the second scan is the row count, or the rates
    "volume_global": 2,
    "volume_value": 2,
    "long_report": 2,
    "mean_confidence": 2,
    "completeness_frequency_hour": 2,
    "completeness_frequency_global": 2,
    "completeness_frequency_value": 4,
    "completeness_frequency_attribute": 4,
    "completeness_population": 2,
    # allow-lists and value lists come from tables
    "association_consistency_tuple": 4,
    "select_values_table": 3,
    "extended_dataset": 2,
    # totals, row count, duplicates, hours and rates
    "final_quality": 5,
    "final_quality_dirty": 3,
    "completeness_frequency_commas": 2,
    "allow_list_numbers": 1,
    "read_allow_lists": 3,
    "extended_sink": 1,
}


STORED = {"assessed_values", "assessed_attributes", "assessed_distinctness", "mixed_confidence", "sample_bernoulli_facts"}


def scans(plan):
    return len(re.findall(r"FileScan ", plan))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_is_native(spark, small, name):
    df = QUERIES[name](spark, small)
    plan = plan_of(df)
    for bad in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin", "Window", "ObjectHashAggregate", "ExternalRDD"):
        assert bad not in plan, bad
    if name not in STORED:  # they read stored tables
        assert scans(plan) == SCANS.get(name, 1)


def test_entry_and_sql_cover_the_queries(spark):
    own = {name for name in driver.oracle_sql() if not re.match(r"op\d+_|pipeline$", name)}
    assert own == set(QUERIES) - {"sample_bernoulli"}
    assert len(rows(driver.entry(spark))) == 1


def test_hot_keys_collapse_before_the_shuffle(spark):
    """A third of the rows share a key; each map task sends one partial row for it."""
    df = spark.range(0, 300_000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 1000).alias("k"), (F.col("id") % 7).alias("x")
    )
    out = op.accuracy_value(df, [op.AccuracyTarget("x", 3, 6)], [["k"], ["k", "x"]][:1])
    out.collect()
    plan = plan_of(out)
    assert plan.index("partial_avg") > plan.index("Exchange")
    assert out.count() == df.select("k").distinct().count()


def test_a_dominant_binding_is_split(spark, tmp_path):
    """Beyond the broadcast threshold the source is shuffled and its hot binding split."""
    path = str(tmp_path / "hot")
    (
        spark.range(0, 400_000, 1, 8)
        .select(
            "id",
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5000)).alias("k"),
            F.sha2(F.col("id").cast("string"), 256).alias("payload"),
        )
        .write.parquet(path)
    )
    source = spark.read.parquet(path)
    allowed = source.filter("k = 'hot' OR id % 2 = 0").select("k")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1MB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1MB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    previous = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        out = op.association_consistency(source, [allowed], ["k"])
        found = {(r["k"] == "hot", r["ASSOCIATION_CONSISTENCY"]) for r in out.collect()}
        plan = plan_of(out)
    finally:
        for name, value in previous.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
    assert (True, "1.0") in found and (True, "0.0") not in found
    assert out.count() == 400_000
    assert "isFinalPlan=true" in plan and "SortMergeJoin(skew=true)" in plan


def test_stored_aggregates_replace_the_source(spark, table):
    """Published tables of a stored assessment read the shared folder, not the source."""
    config = AssessmentConfig(
        columns=["l_quantity", "l_returnflag", "l_linestatus"],
        keys=[["l_returnflag"], ["l_linestatus"]],
        dimensions=["Accuracy", "Precision", "Distinctness", "Consistency"],
        granularity={n: ["value", "attribute"] for n in ("Accuracy", "Precision", "Distinctness", "Consistency")},
        expected_mean={"l_quantity": 25},
        interval_width={"l_quantity": 40},
        rules=["l_returnflag:l_linestatus"],
    )
    tables = assess(table("lineitem"), config, driver.NOW)
    for name, df in tables.items():
        assert "lineitem.parquet" not in plan_of(df), name
