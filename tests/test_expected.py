"""Known values on the sf0.01 tables, computed from the definitions beforehand."""

import pytest
from pyspark.sql import functions as F

from gaugeframe import operators as op
from helpers import by, one

NOW = "2024-02-01 00:00:00"
FLAGS = ["l_returnflag", "l_linestatus"]


@pytest.fixture(scope="module")
def big(spark):
    return lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")


def near(value):
    return pytest.approx(value, abs=6e-7)


def test_accuracy(big):
    lines, target = big("lineitem"), [op.AccuracyTarget("l_quantity", 25, 40)]
    assert one(op.accuracy_global(lines, target)) == {
        "Accuracy_Dynamic_l_quantity": near(0.399455),
        "Accuracy_Static_l_quantity": near(0.780817),
    }
    attribute = one(op.accuracy_attribute(op.accuracy_value(lines, target, [FLAGS])))
    assert attribute["AccuracyDynamic"] == near(0.399454)


def test_precision(big):
    values = by(op.precision_value(big("lineitem"), ["l_extendedprice"], [FLAGS[:1]]), "Value")
    assert {k: r["Precision"] for k, r in values.items()} == {
        "A": near(0.432509), "N": near(0.434698), "R": near(0.431773),
    }
    customer = big("customer")
    whole = one(op.precision_global(customer, ["c_acctbal"]))
    assert whole["Precision_c_acctbal"] == near(0.415925)
    assert whole["Precision(Deviation)_c_acctbal"] == near(3206.575522)
    cars = by(op.precision_value(customer, ["c_acctbal"], [["c_mktsegment"]]), "Value")["AUTOMOBILE"]
    assert (cars["Mean"], cars["Precision"]) == (near(4784.744362), near(0.445321))


def test_missing(big):
    dirty = big("orders").selectExpr(
        "o_orderkey",
        "o_custkey",
        "CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END AS o_orderstatus",
        "CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS o_orderpriority",
    )
    assert one(op.completeness_missing_global(dirty, dirty.columns))["Completeness_Missing"] == near(0.865267)
    values = by(op.completeness_missing_value(dirty, dirty.columns, [["o_orderstatus"]]), "Value")
    assert {k: r["MissingValues"] for k, r in values.items()} == {"F": 967, "O": 1008}


def test_timeliness(big):
    events, times = big("events"), [op.TimeColumn("ts", 720.0)]
    whole = one(op.timeliness_global(events, times, NOW))
    assert [whole[f"Timeliness_{s}_ts"] for s in ("Mean", "Max", "Min")] == [near(0.466182), near(0.966602), 0.0]
    attribute = one(op.timeliness_attribute(op.timeliness_groups(events, times, [["event_type"]], NOW)))
    assert attribute["TimelinessMean"] == near(0.466177)


def test_frequency(big):
    events = big("events")
    seen = events.filter("event_id % 3 <> 0")
    rates = op.update_rate_global(op.hour_counts(events, "ts"))
    hours = op.frequency_hour(op.hour_counts(seen, "ts"), rates)
    assert hours.count() == 24
    assert one(op.frequency_global(hours, "ts"))["Completeness_Frequency_ts"] == near(0.666579)
    same = op.frequency_hour(op.hour_counts(events, "ts"), rates)
    assert one(op.frequency_global(same, "ts"))["Completeness_Frequency_ts"] == 1.0
    keys = [["event_type"]]
    rates = op.update_rate_values(op.value_hour_counts(events, "ts", keys))
    attribute = one(op.frequency_attribute(op.frequency_groups(op.value_hour_counts(seen, "ts", keys), rates)))
    assert (attribute["RecordNumber"], attribute["CompletenessFrequencyValue"]) == (6666, near(0.664550))


def test_volume_distinctness_population(big):
    orders, part = big("orders"), big("part")
    placed = op.filter_values(orders, {"o_orderstatus": ["O", "F"]})
    assert one(op.volume_global(placed, orders)) == {"Volume": near(0.6608), "Volume(TotalRows)": 9912}
    assert one(op.distinctness_global(part, ["p_name", "p_brand"]))["Distinctness"] == near(0.822)
    assert one(op.distinctness_global(big("lineitem"), ["l_partkey", "l_suppkey"]))["Distinctness"] == near(0.981675)
    keys = [["p_name", "p_brand"], ["p_brand"]]
    shares = {k: r["Distinctness"] for k, r in by(op.distinctness_attribute(part, keys), "Attribute").items()}
    assert shares == {"p_name_p_brand": near(0.565), "p_brand": near(0.0125)}
    known = op.source_distinctness(orders, ["o_custkey"])
    early = orders.filter("o_orderstatus = 'O' AND o_orderkey < 3000")
    population = one(op.completeness_population(early, known, [["o_custkey"]]))
    assert population["CompletenessPopulationValue"] == near(0.476)


def test_consistency(big):
    scores = op.rule_scores(big("part"), op.rule_set(["p_brand:p_type"]))
    assert one(op.consistency_attribute(scores))["ConsistencyValue"] == near(0.233384)
    scores = op.rule_scores(big("lineitem"), op.rule_set(["l_returnflag:l_linestatus"]))
    values = by(op.consistency_value(scores), "AntecedentValue")
    assert {k: r["ConsistencyValue"] for k, r in values.items()} == {
        "A": near(0.500549), "N": near(0.501957), "R": near(0.500698),
    }
    customer = big("customer")
    lists = [
        customer.filter("c_custkey % 3 = 0 AND c_custkey < 300").select("c_nationkey", "c_mktsegment"),
        big("nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey")),
    ]
    marked = op.association_consistency(customer, lists, ["c_nationkey", "c_mktsegment"])
    out = one(marked.agg(F.avg(F.col("ASSOCIATION_CONSISTENCY").cast("double")).alias("m"), F.count("*").alias("n")))
    assert (out["m"], out["n"]) == (near(0.600333), 1500)


def test_selection(big):
    orders = big("orders")
    assert op.filter_intervals(orders, {"o_custkey": [("100", "20")]}).count() == 6082
    assert op.filter_intervals(orders, {"o_custkey": [(100, 200)]}, "typed").count() == 952
    assert op.sample_by_key(orders, "o_orderkey", 0.25).count() == 3803
