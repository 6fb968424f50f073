import math

import pytest
from pyspark.sql import functions as F

from gaugeframe import operators as op
from helpers import by, one, raised, rows

NOW = "2020-01-02 00:00:00"


# --- accuracy


def test_accuracy_scores(spark):
    df = spark.createDataFrame([("a", "10"), ("a", "12,5"), ("b", "15"), ("b", "99")], "k string, x string")
    target = [op.AccuracyTarget("x", 10, 10)]
    assert one(op.accuracy_global(df, target)) == {"Accuracy_Static_x": 0.5, "Accuracy_Dynamic_x": 0.375}
    values = op.accuracy_value(df, target, [["k"]])
    assert {k: (r["AccuracyDynamic"], r["AccuracyStatic"]) for k, r in by(values, "Value").items()} == {
        "a": (0.75, 1.0),
        "b": (0.0, 0.0),
    }


def test_attribute_level_is_the_unweighted_mean_of_groups(spark):
    df = spark.createDataFrame([("a", 10.0)] * 3 + [("b", 99.0)], "k string, x double")
    values = op.accuracy_value(df, [op.AccuracyTarget("x", 10, 10)], [["k"]])
    assert one(op.accuracy_attribute(values, 0.5)) == {
        "Column": "x", "Attribute": "k", "AccuracyDynamic": 0.5, "AccuracyStatic": 0.5, "Confidence": 0.5,
    }


def test_keys_with_the_analysed_or_a_timestamp_column_are_skipped(spark):
    df = spark.createDataFrame([("a", 10.0, 5.0, "t")], "k string, x double, y double, ts string")
    targets = [op.AccuracyTarget("x", 10, 10), op.AccuracyTarget("y", 10, 10)]
    values = op.accuracy_value(df, targets, [["k"], ["k", "x"], ["ts"], ["k", "ts"]], timestamps=["ts"])
    assert {(r["Column"], r["Attribute"]) for r in rows(values)} == {("x", "k"), ("y", "k"), ("y", "k_x")}


def test_accuracy_needs_a_width():
    with pytest.raises(ValueError):
        op.AccuracyTarget("x", 1, 0)


# --- precision


def test_precision_with_sign_shift(spark):
    df = spark.createDataFrame([("a", -1.0), ("a", 1.0), ("a", 3.0)], "k string, x double")
    deviation = math.sqrt(8 / 3)
    out = one(op.precision_global(df, ["x"]))
    assert out["Precision_x"] == pytest.approx(1 - deviation / 2)
    assert out["Precision(Deviation)_x"] == pytest.approx(deviation)
    value = one(op.precision_value(df, ["x"], [["k"]]))
    assert value["Mean"] == pytest.approx(1.0)
    assert value["Precision"] == pytest.approx(1 - deviation / 2)


def test_the_shift_comes_from_all_rows(spark):
    df = spark.createDataFrame([("a", -2.0), ("a", -2.0), ("b", 1.0), ("b", 3.0)], "k string, x double")
    values = by(op.precision_value(df, ["x"], [["k"]]), "Value")
    assert values["b"]["Precision"] == pytest.approx(1 - 1 / (2 + 2))
    assert values["a"]["Precision"] is None  # the shifted mean is zero


def test_global_and_group_denominators_differ(spark):
    """|mean| + shift for the whole table, |mean + shift| per group."""
    df = spark.createDataFrame([("a", -4.0), ("a", -2.0), ("a", 3.0)], "k string, x double")
    deviation = one(df.agg(F.stddev_pop("x").alias("s")))["s"]
    assert one(op.precision_global(df, ["x"]))["Precision_x"] == pytest.approx(1 - deviation / (1 + 4))
    assert one(op.precision_value(df, ["x"], [["k"]]))["Precision"] == pytest.approx(max(0, 1 - deviation / (-1 + 4)))


def test_zero_mean_gives_null(spark):
    df = spark.createDataFrame([(0.0,), (0.0,)], "x double")
    assert one(op.precision_global(df, ["x"]))["Precision_x"] is None


# --- completeness


@pytest.fixture
def dirty(spark):
    return spark.createDataFrame(
        [("a", None, "1"), ("a", "", "2"), ("", "x", "nan"), (None, "y", "null"), ("null", "z", "3")],
        "k string, u string, v string",
    )


def test_missing_global(dirty):
    assert one(op.completeness_missing_global(dirty, ["k", "u", "v"]))["Completeness_Missing"] == 8 / 15


def test_missing_attribute(dirty):
    out = by(op.completeness_missing_attribute(dirty, [["k"], ["k", "u"]]), "Attribute")
    assert (out["k"]["MissingValues"], out["k"]["CompletenessMissingValue"]) == (3, 0.4)
    assert (out["k_u"]["MissingValues"], out["k_u"]["CompletenessMissingValue"]) == (0, 1.0)


def test_missing_value(dirty):
    out = by(op.completeness_missing_value(dirty, ["k", "u", "v"], [["k"], ["k", "u"]]), "Attribute", "Value")
    assert set(out) == {("k", "a")} | {("k_u", v) for v in ("a,null", "a,", ",x", "null,y", "null,z")}
    assert (out["k", "a"]["MissingValues"], out["k", "a"]["CompletenessMissingValue"]) == (2, 0.5)
    assert out["k_u", "a,null"]["CompletenessMissingValue"] == 1.0
    assert out["k_u", ",x"]["CompletenessMissingValue"] == 0.0


def test_composite_key_with_three_columns_in_any_order(spark):
    df = spark.createDataFrame([("a", "b", "c", None), ("a", "b", "c", "d")], "p string, q string, r string, s string")
    out = one(op.completeness_missing_value(df, ["p", "q", "r", "s"], [["r", "p", "q"]]))
    assert (out["Value"], out["MissingValues"], out["CompletenessMissingValue"]) == ("c,a,b", 1, 0.5)


def test_null_and_null_text_are_one_key(spark):
    df = spark.createDataFrame([("a", None), ("a", "null")], "k string, u string")
    assert one(op.volume_value(df, df, [["k", "u"]]))["Count"] == 2


def test_row_completeness(dirty):
    assert [r["COMPLETENESS_MISSING"] for r in rows(op.row_completeness(dirty, ["u", "v"]))] == [
        "0.5", "0.5", "0.5", "0.5", "1.0",
    ]


# --- grouping


def test_components_with_commas_do_not_merge(spark):
    df = spark.createDataFrame([("a,b", "c"), ("a", "b,c")], "x string, y string")
    out = rows(op.volume_value(df, df, [["x", "y"]]))
    assert [(r["Value"], r["Count"]) for r in out] == [("a,b,c", 1), ("a,b,c", 1)]
    assert one(op.distinctness_attribute(df, [["x", "y"]]))["DistinctCount"] == 2


def test_two_keys_over_the_same_columns(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "x string, n int")
    out = by(op.volume_value(df, df, [["x", "n"], ["n", "x"], ["x"]]), "Attribute", "Value")
    assert {k: r["Count"] for k, r in out.items()} == {
        ("x_n", "a,1"): 2, ("x_n", "b,2"): 1, ("n_x", "1,a"): 2, ("n_x", "2,b"): 1, ("x", "a"): 2, ("x", "b"): 1,
    }


def test_keys_apart_give_the_same_groups(table):
    lines = table("lineitem")
    keys = [["l_returnflag"], ["l_orderkey", "l_returnflag"], ["l_suppkey"]]

    def found(**options):
        return by(op.volume_value(lines, lines, keys, **options), "Attribute", "Value")

    together = found()
    assert found(apart=[1]) == together and found(apart=[0, 1, 2]) == together
    rules = op.rule_set(["l_returnflag:l_linestatus", "l_orderkey:l_returnflag"])

    def scores(apart):
        return by(op.rule_scores(lines, rules, apart), "rule", "AntecedentValue")

    assert scores([1]) == scores([]) and scores([0, 1]) == scores([])


def test_keys_with_one_label_are_rejected(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, a_b int")
    with pytest.raises(ValueError):
        op.volume_value(df, df, [["a", "b"], ["a_b"]])


# --- timeliness


def test_timeliness_clamps_after_aggregation(spark):
    df = spark.createDataFrame(
        [
            ("a", "2020-01-01 12:00:00"),
            ("a", "2019-12-31 00:00:00"),
            ("b", "2019-12-01 00:00:00"),
            ("c", "2020-01-03 00:00:00"),
        ],
        "k string, t string",
    )
    spec = [op.TimeColumn("t", 24, "%Y-%m-%d %H:%M:%S")]
    signed = op.timeliness_groups(df, spec, [["k"], ["t"]], NOW)
    values = by(op.timeliness_value(signed), "Value")
    assert {k: (r["TimelinessMean"], r["TimelinessMax"], r["TimelinessMin"]) for k, r in values.items()} == {
        "a": (0.0, 0.5, 0.0), "b": (0.0, 0.0, 0.0), "c": (2.0, 2.0, 2.0),
    }
    attribute = one(op.timeliness_attribute(signed))
    assert (attribute["TimelinessMean"], attribute["TimelinessMax"], attribute["TimelinessMin"]) == (0.0, 2.0, 0.0)
    assert attribute["AnalysisTime"] == NOW
    whole = one(op.timeliness_global(df, spec, NOW))
    assert whole["Timeliness_Max_t"] == 2.0 and whole["Last_Analysis_Timestamp_t"] == NOW
    per_row = [float(r["TIMELINESS_t"]) for r in rows(op.timeliness_tuple(df, spec, NOW))]
    assert per_row == [0.5, 0.0, 0.0, 2.0]


def test_each_timestamp_has_its_own_volatility(spark):
    df = spark.createDataFrame([("2020-01-01 12:00:00", "2020-01-01 12:00:00")], "t_one string, t_two string")
    fmt = "%Y-%m-%d %H:%M:%S"
    out = one(op.timeliness_tuple(df, [op.TimeColumn("t_one", 24, fmt), op.TimeColumn("t_two", 48, fmt)], NOW))
    assert (out["TIMELINESS_t_one"], out["TIMELINESS_t_two"]) == ("0.5", "0.75")


# --- frequency


@pytest.fixture
def visits(spark):
    texts = [("a", f"2020-01-0{d} 0{h}:00:00") for d in (1, 2) for h in (1, 2, 3)] + [("b", "2020-01-01 01:30:00")]
    df = spark.createDataFrame(texts, "k string, t string")
    return df.select("k", F.col("t").cast("timestamp_ntz").alias("t"))


def test_same_data_and_rates_give_one(visits):
    counts = op.hour_counts(visits, "t")
    hours = op.frequency_hour(counts, op.update_rate_global(counts))
    assert {r["Hour"]: r["CompletenessFrequency"] for r in rows(hours)} == {1: 1.0, 2: 1.0, 3: 1.0}
    assert one(op.frequency_global(hours, "t")) == {"Completeness_Frequency_t": 1.0}


def test_hours_without_a_rate_vanish_and_samples_expect_less(spark, visits):
    rates = spark.createDataFrame([(1, 4 / 7200), (2, 2 / 7200)], "Hour int, Frequency double")
    out = by(op.frequency_hour(op.hour_counts(visits, "t"), rates), "Hour")
    assert {h: r["CompletenessFrequency"] for h, r in out.items()} == {1: pytest.approx(0.75), 2: pytest.approx(1.0)}
    half = by(op.frequency_hour(op.hour_counts(visits, "t"), rates, 0.5), "Hour")
    assert half[1]["CompletenessFrequency"] == 1.0


def test_frequency_per_value(spark, visits):
    rates = spark.createDataFrame(
        [("k", "a", 1, 0.0001), ("k", "a", 2, 0.0003), ("k", "b", 1, 0.1), ("other", "a", 3, 9.0)],
        "Key string, Value string, Hour int, Frequency double",
    )
    groups = op.frequency_groups(op.value_hour_counts(visits, "t", [["k"], ["t"]]), rates)
    kept = one(op.frequency_value(groups))
    elapsed = 25 * 3600
    assert (kept["Value"], kept["RecordNumber"]) == ("a", 4)
    assert kept["CompletenessFrequencyValue"] == pytest.approx(4 / (elapsed * 0.0002))
    attribute = one(op.frequency_attribute(groups))
    assert attribute["RecordNumber"] == 4


def test_no_kept_value_gives_zeros(spark, visits):
    rates = spark.createDataFrame([("k", "b", 1, 0.1)], "Key string, Value string, Hour int, Frequency double")
    groups = op.frequency_groups(op.value_hour_counts(visits, "t", [["k"]]), rates)
    assert op.frequency_value(groups).count() == 0
    out = one(op.frequency_attribute(groups))
    assert (out["RecordNumber"], out["CompletenessFrequencyValue"]) == (0, 0.0)


# --- volume, distinctness, population


def test_volume(spark):
    source = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "k string")
    seen = source.filter("k <> 'c'")
    assert one(op.volume_global(seen, source)) == {"Volume": 0.75, "Volume(TotalRows)": 3}
    out = by(op.volume_value(seen, source, [["k"]]), "Value")
    assert {k: (r["Count"], r["VolumeValue"]) for k, r in out.items()} == {"a": (2, 0.5), "b": (1, 0.25)}


def test_duplicate_mass(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("b", 1), ("c", 1), ("c", 1), ("c", 1)], "x string, y int")
    assert one(op.distinctness_global(df, ["x", "y"]))["Distinctness"] == 0.75


def test_distinctness_per_key(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 2)], "x string, y int")
    out = by(op.distinctness_attribute(df, [["x"], ["x", "y"]], confidence=0.5), "Attribute")
    assert {k: (r["DistinctCount"], r["Distinctness"]) for k, r in out.items()} == {"x": (2, 0.5), "x_y": (3, 0.75)}


def test_population(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "x string, y int")
    known = spark.createDataFrame([("x", 8), ("y", 1)], "Attribute string, Count bigint")
    out = by(op.completeness_population(df, known, [["x"], ["y"], ["x", "y"]]), "Attribute")
    assert {k: (r["DistinctCount"], r["CompletenessPopulationValue"]) for k, r in out.items()} == {
        "x": (2, 0.25), "y": (2, 1.0),
    }


def test_population_of_the_source_itself_is_one(table):
    orders = table("orders")
    known = op.source_distinctness(orders, ["o_custkey", "o_orderstatus"])
    out = rows(op.completeness_population(orders, known, [["o_custkey"], ["o_orderstatus"]]))
    assert [r["CompletenessPopulationValue"] for r in out] == [1.0, 1.0]


def test_source_distinctness_ignores_nulls(spark):
    df = spark.createDataFrame([("a", None), ("a", None), (None, None)], "x string, y int")
    assert {r["Attribute"]: r["Count"] for r in rows(op.source_distinctness(df))} == {"x": 1, "y": 0}


# --- consistency


def test_rule_scores(spark):
    df = spark.createDataFrame(
        [("a", 1, "u"), ("a", 1, "u"), ("a", 2, "u"), ("b", 3, "u")], "x string, y int, z string"
    )
    rules = op.rule_set(["x:y", "", "x,z:y"], stored=[("y", "x")])
    scores = op.rule_scores(df, rules)
    out = {(r["Rule"], r["AntecedentValue"]): r["ConsistencyValue"] for r in rows(op.consistency_value(scores))}
    assert out == {
        ("x -> y", "a"): 2 / 3, ("x -> y", "b"): 1.0,
        ("x,z -> y", "a,u"): 2 / 3, ("x,z -> y", "b,u"): 1.0,
        ("y -> x", "1"): 1.0, ("y -> x", "2"): 1.0, ("y -> x", "3"): 1.0,
    }
    means = by(op.consistency_attribute(scores, 0.5), "RuleAntecedent")
    assert means["x"]["ConsistencyValue"] == pytest.approx(5 / 6)
    assert means["y"]["ConsistencyValue"] == 1.0 and means["y"]["Confidence"] == 0.5


def test_repeated_rules_are_reported_twice(spark):
    df = spark.createDataFrame([("a", 1)], "x string, y int")
    scores = op.rule_scores(df, op.rule_set(["x:y"], stored=["x:y"]))
    assert op.consistency_value(scores).count() == 2 and op.consistency_attribute(scores).count() == 2


def test_rule_texts():
    assert op.parse_rule("a, b:c") == (("a", "b"), ("c",))
    assert op.parse_rule("  ") is None
    for bad in ("a", "a:", ":b"):
        with pytest.raises(ValueError):
            op.parse_rule(bad)


def test_rule_table_union(spark):
    stored = spark.createDataFrame([("a", "b")], "Antecedent string, Consequent string")
    assert op.rule_table(None) is None
    assert op.rule_table(stored, stored).count() == 2


def test_association_consistency(spark):
    df = spark.createDataFrame([(1, "a", 10), (2, "b", 10), (3, None, 20), (4, "a", 99)], "id int, x string, y int")
    pairs = spark.createDataFrame([("a", "10"), ("a", "10"), (None, "20")], "x string, y string")
    singles = spark.createDataFrame([("20",), ("99",)], "y string")
    foreign = spark.createDataFrame([("q",)], "elsewhere string")
    out = by(op.association_consistency(df, [pairs, singles, foreign], ["x", "y"]), "id")
    assert {k: r["ASSOCIATION_CONSISTENCY"] for k, r in out.items()} == {1: "0.5", 2: "0.0", 3: "1.0", 4: "0.5"}
    assert op.association_consistency(df, [foreign], ["x", "y"]) is df


def test_stored_association_column_is_replaced_in_place(spark):
    df = spark.createDataFrame([("old", "a")], "ASSOCIATION_CONSISTENCY string, x string")
    allowed = spark.createDataFrame([("a",)], "x string")
    out = op.association_consistency(df, [allowed], ["x"])
    assert out.columns == df.columns and one(out)["ASSOCIATION_CONSISTENCY"] == "1.0"


def test_bad_numbers_fail_or_are_skipped(spark):
    df = spark.createDataFrame([("10",), ("ten",)], "x string")
    target = [op.AccuracyTarget("x", 10, 10)]
    raised(lambda: op.accuracy_global(df, target).collect(), "CAST_INVALID_INPUT")
    assert one(op.accuracy_global(df, target, "skip"))["Accuracy_Static_x"] == 1.0


def test_rates_of_values_with_commas(spark):
    """Two values show one text; each meets its own rate, and no record counts twice."""
    times = ["2024-01-01 08:00:00", "2024-01-01 08:30:00"]
    data = [(t, a, c) for t in times for a, c in (("x,b", "c"), ("x", "b,c"))]
    df = spark.createDataFrame(data, "t string, a string, c string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    counts = op.value_hour_counts(df, "t", [["a", "c"]])
    out = op.frequency_groups(counts, op.update_rate_values(counts)).collect()
    assert [(r["Value"], r["RecordNumber"]) for r in out] == [("x,b,c", 2)] * 2
    shown = op.update_rate_values(counts).drop("Parts")
    raised(lambda: op.frequency_groups(counts, shown).collect(), "two rates for one key value and hour")
    raised(lambda: op.frequency_groups(counts, shown.dropDuplicates(["Value"])).collect(), "one display text")
