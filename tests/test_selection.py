import datetime as dt

import pytest
from pyspark.sql import functions as F

from gaugeframe import operators as op
from helpers import plan_of, raised, rows


@pytest.fixture
def people(spark):
    return spark.createDataFrame(
        [(1, "9", 10.0), (2, "10", 20.0), (3, "100", 30.0), (4, None, 40.0), (5, "20", None)],
        "id int, code string, amount double",
    )


def ids(df):
    return [r["id"] for r in rows(df, "id")]


def test_text_bounds_are_lexicographic(people):
    assert ids(op.filter_intervals(people, {"code": [("10", "20")]})) == [2, 3, 5]


def test_typed_bounds(people):
    assert ids(op.filter_intervals(people, {"amount": [(10, 20)]}, "typed")) == [1, 2]


def test_open_bounds_drop_nulls(people):
    assert ids(op.filter_intervals(people, {"amount": [(20, None)]}, "typed")) == [2, 3, 4]
    assert ids(op.filter_intervals(people, {"amount": [("", 20)]}, {"amount": "typed"})) == [1, 2]


def test_overlapping_intervals_do_not_repeat_rows(people):
    assert ids(op.filter_intervals(people, {"amount": [(10, 30), (20, 40)]}, "typed")) == [1, 2, 3, 4]


def test_constraints_on_two_columns_are_a_conjunction(people):
    assert ids(op.filter_intervals(people, {"amount": [(20, 40)], "code": [("1", "2")]}, {"amount": "typed"})) == [2, 3]


def test_an_empty_selection_stays_empty(people):
    assert ids(op.filter_intervals(people, {"amount": [(900, 901)]}, "typed")) == []


def test_timestamp_bounds(spark):
    df = spark.createDataFrame(
        [(1, "01/02/20 10:00:00"), (2, "02/02/20 10:00:00"), (3, "03/02/20 10:00:00")], "id int, t string"
    )
    spec = {"t": "%d/%m/%y %H:%M:%S"}
    kept = op.filter_intervals(df, {"t": [("02/02/2020 10.00.00", "")]}, timestamps=spec)
    assert ids(kept) == [2, 3]
    until = op.filter_intervals(df, {"t": [(None, dt.datetime(2020, 2, 1, 12))]}, timestamps=spec)
    assert ids(until) == [1]


def test_value_lists(spark, people):
    assert ids(op.filter_values(people, {"code": ["10", "20"]})) == [2, 5]
    assert ids(op.filter_values(people, {"code": ["10", "20"], "id": [2]})) == [2]
    assert ids(op.filter_values(people, {"code": []})) == [1, 2, 3, 4, 5]
    wanted = spark.createDataFrame([("10",), ("10",), (None,)], "c string")
    assert ids(op.filter_values(people, {"code": wanted})) == [2]


def test_filters_reach_the_scan(table):
    kept = op.select_rows(
        table("lineitem"),
        ["l_quantity", "l_returnflag", "l_shipdate"],
        {"l_quantity": [(1, 5)], "l_shipdate": [("01/01/1999 00.00.00", "")]},
        {"l_returnflag": ["A"]},
        {"l_quantity": "typed"},
        {"l_shipdate": None},
    )
    plan = plan_of(kept)
    pushed = plan.split("PushedFilters")[1]
    assert "GreaterThanOrEqual(l_quantity,1.0)" in pushed and "l_returnflag" in pushed and "l_shipdate" in pushed
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string,l_shipdate:timestamp_ntz>" in plan
    assert "Exchange" not in plan


def test_null_handling(spark):
    df = spark.createDataFrame([("a", 1), ("", None), ("null", 2), (None, 3)], "t string, n int")
    assert [r["t"] for r in rows(op.drop_incomplete(df))] == ["a", "null"]
    assert rows(op.null_to_text(df))[1] == {"t": "", "n": "null"}


def test_samples(table):
    orders = table("orders")
    assert op.sample_rows(orders, 1.0) is orders
    one, two = (op.sample_rows(orders, 0.3, 5).count() for _ in range(2))
    assert one == two and 0 < one < orders.count()
    kept = op.sample_by_key(orders, "o_orderkey", 0.25)
    assert kept.count() == 394
    shuffled = op.sample_by_key(orders.repartition(3, F.col("o_custkey")), "o_orderkey", 0.25)
    assert shuffled.exceptAll(kept).count() == 0
    for bad in (0, -1, 1.5):
        with pytest.raises(ValueError):
            op.sample_rows(orders, bad)


def test_small_fractions_keep_their_share(spark):
    """A fraction far below 1/10,000 of ten million keys; five standard errors are 50 rows."""
    keys = spark.range(0, 10_000_000, 1, 8).select(F.col("id").alias("k"))
    assert 50 <= op.sample_by_key(keys, "k", 1e-5).count() <= 150
    assert op.sample_by_key(keys, "k", 0.99996).count() < 10_000_000


def test_times_that_are_none(spark):
    df = spark.createDataFrame([(1, "2024-01-02"), (2, "junk"), (3, None), (4, "2023-12-31")], "n int, t string")
    call = lambda policy: op.filter_intervals(
        df, {"t": [("01/01/2024 00.00.00", "")]}, timestamps={"t": "%Y-%m-%d"}, on_invalid=policy
    )
    assert [r["n"] for r in call("skip").collect()] == [1]
    raised(lambda: call("fail").collect(), "CANNOT_PARSE_TIMESTAMP")
