import datetime as dt

import pytest
from pyspark.sql import functions as F

from gaugeframe import functions as fx
from helpers import one, raised, rows


def test_missing_tokens(spark):
    df = spark.createDataFrame([(t,) for t in (None, "", "nan", "null", "NaN", "x")], "t string")
    flags = [r["m"] for r in rows(df.select(fx.is_missing(df, "t").alias("m")))]
    assert flags == [True, True, True, True, False, False]


def test_typed_cells_are_missing_only_when_null(spark):
    df = spark.createDataFrame([(1.5,), (None,), (float("nan"),)], "x double")
    assert [r["m"] for r in rows(df.select(fx.is_missing(df, "x").alias("m")))] == [False, True, False]


def test_key_text_keeps_nulls_and_order(spark):
    df = spark.createDataFrame([("a", None, 3)], "x string, y string, z int")
    assert one(df.select(fx.key_text(["z", "x", "y"]).alias("k")))["k"] == "3,a,null"


def test_column_names_with_dots_and_parentheses(spark):
    df = spark.createDataFrame([("1,5",)], ["a.b(c)"])
    assert one(df.select(fx.to_number(df, "a.b(c)").alias("x")))["x"] == 1.5


def test_to_number(spark):
    df = spark.createDataFrame([("1,5",), (" 2.25 ",), (None,)], "t string")
    assert [r["x"] for r in rows(df.select(fx.to_number(df, "t").alias("x")))] == [1.5, 2.25, None]
    bad = spark.createDataFrame([("oops",)], "t string")
    assert one(bad.select(fx.to_number(bad, "t", "skip").alias("x")))["x"] is None
    raised(lambda: bad.select(fx.to_number(bad, "t")).collect(), "CAST_INVALID_INPUT")
    with pytest.raises(ValueError):
        fx.to_number(bad, "t", "ignore")


def test_clamps(spark):
    df = spark.createDataFrame([(-1.0,), (0.5,), (2.0,), (float("nan"),), (None,)], "x double")
    out = rows(df.select(fx.at_least_zero(F.col("x")).alias("lo"), fx.at_most_one(F.col("x")).alias("hi")))
    assert [r["lo"] for r in out] == [0.0, 0.5, 2.0, 0.0, None]
    assert [r["hi"] for r in out][:3] == [-1.0, 0.5, 1.0] and out[4]["hi"] is None


def test_line_cleaning(spark):
    df = spark.createDataFrame([('a"b\\c 1,5 x,y 1,2,3',)], "t string")
    out = one(
        df.select(
            fx.strip_quotes(F.col("t")).alias("q"),
            fx.strip_backslashes(F.col("t")).alias("b"),
            fx.decimal_commas_to_dots(F.col("t")).alias("d"),
        )
    )
    assert out["q"] == "ab\\c 1,5 x,y 1,2,3"
    assert out["b"] == 'a"bc 1,5 x,y 1,2,3'
    assert out["d"] == 'a"b\\c 1.5 x,y 1.2,3'


@pytest.mark.parametrize(
    "fmt, strict, lenient",
    [
        ("%d/%m/%y %H:%M:%S,%f", "dd/MM/yy HH:mm:ss,SSSSSS", "d/M/yy H:m:s,SSSSSS"),
        ("%Y%m%dT%H%M%S", "yyyyMMdd'T'HHmmss", "yyyyMMdd'T'HHmmss"),
        ("%Y-%m-%d at 100%%", "yyyy-MM-dd 'a''t' 100%", "yyyy-M-d 'a''t' 100%"),
    ],
)
def test_patterns(fmt, strict, lenient):
    assert fx.spark_pattern(fmt) == strict
    assert fx.spark_pattern(fmt, lenient=True) == lenient


def test_unknown_directive():
    with pytest.raises(ValueError):
        fx.spark_pattern("%Q")


def test_two_digit_year_pivot(spark):
    df = spark.createDataFrame([("01/01/99",), ("1/1/68",), ("1/1/69",)], "t string")
    years = [r["y"] for r in rows(df.select(F.year(fx.to_instant(df, "t", "%d/%m/%y")).alias("y")))]
    assert years == [1999, 2068, 1969]


def test_instants_agree_with_strptime(spark):
    fmt, texts = "%d/%m/%y %H:%M:%S,%f", ["02/05/17 17:26:30,000000", "1/12/70 1:02:03,5", "29/02/72 00:00:00,000001"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["i"] for r in rows(df.select(fx.to_instant(df, "t", fmt).alias("i")))]
    assert got == [dt.datetime.strptime(t, fmt) for t in texts]


def test_bad_instants(spark):
    bad = spark.createDataFrame([("soon",)], "t string")
    assert one(bad.select(fx.to_instant(bad, "t", "%Y-%m-%d", "skip").alias("i")))["i"] is None
    raised(lambda: bad.select(fx.to_instant(bad, "t", "%Y-%m-%d")).collect(), "CANNOT_PARSE_TIMESTAMP")
    with pytest.raises(ValueError):
        fx.to_instant(bad, "t")


def test_ages_do_not_depend_on_the_session_zone(spark):
    """The interval holds a clock change in New York."""
    df = spark.createDataFrame([("2024-03-09 12:00:00.25",)], "t string")
    age = fx.seconds_between(F.col("t").cast("timestamp_ntz"), fx.instant_literal("2024-03-11 12:00:00"))
    previous = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert one(df.select(age.alias("s")))["s"] == 2 * 86400 - 0.25
    finally:
        spark.conf.set("spark.sql.session.timeZone", previous)


def test_format_instant(spark):
    now = fx.instant_literal(dt.datetime(2018, 4, 3, 14, 42, 17, 844845))
    text = one(spark.range(1).select(fx.format_instant(now, "%d/%m/%y %H:%M:%S,%f").alias("t")))["t"]
    assert text == "03/04/18 14:42:17,844845"
