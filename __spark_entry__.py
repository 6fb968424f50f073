"""

Every query runs over whole tables. Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gaugeframe import operators as op  # noqa: E402
from gaugeframe import plans, sources  # noqa: E402
from gaugeframe.functions import column  # noqa: E402

NOW = "2024-02-01 00:00:00"
SHIP_NOW = "2002-01-01 00:00:00"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder among the stored tables of the session."""
    return f"{sources.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _six_places(x: Column) -> Column:
    """Half away from zero on the scaled double, the arithmetic of the SQL side's round.

    (Spark's own round works on the decimal text, so it breaks ties such as 333/640
    differently.)
    """
    return F.signum(x) * F.floor(F.abs(x) * 1e6 + 0.5) / 1e6


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places; other columns unchanged."""
    return df.select(
        *[
            _six_places(column(name)).alias(name) if kind == "double" else column(name)
            for name, kind in df.dtypes
        ]
    )


# --- inputs of the queries ---------------------------------------------------------

ACCURACY = [op.AccuracyTarget("l_quantity", 25, 40), op.AccuracyTarget("l_discount", 0.05, 0.06)]
LINE_COLUMNS = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate"]
LINE_KEYS = [["l_returnflag"], ["l_returnflag", "l_linestatus"], ["l_suppkey"]]
LINE_APART = [2]  # suppliers grow with the data, flags do not: a scan of their own
CUSTOMER_KEYS = [["c_mktsegment"], ["c_nationkey"]]
DIRTY_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
DIRTY_KEYS = [["o_orderstatus"], ["o_orderpriority"], ["o_orderpriority", "o_orderstatus"]]
ORDER_KEYS = [["o_orderstatus"], ["o_orderpriority", "o_orderstatus"]]
EVENT_KEYS = [["event_type"], ["user_id"]]
EVENT_APART = [1]  # likewise users
EVENT_TIMES = [op.TimeColumn("ts", 720.0)]
PART_COLUMNS = ["p_name", "p_brand"]
PART_RULES = op.rule_set(["p_brand:p_type", "p_type:p_brand", "p_brand,p_type:p_size", ""])


def _dirty_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with empty and NULL cells."""
    return _table(spark, folder, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("o_orderpriority"),
    )


DIRTY = """dirty AS (
  SELECT o_orderkey, o_custkey,
         CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END AS o_orderstatus,
         CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS o_orderpriority
  FROM orders)"""


def _valued(events: DataFrame) -> DataFrame:
    """Events after an interval selection on the measured value."""
    return op.filter_intervals(events, {"value": [(20, 400)]}, "typed")


def _placed(orders: DataFrame) -> DataFrame:
    return op.filter_values(orders, {"o_orderstatus": ["O", "F"]})


def _catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """An update catalogue: a source is analysed when at most 4% of its texts are short."""
    mostly_long = F.count_if(F.col("n_chars") < 200) * 25 <= F.count(F.lit(1))
    return (
        _table(spark, folder, "documents")
        .groupBy(F.col("source").alias("fileName"))
        .agg(F.when(mostly_long, 1).otherwise(0).alias("correctAnalysis"))
    )


ORDER_FIELDS = ["orderkey", "custkey", "status", "price"]
ORDER_REGEX = r"([^;]+);"


def _order_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as quoted, backslash-escaped text lines with decimal commas."""
    cents = (F.col("o_totalprice") * 100).cast("bigint")
    whole = ((cents - cents % 100) / 100).cast("bigint")
    price = F.concat(whole.cast("string"), F.lit(","), (cents % 100).cast("string"))
    return _table(spark, folder, "orders").select(
        F.concat(
            F.lit('"'), F.col("o_orderkey"), F.lit('";"'), F.col("o_custkey"), F.lit('";"\\'),
            F.col("o_orderstatus"), F.lit('\\";"'), price, F.lit('";'),
        ).alias("value")
    )


def _allow_lists(spark: SparkSession, folder: str) -> list[DataFrame]:
    customer, nation, region = (_table(spark, folder, t) for t in ("customer", "nation", "region"))
    in_debt = customer.filter("c_acctbal < 0").select("c_nationkey", "c_mktsegment")
    served = region.filter(F.col("r_name").isin("AFRICA", "AMERICA", "ASIA"))
    nations = nation.join(served, nation.n_regionkey == served.r_regionkey, "left_semi")
    return [in_debt, nations.select(F.col("n_nationkey").alias("c_nationkey"))]


def _line_config(level: str) -> plans.AssessmentConfig:
    """Line items of two return flags and two ranges of quantity, at one granularity."""
    dimensions = ["Volume", "Accuracy", "Precision", "Completeness_Missing", "Timeliness"]
    if level == "global":
        dimensions += ["Distinctness", "Completeness_Frequency"]
    return plans.AssessmentConfig(
        columns=LINE_COLUMNS,
        keys=[["l_returnflag"], ["l_linestatus", "l_returnflag"], ["l_quantity"]],
        dimensions=dimensions,
        granularity={name: [level] for name in dimensions},
        values={"l_returnflag": ["A", "N"]},
        intervals={"l_quantity": [(1, 10), (20, None)]},
        compare="typed",
        expected_mean={"l_quantity": 25},
        interval_width={"l_quantity": 40},
        numeric_columns=["l_quantity", "l_extendedprice"],
        timestamps={"l_shipdate": None},
        volatility_hours={"l_shipdate": 100_000},
    )


def _line_metadata(lineitem: DataFrame) -> plans.SourceMetadata:
    rates = op.update_rate_global(op.hour_counts(lineitem, "l_shipdate"))
    return plans.SourceMetadata(update_rate_global={"l_shipdate": rates})


def _final_quality(spark: SparkSession, folder: str) -> DataFrame:
    lineitem = _table(spark, folder, "lineitem")
    return _rounded(plans.final_quality(lineitem, _line_config("global"), SHIP_NOW, _line_metadata(lineitem)))


# --- queries -----------------------------------------------------------------------


def _on(table: str, build: Callable[[DataFrame], DataFrame]):
    """Query over one whole table."""
    return lambda spark, folder: _rounded(build(_table(spark, folder, table)))


def _frequency(events: DataFrame) -> DataFrame:
    rates = op.update_rate_values(op.value_hour_counts(events, "ts", EVENT_KEYS, apart=EVENT_APART))
    counts = op.value_hour_counts(_valued(events), "ts", EVENT_KEYS, apart=EVENT_APART)
    return op.frequency_groups(counts, rates)


def _frequency_hours(events: DataFrame) -> DataFrame:
    rates = op.update_rate_global(op.hour_counts(events, "ts"))
    return op.frequency_hour(op.hour_counts(_valued(events), "ts"), rates)


def _timeliness_groups(events: DataFrame) -> DataFrame:
    return op.timeliness_groups(events, EVENT_TIMES, EVENT_KEYS, NOW, apart=EVENT_APART)


def _population(orders: DataFrame) -> DataFrame:
    known = op.source_distinctness(orders, ["o_custkey", "o_orderpriority"])
    urgent = op.filter_values(orders, {"o_orderstatus": ["P"], "o_orderpriority": ["1-URGENT"]})
    keys = [["o_custkey"], ["o_orderpriority"], ["o_custkey", "o_orderpriority"]]
    return op.completeness_population(urgent, known, keys)


def _association(spark: SparkSession, folder: str) -> DataFrame:
    marked = op.association_consistency(
        _table(spark, folder, "customer"), _allow_lists(spark, folder), ["c_nationkey", "c_mktsegment"]
    )
    return marked.select("c_custkey", F.col("ASSOCIATION_CONSISTENCY").cast("double").alias("ASSOCIATION_CONSISTENCY"))


def _json_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Orders written as JSON to the shared folder, read back with an all-text schema."""
    header = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    path = _scratch(spark, "orders-json")
    sources.write_json(_table(spark, folder, "orders").select(*header), path)
    return sources.read_rows(spark, path, header)


def _customers_of_region(spark: SparkSession, folder: str) -> DataFrame:
    nation, region = _table(spark, folder, "nation"), _table(spark, folder, "region")
    asia = nation.join(region.filter("r_name = 'ASIA'"), nation.n_regionkey == region.r_regionkey)
    allowed = asia.select(F.col("n_nationkey").alias("c_nationkey"))
    kept = op.filter_values(_table(spark, folder, "customer"), {"c_nationkey": allowed})
    return kept.select("c_custkey", "c_nationkey")


def _assessed_values(spark: SparkSession, folder: str) -> DataFrame:
    """Value tables of a stored assessment as one long table."""
    tables = plans.assess(_table(spark, folder, "lineitem"), _line_config("value"), SHIP_NOW)

    def lines(name: str, metrics: list[str]) -> DataFrame:
        table = tables[name]
        labelled = table if "Column" in table.columns else table.withColumn("Column", F.lit(""))
        pairs = [F.struct(F.lit(m).alias("Metric"), F.col(m).cast("double").alias("Result")) for m in metrics]
        return labelled.select("Column", "Attribute", "Value", F.inline(F.array(*pairs)))

    return (
        lines("accuracy_values", ["AccuracyDynamic", "AccuracyStatic"])
        .unionByName(lines("precision_values", ["Mean", "Precision", "StandardDeviation"]))
        .unionByName(lines("completeness_missing_values", ["MissingValues", "CompletenessMissingValue"]))
        .unionByName(lines("timeliness_values", ["TimelinessMean", "TimelinessMax", "TimelinessMin"]))
        .unionByName(lines("volume_values", ["Count", "VolumeValue"]))
    )


def _assessed_distinctness(spark: SparkSession, folder: str) -> DataFrame:
    """Duplicate mass in a stored assessment."""
    config = plans.AssessmentConfig(columns=["l_partkey", "l_suppkey"], dimensions=["Distinctness"])
    return plans.assess(_table(spark, folder, "lineitem"), config, NOW)["final_quality"]


def _sampled_report(spark: SparkSession, folder: str) -> DataFrame:
    """Final row of a sampled selection in long form; the fraction is the confidence."""
    config = plans.AssessmentConfig(
        columns=["o_orderkey", "o_totalprice", "o_orderstatus"],
        dimensions=["Volume", "Precision", "Completeness_Missing"],
        numeric_columns=["o_totalprice"],
        values={"o_orderstatus": ["O"]},
        sample_key="o_orderkey",
        sample_fraction=0.25,
    )
    return plans.long_report(plans.final_quality(_table(spark, folder, "orders"), config, NOW))


def _text_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events whose instants are text with two-digit years and decimal commas."""
    return _table(spark, folder, "events").select(
        "event_id", "event_type", F.date_format("ts", "dd/MM/yy HH:mm:ss,SSSSSS").alias("ts")
    )


def _text_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line items whose numbers are text with a decimal comma."""
    return _table(spark, folder, "lineitem").select(
        "l_returnflag",
        *[F.translate(F.col(c).cast("string"), ".", ",").alias(c) for c in ("l_quantity", "l_discount")],
    )


def _extended(spark: SparkSession, folder: str) -> DataFrame:
    """Events with all per-row quality columns; the numbers are read back from text."""
    events = _table(spark, folder, "events")
    config = plans.AssessmentConfig(
        columns=["ts", "user_id", "event_type"],
        dimensions=["Completeness_Missing", "Timeliness", "Consistency-R"],
        granularity={name: ["tuple"] for name in ("Completeness_Missing", "Timeliness", "Consistency")},
        timestamps={"ts": None},
        volatility_hours={"ts": 720},
    )
    spenders = events.filter("event_type = 'purchase' AND value > 100").select("user_id")
    out = plans.extended_dataset(events, config, NOW, [spenders])
    quality = ["COMPLETENESS_MISSING", "TIMELINESS_ts", "ASSOCIATION_CONSISTENCY"]
    return out.select(
        "event_id", "user_id", "event_type", "props", *[F.col(c).cast("double").alias(c) for c in quality]
    )


def _comma_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with a composite key whose two values show one text: (x,b | c) and (x | b,c)."""
    even = F.col("event_id") % 2 == 0
    return _table(spark, folder, "events").select(
        "event_id",
        "ts",
        F.when(even, F.concat("event_type", F.lit(",b"))).otherwise(F.col("event_type")).alias("a"),
        F.when(even, "c").otherwise("b,c").alias("c"),
    )


def _frequency_commas(spark: SparkSession, folder: str) -> DataFrame:
    events, keys = _comma_events(spark, folder), [["a", "c"]]
    rates = op.update_rate_values(op.value_hour_counts(events, "ts", keys))
    counts = op.value_hour_counts(events.filter("event_id % 3 <> 0"), "ts", keys)
    return op.frequency_value(op.frequency_groups(counts, rates))


def _interval_of_text_times(spark: SparkSession, folder: str) -> DataFrame:
    """Instants as text, each tenth one junk, which lies in no interval."""
    junk = F.when(F.col("event_id") % 10 == 0, "junk").otherwise(F.col("ts")).alias("ts")
    events = _text_events(spark, folder).select("event_id", "event_type", junk)
    low, high = "05/01/2024 00.00.00", "20/01/2024 12.00.00"
    times = {"ts": "%d/%m/%y %H:%M:%S,%f"}
    return op.filter_intervals(events, {"ts": [(low, high)]}, timestamps=times, on_invalid="skip").drop("ts")


def _stored_allow_lists(spark: SparkSession, folder: str) -> DataFrame:
    """The allow-lists as JSON text, read back and held against typed columns."""
    paths = []
    for allowed in _allow_lists(spark, folder):
        paths.append(_scratch(spark, "allow-list"))
        sources.write_json(allowed, paths[-1])
    columns = ["c_nationkey", "c_mktsegment"]
    lists = sources.read_allow_lists(spark, [*paths, paths[0] + "-absent"], columns)
    marked = op.association_consistency(_table(spark, folder, "customer"), lists, columns)
    return marked.select("c_custkey", F.col("ASSOCIATION_CONSISTENCY").cast("double").alias("ASSOCIATION_CONSISTENCY"))


def _numbers_in_allow_lists(spark: SparkSession, folder: str) -> DataFrame:
    """A double column against lists of texts: 5 and 5.0 are one number, x is none."""
    texts = [spark.createDataFrame([(t,) for t in part], "l_quantity string") for part in (["5", "7.0", "x"], ["5.00", "9"])]
    lines = _table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    marked = op.association_consistency(lines, texts, ["l_quantity"])
    return marked.withColumn("ASSOCIATION_CONSISTENCY", F.col("ASSOCIATION_CONSISTENCY").cast("double"))


def _structured_from_files(spark: SparkSession, folder: str) -> DataFrame:
    path = _scratch(spark, "order-lines")
    sources.write_text(_order_lines(spark, folder), path)
    return sources.structure_text(sources.read_text_lines(spark, path), ORDER_REGEX, ORDER_FIELDS)


def _metadata_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Update rates as a profiling step leaves them beside a source."""
    path = _scratch(spark, "source")
    counts = op.value_hour_counts(_table(spark, folder, "events"), "ts", EVENT_KEYS, apart=EVENT_APART)
    sources.write_json(op.update_rate_values(counts).drop("Parts"), f"{path}/update_rate_values_ts")
    return sources.read_metadata(spark, path, "update_rate_values", "ts")


def _source_quality_copy(spark: SparkSession, folder: str) -> DataFrame:
    path = _scratch(spark, "source")
    quality = _table(spark, folder, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    sources.write_json(quality, f"{path}/source_quality")
    sources.copy_source_quality(spark, path, f"{path}/out")
    return spark.read.schema(quality.schema).json(f"{path}/out/source_quality")


def _kept_output(spark: SparkSession, folder: str) -> DataFrame:
    """A second write with "ignore" leaves the first output as it is."""
    path, header = _scratch(spark, "kept"), ["o_orderkey", "o_orderstatus"]
    orders = _table(spark, folder, "orders").select(*header)
    for status in ("O", "F"):
        sources.write_json(orders.filter(F.col("o_orderstatus") == status), path, "ignore")
    return sources.read_rows(spark, path, header)


def _text_sink(spark: SparkSession, folder: str) -> DataFrame:
    path = _scratch(spark, "customers")
    sources.write_text(_table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), path, ";")
    return sources.read_text_lines(spark, path)


def _extended_sink(spark: SparkSession, folder: str) -> DataFrame:
    path, table = _scratch(spark, "extended"), _extended(spark, folder)
    sources.write_extended(table, path)
    return spark.read.schema(table.schema).json(path)


def _stored_and_custom_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rules of the metadata beside a source and rules of the configuration, one of them in both."""
    path, part = _scratch(spark, "source"), _table(spark, folder, "part")
    pairs = part.limit(1).select(F.inline(F.array(*[F.struct(F.lit(x).alias("Antecedent"), F.lit(y).alias("Consequent")) for x, y in (("p_brand", "p_type"), ("p_brand,p_type", "p_size"))])))
    sources.write_json(pairs, f"{path}/association_rules")
    config = plans.AssessmentConfig(
        columns=["p_brand", "p_type", "p_size"],
        dimensions=["Consistency"],
        granularity={"Consistency": ["value"]},
        rules=["p_type:p_brand", "p_brand:p_type"],
    )
    metadata = plans.SourceMetadata(association_rules=sources.read_metadata(spark, path, "association_rules"))
    return plans.assess(part, config, NOW, metadata, stored=False)["consistency_values"]


def _bernoulli_facts(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of a random sample: no foreign and no repeated key, a fitting share, the same rows again."""
    orders = _table(spark, folder, "orders").select("o_orderkey")
    draw = lambda: op.sample_rows(orders, 0.25, 7)
    n = lambda df: df.agg(F.count(F.lit(1))).scalar()
    total, drawn = n(orders), n(draw())
    return orders.agg(F.count(F.lit(1)).alias("n")).select(
        (n(draw().join(orders, "o_orderkey", "left_anti")) == 0).alias("is_subset"),
        (n(draw().distinct()) == drawn).alias("is_unique"),
        (F.abs(drawn - total * 0.25) <= 5 * F.sqrt(total * 0.1875)).alias("share_fits"),
        (n(draw().join(draw(), "o_orderkey", "left_anti")) == 0).alias("same_again"),
    )


def _dirty_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with empty and NULL types and coarse amounts, so that many rows repeat."""
    kind = F.when(F.col("user_id") % 7 == 0, "").when(F.col("user_id") % 11 != 0, F.col("event_type"))
    return _table(spark, folder, "events").select(kind.alias("kind"), F.floor(F.col("value") / 20).alias("amount"), "ts")


DIRTY_EVENTS = """dirty AS (SELECT CASE WHEN user_id % 7 = 0 THEN '' WHEN user_id % 11 <> 0 THEN event_type END AS kind,
  CAST(floor(value / 20) AS BIGINT) AS amount, ts FROM events)"""


def _dirty_config(level: str) -> plans.AssessmentConfig:
    wanted = ("Volume", "Completeness_Missing", "Distinctness", "Precision")
    return plans.AssessmentConfig(
        columns=["kind", "amount"],
        keys=[["kind"]],
        dimensions=wanted,
        granularity={name: [level] for name in wanted},
        numeric_columns=["amount"],
    )


def _dirty_quality(spark: SparkSession, folder: str) -> DataFrame:
    return plans.final_quality(_dirty_events(spark, folder), _dirty_config("global"), NOW)


def _assessed_attributes(spark: SparkSession, folder: str) -> DataFrame:
    """Attribute tables of a stored assessment of dirty rows as one long table."""
    config = replace(_dirty_config("attribute"), dimensions=("Completeness_Missing", "Distinctness", "Precision"))
    tables = plans.assess(_dirty_events(spark, folder), config, NOW)

    def lines(name: str, metric: str) -> DataFrame:
        return tables[name].select("Attribute", F.lit(metric).alias("Metric"), F.col(metric).cast("double").alias("Result"))

    return (
        lines("completeness_missing_attributes", "CompletenessMissingValue")
        .unionByName(lines("distinctness_attributes", "DistinctCount"))
        .unionByName(lines("precision_attributes", "Precision"))
    )


def _mixed_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """Two reports of different samples: the mean hangs on how many metrics each has."""
    whole = plans.long_report(_dirty_quality(spark, folder))
    return plans.mean_confidence(_sampled_report(spark, folder).unionByName(whole))


def _training_data_modules():
    """The optional subpackage with its pipeline, or None where it, or a library that only it needs, was left out."""
    try:
        import corpus_pipeline

        from gaugeframe.llm import queries as found
        from gaugeframe.llm import sql
    except ModuleNotFoundError as missing:
        if missing.name not in ("corpus_pipeline", "gaugeframe.llm"):
            if (missing.name or "").split(".")[0] in ("gaugeframe", "pyspark"):
                raise
            print(f"Training-data queries are left out: {missing}", file=sys.stderr)
        return None
    return corpus_pipeline, found, sql


def _training_data_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    modules = _training_data_modules()
    if modules is None:
        return {}
    corpus_pipeline, found, _ = modules
    return {**found.queries(), "pipeline": corpus_pipeline.run}


def _training_data_sql() -> dict[str, str]:
    modules = _training_data_modules()
    if modules is None:
        return {}
    corpus_pipeline, _, sql = modules
    whole = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {**sql.oracle_sql(), **whole}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {
        "accuracy_global": _on("lineitem", lambda t: op.accuracy_global(t, ACCURACY)),
        "accuracy_value": _on("lineitem", lambda t: op.accuracy_value(t, ACCURACY, LINE_KEYS, apart=LINE_APART)),
        "accuracy_attribute": _on(
            "lineitem", lambda t: op.accuracy_attribute(op.accuracy_value(t, ACCURACY, LINE_KEYS, apart=LINE_APART))
        ),
        "accuracy_text_numbers": lambda s, d: _rounded(
            op.accuracy_attribute(op.accuracy_value(_text_lines(s, d), ACCURACY, [["l_returnflag"]]))
        ),
        "precision_global": _on("lineitem", lambda t: op.precision_global(t, ["l_extendedprice", "l_tax"])),
        "precision_value": _on("lineitem", lambda t: op.precision_value(t, ["l_extendedprice"], LINE_KEYS, apart=LINE_APART)),
        "precision_attribute": _on(
            "lineitem", lambda t: op.precision_attribute(op.precision_value(t, ["l_extendedprice"], LINE_KEYS, apart=LINE_APART))
        ),
        "precision_shift_global": _on("customer", lambda t: op.precision_global(t, ["c_acctbal"])),
        "precision_shift_value": _on("customer", lambda t: op.precision_value(t, ["c_acctbal"], CUSTOMER_KEYS)),
        "precision_shift_attribute": _on(
            "customer", lambda t: op.precision_attribute(op.precision_value(t, ["c_acctbal"], CUSTOMER_KEYS))
        ),
        "completeness_missing_global": lambda s, d: _rounded(
            op.completeness_missing_global(_dirty_orders(s, d), DIRTY_COLUMNS)
        ),
        "completeness_missing_attribute": lambda s, d: _rounded(
            op.completeness_missing_attribute(_dirty_orders(s, d), DIRTY_KEYS)
        ),
        "completeness_missing_value": lambda s, d: _rounded(
            op.completeness_missing_value(_dirty_orders(s, d), DIRTY_COLUMNS, DIRTY_KEYS)
        ),
        "row_completeness": lambda s, d: _rounded(
            op.row_completeness(_dirty_orders(s, d)).select(
                "o_orderkey", F.col("COMPLETENESS_MISSING").cast("double").alias("COMPLETENESS_MISSING")
            )
        ),
        "completeness_frequency_hour": _on("events", lambda t: _frequency_hours(t)),
        "completeness_frequency_global": _on("events", lambda t: op.frequency_global(_frequency_hours(t), "ts")),
        "completeness_frequency_value": _on("events", lambda t: op.frequency_value(_frequency(t))),
        "completeness_frequency_attribute": _on("events", lambda t: op.frequency_attribute(_frequency(t))),
        "update_rate_global": _on("events", lambda t: op.update_rate_global(op.hour_counts(t, "ts"))),
        "update_rate_values": _on(
            "events",
            lambda t: op.update_rate_values(op.value_hour_counts(t, "ts", EVENT_KEYS, apart=EVENT_APART)).drop("Parts"),
        ),
        "completeness_population": _on("orders", _population),
        "source_distinctness": _on(
            "orders", lambda t: op.source_distinctness(t, ["o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"])
        ),
        "timeliness_global": _on("events", lambda t: op.timeliness_global(t, EVENT_TIMES, NOW)),
        "timeliness_value": _on("events", lambda t: op.timeliness_value(_timeliness_groups(t))),
        "timeliness_attribute": _on("events", lambda t: op.timeliness_attribute(_timeliness_groups(t))),
        "timeliness_text": lambda s, d: _rounded(
            op.timeliness_global(_text_events(s, d), [op.TimeColumn("ts", 720.0, "%d/%m/%y %H:%M:%S,%f")], NOW)
        ),
        "timeliness_tuple": _on(
            "events",
            lambda t: op.timeliness_tuple(t, EVENT_TIMES, NOW).select(
                "event_id", F.col("TIMELINESS_ts").cast("double").alias("TIMELINESS_ts")
            ),
        ),
        "volume_global": _on("orders", lambda t: op.volume_global(_placed(t), t)),
        "volume_value": _on("orders", lambda t: op.volume_value(_placed(t), t, ORDER_KEYS)),
        "distinctness_global": _on("part", lambda t: op.distinctness_global(t, PART_COLUMNS)),
        "distinctness_global_lineitem": _on(
            "lineitem", lambda t: op.distinctness_global(t, ["l_partkey", "l_suppkey"])
        ),
        "assessed_distinctness": lambda s, d: _rounded(_assessed_distinctness(s, d)),
        "distinctness_attribute": _on(
            "part", lambda t: op.distinctness_attribute(t, [PART_COLUMNS, ["p_brand"], ["p_name"]])
        ),
        "consistency_value": _on("part", lambda t: op.consistency_value(op.rule_scores(t, PART_RULES))),
        "consistency_attribute": _on("part", lambda t: op.consistency_attribute(op.rule_scores(t, PART_RULES))),
        "consistency_value_lineitem": _on(
            "lineitem",
            lambda t: op.consistency_value(op.rule_scores(t, op.rule_set(["l_returnflag:l_linestatus"]))),
        ),
        "association_consistency_tuple": lambda s, d: _rounded(_association(s, d)),
        "select_interval_string": _on(
            "orders",
            lambda t: op.filter_intervals(
                t.select("o_orderkey", "o_totalprice"), {"o_totalprice": [("100", "20"), ("9", "")]}
            ),
        ),
        "select_interval_typed": _on(
            "lineitem",
            lambda t: op.filter_intervals(
                t.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"),
                {"l_quantity": [(None, 5), (40, 45.0)], "l_discount": [(0.05, None)]},
                "typed",
            ),
        ),
        "select_interval_timestamp": _on(
            "orders",
            lambda t: op.filter_intervals(
                t.select("o_orderkey", "o_orderdate"),
                {"o_orderdate": [("01/01/1996 00.00.00", "31/12/1996 23.59.59"), ("01/01/1999 00.00.00", "")]},
                timestamps={"o_orderdate": None},
            ).select("o_orderkey"),
        ),
        "select_values": _on(
            "orders",
            lambda t: op.filter_values(
                t.select("o_orderkey", "o_orderstatus", "o_orderpriority"),
                {"o_orderstatus": ["O", "F"], "o_orderpriority": ["1-URGENT", "2-HIGH"]},
            ),
        ),
        "select_values_table": _customers_of_region,
        "drop_null_rows": lambda s, d: op.drop_incomplete(_dirty_orders(s, d)),
        "null_to_text": lambda s, d: op.null_to_text(_dirty_orders(s, d)),
        "sample_hash": _on(
            "orders", lambda t: op.sample_by_key(t.select("o_orderkey", "o_custkey"), "o_orderkey", 0.25)
        ),
        "sample_bernoulli": _on(
            "orders", lambda t: op.sample_rows(t.select("o_orderkey", "o_custkey"), 0.25, 7)
        ),
        "structure_text": lambda s, d: sources.structure_text(_order_lines(s, d), ORDER_REGEX, ORDER_FIELDS),
        "read_json_rows": _json_round_trip,
        "analysed_files": lambda s, d: sources.analysed_files(_catalogue(s, d)),
        "final_quality": _final_quality,
        "assessed_values": lambda s, d: _rounded(_assessed_values(s, d)),
        "extended_dataset": lambda s, d: _rounded(_extended(s, d)),
        "long_report": lambda s, d: _rounded(
            _sampled_report(s, d).withColumn("Value", F.col("Value").cast("double"))
        ),
        "mean_confidence": lambda s, d: plans.mean_confidence(_sampled_report(s, d)),
        "mixed_confidence": lambda s, d: _rounded(_mixed_confidence(s, d)),
        "completeness_frequency_commas": lambda s, d: _rounded(_frequency_commas(s, d)),
        "select_interval_text_timestamp": _interval_of_text_times,
        "interval_on_nulls": lambda s, d: op.filter_intervals(_dirty_orders(s, d), {"o_orderpriority": [("2-HIGH", None)]}),
        "read_allow_lists": lambda s, d: _rounded(_stored_allow_lists(s, d)),
        "allow_list_numbers": _numbers_in_allow_lists,
        "read_text_structured": _structured_from_files,
        "metadata_round_trip": lambda s, d: _rounded(_metadata_round_trip(s, d)),
        "source_quality_copy": _source_quality_copy,
        "keep_existing_output": _kept_output,
        "text_sink": _text_sink,
        "extended_sink": lambda s, d: _rounded(_extended_sink(s, d)),
        "stored_and_custom_rules": lambda s, d: _rounded(_stored_and_custom_rules(s, d)),
        "sample_bernoulli_facts": _bernoulli_facts,
        "final_quality_dirty": lambda s, d: _rounded(_dirty_quality(s, d)),
        "assessed_attributes": lambda s, d: _rounded(_assessed_attributes(s, d)),
    }
    out.update(_training_data_queries())
    return out


def entry(spark: SparkSession) -> DataFrame:
    """Final quality row of lineitem."""
    return _final_quality(spark, "/root/testdata/sf0.001")


# --- SQL checks --------------------------------------------------------------------


def _key_union(select: str, keys: list[list[str]], rest: str) -> str:
    """One SELECT per key; {label}, {value} and {group} are filled in."""
    parts = []
    for key in keys:
        texts = [f"coalesce(CAST({c} AS VARCHAR), 'null')" for c in key]
        filled = {
            "label": "_".join(key),
            "value": " || ',' || ".join(texts),
            "group": ", ".join(texts),
            "single": texts[0] if len(texts) == 1 else "'composite'",
            "width": str(len(key)),
        }
        text = f"{select} {rest}"
        for name, value in filled.items():
            text = text.replace("{" + name + "}", value)
        parts.append(text)
    return " UNION ALL ".join(parts)


def _score(name: str, mean: float, width: float) -> str:
    return f"greatest(0e0, 1e0 - abs({name} - {mean}e0) / ({width}e0 / 2))"


def _accuracy_sql(keys, table="lineitem", targets=ACCURACY) -> str:
    return " UNION ALL ".join(
        _key_union(
            f"SELECT '{t.column}' AS \"Column\", '{{label}}' AS \"Attribute\", {{value}} AS \"Value\", "
            f"avg({_score(t.column, t.mean, t.width)}) AS dyn, avg(ceil({_score(t.column, t.mean, t.width)})) AS sta",
            [k for k in keys if t.column not in k],
            f"FROM {table} GROUP BY {{group}}",
        )
        for t in targets
    )


def _precision_sql(name, keys, table) -> str:
    return _key_union(
        f"SELECT '{name}' AS \"Column\", '{{label}}' AS \"Attribute\", {{value}} AS \"Value\", avg({name}) AS m, "
        f"greatest(0e0, 1e0 - stddev_pop({name}) / abs(avg({name}) + (SELECT CASE WHEN min({name}) < 0 AND "
        f"max({name}) > 0 THEN abs(min({name})) ELSE 0e0 END FROM {table}))) AS p, stddev_pop({name}) AS s",
        [k for k in keys if name not in k],
        f"FROM {table} GROUP BY {{group}}",
    )


def _precision_value_sql(name, keys, table) -> str:
    return (
        'SELECT "Column", "Attribute", "Value", round(m, 6) AS "Mean", round(p, 6) AS "Precision", '
        f'round(s, 6) AS "StandardDeviation" FROM ({_precision_sql(name, keys, table)})'
    )


def _precision_attribute_sql(name, keys, table) -> str:
    return (
        'SELECT "Column", "Attribute", round(avg(m), 6) AS "Mean", round(avg(p), 6) AS "Precision", '
        'round(avg(s), 6) AS "Standard_Deviation", 1e0 AS "Confidence" '
        f'FROM ({_precision_sql(name, keys, table)}) GROUP BY "Column", "Attribute"'
    )


def _present(name: str) -> str:
    return f"CASE WHEN {name} IS NULL OR CAST({name} AS VARCHAR) IN ('', 'nan', 'null') THEN 0 ELSE 1 END"


def _present_sum(names) -> str:
    return "(" + " + ".join(_present(n) for n in names) + ")"


def _missing_value_sql(table: str, columns, keys) -> str:
    parts = []
    for key in keys:
        others = [c for c in columns if c not in key]
        parts.append(
            _key_union(
                "SELECT '{label}' AS \"Attribute\", {value} AS \"Value\", "
                f"CAST(count(*) * {len(others)} - sum({_present_sum(others)}) AS BIGINT) AS \"MissingValues\", "
                f"round(sum({_present_sum(others)}) / (count(*) * {len(others)}), 6) AS \"CompletenessMissingValue\"",
                [key],
                f"FROM {table} WHERE {{single}} NOT IN ('', 'nan', 'null') GROUP BY {{group}}",
            )
        )
    return " UNION ALL ".join(parts)


EVENT_AGE = f"date_diff('microsecond', ts, TIMESTAMP '{NOW}') / 1e6"
EVENT_FRESH = f"(1e0 - {EVENT_AGE} / (720e0 * 3600e0))"
EVENT_GROUPS = _key_union(
    "SELECT 'ts' AS \"Column\", '{label}' AS \"Attribute\", {value} AS \"Value\", "
    f"avg({EVENT_FRESH}) AS a, max({EVENT_FRESH}) AS b, min({EVENT_FRESH}) AS c",
    EVENT_KEYS,
    "FROM events GROUP BY {group}",
)
DAYS = "(date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) + 1)"
HOUR_RATES = (
    f"SELECT CAST(hour(ts) AS INTEGER) AS h, count(*) / ({DAYS} * 3600e0) AS f FROM events GROUP BY hour(ts)"
)
VALUE_RATES = _key_union(
    "SELECT '{label}' AS k, {value} AS v, CAST(hour(ts) AS INTEGER) AS h, "
    f"count(*) / ({DAYS} * 3600e0) AS f",
    EVENT_KEYS,
    "FROM events GROUP BY {group}, hour(ts)",
)
VALUED = "valued AS (SELECT * FROM events WHERE value BETWEEN 20 AND 400)"
HOUR_FREQUENCY = (
    f"WITH {VALUED}, rates AS ({HOUR_RATES}), counts AS (SELECT CAST(hour(ts) AS INTEGER) AS h, count(*) AS n, "
    f"{DAYS} AS d FROM valued GROUP BY hour(ts)), hours AS (SELECT h, n, greatest(0e0, least(1e0, "
    "n / (f * d * 3600e0))) AS q FROM counts JOIN rates USING (h)) "
)
VALUE_FREQUENCY = (
    f"WITH {VALUED}, rates AS ({VALUE_RATES}), counts AS ("
    + _key_union(
        "SELECT '{label}' AS k, {value} AS v, CAST(hour(ts) AS INTEGER) AS h, count(*) AS n, min(ts) AS lo, max(ts) AS hi",
        EVENT_KEYS,
        "FROM valued GROUP BY {group}, hour(ts)",
    )
    + "), rolled AS (SELECT k, v, sum(n) AS n, date_diff('microsecond', min(lo), max(hi)) / 1e6 AS e, avg(f) AS f "
    "FROM counts JOIN rates USING (k, v, h) GROUP BY k, v), kept AS (SELECT k, v, n, least(1e0, n / (e * f)) AS q "
    "FROM rolled WHERE e * f > 0) "
)


def _rule_sql(table: str, rules) -> str:
    parts = []
    for i, (x, y) in enumerate(rules):
        xs = [f"CAST({c} AS VARCHAR)" for c in x]
        ys = [f"CAST({c} AS VARCHAR)" for c in y]
        named = ", ".join(f"{t} AS x{j}" for j, t in enumerate(xs))
        group = ", ".join(f"x{j}" for j in range(len(xs)))
        shown = " || ',' || ".join(f"x{j}" for j in range(len(xs)))
        parts.append(
            f"SELECT {i} AS rule, '{','.join(x)}' AS ant, '{','.join(y)}' AS cons, {shown} AS v, max(n) / sum(n) AS q "
            f"FROM (SELECT {named}, count(*) AS n FROM {table} GROUP BY {', '.join(xs + ys)}) GROUP BY {group}"
        )
    return " UNION ALL ".join(parts)


def _rule_value_sql(table: str, rules) -> str:
    return (
        "SELECT v AS \"AntecedentValue\", ant || ' -> ' || cons AS \"Rule\", round(q, 6) AS \"ConsistencyValue\" "
        f"FROM ({_rule_sql(table, rules)})"
    )


SHIP_FRESH = f"(1e0 - date_diff('microsecond', l_shipdate, TIMESTAMP '{SHIP_NOW}') / 1e6 / (100000e0 * 3600e0))"
SHIP_DAYS = "(date_diff('day', CAST(min(l_shipdate) AS DATE), CAST(max(l_shipdate) AS DATE)) + 1)"
LINES = (
    "WITH seen AS (SELECT l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus, l_shipdate "
    "FROM lineitem WHERE l_returnflag IN ('A', 'N') AND (l_quantity BETWEEN 1 AND 10 OR l_quantity >= 20))"
)


def _final_quality_sql() -> str:
    return f"""{LINES},
    rates AS (SELECT hour(l_shipdate) AS h, count(*) / ({SHIP_DAYS} * 3600e0) AS f FROM lineitem GROUP BY 1),
    hours AS (SELECT hour(l_shipdate) AS h, count(*) AS n, {SHIP_DAYS} AS d FROM seen GROUP BY 1),
    groups AS (SELECT count(*) AS c FROM seen GROUP BY {", ".join(LINE_COLUMNS)})
    SELECT round(least(1e0, count(*) / (SELECT count(*) FROM lineitem)), 6) AS "Volume",
      count(*) AS "Volume(TotalRows)",
      round(avg(ceil({_score("l_quantity", 25, 40)})), 6) AS "Accuracy_Static_l_quantity",
      round(avg({_score("l_quantity", 25, 40)}), 6) AS "Accuracy_Dynamic_l_quantity",
      round(greatest(0e0, 1e0 - stddev_pop(l_quantity) / abs(avg(l_quantity))), 6) AS "Precision_l_quantity",
      round(stddev_pop(l_quantity), 6) AS "Precision(Deviation)_l_quantity",
      round(greatest(0e0, 1e0 - stddev_pop(l_extendedprice) / abs(avg(l_extendedprice))), 6) AS "Precision_l_extendedprice",
      round(stddev_pop(l_extendedprice), 6) AS "Precision(Deviation)_l_extendedprice",
      round(sum({_present_sum(LINE_COLUMNS)}) / (count(*) * {len(LINE_COLUMNS)}), 6) AS "Completeness_Missing",
      round(greatest(0e0, avg({SHIP_FRESH})), 6) AS "Timeliness_Mean_l_shipdate",
      round(greatest(0e0, max({SHIP_FRESH})), 6) AS "Timeliness_Max_l_shipdate",
      round(greatest(0e0, min({SHIP_FRESH})), 6) AS "Timeliness_Min_l_shipdate",
      '{SHIP_NOW}' AS "Last_Analysis_Timestamp_l_shipdate",
      (SELECT round(greatest(0e0, 1e0 - coalesce(sum(c / 2) FILTER (WHERE c / 2 > 1), 0) / sum(c)), 6) FROM groups)
        AS "Distinctness",
      (SELECT round(avg(greatest(0e0, least(1e0, n / (f * d * 3600e0)))), 6) FROM hours JOIN rates USING (h))
        AS "Completeness_Frequency_l_shipdate",
      1e0 AS "Confidence"
    FROM seen"""


def _assessed_values_sql() -> str:
    keys = [["l_returnflag"], ["l_linestatus", "l_returnflag"], ["l_quantity"]]

    def lines(name: str, metric: str, expression: str, where: str = "") -> str:
        return _key_union(
            f"SELECT '{name}' AS \"Column\", '{{label}}' AS \"Attribute\", {{value}} AS \"Value\", "
            f"'{metric}' AS \"Metric\", round(CAST({expression} AS DOUBLE), 6) AS \"Result\"",
            [k for k in keys if name not in k],
            "FROM seen GROUP BY {group}",
        )

    score = _score("l_quantity", 25, 40)
    parts = [
        lines("l_quantity", "AccuracyDynamic", f"avg({score})"),
        lines("l_quantity", "AccuracyStatic", f"avg(ceil({score}))"),
        lines("l_shipdate", "TimelinessMean", f"greatest(0e0, avg({SHIP_FRESH}))"),
        lines("l_shipdate", "TimelinessMax", f"greatest(0e0, max({SHIP_FRESH}))"),
        lines("l_shipdate", "TimelinessMin", f"greatest(0e0, min({SHIP_FRESH}))"),
        lines("", "Count", "count(*)"),
        lines("", "VolumeValue", "count(*) / (SELECT count(*) FROM lineitem)"),
    ]
    for c in ("l_quantity", "l_extendedprice"):
        parts += [
            lines(c, "Mean", f"avg({c})"),
            lines(c, "Precision", f"greatest(0e0, 1e0 - stddev_pop({c}) / abs(avg({c})))"),
            lines(c, "StandardDeviation", f"stddev_pop({c})"),
        ]
    missing = _missing_value_sql("seen", LINE_COLUMNS, keys)
    for metric in ("MissingValues", "CompletenessMissingValue"):
        parts.append(
            f"SELECT '' AS \"Column\", \"Attribute\", \"Value\", '{metric}' AS \"Metric\", "
            f'CAST("{metric}" AS DOUBLE) AS "Result" FROM ({missing})'
        )
    return LINES + " " + " UNION ALL ".join(parts)


def oracle_sql() -> dict[str, str]:
    accuracy = _accuracy_sql(LINE_KEYS)
    placed = "(SELECT * FROM orders WHERE o_orderstatus IN ('O', 'F'))"
    cents = "CAST(trunc(o_totalprice * 100) AS BIGINT)"
    hashed = f"CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 15) AS BIGINT) < {2**58}"
    duplicates = (
        "SELECT round(greatest(0e0, 1e0 - coalesce(sum(c / 2) FILTER (WHERE c / 2 > 1), 0) / sum(c)), 6) "
        'AS "Distinctness" FROM (SELECT count(*) AS c FROM {table} GROUP BY {columns})'
    )
    sql = {
        "accuracy_global": "SELECT "
        + ", ".join(
            f"round(avg(ceil({_score(t.column, t.mean, t.width)})), 6) AS \"Accuracy_Static_{t.column}\", "
            f"round(avg({_score(t.column, t.mean, t.width)}), 6) AS \"Accuracy_Dynamic_{t.column}\""
            for t in ACCURACY
        )
        + " FROM lineitem",
        "accuracy_value": 'SELECT "Column", "Attribute", "Value", round(dyn, 6) AS "AccuracyDynamic", '
        f'round(sta, 6) AS "AccuracyStatic" FROM ({accuracy})',
        "accuracy_attribute": 'SELECT "Column", "Attribute", round(avg(dyn), 6) AS "AccuracyDynamic", '
        f'round(avg(sta), 6) AS "AccuracyStatic", 1e0 AS "Confidence" FROM ({accuracy}) GROUP BY 1, 2',
        "accuracy_text_numbers": 'SELECT "Column", "Attribute", round(avg(dyn), 6) AS "AccuracyDynamic", '
        f'round(avg(sta), 6) AS "AccuracyStatic", 1e0 AS "Confidence" FROM '
        f"({_accuracy_sql([['l_returnflag']])}) GROUP BY 1, 2",
        "precision_global": "SELECT "
        + ", ".join(
            f'round(greatest(0e0, 1e0 - stddev_pop({c}) / abs(avg({c}))), 6) AS "Precision_{c}", '
            f'round(stddev_pop({c}), 6) AS "Precision(Deviation)_{c}"'
            for c in ("l_extendedprice", "l_tax")
        )
        + " FROM lineitem",
        "precision_value": _precision_value_sql("l_extendedprice", LINE_KEYS, "lineitem"),
        "precision_attribute": _precision_attribute_sql("l_extendedprice", LINE_KEYS, "lineitem"),
        "precision_shift_global": "SELECT round(greatest(0e0, 1e0 - stddev_pop(c_acctbal) / (abs(avg(c_acctbal)) + "
        "CASE WHEN min(c_acctbal) < 0 AND max(c_acctbal) > 0 THEN abs(min(c_acctbal)) ELSE 0e0 END)), 6) "
        'AS "Precision_c_acctbal", round(stddev_pop(c_acctbal), 6) AS "Precision(Deviation)_c_acctbal" FROM customer',
        "precision_shift_value": _precision_value_sql("c_acctbal", CUSTOMER_KEYS, "customer"),
        "precision_shift_attribute": _precision_attribute_sql("c_acctbal", CUSTOMER_KEYS, "customer"),
        "completeness_missing_global": f"WITH {DIRTY} SELECT round(sum({_present_sum(DIRTY_COLUMNS)}) / "
        f'(count(*) * {len(DIRTY_COLUMNS)}), 6) AS "Completeness_Missing" FROM dirty',
        "completeness_missing_attribute": f"WITH {DIRTY} "
        + _key_union(
            "SELECT '{label}' AS \"Attribute\", count(*) FILTER (WHERE {single} IN ('', 'nan', 'null')) "
            "AS \"MissingValues\", round(count(*) FILTER (WHERE {single} NOT IN ('', 'nan', 'null')) / count(*), 6) "
            'AS "CompletenessMissingValue", 1e0 AS "Confidence"',
            DIRTY_KEYS,
            "FROM dirty",
        ),
        "completeness_missing_value": f"WITH {DIRTY} " + _missing_value_sql("dirty", DIRTY_COLUMNS, DIRTY_KEYS),
        "row_completeness": f"WITH {DIRTY} SELECT o_orderkey, round({_present_sum(DIRTY_COLUMNS)} / "
        f'{len(DIRTY_COLUMNS)}, 6) AS "COMPLETENESS_MISSING" FROM dirty',
        "completeness_frequency_hour": HOUR_FREQUENCY
        + 'SELECT h AS "Hour", n AS "RecordNumber", round(q, 6) AS "CompletenessFrequency" FROM hours',
        "completeness_frequency_global": HOUR_FREQUENCY
        + 'SELECT round(avg(q), 6) AS "Completeness_Frequency_ts" FROM hours',
        "completeness_frequency_value": VALUE_FREQUENCY
        + 'SELECT k AS "Attribute", v AS "Value", CAST(n AS BIGINT) AS "RecordNumber", '
        'round(q, 6) AS "CompletenessFrequencyValue" FROM kept',
        "completeness_frequency_attribute": VALUE_FREQUENCY
        + 'SELECT k AS "Attribute", CAST(sum(n) AS BIGINT) AS "RecordNumber", '
        'round(avg(q), 6) AS "CompletenessFrequencyValue", 1e0 AS "Confidence" FROM kept GROUP BY k',
        "update_rate_global": f'SELECT h AS "Hour", round(f, 6) AS "Frequency" FROM ({HOUR_RATES})',
        "update_rate_values": 'SELECT k AS "Key", v AS "Value", h AS "Hour", round(f, 6) AS "Frequency" '
        f"FROM ({VALUE_RATES})",
        "completeness_population": " UNION ALL ".join(
            f"SELECT '{c}' AS \"Attribute\", count(DISTINCT {c}) AS \"DistinctCount\", round(least(1e0, "
            f"count(DISTINCT {c}) / (SELECT count(DISTINCT {c}) FROM orders)), 6) AS \"CompletenessPopulationValue\", "
            "1e0 AS \"Confidence\" FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'"
            for c in ("o_custkey", "o_orderpriority")
        ),
        "source_distinctness": " UNION ALL ".join(
            f"SELECT '{c}' AS \"Attribute\", count(DISTINCT {c}) AS \"Count\" FROM orders"
            for c in ("o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
        ),
        "timeliness_global": f"SELECT round(greatest(0e0, avg({EVENT_FRESH})), 6) AS \"Timeliness_Mean_ts\", "
        f"round(greatest(0e0, max({EVENT_FRESH})), 6) AS \"Timeliness_Max_ts\", "
        f"round(greatest(0e0, min({EVENT_FRESH})), 6) AS \"Timeliness_Min_ts\", "
        f"'{NOW}' AS \"Last_Analysis_Timestamp_ts\" FROM events",
        "timeliness_text": f"SELECT round(greatest(0e0, avg({EVENT_FRESH})), 6) AS \"Timeliness_Mean_ts\", "
        f"round(greatest(0e0, max({EVENT_FRESH})), 6) AS \"Timeliness_Max_ts\", "
        f"round(greatest(0e0, min({EVENT_FRESH})), 6) AS \"Timeliness_Min_ts\", "
        "'01/02/24 00:00:00,000000' AS \"Last_Analysis_Timestamp_ts\" FROM events",
        "timeliness_value": 'SELECT "Column", "Attribute", "Value", round(greatest(0e0, a), 6) AS "TimelinessMean", '
        'round(greatest(0e0, b), 6) AS "TimelinessMax", round(greatest(0e0, c), 6) AS "TimelinessMin", '
        f"'{NOW}' AS \"AnalysisTime\" FROM ({EVENT_GROUPS})",
        "timeliness_attribute": 'SELECT "Column", "Attribute", round(greatest(0e0, avg(a)), 6) AS "TimelinessMean", '
        'round(greatest(0e0, max(b)), 6) AS "TimelinessMax", round(greatest(0e0, min(c)), 6) AS "TimelinessMin", '
        f"1e0 AS \"Confidence\", '{NOW}' AS \"AnalysisTime\" FROM ({EVENT_GROUPS}) GROUP BY 1, 2",
        "timeliness_tuple": f'SELECT event_id, round(greatest(0e0, {EVENT_FRESH}), 6) AS "TIMELINESS_ts" FROM events',
        "volume_global": "SELECT round(least(1e0, count(*) / (SELECT count(*) FROM orders)), 6) AS \"Volume\", "
        f'count(*) AS "Volume(TotalRows)" FROM {placed}',
        "volume_value": _key_union(
            "SELECT '{label}' AS \"Attribute\", {value} AS \"Value\", count(*) AS \"Count\", "
            'round(count(*) / (SELECT count(*) FROM orders), 6) AS "VolumeValue"',
            ORDER_KEYS,
            f"FROM {placed} GROUP BY {{group}}",
        ),
        "distinctness_global": duplicates.format(table="part", columns="p_name, p_brand"),
        "distinctness_global_lineitem": duplicates.format(table="lineitem", columns="l_partkey, l_suppkey"),
        "assessed_distinctness": "SELECT *, 1e0 AS \"Confidence\" FROM ("
        + duplicates.format(table="lineitem", columns="l_partkey, l_suppkey")
        + ")",
        "distinctness_attribute": " UNION ALL ".join(
            f"SELECT '{'_'.join(key)}' AS \"Attribute\", count(*) AS \"DistinctCount\", "
            f"round(count(*) / sum(n), 6) AS \"Distinctness\", 1e0 AS \"Confidence\" FROM "
            f"(SELECT count(*) AS n FROM part GROUP BY {', '.join(key)})"
            for key in (PART_COLUMNS, ["p_brand"], ["p_name"])
        ),
        "consistency_value": _rule_value_sql("part", PART_RULES),
        "consistency_attribute": 'SELECT ant AS "RuleAntecedent", cons AS "RuleConsequent", '
        'round(avg(q), 6) AS "ConsistencyValue", 1e0 AS "Confidence" '
        f"FROM ({_rule_sql('part', PART_RULES)}) GROUP BY rule, ant, cons",
        "consistency_value_lineitem": _rule_value_sql("lineitem", [(("l_returnflag",), ("l_linestatus",))]),
        "association_consistency_tuple": "SELECT c_custkey, "
        "(CASE WHEN (c_nationkey, c_mktsegment) IN (SELECT (c_nationkey, c_mktsegment) FROM customer "
        "WHERE c_acctbal < 0) THEN 1 ELSE 0 END + CASE WHEN c_nationkey IN (SELECT n_nationkey FROM nation JOIN "
        "region ON n_regionkey = r_regionkey WHERE r_name IN ('AFRICA', 'AMERICA', 'ASIA')) THEN 1 ELSE 0 END) / 2 "
        'AS "ASSOCIATION_CONSISTENCY" FROM customer',
        "select_interval_string": "SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders "
        "WHERE CAST(o_totalprice AS VARCHAR) BETWEEN '100' AND '20' OR CAST(o_totalprice AS VARCHAR) >= '9'",
        "select_interval_typed": "SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem "
        "WHERE (l_quantity <= 5 OR l_quantity BETWEEN 40 AND 45) AND l_discount >= 0.05e0",
        "select_interval_timestamp": "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN "
        "TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1996-12-31 23:59:59' "
        "OR o_orderdate >= TIMESTAMP '1999-01-01 00:00:00'",
        "select_values": "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders "
        "WHERE o_orderstatus IN ('O', 'F') AND o_orderpriority IN ('1-URGENT', '2-HIGH')",
        "select_values_table": "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey "
        "FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')",
        "drop_null_rows": f"WITH {DIRTY} SELECT * FROM dirty WHERE o_orderpriority IS NOT NULL",
        "null_to_text": f"WITH {DIRTY} SELECT "
        + ", ".join(f"coalesce(CAST({c} AS VARCHAR), 'null') AS {c}" for c in DIRTY_COLUMNS)
        + " FROM dirty",
        "sample_hash": f"SELECT o_orderkey, o_custkey FROM orders WHERE {hashed}",
        "structure_text": "SELECT CAST(o_orderkey AS VARCHAR) AS orderkey, CAST(o_custkey AS VARCHAR) AS custkey, "
        f"o_orderstatus AS status, CAST({cents} // 100 AS VARCHAR) || '.' || CAST({cents} % 100 AS VARCHAR) "
        "AS price FROM orders",
        "read_json_rows": "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, "
        "o_orderstatus, o_orderpriority FROM orders",
        "analysed_files": 'SELECT source AS "fileName" FROM documents GROUP BY source '
        "HAVING count(*) FILTER (WHERE n_chars < 200) * 25 <= count(*)",
        "final_quality": _final_quality_sql(),
        "assessed_values": _assessed_values_sql(),
        "extended_dataset": "WITH spenders AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' "
        "AND value > 100) SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id, "
        f"event_type, props, 1e0 AS \"COMPLETENESS_MISSING\", round(greatest(0e0, {EVENT_FRESH}), 6) "
        'AS "TIMELINESS_ts", CASE WHEN user_id IN (SELECT user_id FROM spenders) THEN 1e0 ELSE 0e0 END '
        'AS "ASSOCIATION_CONSISTENCY" FROM events',
        "long_report": f"WITH seen AS (SELECT * FROM orders WHERE o_orderstatus = 'O' AND {hashed}) "
        + " UNION ALL ".join(
            f"SELECT '{metric}' AS \"Metric\", round(CAST({expression} AS DOUBLE), 6) AS \"Value\", "
            '0.25e0 AS "Confidence" FROM seen'
            for metric, expression in (
                ("Volume", "count(*) / (SELECT count(*) FROM orders)"),
                ("Volume(TotalRows)", "count(*)"),
                ("Precision_o_totalprice", "greatest(0e0, 1e0 - stddev_pop(o_totalprice) / abs(avg(o_totalprice)))"),
                ("Precision(Deviation)_o_totalprice", "stddev_pop(o_totalprice)"),
                ("Completeness_Missing", "count(*) / count(*)"),
            )
        ),
        "mean_confidence": "SELECT avg(c) AS \"Confidence\" FROM (SELECT 0.25e0 AS c FROM orders)",
    }
    sql["mixed_confidence"] = "SELECT round((5 * 0.25e0 + 6 * 1e0) / 11, 6) AS \"Confidence\" FROM (SELECT count(*) FROM orders)"
    sql["completeness_frequency_commas"] = f"""
        WITH seen AS (SELECT ts, event_id, hour(ts) AS h, CASE WHEN event_id % 2 = 0 THEN event_type || ',b' ELSE event_type END AS a,
          CASE WHEN event_id % 2 = 0 THEN 'c' ELSE 'b,c' END AS c FROM events),
        rates AS (SELECT a, c, h, count(*) / ({DAYS} * 3600e0) AS f FROM seen GROUP BY a, c, h),
        counts AS (SELECT a, c, h, count(*) AS n, min(ts) AS lo, max(ts) AS hi FROM seen WHERE event_id % 3 <> 0 GROUP BY a, c, h),
        rolled AS (SELECT a, c, sum(n) AS n, date_diff('microsecond', min(lo), max(hi)) / 1e6 AS e, avg(f) AS f
          FROM counts JOIN rates USING (a, c, h) GROUP BY a, c)
        SELECT 'a_c' AS "Attribute", a || ',' || c AS "Value", CAST(n AS BIGINT) AS "RecordNumber",
          round(least(1e0, n / (e * f)), 6) AS "CompletenessFrequencyValue" FROM rolled WHERE e * f > 0"""
    sql["select_interval_text_timestamp"] = (
        "SELECT event_id, event_type FROM events WHERE event_id % 10 <> 0 "
        "AND ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'"
    )
    sql["interval_on_nulls"] = f"WITH {DIRTY} SELECT * FROM dirty WHERE o_orderpriority >= '2-HIGH'"
    sql["read_allow_lists"] = sql["association_consistency_tuple"]
    sql["allow_list_numbers"] = (
        "SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_quantity = 5 THEN 1e0 WHEN l_quantity IN (7, 9) THEN 0.5e0 "
        'ELSE 0e0 END AS "ASSOCIATION_CONSISTENCY" FROM lineitem'
    )
    sql["read_text_structured"] = sql["structure_text"]
    sql["metadata_round_trip"] = sql["update_rate_values"]
    sql["source_quality_copy"] = "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus"
    sql["keep_existing_output"] = (
        "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O'"
    )
    sql["text_sink"] = (
        "SELECT CAST(c_custkey AS VARCHAR) || ';' || c_mktsegment || ';' || CAST(c_nationkey AS VARCHAR) AS value FROM customer"
    )
    sql["extended_sink"] = sql["extended_dataset"]
    stored_rules = op.rule_set(["p_type:p_brand", "p_brand:p_type"], [("p_brand", "p_type"), ("p_brand,p_type", "p_size")])
    sql["stored_and_custom_rules"] = _rule_value_sql("part", stored_rules)
    sql["sample_bernoulli_facts"] = (
        "SELECT true AS is_subset, true AS is_unique, true AS share_fits, true AS same_again FROM (SELECT count(*) FROM orders)"
    )
    complete = "kind IS NOT NULL AND amount IS NOT NULL"
    precision = "greatest(0e0, 1e0 - stddev_pop(amount) / abs(avg(amount)))"
    sql["final_quality_dirty"] = f"""WITH {DIRTY_EVENTS},
        seen AS (SELECT * FROM dirty WHERE {complete}), groups AS (SELECT count(*) AS c FROM seen GROUP BY kind, amount)
        SELECT round(least(1e0, count(*) / (SELECT count(*) FROM dirty)), 6) AS "Volume", count(*) AS "Volume(TotalRows)",
          round({precision}, 6) AS "Precision_amount", round(stddev_pop(amount), 6) AS "Precision(Deviation)_amount",
          (SELECT round(avg({_present("kind")} + {_present("amount")}) / 2, 6) FROM dirty) AS "Completeness_Missing",
          (SELECT round(greatest(0e0, 1e0 - coalesce(sum(c / 2) FILTER (WHERE c / 2 > 1), 0) / sum(c)), 6) FROM groups) AS "Distinctness",
          1e0 AS "Confidence" FROM seen"""
    sql["assessed_attributes"] = f"""WITH {DIRTY_EVENTS}, seen AS (SELECT * FROM dirty WHERE {complete}),
        kinds AS (SELECT kind, {precision} AS p FROM seen GROUP BY kind)
        SELECT 'kind' AS "Attribute", 'CompletenessMissingValue' AS "Metric", round(avg({_present("kind")}), 6) AS "Result" FROM dirty
        UNION ALL SELECT 'kind', 'DistinctCount', CAST(count(*) AS DOUBLE) FROM kinds
        UNION ALL SELECT 'kind', 'Precision', round(avg(p), 6) FROM kinds"""
    return {**sql, **_training_data_sql()}
