import json
import os

import pytest
from pyspark.sql import functions as F

from gaugeframe import sources
from helpers import by, one, plan_of, raised, rows


def lines(folder, *texts):
    folder.parent.mkdir(parents=True, exist_ok=True)
    folder.write_text("".join(t + "\n" for t in texts), encoding="utf-8")
    return str(folder)


def test_rows_are_text_in_header_order(spark, tmp_path):
    path = lines(tmp_path / "a.json", json.dumps({"b": 1, "a": "SÃO"}), json.dumps({"a": None, "x": 2}))
    df = sources.read_rows(spark, path, ["a", "b"])
    assert df.dtypes == [("a", "string"), ("b", "string")]
    assert rows(df, "b") == [{"a": "SÃO", "b": "1"}, {"a": None, "b": None}]


def test_text_structuration(spark, tmp_path):
    path = lines(tmp_path / "u.txt", '"a";"1,5";"02\\/05";', "", '""', "b;2;x;")
    df = sources.structure_text(sources.read_text_lines(spark, path), r"([^;]+);", ["p", "q", "r"])
    assert rows(df, "p") == [{"p": "a", "q": "1.5", "r": "02/05"}, {"p": "b", "q": "2", "r": "x"}]


def test_text_structuration_options(spark):
    df = spark.createDataFrame([("1,5;",), ("7;8;",)], "value string")
    kept = sources.structure_text(df, "[^;]+", ["p"], decimal_commas=False, on_mismatch="null")
    assert [r["p"] for r in rows(kept, "p")] == ["1,5", "7"]
    raised(lambda: sources.structure_text(df, "[^;]+", ["p"]).collect(), "expected 1 fields, found 2")
    wide = sources.structure_text(df, "([^;]+);", ["p", "q"], on_mismatch="null")
    assert [r["q"] for r in rows(wide, "p")] == [None, "8"]
    with pytest.raises(ValueError):
        sources.structure_text(df, "(a)(b)", ["p"])


@pytest.fixture
def source_folder(spark, tmp_path):
    """A profiled source: catalogue, JSON rows, text updates and some metadata."""
    lines(
        tmp_path / "source_analysed_updates" / "part.json",
        *[json.dumps({"fileName": n, "correctAnalysis": ok}) for n, ok in (("one", 1), ("two", 1), ("bad", 0))],
    )
    for name in ("one", "two", "bad"):
        lines(tmp_path / "extended_dataset" / name / "part.json", json.dumps({"k": name, "x": "1"}))
        lines(tmp_path / "updates" / f"{name}.txt", f"{name};1;")
    lines(tmp_path / "update_rate_global_t" / "part.json", json.dumps({"Hour": 3, "Frequency": 0.5}))
    lines(tmp_path / "source_quality" / "part.json", json.dumps({"Volume": 1.0, "Confidence": 0.5}))
    return str(tmp_path)


def test_analysed_source(spark, source_folder):
    def names(**options):
        return sorted(r.k for r in sources.read_analysed_source(spark, source_folder, ["k", "x"], **options).collect())

    assert names() == ["one", "two"]
    assert names(requested=["two", "bad"]) == ["two"]
    assert names(requested=["two"], regex="([^;]+);") == ["two"]
    with pytest.raises(ValueError):
        names(requested=["bad"])


@pytest.mark.parametrize("regex", ["", "([^;]+);"])
def test_analysed_source_by_its_files(spark, tmp_path, regex):
    """Odd names, updates of several files, names that begin alike, an empty and a malformed update."""
    folder = tmp_path / "updates" / "extended_dataset" / "source x"
    names = ["a b", "a%20b", "a+b", "2024/one", "2024/one-more", "one.txt", "one", "empty", "\u00e4"]
    known = [*[(n, 1) for n in names], ("a b", 1), ("broken", 0), ("2024", 0)]
    lines(folder / "source_analysed_updates" / "c.json", *[json.dumps({"fileName": n, "correctAnalysis": ok}) for n, ok in known])
    for name in names:
        kept = [] if name == "empty" else [name]
        if regex:
            whole = folder / "updates" / f"{name}.txt"
            lines(whole / "part-1" if name == "one" else whole, *[f"{n};1;" for n in kept])
        else:
            for part in ("part-1.json", "part-2.json"):
                lines(folder / "extended_dataset" / name / part, *[json.dumps({"k": n, "x": part}) + "\n" for n in kept])
    lines(folder / "updates" / "broken.txt", "no fields")
    lines(folder / "extended_dataset" / "broken" / "part.json", "{no json")
    for base in (str(folder), f"file://{folder}", str(folder) + "/./"):
        found = sources.read_analysed_source(spark, base, ["k", "x"], regex=regex)
        wanted = sorted(n for n in names if n != "empty")
        assert sorted(r.k for r in found.collect()) == sorted(wanted * (1 if regex else 2))
    chosen = spark.createDataFrame([("2024/one",), ("broken",)], "fileName string")
    found = sources.read_analysed_source(spark, str(folder), ["k", "x"], chosen, regex)
    assert {r.k for r in found.collect()} == {"2024/one"}
    plan = plan_of(found)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    lines(folder / "source_analysed_updates" / "d.json", json.dumps({"fileName": "gone", "correctAnalysis": 1}))
    raised(lambda: sources.read_analysed_source(spark, str(folder), ["k", "x"], regex=regex), "PATH_NOT_FOUND")


def test_analysed_source_by_a_relative_path(spark, source_folder):
    path = os.path.relpath(source_folder)
    assert path.startswith("..")
    found = sources.read_analysed_source(spark, path, ["k", "x"])
    assert sorted(r.k for r in found.collect()) == ["one", "two"]


def test_analysed_source_malformed(spark, source_folder):
    """A malformed line of an analysed update raises, whichever way its files are chosen."""
    with open(f"{source_folder}/extended_dataset/one/part.json", "a", encoding="utf-8") as out:
        out.write("{no json\n")
    for requested in (None, ["one"]):
        raised(lambda: sources.read_analysed_source(spark, source_folder, ["k", "x"], requested).collect(), "MALFORMED")


def test_analysed_files_with_a_request_table(spark):
    catalogue = spark.createDataFrame([("a", 1), ("b", 1), ("c", 0)], "fileName string, correctAnalysis int")
    wanted = spark.createDataFrame([("b",), ("c",)], "fileName string")
    assert rows(sources.analysed_files(catalogue, wanted)) == [{"fileName": "b"}]
    assert sources.analysed_files(catalogue, []).count() == 2


def test_metadata(spark, source_folder):
    rates = sources.read_metadata(spark, source_folder, "update_rate_global", "t")
    assert one(rates) == {"Hour": 3, "Frequency": 0.5}
    assert sources.read_metadata(spark, source_folder, "association_rules") is None
    raised(lambda: sources.read_metadata(spark, source_folder, "association_rules", required=True), "PATH_NOT_FOUND")


def test_allow_lists(spark, tmp_path):
    good = lines(tmp_path / "a.json", '{"x": 1, "y": "b"}')
    other = lines(tmp_path / "b.json", '{"z": 1}')
    tables = sources.read_allow_lists(spark, [good, other, str(tmp_path / "none.json")], ["x", "y"])
    assert [t.dtypes for t in tables] == [[("x", "string"), ("y", "string")]]
    assert len(sources.read_allow_lists(spark, [good, other])) == 2


def test_source_quality_is_copied(spark, source_folder, tmp_path):
    sources.copy_source_quality(spark, source_folder, str(tmp_path / "out"))
    assert one(spark.read.json(str(tmp_path / "out" / "source_quality"))) == {"Volume": 1.0, "Confidence": 0.5}


def test_json_sink_modes(spark, tmp_path):
    path = str(tmp_path / "t")
    sources.write_json(spark.range(8).repartition(4), path, single_file=True)
    assert len(list((tmp_path / "t").glob("part-*.json"))) == 1
    sources.write_json(spark.range(3), path, mode="ignore")
    assert spark.read.json(path).count() == 8
    sources.write_json(spark.range(3), path)
    assert spark.read.json(path).count() == 3
    with pytest.raises(ValueError):
        sources.write_json(spark.range(1), path, mode="replace")


def test_text_sink_keeps_an_existing_output(spark, tmp_path):
    path = str(tmp_path / "times")
    sources.write_text(spark.createDataFrame([("Selection", 1.5)], "stage string, seconds double"), path)
    sources.write_text(spark.createDataFrame([("Other", 9.0)], "stage string, seconds double"), path)
    assert [r.value for r in spark.read.text(path).collect()] == ["Selection,1.5"]


def test_extended_sink_stays_parallel(spark, tmp_path):
    path = str(tmp_path / "x")
    sources.write_extended(spark.range(100).repartition(4), path, "parquet")
    assert len(list((tmp_path / "x").glob("part-*.parquet"))) == 4


def test_store_uses_the_shared_folder(spark):
    folder = sources.shared_folder(spark)
    assert folder == spark.conf.get("spark.checkpoint.dir")
    kept = sources.store(spark.range(5).withColumn("odd", F.col("id") % 2), "numbers")
    assert kept.count() == 5 and by(kept, "id")[3]["odd"] == 1
    files = kept.inputFiles()
    assert files and all(f"{folder}/numbers-" in path for path in files)


def test_malformed_lines_are_not_silent(spark, tmp_path):
    path = tmp_path / "bad"
    path.mkdir()
    (path / "part-0").write_text('{"x": "1", "y": "2"}\nno json\n', encoding="utf-8")
    raised(lambda: sources.read_rows(spark, str(path), ["x", "y"]).collect(), "MALFORMED_RECORD")
    assert len(sources.read_rows(spark, str(path), ["x", "y"], on_malformed="null").collect()) == 2
    raised(lambda: [t.collect() for t in sources.read_allow_lists(spark, [str(path)], ["x", "y"])], "MALFORMED")
    named = sources.read_allow_lists(spark, [str(path)], ["x", "y"], schemas={str(path): ["x", "y"]})
    raised(lambda: named[0].collect(), "MALFORMED_RECORD")


def test_stored_tables_are_removed(spark, tmp_path):
    with sources.stored_tables(spark) as folder:
        kept = sources.store(spark.range(5), "numbers")
        assert kept.count() == 5 and folder in kept.inputFiles()[0]
    raised(kept.count, "FILE_NOT_EXIST")
