"""Random dirty text tables against plain Python loops over the definitions."""

import random
from collections import Counter, defaultdict

import pytest

from gaugeframe import operators as op
from helpers import by, one, rows

MISSING = {None, "", "nan", "null"}
CELLS = [None, "", "nan", "null", "a", "b", "a,b", "7"]
KEYS = [["x"], ["y", "x"], ["z"]]


def text(cell):
    return "null" if cell is None else cell


@pytest.fixture(params=[1, 2, 3])
def data(request, spark):
    """A third of the rows are copies of one row."""
    draw = random.Random(request.param)
    records = [tuple(draw.choice(CELLS) for _ in range(3)) for _ in range(200)]
    records += [("a", "a,b", "7")] * 100
    return records, spark.createDataFrame(records, "x string, y string, z string").repartition(4)


def positions(key):
    return ["xyz".index(name) for name in key]


def grouped(records, key):
    out = defaultdict(list)
    for record in records:
        out[tuple(text(record[i]) for i in positions(key))].append(record)
    return out


def test_missing(data):
    records, df = data
    present = sum(cell not in MISSING for record in records for cell in record)
    assert one(op.completeness_missing_global(df, ["x", "y", "z"]))["Completeness_Missing"] == present / 900

    attributes = by(op.completeness_missing_attribute(df, KEYS), "Attribute")
    found = Counter(map(str, rows(op.completeness_missing_value(df, ["x", "y", "z"], KEYS))))
    expected = Counter()
    for key in KEYS:
        name, at = "_".join(key), positions(key)
        missing = 0 if len(key) > 1 else sum(record[at[0]] in MISSING for record in records)
        assert attributes[name]["MissingValues"] == missing
        assert attributes[name]["CompletenessMissingValue"] == (300 - missing) / 300
        for parts, members in grouped(records, key).items():
            if ",".join(parts) in MISSING:
                continue
            others = [record[i] for record in members for i in range(3) if i not in at]
            good = sum(cell not in MISSING for cell in others)
            row = {
                "Attribute": name,
                "Value": ",".join(parts),
                "MissingValues": len(others) - good,
                "CompletenessMissingValue": good / len(others),
            }
            expected[str(row)] += 1
    assert found == expected


def test_counts(data):
    records, df = data
    complete = [record for record in records if None not in record]
    kept = op.drop_incomplete(df)
    found = Counter((r["Attribute"], r["Value"], r["Count"]) for r in rows(op.volume_value(kept, df, KEYS)))
    distinct = by(op.distinctness_attribute(kept, KEYS), "Attribute")
    expected = Counter()
    for key in KEYS:
        groups = grouped(complete, key)
        assert distinct["_".join(key)]["DistinctCount"] == len(groups)
        for parts, members in groups.items():
            expected["_".join(key), ",".join(parts), len(members)] += 1
    assert found == expected

    mass = sum(n / 2 for n in Counter(complete).values() if n / 2 > 1)
    assert one(op.distinctness_global(kept, ["x", "y", "z"]))["Distinctness"] == pytest.approx(
        max(0.0, 1 - mass / len(complete))
    )


def test_rules(data):
    records, df = data
    rules = op.rule_set(["x:y", "y,z:x"])
    scores = op.rule_scores(op.drop_incomplete(df), rules)
    found = Counter((r["rule"], r["AntecedentValue"], round(r["ConsistencyValue"], 9)) for r in rows(scores))
    expected = Counter()
    complete = [record for record in records if None not in record]
    for number, (ant, cons) in enumerate(rules):
        pairs = defaultdict(Counter)
        for record in complete:
            pairs[tuple(record[i] for i in positions(ant))][tuple(record[i] for i in positions(cons))] += 1
        for parts, counts in pairs.items():
            share = max(counts.values()) / sum(counts.values())
            expected[number, ",".join(parts), round(share, 9)] += 1
    assert found == expected


def test_association(data, spark):
    records, df = data
    pairs = [("a", "b"), ("a", "a,b"), (None, "7"), ("null", "a"), ("a", "b")]
    singles = [("7",), (None,)]
    lists = [spark.createDataFrame(pairs, "x string, y string"), spark.createDataFrame(singles, "z string")]
    found = Counter(
        (r["x"], r["y"], r["z"], float(r["ASSOCIATION_CONSISTENCY"]))
        for r in rows(op.association_consistency(df, lists, ["x", "y", "z"]))
    )
    valid_pairs = {(text(a), text(b)) for a, b in pairs}
    valid_singles = {text(a) for a, in singles}
    expected = Counter(
        (x, y, z, (((text(x), text(y)) in valid_pairs) + (text(z) in valid_singles)) / 2) for x, y, z in records
    )
    assert found == expected


def test_row_completeness(data):
    records, df = data
    found = Counter(float(r["COMPLETENESS_MISSING"]) for r in rows(op.row_completeness(df)))
    assert found == Counter(sum(cell not in MISSING for cell in record) / 3 for record in records)
