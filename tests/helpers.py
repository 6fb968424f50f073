"""Small helpers shared by the tests."""


def rows(df, *order):
    """Rows as dicts, sorted by the given columns."""
    out = [row.asDict() for row in df.collect()]
    return sorted(out, key=lambda r: tuple(str(r[c]) for c in order)) if order else out


def one(df):
    found = df.collect()
    assert len(found) == 1
    return found[0].asDict()


def by(df, *key):
    """Rows as a dict from key columns to the row."""
    out = {}
    for row in df.collect():
        k = tuple(row[c] for c in key)
        assert k not in out, k
        out[k[0] if len(k) == 1 else k] = row.asDict()
    return out


def plan_of(df):
    """Physical plan text."""
    return df._jdf.queryExecution().executedPlan().toString()


def raised(spark_call, text):
    """The call fails and the message holds the text."""
    try:
        spark_call()
    except Exception as error:  # noqa: BLE001
        assert text in str(error), str(error)[:500]
        return
    raise AssertionError("nothing raised")
