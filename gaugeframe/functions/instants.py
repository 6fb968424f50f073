"""Time expressions. All instants are zone-less (TIMESTAMP_NTZ), so results do not
depend on the session time zone."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cells import INVALID_POLICIES, column, data_type

# Strptime directive -> Spark pattern (padded form).
DIRECTIVES = {
    "%d": "dd",
    "%m": "MM",
    "%y": "yy",
    "%Y": "yyyy",
    "%H": "HH",
    "%I": "hh",
    "%M": "mm",
    "%S": "ss",
    "%f": "SSSSSS",
    "%p": "a",
    "%b": "MMM",
    "%B": "MMMM",
    "%j": "DDD",
}

# Format used to display the analysis time of columns that are already timestamps.
TYPED_FORMAT = "%Y-%m-%d %H:%M:%S"

# Format of interval bounds on timestamp columns.
BOUND_FORMAT = "%d/%m/%Y %H.%M.%S"

# Two-digit years: 69-99 are 19xx in strptime, always 20xx in Spark.
PIVOT_YEAR = 2069


def _tokens(fmt: str) -> list[str]:
    out, i = [], 0
    while i < len(fmt):
        step = 2 if fmt[i] == "%" else 1
        out.append(fmt[i : i + step])
        i += step
    return out


def spark_pattern(fmt: str, lenient: bool = False) -> str:
    """Spark datetime pattern for a strptime/strftime format.

    ``lenient`` (for parsing) lets day, month and clock fields have one digit where a
    literal ends the field; touching fields stay padded.
    """
    tokens = _tokens(fmt)
    out = []
    for i, token in enumerate(tokens):
        if token == "%%":
            out.append("%")
        elif token.startswith("%"):
            if token not in DIRECTIVES:
                raise ValueError(f"unsupported time directive {token!r} in {fmt!r}")
            pattern = DIRECTIVES[token]
            touching = any(
                t.startswith("%") and t != "%%" for t in tokens[max(i - 1, 0) : i] + tokens[i + 1 : i + 2]
            )
            if lenient and not touching and token in ("%d", "%m", "%H", "%I", "%M", "%S", "%j"):
                pattern = pattern[0]
            out.append(pattern)
        elif token == "'":
            out.append("''")
        elif token.isalpha() or token in "[]{}#":
            out.append(f"'{token}'")
        else:
            out.append(token)
    return "".join(out)


def to_instant(df: DataFrame, name: str, fmt: str | None = None, on_invalid: str = "fail") -> Column:
    """Zone-less timestamp of a cell; text needs its strptime format."""
    if on_invalid not in INVALID_POLICIES:
        raise ValueError(f"on_invalid must be one of {INVALID_POLICIES}")
    cell, kind = column(name), data_type(df, name)
    if isinstance(kind, T.TimestampNTZType):
        return cell
    if not isinstance(kind, T.StringType):
        return cell.cast("timestamp_ntz")
    if not fmt:
        raise ValueError(f"text column {name!r} needs a time format")
    return parse_instant(cell, fmt, on_invalid)


def parse_instant(text: Column, fmt: str, on_invalid: str = "fail") -> Column:
    pattern = spark_pattern(fmt, lenient=True)
    if on_invalid == "fail":
        parsed = F.to_timestamp_ntz(text, F.lit(pattern))
    else:
        parsed = F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")
    if "%y" in _tokens(fmt):
        century = F.make_ym_interval(F.lit(100))
        parsed = F.when(F.year(parsed) >= PIVOT_YEAR, parsed - century).otherwise(parsed)
    return parsed


def instant_literal(now: dt.datetime | str) -> Column:
    """Literal zone-less timestamp from a naive datetime or ISO text."""
    text = now.isoformat(sep=" ") if isinstance(now, dt.datetime) else now
    return F.lit(text).cast("timestamp_ntz")


def bound_instant(bound: dt.datetime | str) -> Column:
    """Interval bound: a datetime, or text in BOUND_FORMAT."""
    if not isinstance(bound, dt.datetime):
        bound = dt.datetime.strptime(bound, BOUND_FORMAT)
    return instant_literal(bound)


def seconds_between(start: Column, end: Column) -> Column:
    """Signed seconds from start to end with microseconds, as a double."""
    elapsed = (end - start).cast("interval second")
    return elapsed.cast(T.DecimalType(18, 6)).cast("double")


def format_instant(instant: Column, fmt: str | None) -> Column:
    return F.date_format(instant, spark_pattern(fmt or TYPED_FORMAT))
