from .cells import (
    MISSING_TOKENS,
    at_least_zero,
    at_most_one,
    column,
    complete_row,
    data_type,
    decimal_commas_to_dots,
    group_cell,
    is_missing,
    is_missing_text,
    key_part,
    key_text,
    ratio,
    strip_backslashes,
    strip_quotes,
    to_number,
)
from .instants import (
    BOUND_FORMAT,
    TYPED_FORMAT,
    bound_instant,
    format_instant,
    instant_literal,
    parse_instant,
    seconds_between,
    spark_pattern,
    to_instant,
)

__all__ = [name for name in dir() if not name.startswith("_")]
