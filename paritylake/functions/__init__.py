"""Column builders: no action, no Python UDF."""

from .cells import cells_equal, numbers_equal
from .decimals import decimal_places, diff_ignorable, round_half_even, round_to_reference
from .numbers import (
    difference,
    float_text,
    format_number_plain,
    numeric,
    plain_number,
    to_double,
    to_number,
    unquote,
)
from .text import clean, first_nonempty, is_null_token, non_empty, text_guard
from .times import normalize_ts, plus_one_second, request_time, to_standard_time

__all__ = [
    "cells_equal", "clean", "decimal_places", "diff_ignorable", "difference",
    "first_nonempty", "float_text", "format_number_plain", "is_null_token", "non_empty",
    "normalize_ts", "numbers_equal", "numeric", "plain_number", "plus_one_second", "request_time",
    "round_half_even", "round_to_reference", "text_guard", "to_double", "to_number",
    "to_standard_time", "unquote",
]
