"""Numbers held as text: recognition, conversion and rendering (V2-V4, V6)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import (
    JSON_NULL_TOKENS,
    WHITESPACE,
    clean,
    col,
    is_null_token,
)

# The layout of a decimal number in text, digits may be grouped with "_".
_DIGITS = r"\d+(?:_\d+)*"
NUMBER = rf"^([+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?)$"
_PLAIN = r"^(?:0|-?[1-9][0-9]{0,14})\z"
_PART = 2.0**40

# What `unquote` removes. Every pattern needs one character to remain, so a cell of
# nothing but quote marks stays as it is.
_QUOTES = {
    "fast": (r"""(?s)^["'](.+)["']$""", "$1"),
    "quoted": (r"""(?s)^(["'])\s*(\S|\S.*?\S)\s*\1$""", "$2"),
    "greedy_quotes": (r"""(?s)^["'\s]*([^"'\s]|[^"'\s].*[^"'\s])["'\s]*$""", "$1"),
}


def numeric(c: Column | str) -> Column:
    """Text to double; NULL for anything but a decimal number.

    The pattern keeps out what the cast alone would take (`1d`, `0x10`, `nan`, `inf`)
    and lets `1_000` in. Input is used once, so the expression stays small when this
    is nested in others. What is no number is NULL before the cast, as a cast that fails
    costs an exception, many times what the pattern costs.
    """
    number = F.get(F.regexp_extract_all(clean(c), F.lit(NUMBER), F.lit(1)), F.lit(0))
    return F.replace(number, F.lit("_"), F.lit("")).try_cast("double")


def plain_whole(c: Column | str) -> Column:
    """The bigint of a cell that is an integer in its plain digits and exact as a double, else NULL. Such a
    cell is its own trimmed, unquoted and shown text, so it needs no pattern."""
    return F.when(col(c).rlike(_PLAIN), col(c)).try_cast("bigint")


def unquote(c: Column | str, style: str = "fast") -> Column:
    """Remove quote marks around a cell; the result is trimmed.

    fast: one outer pair, marks may differ. quoted: one matching pair and the blanks
    inside it. greedy_quotes: every quote mark at either end.
    """
    if style not in _QUOTES:
        raise ValueError(f"unknown quote style: {style}")
    pattern, kept = _QUOTES[style]
    return F.regexp_replace(clean(c), pattern, kept)


def plain_number(x: Column) -> Column:
    """V6: a double without exponent; integral values as integers, others to 17 places.

    Integers are shown by their exact value up to 2**103, above that by the digits that
    tell the double apart, followed by zeros.
    """
    whole = (F.abs(x) >= 2.0**53) | (x == F.floor(x))  # floor() stops at the largest bigint
    high = F.floor(x / _PART)
    low = x - high.cast("double") * _PART
    exact = high.cast("decimal(20,0)") * F.lit(int(_PART)).cast("decimal(14,0)") + low.cast("decimal(14,0)")
    digits = F.regexp_replace(x.try_cast("decimal(38,17)").cast("string"), r"\.?0+$", "")
    return (
        F.when(F.isnan(x), F.lit("nan"))
        .when(whole & (F.abs(x) < 9e18), x.cast("bigint").cast("string"))
        .when(whole & (F.abs(x) < 2.0**102), exact.cast("string"))
        .when(F.abs(x) >= 2.0**102, F.format_string("%.0f", x))
        .when((x < 0) & (digits == "0"), F.lit("-0"))
        .otherwise(digits)
    )


def float_text(x: Column) -> Column:
    """A double as text that always shows it is a double: 8 becomes `8.0`."""
    text = plain_number(x)
    return F.when(text.rlike(r"^-?\d+$"), F.concat(text, F.lit(".0"))).otherwise(text)


def format_number_plain(c: Column | str) -> Column:
    """V6 over a double column; NULL becomes ''."""
    x = col(c).cast("double")
    return F.coalesce(plain_number(x), F.lit(""))


def to_double(c: Column | str) -> Column:
    """V3e: response value to double; thousands separators and inner spaces dropped."""
    t = clean(c)
    squeezed = F.translate(t, "," + WHITESPACE, "")
    x = numeric(squeezed)
    return F.when(F.abs(x) < float("inf"), x)


def to_number(c: Column | str, style: str = "fast") -> Column:
    """V3a-V3d: the cell as number text where it is a number, else as text.

    fast, quoted and greedy_quotes strip quote marks and print integral values as
    integers; json maps null tokens to NULL, drops `,` and spaces, and prints a
    number that carries a point as a double.
    """
    raw = col(c).cast("string")
    if style == "json":
        t = clean(raw)
        squeezed = F.translate(t, ", ", "")
        x = numeric(squeezed)
        whole = F.regexp_replace(F.replace(squeezed, F.lit("_"), F.lit("")), r"^([+-]?)0+(?=\d)", "$1")
        whole = F.regexp_replace(F.regexp_replace(whole, r"^\+", ""), r"^-0$", "0")
        is_whole = squeezed.rlike(r"^[+-]?\d+(_\d+)*$")
        return (
            F.when(is_null_token(raw, JSON_NULL_TOKENS), F.lit(None).cast("string"))
            .when(is_whole, whole)
            .when(squeezed.contains(".") & x.isNotNull(), float_text(x))
            .otherwise(t)
        )
    inner = unquote(raw, style)
    x = numeric(inner)
    finite = F.abs(x) < float("inf")
    return (
        F.when(raw.isNull() | (clean(raw) == ""), raw)
        .when(finite, plain_number(x))
        .otherwise(inner)
    )


def difference(left: Column | str, right: Column | str) -> Column:
    """V4: left - right to 6 places; missing counts as 0, other text gives NULL."""
    lraw, rraw = col(left).cast("string"), col(right).cast("string")
    lv = F.when(lraw.isNull() | (lraw == ""), F.lit(0.0)).otherwise(numeric(lraw))
    rv = F.when(rraw.isNull() | rraw.isin("", "null"), F.lit(0.0)).otherwise(numeric(rraw))
    return F.round(lv - rv, 6)
