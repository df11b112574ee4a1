"""Rounding one value to the decimal places of another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import numeric
from .text import clean, col

METHODS = ("none", "round", "double_round", "truncate", "ceil")
MODES = ("exact", "tolerance", "last_digit", "last_digit_2")
_SLACK = 1e-10
_SPLITTER = 134217729.0  # 2**27 + 1: halves the mantissa of a double
_NEAR_TIE = 1e-3
_FAR_FROM_ULP = 1e12
_EXACT_DOUBLE = 4503599627370496.0  # 2**52: no fraction bits above this


def decimal_places(c: Column | str) -> Column:
    """Digits after the point of a printed number, trailing zeros left out."""
    frac = F.split_part(clean(c), F.lit("."), F.lit(2))
    return F.coalesce(F.length(F.rtrim(frac, F.lit("0"))), F.lit(0))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, however often it is mentioned."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _halves(x: Column) -> tuple[Column, Column]:
    scaled = x * _SPLITTER
    high = scaled - (scaled - x)
    return high, x - high


def round_half_even(x: Column, places: Column) -> Column:
    """Round the exact binary value of a double, ties to even."""
    pair = F.struct(x.alias("x"), F.pow(F.lit(10.0), places).alias("p"))
    return _let(pair, lambda s: round_scaled(s["x"], s["p"]))


def round_scaled(x: Column, p: Column) -> Column:
    """`round_half_even` with the scale as a power of ten. Arguments are used many
    times: pass columns, not expressions.

    Away from a tie the product tells the answer. Near one, `x * p` has lost the bits
    that decide (2.675 is in binary just below its tie), so the product is taken with
    its rounding error, from two halves of each factor.
    """
    hi = x * p
    floor = F.floor(hi).cast("double")
    off = hi - (floor + 0.5)
    (xh, xl), (ph, pl) = _halves(x), _halves(p)
    lo = ((xh * ph - hi) + xh * pl + xl * ph) + xl * pl
    odd = F.pmod(floor, F.lit(2.0)) == 1
    up = (off > 0) | ((off == 0) & ((lo > 0) | ((lo == 0) & odd)))
    return (
        F.when((F.abs(off) > _NEAR_TIE) & (F.abs(hi) < _FAR_FROM_ULP), F.rint(hi) / p)
        .when(F.abs(hi) >= _EXACT_DOUBLE, x)
        .when(up, (floor + 1) / p)
        .otherwise(floor / p)
    )


def round_to_reference(src: Column | str, ref: Column | str, method: str = "round") -> Column:
    """Src as double with the decimal places of ref's text; NULL when either
    is no number (with method `none` only src has to be one)."""
    if method not in METHODS:
        raise ValueError(f"unknown rounding method: {method}")
    x = numeric(src)
    if method == "none":
        return x
    given = F.struct(x.alias("x"), decimal_places(ref).alias("d"), numeric(ref).isNotNull().alias("ok"))
    return _let(given, lambda s: F.when(s["ok"], round_number(s["x"], s["d"], method)))


def round_number(x: Column, places: Column, method: str) -> Column:
    """V15 for a double and a number of places."""
    if method not in METHODS:
        raise ValueError(f"unknown rounding method: {method}")
    if method == "none":
        return x
    if method == "round":
        return round_half_even(x, places)
    if method == "double_round":
        return round_half_even(round_half_even(x, places + 1), places)
    p = F.pow(F.lit(10.0), places)
    scaled = x * p
    if method == "truncate":
        whole = F.when(scaled < 0, F.ceil(scaled)).otherwise(F.floor(scaled)).cast("double")
    else:
        whole = F.ceil(scaled).cast("double")
    return F.when(F.abs(scaled) >= _EXACT_DOUBLE, x).otherwise(whole / p)


def diff_ignorable(
    ref: Column | str, diff: Column | str, mode: str = "exact", tolerance: float = 0.01
) -> Column:
    """May this difference be overlooked? A NULL difference never may."""
    if mode not in MODES:
        raise ValueError(f"unknown comparison mode: {mode}")
    d = F.abs(col(diff))
    if mode == "exact":
        out = d == 0
    elif mode == "tolerance":
        out = d <= F.lit(float(tolerance))
    else:
        units = F.lit(1.0 if mode == "last_digit" else 2.0)
        places = decimal_places(ref)
        out = F.when(places == 0, d <= units).otherwise(d <= units / F.pow(F.lit(10.0), places) + _SLACK)
    return F.coalesce(out, F.lit(False))
