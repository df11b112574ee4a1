"""Keep what still differs after rounding to the reference's decimal places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.decimals import METHODS, decimal_places, diff_ignorable, round_number, round_scaled
from ..functions.numbers import numeric, plain_number
from ..functions.text import quote
from . import keys as K
from .stage import compute


def decimal_reconcile(
    df: DataFrame, source: K.Ref, reference: K.Ref, *, method: str = "round", mode: str = "exact",
    tolerance: float = 0.01, full: bool = False,
) -> DataFrame:
    """Round `source` to the decimal places of `reference` and list remaining differences.

    The rounded column (`<source>_<method>`) stands behind the source, `difference`
    (reference - rounded, 10 places) last. Rows with a value that is no number have a
    NULL difference and are kept. `full=True` returns all rows.
    """
    names = df.columns
    at, by = K.resolve(names, source), K.resolve(names, reference)
    if method not in METHODS:
        raise ValueError(f"unknown rounding method: {method}")
    rounded = f"{names[at]}_{method}"
    rows = compute(
        df, __x=_number(df, names[at]), __ref=_number(df, names[by]), __text=_text(df, names[by])
    )
    places = decimal_places("__text")
    rows = compute(rows, __d=places, __p=F.pow(F.lit(10.0), places))
    x, p = F.col("__x"), F.col("__p")
    if method == "round":
        value = round_scaled(x, p)
    elif method == "double_round":
        rows = compute(rows, __p1=p * 10)
        rows = compute(rows, __once=round_scaled(x, F.col("__p1")))
        value = round_scaled(F.col("__once"), p)
    else:
        value = round_number(x, F.col("__d"), method)
    if method != "none":
        value = F.when(F.col("__ref").isNotNull(), value)
    rows = compute(rows, __rounded=value, __p10=F.lit(1e10))
    rows = compute(rows, __gap=F.col("__ref") - F.col("__rounded"))
    rows = compute(rows, difference=round_scaled(F.col("__gap"), F.col("__p10")))
    if not full:
        rows = rows.where(~diff_ignorable("__text", "difference", mode, tolerance))
    columns = [F.col(quote(n)) for n in names]
    columns.insert(at + 1, F.col("__rounded").alias(rounded))
    return rows.select(*columns, "difference")


def _is_number(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def _number(df: DataFrame, name: str) -> Column:
    c = F.col(quote(name))
    if not _is_number(df, name):
        return numeric(c)
    x = c.cast("double")
    return F.when(~F.isnan(x), x)


def _text(df: DataFrame, name: str) -> Column:
    c = F.col(quote(name))
    fractional = isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))
    return plain_number(c.cast("double")) if fractional else c.cast("string")
