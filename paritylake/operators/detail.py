"""Report tables made from a comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import difference as gap
from ..functions.text import first_nonempty, quote
from . import keys as K
from .compare import Comparison

# Column names that identify a failed request, in order of preference.
ERROR_ID_NAMES = ("applyid", "apply_id", "custno", "cust_no", "use_credit_apply_id")
ERROR_TIME_NAMES = ("basetime", "base_time", "use_create_time", "create_time")


def _has_any(df: DataFrame, column: str) -> bool:
    return bool(df.where(F.col(quote(column)) != "").limit(1).count())


def diff_detail(
    cmp: Comparison, form: str | None = None, *, params: Sequence[str] = (), difference: bool = False,
    time_now: bool | None = None, sort: str | None = None, labels: Mapping[str, str] | None = None,
) -> DataFrame:
    """The list of differences in the layout of one report.

    table (R1): keys, time, customer, feature, right and left value. offline (R2): keys,
    customer, both times, feature, left and right value. response (R3): feature, the
    `params` context columns, left and right value (`null` when missing), optionally
    their numeric difference. `time_now` is appended in the last two; None adds it only
    if any row has one (offline), or if the column exists (response). `sort`: `key`
    (O2) or `feature` (O3). `labels` renames columns.
    """
    form = form or cmp.mode
    diffs = cmp.diffs()
    have = set(diffs.columns)
    keys = [F.col(quote(k)) for k in cmp.key_names]

    def ctx(name: str) -> Column:
        return F.col(quote(name)) if name in have else F.lit("").alias(name)

    if form == "table":
        cols = [*keys, ctx("time"), ctx("customer"), F.col("feature"), F.col("right_value"), F.col("left_value")]
    elif form == "offline":
        cols = [*keys, ctx("customer"), ctx("left_time"), ctx("right_time"), F.col("feature"),
                F.coalesce("left_value", F.lit("")).alias("left_value"),
                F.coalesce("right_value", F.lit("")).alias("right_value")]
        if "time_now" in have and (time_now if time_now is not None else _has_any(diffs, "time_now")):
            cols.append(ctx("time_now"))
    elif form == "response":
        cols = [F.col("feature"), *(F.col(quote(p)) for p in params or cmp.key_names),
                F.col("left_value"), F.coalesce("right_value", F.lit("null")).alias("right_value")]
        if difference:
            cols.append(gap("left_value", "right_value").alias("difference"))
        if "time_now" in have and time_now is not False:
            cols.append(ctx("time_now"))
    else:
        raise ValueError(f"unknown report form: {form}")
    out = diffs.select(*cols)
    if sort == "key":
        out = out.orderBy(*cmp.key_names, "feature")
    elif sort == "feature":
        out = out.orderBy("feature", *[c for c in cmp.key_names if c in out.columns])
    elif sort is not None:
        raise ValueError(f"unknown sort: {sort}")
    return out.withColumnsRenamed(dict(labels)) if labels else out


def only_report(cmp: Comparison, side: str, width: int | None = None) -> DataFrame:
    """One-sided rows in their own columns, cut or padded to `width` columns."""
    rows = cmp.left_only() if side == "left" else cmp.right_only()
    if width is None or width == len(rows.columns):
        return rows
    kept = [F.col(quote(c)) for c in rows.columns[:width]]
    extra = [F.lit("").alias(f"_{i}") for i in range(len(rows.columns), width)]
    return rows.select(*kept, *extra)


def error_report(
    df: DataFrame, *, id_column: K.Ref | None = None, time_column: K.Ref | None = None,
    error: str = "error",
) -> DataFrame:
    """Failed rows as record_id, base_time, error. The two columns are the given
    ones, else found by name, else empty."""
    names = df.columns

    def source(ref, wanted, parts) -> Column:
        if ref is not None:
            places = [K.resolve(names, ref)]
        else:
            places = K.find_named(names, wanted)
            places = places or [i for i, c in enumerate(names) if any(p in c.lower() for p in parts)][:1]
        return first_nonempty(*[F.col(quote(names[i])) for i in places]) if places else F.lit("")

    return df.where(F.col(quote(error)).isNotNull()).select(
        source(id_column, ERROR_ID_NAMES, ("applyid", "apply_id", "custno", "cust_no")).alias("record_id"),
        source(time_column, ERROR_TIME_NAMES, ("time", "date")).alias("base_time"),
        F.col(quote(error)).alias("error"),
    )
