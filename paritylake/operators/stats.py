"""Summaries of a comparison, dataset profiles and run history (A1-A10, O1).

Functions that take `stats` work on the table of `Comparison.stats()`, which has one
row per compared column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import quote


def _percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.round(F.when(whole > 0, part / whole * 100), 2), F.lit(0.0))


def overall_stats(stats: DataFrame) -> DataFrame:
    """A2: comparisons, matches, differences and the match rate (0 when empty)."""
    zero = F.lit(0).cast("bigint")
    out = stats.agg(
        F.coalesce(F.sum("total"), zero).alias("comparisons"),
        F.coalesce(F.sum("match"), zero).alias("matches"),
        F.coalesce(F.sum("mismatch"), zero).alias("diffs"),
    )
    return out.withColumn("match_pct", _percent(F.col("matches"), F.col("comparisons")))


def diff_summary(stats: DataFrame) -> DataFrame:
    """A3: differing features only, most differences first."""
    return (
        stats.where("mismatch > 0")
        .select("feature", F.col("mismatch").alias("diff_count"), "total",
                _percent(F.col("mismatch"), F.col("total")).alias("diff_pct"))
        .orderBy(F.desc("diff_count"), "feature")
    )


def class_counts(stats: DataFrame) -> DataFrame:
    """A4: how many features are clean and how many differ."""
    return stats.agg(
        F.count_if(F.col("mismatch") == 0).alias("clean_features"),
        F.count_if(F.col("mismatch") > 0).alias("differing_features"),
    )


def diff_key_count(cmp, approximate: bool = False) -> DataFrame:
    """A5: number of keys with any difference."""
    if approximate:
        keys = cmp.diff_keys()
        return keys.agg(F.approx_count_distinct(F.struct(*[quote(c) for c in keys.columns])).alias("diff_keys"))
    return cmp.diff_keys().agg(F.count(F.lit(1)).alias("diff_keys"))


def stats_report(stats: DataFrame, order: str = "feature") -> DataFrame:
    """The statistics sheet, by feature name or by falling mismatch rate."""
    out = stats.select(
        "feature", (F.col("mismatch") > 0).alias("differs"), "total", "match", "mismatch",
        _percent(F.col("match"), F.col("total")).alias("match_pct"),
        _percent(F.col("mismatch"), F.col("total")).alias("mismatch_pct"),
    )
    if order == "feature":
        return out.orderBy("feature")
    if order == "rate":
        rate = F.coalesce(F.col("mismatch") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0))
        return out.orderBy(rate.desc(), "feature")
    raise ValueError(f"unknown order: {order}")


def top_diffs(stats: DataFrame, n: int = 20) -> DataFrame:
    """O1: the n features with most differences."""
    return diff_summary(stats).limit(n)


def run_totals(rows: DataFrame, feature_count: int, error: str = "error") -> DataFrame:
    """Rows, successes, errors and features of a run."""
    e = F.col(quote(error))
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(e.isNull()).alias("success"),
        F.count_if(e.isNotNull()).alias("errors"),
    ).withColumn("features_count", F.lit(feature_count).cast("bigint"))


_PROFILED = ("count", "mean", "stddev", "min", "p25", "p50", "p75", "max")


_GRID, _FEW = 1_000, 10_000


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> dict[str, list[float | None]]:
    """Interpolated quantiles of number columns, exact.

    Each wanted rank is narrowed to an interval of values: a pass counts what lies below and within
    every interval and cuts it by an approximate grid, so an interval loses all but a few
    thousandths of its rows; the counts tell whether the cut still holds the rank, and if not,
    on which side it lies. Intervals of few rows, or of one value, are then read out. All columns share the
    passes: two for a million rows, four for 10^12, none of which sorts or keeps the table. Only
    a few numbers for each rank come to the driver.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(quote(c)).cast("double").alias("x")) for i, c in enumerate(columns)])
    cells = df.select(F.inline(cells)).where("x IS NOT NULL").select("i", (F.col("x") + F.lit(0.0)).alias("x"))  # one zero
    grid = [k / _GRID for k in range(_GRID + 1)]
    total: dict[int, int] = {}
    found: dict[tuple[int, int], float] = {}
    todo: dict[tuple[int, int], dict] = {}
    for r in cells.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("x", grid, 10 * _GRID).alias("q")).collect():
        total[r["i"]] = r["n"]
        spots = [p * (r["n"] - 1) for p in probabilities]
        for rank in {int(s) for s in spots} | {min(int(s) + 1, r["n"] - 1) for s in spots}:
            todo[r["i"], rank] = {"lo": r["q"][0], "hi": r["q"][-1], **_cut(r["q"], rank, 0, r["n"])}
    while todo:
        spans = [(i, rank, t["from"], t["to"]) for (i, rank), t in todo.items()]
        spans = df.sparkSession.createDataFrame(spans, "i int, rank bigint, lo double, hi double")
        within = F.col("x").between(F.col("lo"), F.col("hi"))
        met = cells.join(F.broadcast(spans), "i").where(F.col("x") <= F.col("hi"))
        seen = met.groupBy("i", "rank").agg(
            F.count_if(F.col("x") < F.col("lo")).alias("below"), F.count_if(within).alias("inside"),
            F.count_if(F.col("x") == F.col("lo")).alias("first"), F.min(F.when(F.col("x") > F.col("lo"), F.col("x"))).alias("second"),
            F.percentile_approx(F.when(within, F.col("x")), grid, 10 * _GRID).alias("q")).collect()
        few = []
        for r in seen:
            key, t = (r["i"], r["rank"]), todo[r["i"], r["rank"]]
            if r["rank"] < r["below"]:  # the cut went too far
                t.update({"from": t["lo"], "to": t["from"]})
            elif r["rank"] >= r["below"] + r["inside"]:
                t.update({"from": t["to"], "to": t["hi"]})
            elif r["rank"] < r["below"] + r["first"]:
                found[key] = t["from"]
            elif r["inside"] <= _FEW:
                few.append((*key, t["from"], t["to"], r["rank"] - r["below"]))
            else:
                t.update({"lo": t["from"], "hi": t["to"], **_cut(r["q"], r["rank"], r["below"], r["inside"])})
                t["from"] = max(t["from"], r["second"])  # the first value is none: every pass leaves one out
        if few:
            spans = df.sparkSession.createDataFrame(few, "i int, rank bigint, lo double, hi double, at bigint")
            held = cells.join(F.broadcast(spans), "i").where(within).groupBy("i", "rank").agg(
                F.sort_array(F.collect_list("x")).alias("x"), F.first("at").alias("at"))
            found |= {(r["i"], r["rank"]): r["x"] for r in held.select("i", "rank", F.expr("x[cast(at as int)]").alias("x")).collect()}
        todo = {k: t for k, t in todo.items() if k not in found}
    out = {}
    for i, c in enumerate(columns):
        n, row = total.get(i, 0), []
        for p in probabilities:
            at = int(p * (n - 1)) if n else 0
            low = found.get((i, at))
            row.append(None if low is None else low + (found[i, min(at + 1, n - 1)] - low) * (p * (n - 1) - at))
        out[c] = row
    return out


def _cut(q: list[float], rank: int, below: int, n: int) -> dict[str, float]:
    """The part of an interval of n values, given by its grid, that should hold a rank."""
    at = (rank - below) / max(n - 1, 1) * _GRID
    return {"from": q[max(int(at) - 2, 0)], "to": q[min(int(at) + 3, _GRID)]}


def profile(df: DataFrame, quartiles: str | None = "approx") -> DataFrame:
    """One row per column: type, rows, nulls, and count/mean/stddev/min/max and
    quartiles of number columns.

    One aggregation pass. Quartiles: `approx` in the same pass, `exact` with a few more passes that all
    columns share (see `exact_quantiles`), None leaves them NULL.
    """
    if quartiles not in ("approx", "exact", None):
        raise ValueError(f"unknown quartiles: {quartiles}")
    fields = df.schema.fields
    cuts = [0.25, 0.5, 0.75]
    exact: dict[str, list[float | None]] = {}
    if quartiles == "exact":
        exact = exact_quantiles(df, [f.name for f in fields if isinstance(f.dataType, T.NumericType)], cuts)
    aggs: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        c = F.col(quote(f.name))
        aggs.append(F.count_if(c.isNull()).alias(f"n{i}"))
        if isinstance(f.dataType, T.NumericType):
            x = c.cast("double")
            if quartiles == "approx":
                q = F.percentile_approx(x, cuts)
            elif quartiles == "exact":
                q = F.array(*[F.lit(v).cast("double") for v in exact[f.name]])
            else:
                q = F.array(*[F.lit(None).cast("double")] * 3)
            if quartiles != "approx":
                q = F.first(q)
            aggs.append(F.struct(
                F.count(x).cast("double").alias("count"), F.avg(x).alias("mean"),
                F.stddev_samp(x).alias("stddev"), F.min(x).alias("min"), F.max(x).alias("max"),
                q.alias("q"),
            ).alias(f"d{i}"))
    wide = df.agg(*aggs)
    rows = []
    none = F.lit(None).cast("double")
    for i, f in enumerate(fields):
        d = F.col(f"d{i}") if isinstance(f.dataType, T.NumericType) else None
        values = {m: none if d is None else d[m] for m in ("count", "mean", "stddev", "min", "max")}
        for n, m in enumerate(("p25", "p50", "p75")):
            values[m] = none if d is None else F.get(d["q"], F.lit(n))
        rows.append(F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"), F.col("rows"),
            F.col(f"n{i}").alias("null_count"),
            *[values[m].cast("double").alias(m) for m in _PROFILED],
        ))
    return wide.select(F.inline(F.array(*rows)))


def shape(df: DataFrame) -> DataFrame:
    """A8, basic form: row count, column count and column names."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(df.columns)).alias("cols"),
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
    )


def run_delta(
    history: DataFrame, by: Sequence[str] = (), start: str = "start_time", duration: str = "duration",
    status: str = "status", errors: str = "errors",
) -> DataFrame:
    """A10: the latest run against the one before it, per `by` group (or overall).

    Two rows per group are kept before the shuffle; there is no window over the
    whole history in one task. Groups with a single run are left out.
    """
    cols = [F.col(quote(c)).alias(n) for c, n in
            ((start, "start_time"), (duration, "duration"), (status, "status"), (errors, "errors"))]
    groups = list(by)
    rows = history.select(*[F.col(quote(b)) for b in groups], *cols)
    order = [F.desc("start_time"), F.desc(F.xxhash64("start_time", "duration", "status", "errors"))]
    if groups:
        w = Window.partitionBy(*groups).orderBy(*order)
        two = rows.withColumn("rank", F.row_number().over(w)).where("rank <= 2")
    else:
        two = rows.orderBy(*order).limit(2).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    run = F.struct("start_time", "duration", "status", "errors")
    pair = two.groupBy(*groups).agg(
        F.max_by(run, F.when(F.col("rank") == 1, 1)).alias("cur"),
        F.max_by(run, F.when(F.col("rank") == 2, 1)).alias("prev"),
    ).where(F.col("prev").isNotNull())
    before, now = F.col("prev.duration").cast("double"), F.col("cur.duration").cast("double")
    gain = F.when(before != 0, F.round((before - now) / before * 100, 2)).otherwise(F.lit(0.0))
    return pair.select(
        *groups,
        F.col("cur.start_time").alias("current_start"), F.col("prev.start_time").alias("previous_start"),
        now.alias("current_duration"), before.alias("previous_duration"),
        F.coalesce(gain, F.lit(0.0)).alias("duration_improvement"),
        F.col("cur.status").eqNullSafe(F.col("prev.status")).alias("status_same"),
        (F.col("cur.errors") < F.col("prev.errors")).alias("errors_reduced"),
    )
