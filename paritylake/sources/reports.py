"""The result tables of one run, each in its own sub-directory."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.compare import Comparison
from ..operators.detail import diff_detail
from ..operators.merge import merged_view, tagged_view
from ..operators.stats import diff_summary, overall_stats, stats_report
from .files import write_table

_SKIP_EMPTY = ("left_only", "right_only", "errors")


def report_tables(cmp: Comparison, *, full: bool = False, stats: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of a comparison by name; `full` adds the merged rows of both sides, with the
    comparison's own features, names and order of rows. `stats` are its statistics, if made already."""
    stats = cmp.stats() if stats is None else stats
    tables = {
        "summary": diff_summary(stats),
        "detail": diff_detail(cmp, sort="key" if cmp.mode == "table" else "feature"),
        "statistics": stats_report(stats, order="rate" if cmp.mode == "response" else "feature"),
        "overall": overall_stats(stats),
    }
    if cmp.mode != "response":
        tables["left_only"] = cmp.left_only()
        tables["right_only"] = cmp.right_only()
    if full and cmp.mode == "table":
        tables["merged"] = tagged_view(cmp)
    elif full:
        l, r = cmp.left, cmp.right
        places = [{f[at]: f[0] for f in cmp.feature_positions if f[at] is not None} for at in (1, 2)]
        tables["merged"] = merged_view(
            l.original(l.df), r.original(r.df), left_keys=cmp.left_keys, right_keys=cmp.right_keys,
            left_features=list(places[0]), right_features=list(places[1]), labels=(places[0], places[1]), exclude=(),
            order_by=cmp._lookup_order if cmp._lkp == "right" else (), key_policy=cmp.policy, skew=cmp.skew,
        )
    return tables


def write_reports(
    result: Comparison | Mapping[str, DataFrame], base_path: str, *, full: bool = False,
    fmt: str = "parquet", mode: str = "errorifexists",
) -> dict[str, str]:
    """Write the tables below `base_path` and return name -> path. Empty one-sided
    tables are skipped. The joined rows are kept while a comparison's tables are written."""
    cmp = result if isinstance(result, Comparison) else None
    stats = None
    if cmp is not None:
        cmp.persist()
        stats = cmp.stats().persist()
    try:
        tables = report_tables(cmp, full=full, stats=stats) if cmp is not None else dict(result)
        written = {}
        for name, df in tables.items():
            path = f"{base_path.rstrip('/')}/{name}"
            seen = Observation(name)
            write_table(df.observe(seen, F.count(F.lit(1)).alias("rows")), path, fmt=fmt, mode=mode)
            if name in _SKIP_EMPTY and seen.get["rows"] == 0:
                _remove(df, path)
            else:
                written[name] = path
        return written
    finally:
        if cmp is not None:
            cmp.unpersist()
            stats.unpersist()


def _remove(df: DataFrame, path: str) -> None:
    """Take back an empty table this run has just written."""
    sc = df.sparkSession.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
