"""The registered queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import streaming as ST
from ..functions import decimals as dec
from ..functions.cells import cells_equal
from ..functions.numbers import difference, format_number_plain, to_double, to_number
from ..functions.text import first_nonempty, text_guard
from ..functions.times import normalize_ts, plus_one_second, request_time, to_standard_time
from ..operators import catalogue
from ..operators import documents as D
from ..operators import keys as K
from ..operators import runs as R
from ..operators import stats as S
from ..operators.blocks import compare_by_blocks
from ..operators.compare import Comparison, compare, compare_nested, split_errors
from ..operators.detail import diff_detail, error_report, only_report
from ..operators.enrich import batch_enrich, enrich
from ..operators.merge import merge_columns, merge_rows, merged_view, tagged_view
from ..operators.reconcile import decimal_reconcile
from ..operators.skew import SkewPolicy
from ..operators.stage import fresh_dir, stored
from ..sources import files, preview, write_reports
from . import fixtures as X
from .scenarios import outcome_counts, run_scenarios

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


# -- SQL building blocks --------------------------------------------------------------

_NUM = r"[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?"


def num_sql(x: str) -> str:
    t = f"trim({x})"
    return f"(CASE WHEN regexp_full_match({t}, '{_NUM}') THEN TRY_CAST(replace({t}, '_', '') AS DOUBLE) END)"


def null_sql(x: str) -> str:
    return f"({x} IS NULL OR lower(trim({x})) IN ('', 'null', 'none'))"


def eq_sql(l: str, r: str, *, zero_nan: bool = False, fill: bool = False, tol: float | None = None) -> str:
    out = "(CASE "
    if zero_nan:
        def zn(x):
            return f"({null_sql(x)} OR lower(trim({x})) IN ('nan', 'na', 'n/a') OR coalesce({num_sql(x)} = 0, false))"
        out += f"WHEN {zn(l)} AND {zn(r)} THEN true "
    if fill:
        def df(x):
            return f"({null_sql(x)} OR coalesce({num_sql(x)} = -999, false))"
        out += f"WHEN {df(l)} AND {df(r)} THEN true "
    close = f"<= {tol!r}" if tol is not None else "< 1e-10"
    out += f"WHEN {null_sql(l)} AND {null_sql(r)} THEN true WHEN {null_sql(l)} OR {null_sql(r)} THEN false "
    out += f"WHEN {num_sql(l)} IS NOT NULL AND {num_sql(r)} IS NOT NULL THEN abs({num_sql(l)} - {num_sql(r)}) {close} "
    return out + f"ELSE trim({l}) = trim({r}) END)"


FEATURES = ("cust", "price", "priority", "status")


def cells_sql(**options) -> str:
    """CTE `cells(k, feature, l, r, same)` over the matched orders."""
    arms = " UNION ALL ".join(
        f"SELECT a.k, '{f}' AS feature, a.{f} AS l, b.{f} AS r FROM orders_a a JOIN orders_b b ON a.k = b.k"
        for f in FEATURES
    )
    return f"WITH {X.ORDERS_SQL}, raw AS ({arms}), cells AS (SELECT *, {eq_sql('l', 'r', **options)} AS same FROM raw)"


_PER_FEATURE = """
stats AS (SELECT feature, count(*) AS total, CAST(sum(CASE WHEN same THEN 1 ELSE 0 END) AS BIGINT) AS match,
                 CAST(sum(CASE WHEN same THEN 0 ELSE 1 END) AS BIGINT) AS mismatch
          FROM cells GROUP BY feature)
"""


def stats_sql(select: str = "SELECT feature, total, match, mismatch FROM stats", **options) -> str:
    return f"{cells_sql(**options)}, {_PER_FEATURE} {select}"


def shown_sql(x: str) -> str:
    """A value after the default number conversion; numbers here are all integral."""
    return (f"CASE WHEN {num_sql(x)} IS NOT NULL THEN CAST(CAST({num_sql(x)} AS BIGINT) AS VARCHAR) "
            f"WHEN trim({x}) = '' THEN {x} ELSE trim({x}) END")


def _orders(spark: SparkSession, d: str, **options) -> Comparison:
    return compare(X.orders_a(spark, d), X.orders_b(spark, d), "k", **options)


# -- C1 and its statistics -----------------------------------------------------------

@query("compare_feature_stats", stats_sql())
def compare_feature_stats(spark, d):
    return _orders(spark, d).stats()


@query("compare_stored_tables", stats_sql())
def compare_stored_tables(spark, d):
    """Both sides are stored by key first; the comparison then shuffles neither."""
    sides = []
    for rows in (X.orders_a(spark, d), X.orders_b(spark, d)):
        path = fresh_dir(spark, "keyed")
        sides.append(files.write_keyed(rows, "keyed_" + path.rsplit("-", 1)[1], ["k"], buckets=8, path=path))
    return compare(*sides, "k", skew=SkewPolicy(enabled=False), unique_lookup=True, unique_driver=True).stats()


@query("compare_blocks_stats", """WITH a AS (SELECT o_orderkey AS k, o_orderpriority AS prio, o_orderstatus AS status, o_custkey AS cust FROM orders WHERE o_orderkey % 211 <> 3),
b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 97 = 5 THEN 'none yet' ELSE o_orderpriority END AS prio,
  CASE WHEN o_orderkey % 89 = 7 THEN ' ' || o_orderstatus WHEN o_orderkey % 83 = 1 THEN NULL ELSE o_orderstatus END AS status, o_custkey AS cust FROM orders WHERE o_orderkey % 223 <> 4),
m AS (SELECT count(*) AS total, count(*) FILTER (a.prio <> b.prio) AS prio, count(*) FILTER (coalesce(trim(a.status), '') <> coalesce(trim(b.status), '')) AS status FROM a JOIN b USING (k))
SELECT 'prio' AS feature, total, total - prio AS match, prio AS mismatch FROM m UNION ALL SELECT 'status', total, total - status, status FROM m
UNION ALL SELECT 'cust', total, total, 0 FROM m""")
def compare_blocks_stats(spark, d):
    """Two versions of a table that are equal in most rows: only unlike blocks are joined."""
    rows, k, status = X.table(spark, d, "orders"), F.col("o_orderkey"), F.col("o_orderstatus")
    left = rows.where(k % 211 != 3).select(k.alias("k"), F.col("o_orderpriority").alias("prio"), status.alias("status"), F.col("o_custkey").alias("cust"))
    right = rows.where(k % 223 != 4).select(
        k.alias("k"), F.when(k % 97 == 5, "none yet").otherwise(F.col("o_orderpriority")).alias("prio"),
        F.when(k % 89 == 7, F.concat(F.lit(" "), status)).when(k % 83 != 1, status).alias("status"), F.col("o_custkey").alias("cust"))
    return compare_by_blocks(left, right, "k", unique_lookup=True, unique_driver=True).stats()


@query("compare_diff_detail", f"""{cells_sql()}
SELECT k, feature, {shown_sql('r')} AS right_value, {shown_sql('l')} AS left_value,
       coalesce(nullif(trim(bp), ''), trim(ap)) AS time, coalesce(nullif(trim(ac), ''), trim(bc)) AS customer
FROM (SELECT c.*, a.price AS ap, b.price AS bp, a.cust AS ac, b.cust AS bc FROM cells c
      JOIN orders_a a ON a.k = c.k JOIN orders_b b ON b.k = c.k) WHERE NOT same""")
def compare_diff_detail(spark, d):
    context = {"time": [("right", "price"), ("left", "price")], "customer": [("left", "cust"), ("right", "cust")]}
    return diff_detail(_orders(spark, d, context=context))


@query("compare_overall", stats_sql("""SELECT CAST(sum(total) AS BIGINT) AS comparisons, CAST(sum(match) AS BIGINT) AS matches,
CAST(sum(mismatch) AS BIGINT) AS diffs, round(sum(match) * 100.0 / sum(total), 2)::DOUBLE AS match_pct FROM stats"""))
def compare_overall(spark, d):
    return S.overall_stats(_orders(spark, d).stats())


@query("class_counts", stats_sql("""SELECT count(*) FILTER (mismatch = 0) AS clean_features,
count(*) FILTER (mismatch > 0) AS differing_features FROM stats"""))
def class_counts(spark, d):
    return S.class_counts(_orders(spark, d).stats())


@query("diff_summary", stats_sql("""SELECT feature, mismatch AS diff_count, total,
round(mismatch * 100.0 / total, 2)::DOUBLE AS diff_pct FROM stats WHERE mismatch > 0"""))
def diff_summary(spark, d):
    return S.diff_summary(_orders(spark, d).stats())


@query("stats_report", stats_sql("""SELECT feature, mismatch > 0 AS differs, total, match, mismatch,
round(match * 100.0 / total, 2)::DOUBLE AS match_pct, round(mismatch * 100.0 / total, 2)::DOUBLE AS mismatch_pct FROM stats"""))
def stats_report(spark, d):
    return S.stats_report(_orders(spark, d).stats(), order="rate")


@query("top_diffs", stats_sql("""SELECT feature, mismatch AS diff_count, total,
round(mismatch * 100.0 / total, 2)::DOUBLE AS diff_pct FROM stats WHERE mismatch > 0
ORDER BY mismatch DESC, feature LIMIT 2"""))
def top_diffs(spark, d):
    return S.top_diffs(_orders(spark, d).stats(), 2)


@query("diff_key_count", f"{cells_sql()} SELECT count(DISTINCT k) AS diff_keys FROM cells WHERE NOT same")
def diff_key_count(spark, d):
    return S.diff_key_count(_orders(spark, d))


for _name, _spark_options, _sql_options in (
    ("compare_tolerance", {"tolerance": 1.0}, {"tol": 1.0}),
    ("compare_zero_nan", {"ignore_zero_nan": True}, {"zero_nan": True}),
    ("compare_default_fill", {"ignore_default_fill": True}, {"fill": True}),
    ("compare_all_options", {"tolerance": 1.0, "ignore_zero_nan": True, "ignore_default_fill": True},
     {"tol": 1.0, "zero_nan": True, "fill": True}),
):
    def _with_options(spark, d, options=_spark_options):
        return _orders(spark, d, **options).stats()

    query(_name, stats_sql(**_sql_options))(_with_options)


@query("compare_cells", f"""{cells_sql()} SELECT k, feature, {shown_sql('l')} AS left_value,
{shown_sql('r')} AS right_value, same AS is_match FROM cells""")
def compare_cells(spark, d):
    return _orders(spark, d).cells()


@query("compare_typed_columns", """
WITH pairs AS (SELECT o_totalprice AS l1, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS r1,
                      o_custkey AS l2, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS r2 FROM orders),
c AS (SELECT 'total' AS feature, abs(l1 - r1) < 1e-10 AS same FROM pairs
      UNION ALL SELECT 'cust', coalesce(l2 = r2, false) FROM pairs)
SELECT feature, count(*) AS total, count(*) FILTER (same) AS match, count(*) FILTER (NOT same) AS mismatch
FROM c GROUP BY feature""")
def compare_typed_columns(spark, d):
    o = X.table(spark, d, "orders")
    left = o.select("o_orderkey", F.col("o_totalprice").alias("total"), F.col("o_custkey").alias("cust"))
    right = o.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("total"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("cust"),
    )
    return compare(left, right, "o_orderkey", unique_lookup=True, unique_driver=True).stats()


# -- keys and rows --------------------------------------------------------------------

@query("key_accounting", f"""WITH {X.ORDERS_SQL} SELECT
(SELECT count(*) FROM orders_b b WHERE EXISTS (SELECT 1 FROM orders_a a WHERE a.k = b.k)) AS matched,
(SELECT count(*) FROM orders_a a WHERE NOT EXISTS (SELECT 1 FROM orders_b b WHERE a.k = b.k)) AS left_only,
(SELECT count(*) FROM orders_b b WHERE NOT EXISTS (SELECT 1 FROM orders_a a WHERE a.k = b.k)) AS right_only""")
def key_accounting(spark, d):
    return _orders(spark, d).key_counts()


@query("left_only", f"WITH {X.ORDERS_SQL} SELECT * FROM orders_a a WHERE NOT EXISTS (SELECT 1 FROM orders_b b WHERE a.k = b.k)")
def left_only(spark, d):
    return only_report(_orders(spark, d), "left")


@query("right_only", f"WITH {X.ORDERS_SQL} SELECT * FROM orders_b b WHERE NOT EXISTS (SELECT 1 FROM orders_a a WHERE a.k = b.k)")
def right_only(spark, d):
    return only_report(_orders(spark, d), "right")


_LINE_KEYS_SQL = """
lk AS (SELECT CASE WHEN l_quantity <> 1 THEN CAST(l_orderkey AS VARCHAR) END AS ok, CAST(l_linenumber AS VARCHAR) AS ln FROM lineitem),
rk AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS ok, CAST(l_linenumber + CASE WHEN l_orderkey % 3 = 0 THEN 5 ELSE 0 END AS VARCHAR) AS ln FROM lineitem)
"""


def _lines(spark, d):
    li = X.table(spark, d, "lineitem")
    left = li.select(
        F.when(F.col("l_quantity") != 1, F.col("l_orderkey").cast("string")).alias("ok"),
        F.col("l_linenumber").cast("string").alias("ln"), F.col("l_tax").alias("tax"),
    )
    right = li.select(
        F.col("l_orderkey").cast("string").alias("ok"),
        (F.col("l_linenumber") + F.when(F.col("l_orderkey") % 3 == 0, 5).otherwise(0)).cast("string").alias("ln"),
        F.col("l_tax").alias("tax"),
    )
    return compare(left, right, ["ok", "ln"], mode="response")


@query("row_status", f"""WITH {_LINE_KEYS_SQL} SELECT status, count(*) AS n FROM (
SELECT CASE WHEN lk.ok IS NULL THEN 'empty_key' WHEN rk.ok IS NULL THEN 'no_match' ELSE 'compared' END AS status
FROM lk LEFT JOIN rk ON lk.ok = rk.ok AND lk.ln = rk.ln) GROUP BY status""")
def row_status(spark, d):
    return _lines(spark, d).row_status().groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("near_misses", f"""WITH {_LINE_KEYS_SQL},
near AS (SELECT ok, string_agg(ln, ',' ORDER BY ln) AS candidates, count(*) AS candidate_count FROM (
  SELECT *, row_number() OVER (PARTITION BY ok ORDER BY ln) AS n FROM rk) WHERE n <= 3 GROUP BY ok)
SELECT lk.ok, lk.ln, coalesce(near.candidates, '') AS candidates,
       CAST(coalesce(near.candidate_count, 0) AS INTEGER) AS candidate_count
FROM lk LEFT JOIN near ON lk.ok = near.ok
WHERE lk.ok IS NOT NULL AND NOT EXISTS (SELECT 1 FROM rk WHERE rk.ok = lk.ok AND rk.ln = lk.ln)""")
def near_misses(spark, d):
    return _lines(spark, d).near_misses()


_LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
               "l_returnflag", "l_linestatus"]
_LAST_SQL = f"""
last AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY {', '.join(c + ' DESC' for c in _LINE_ORDER)}) AS rn FROM lineitem) WHERE rn = 1)
"""


@query("dedupe_last", f"WITH {_LAST_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag FROM last")
def dedupe_last(spark, d):
    last = K.dedupe_last(X.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], _LINE_ORDER)
    return last.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")


@query("compare_composite_last_wins", f"""WITH {_LAST_SQL},
c AS (SELECT b.l_orderkey, b.l_linenumber, 'flag' AS feature, a.l_returnflag = b.l_returnflag AS same
      FROM lineitem b JOIN last a ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber
      UNION ALL
      SELECT b.l_orderkey, b.l_linenumber, 'qty', abs(a.l_quantity - b.l_quantity) < 1e-10
      FROM lineitem b JOIN last a ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber)
SELECT feature, count(*) AS total, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FILTER (NOT same) AS match,
       count(DISTINCT (l_orderkey, l_linenumber)) FILTER (NOT same) AS mismatch FROM c GROUP BY feature""")
def compare_composite_last_wins(spark, d):
    li = X.table(spark, d, "lineitem")
    named = li.withColumnsRenamed({"l_quantity": "qty", "l_returnflag": "flag"})
    order = ["qty" if c == "l_quantity" else "flag" if c == "l_returnflag" else c for c in _LINE_ORDER]
    return compare(
        named, named, ["l_orderkey", "l_linenumber"], left_features=["qty", "flag"],
        right_features=["qty", "flag"], order_by=order,
    ).stats()


@query("compare_unique_keys", f"""WITH {_LAST_SQL},
b AS (SELECT l_orderkey + CASE WHEN l_orderkey % 9 = 0 THEN 1000000000 ELSE 0 END AS ok, l_linenumber, l_quantity,
             CASE WHEN l_orderkey % 4 = 0 THEN l_tax + 1 ELSE l_tax END AS tax FROM last)
SELECT 'tax' AS feature, count(*) AS total, count(*) FILTER (abs(a.l_tax - b.tax) < 1e-10) AS match,
       count(*) FILTER (NOT abs(a.l_tax - b.tax) < 1e-10) AS mismatch
FROM last a JOIN b ON a.l_orderkey = b.ok AND a.l_linenumber = b.l_linenumber""")
def compare_unique_keys(spark, d):
    li = X.table(spark, d, "lineitem").withColumnRenamed("l_tax", "tax")
    order = ["tax" if c == "l_tax" else c for c in _LINE_ORDER]
    right = li.withColumn("tax", F.when(F.col("l_orderkey") % 4 == 0, F.col("tax") + 1).otherwise(F.col("tax")))
    right = right.withColumn("l_orderkey", F.col("l_orderkey") + F.when(F.col("l_orderkey") % 9 == 0, 1_000_000_000).otherwise(0))
    return compare(li, right, ["l_orderkey", "l_linenumber"], left_features=["tax"], right_features=["tax"],
                   order_by=order, driver_order_by=order, unique_keys=True).stats()


# -- feature alignment ----------------------------------------------------------------

def _customers(spark, d):
    c = X.table(spark, d, "customer")
    left = c.select("c_custkey", F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"),
                    F.col("c_mktsegment").alias("segment"))
    right = c.select(
        "c_custkey", F.col("c_name").alias("x_name_v3"),
        (F.col("c_nationkey") + F.when(F.col("c_custkey") % 6 == 0, 1).otherwise(0)).alias("x_nation_v3"),
        F.col("c_acctbal").alias("x_balance_v3"),
    )
    return left, right


@query("compare_renamed_common_only", """
SELECT 'x_name_v3' AS feature, count(*) AS total, count(*) AS match, CAST(0 AS BIGINT) AS mismatch FROM customer
UNION ALL SELECT 'x_nation_v3', count(*), count(*) FILTER (c_custkey % 6 <> 0), count(*) FILTER (c_custkey % 6 = 0) FROM customer""")
def compare_renamed_common_only(spark, d):
    left, right = _customers(spark, d)
    return compare(left, right, "c_custkey", rename="left", prefix="x_", suffix="_v3", common_only=True).stats()


@query("compare_missing_feature", """
SELECT 'x_name_v3' AS feature, count(*) AS total, count(*) AS match, CAST(0 AS BIGINT) AS mismatch FROM customer
UNION ALL SELECT 'x_nation_v3', count(*), count(*) FILTER (c_custkey % 6 <> 0), count(*) FILTER (c_custkey % 6 = 0) FROM customer
UNION ALL SELECT 'x_segment_v3', count(*), CAST(0 AS BIGINT), count(*) FROM customer""")
def compare_missing_feature(spark, d):
    left, right = _customers(spark, d)
    return compare(left, right, "c_custkey", rename="left", prefix="x_", suffix="_v3").stats()


@query("compare_right_baseline", """
SELECT 'x_name_v3' AS feature, count(*) AS total, count(*) AS match, CAST(0 AS BIGINT) AS mismatch FROM customer
UNION ALL SELECT 'x_nation_v3', count(*), count(*) FILTER (c_custkey % 6 <> 0), count(*) FILTER (c_custkey % 6 = 0) FROM customer
UNION ALL SELECT 'x_balance_v3', count(*), CAST(0 AS BIGINT), count(*) FROM customer""")
def compare_right_baseline(spark, d):
    left, right = _customers(spark, d)
    return compare(left, right, "c_custkey", rename="left", prefix="x_", suffix="_v3", baseline="right").stats()


# -- C2, C3, C4 -----------------------------------------------------------------------

@query("compare_offline", stats_sql())
def compare_offline(spark, d):
    return _orders(spark, d, mode="offline").stats()


@query("offline_diff_detail", f"""{cells_sql()} SELECT k, '' AS customer, '' AS left_time, '' AS right_time, feature,
coalesce(trim(l), '') AS left_value, coalesce(trim(r), '') AS right_value FROM cells WHERE NOT same""")
def offline_diff_detail(spark, d):
    return diff_detail(_orders(spark, d, mode="offline"))


def _answered(spark, d):
    """Flat response table next to the request table, keyed by (k, create_time)."""
    r = X.responses(spark, d).withColumn("doc", D.parse("body"))
    wide = D.nested_columns(r, "doc", ["uid", "kind"], keep=["k"])
    req = X.requests(spark, d).drop("K")
    stamps = req.select("id", "create_time")
    flat = wide.join(stamps, wide["k"].cast("string") == stamps["id"]).select("id", "create_time", "uid", "kind")
    return req, flat


_ANSWERED_SQL = f"""WITH {X.REQUESTS_SQL}, {X.RESPONSES_SQL},
c AS (SELECT q.id, q.create_time, 'uid' AS feature, q.uid AS l, CASE WHEN r.state = 'full' THEN r.uid END AS r
      FROM requests q JOIN responses r ON q.id = CAST(r.k AS VARCHAR)
      UNION ALL
      SELECT q.id, q.create_time, 'kind', q.kind, CASE WHEN r.state IN ('full', 'direct') THEN r.kind END
      FROM requests q JOIN responses r ON q.id = CAST(r.k AS VARCHAR)),
cells AS (SELECT *, {eq_sql('l', 'r')} AS same FROM c)"""


@query("compare_response", f"{_ANSWERED_SQL}, {_PER_FEATURE} SELECT feature, total, match, mismatch FROM stats")
def compare_response(spark, d):
    left, right = _answered(spark, d)
    return compare(left, right, ["id", "create_time"], mode="response").stats()


@query("response_diff_detail", f"""{_ANSWERED_SQL} SELECT feature, id, create_time, l AS left_value, coalesce(r, 'null') AS right_value,
CASE WHEN (coalesce(l, '') = '' OR {num_sql('l')} IS NOT NULL) AND (r IS NULL OR {num_sql('r')} IS NOT NULL)
     THEN round(CASE WHEN coalesce(l, '') = '' THEN 0 ELSE {num_sql('l')} END - CASE WHEN r IS NULL THEN 0 ELSE {num_sql('r')} END, 6) END AS difference
FROM cells WHERE NOT same""")
def response_diff_detail(spark, d):
    left, right = _answered(spark, d)
    return diff_detail(compare(left, right, ["id", "create_time"], mode="response"), difference=True)


_NESTED_CELLS_SQL = f"""WITH {X.REQUESTS_SQL}, {X.RESPONSES_SQL},
pairs AS (SELECT q.*, r.state, r.uid AS ruid, r.n AS rn, r.kind AS rkind FROM requests q
          JOIN responses r ON q.id = CAST(r.k AS VARCHAR) WHERE r.state NOT IN ('bad')),
c AS (SELECT 'uid' AS feature, uid AS l, CASE WHEN state = 'full' THEN ruid END AS r FROM pairs
      UNION ALL SELECT 'kind', kind, CASE WHEN state IN ('full', 'direct') THEN rkind END FROM pairs),
cells AS (SELECT *, {eq_sql('l', 'r')} AS same FROM c)"""


@query("compare_nested", f"{_NESTED_CELLS_SQL}, {_PER_FEATURE} SELECT feature, total, match, mismatch FROM stats")
def nested_compare(spark, d):
    left = X.requests(spark, d).select("id", "uid", "kind")
    r = X.responses(spark, d).select(F.col("k").cast("string").alias("id"), D.parse("body").alias("doc"))
    return compare_nested(left, r.where("doc is not null"), "id").stats()


# -- scalar functions over whole tables ------------------------------------------------

@query("to_number_styles", f"""WITH {X.LEXEMES_SQL} SELECT k,
CASE WHEN kind IN (0, 1, 2, 3, 4, 5) THEN cents WHEN kind = 10 THEN '1000' ELSE raw END AS fast,
CASE WHEN kind IN (0, 1, 2, 3, 4, 5) THEN cents WHEN kind = 10 THEN '1000' ELSE raw END AS quoted,
CASE WHEN kind IN (0, 1, 2, 3, 4, 5) THEN cents WHEN kind = 10 THEN '1000' ELSE raw END AS greedy,
CASE WHEN kind IN (0, 5) THEN cents WHEN kind = 1 THEN cents || '.0' WHEN kind IN (8, 9) THEN NULL
     WHEN kind = 10 THEN '1000' WHEN kind = 11 THEN replace(raw, ',', '') ELSE raw END AS json,
CASE WHEN kind IN (0, 1, 4, 5) THEN CAST(cents AS DOUBLE) WHEN kind = 10 THEN 1000.0
     WHEN kind = 11 THEN CAST(replace(raw, ',', '') AS DOUBLE) END AS response
FROM lexemes""")
def to_number_styles(spark, d):
    return X.lexemes(spark, d).select(
        "k", to_number("raw", "fast").alias("fast"), to_number("raw", "quoted").alias("quoted"),
        to_number("raw", "greedy_quotes").alias("greedy"), to_number("raw", "json").alias("json"),
        to_double("raw").alias("response"),
    )


@query("cells_equal_verdicts", f"""WITH {X.LEXEMES_SQL}
SELECT k, {eq_sql('raw', 'cents')} AS plain, {eq_sql('raw', 'cents', zero_nan=True)} AS zero_nan,
{eq_sql('raw', 'cents', fill=True)} AS fill, {eq_sql('raw', 'cents', tol=1000000.0)} AS tolerant,
kind IN (0, 1, 2, 3, 4, 5) OR (kind = 10 AND cents = '1000') AS converted FROM lexemes""")
def cells_equal_verdicts(spark, d):
    return X.lexemes(spark, d).select(
        "k", cells_equal("raw", "cents").alias("plain"),
        cells_equal("raw", "cents", ignore_zero_nan=True).alias("zero_nan"),
        cells_equal("raw", "cents", ignore_default_fill=True).alias("fill"),
        cells_equal("raw", "cents", tolerance=1e6).alias("tolerant"),
        cells_equal("raw", "cents", convert="fast").alias("converted"),
    )


@query("value_difference", f"""WITH {X.LEXEMES_SQL} SELECT k,
CASE WHEN kind IN (0, 1, 4, 5) THEN 0.0 WHEN kind = 8 THEN 0.0 - CAST(cents AS DOUBLE) WHEN kind = 10 THEN 1000.0 - CAST(cents AS DOUBLE) END AS difference,
cents AS plain FROM lexemes""")
def value_difference(spark, d):
    return X.lexemes(spark, d).select(
        "k", difference("raw", "cents").alias("difference"),
        format_number_plain(F.col("cents").cast("double")).alias("plain"),
    )


@query("normalize_ts", f"""WITH {X.TIMES_SQL} SELECT k,
CASE WHEN kind IN (0, 1, 2) THEN d || 'T00:00:00.000' WHEN kind = 6 THEN '' ELSE replace(s, ' ', 'T') || '.' || f END AS request,
CASE WHEN kind IN (0, 1, 2) THEN t WHEN kind = 6 THEN '' ELSE s || '.' || f END AS spaced,
CASE WHEN kind IN (0, 1, 2) THEN t WHEN kind = 6 THEN '' ELSE replace(s, ' ', 'T') || '.' || f END AS strict_t,
CASE WHEN kind IN (0, 1, 2) THEN t WHEN kind = 6 THEN '' ELSE s || '.' || f END AS batch
FROM times""")
def normalize_times(spark, d):
    return X.times(spark, d).select(
        "k", normalize_ts("t").alias("request"), normalize_ts("t", t_sep=False, expand_date=False).alias("spaced"),
        normalize_ts("t", style="strict_t").alias("strict_t"), normalize_ts("t", style="batch").alias("batch"),
    )


@query("plus_one_second", f"""WITH {X.TIMES_SQL} SELECT k,
CASE WHEN kind IN (3, 4, 5, 7) THEN later || '.' || f ELSE t END AS later,
CASE WHEN kind = 6 THEN '' WHEN kind IN (0, 1, 2) THEN t ELSE later || '.' || f END AS requested FROM times""")
def plus_one(spark, d):
    return X.times(spark, d).select(
        "k", plus_one_second("t").alias("later"), request_time("t", plus_one=True).alias("requested")
    )


@query("to_standard_time", f"""WITH {X.TIMES_SQL} SELECT k,
CASE WHEN kind IN (0, 1, 2, 6) THEN t ELSE s || '.' || f END AS standard,
CASE WHEN kind IN (0, 3, 4, 5, 7) THEN chr(9) || t ELSE t END AS guarded FROM times""")
def standard_time(spark, d):
    return X.times(spark, d).select("k", to_standard_time("t").alias("standard"), text_guard("t", "x").alias("guarded"))


@query("first_nonempty", f"""WITH {X.ORDERS_SQL} SELECT k, coalesce(nullif(trim(priority), ''), nullif(trim(status), ''), '') AS id FROM orders_b""")
def first_id(spark, d):
    return X.orders_b(spark, d).select("k", first_nonempty("priority", "status").alias("id"))


# -- decimals -------------------------------------------------------------------------

_ROUNDED = {
    "round": "((m + cut // 2) // cut) / CAST(u AS DOUBLE)",
    "truncate": "(m // cut) / CAST(u AS DOUBLE)",
    "ceil": "(m // cut + 1) / CAST(u AS DOUBLE)",
}


@query("decimal_round_methods", f"""WITH {X.DECIMALS_SQL} SELECT l_orderkey, l_linenumber, l_partkey,
CAST(CASE WHEN p = 0 OR r % u = 0 THEN 0 ELSE length(rtrim(lpad(CAST(r % u AS VARCHAR), p, '0'), '0')) END AS INTEGER) AS places,
src AS none, {_ROUNDED['round']} AS rounded, {_ROUNDED['truncate']} AS truncated, {_ROUNDED['ceil']} AS ceiled
FROM decimals WHERE p = 0 OR r % 10 <> 0
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, z, src, (m + zc // 2) // zc / zu, (m // zc) / zu, (m // zc + 1) / zu
FROM (SELECT *, CAST(pow(10, 4 - z) AS BIGINT) AS zc, pow(10, z) AS zu FROM (
  SELECT *, CAST(CASE WHEN r % u = 0 THEN 0 ELSE length(rtrim(lpad(CAST(r % u AS VARCHAR), p, '0'), '0')) END AS INTEGER) AS z
  FROM decimals WHERE p > 0 AND r % 10 = 0))""")
def decimal_round_methods(spark, d):
    return X.decimals(spark, d).select(
        "l_orderkey", "l_linenumber", "l_partkey", dec.decimal_places("ref").alias("places"),
        dec.round_to_reference("src", "ref", "none").alias("none"),
        dec.round_to_reference("src", "ref", "round").alias("rounded"),
        dec.round_to_reference("src", "ref", "truncate").alias("truncated"),
        dec.round_to_reference("src", "ref", "ceil").alias("ceiled"),
    )


_PLACES_SQL = f"""WITH {X.DECIMALS_SQL},
z AS (SELECT *, CAST(CASE WHEN p = 0 OR r % u = 0 THEN 0 ELSE length(rtrim(lpad(CAST(r % u AS VARCHAR), p, '0'), '0')) END AS INTEGER) AS z FROM decimals),
rounded AS (SELECT *, (m + CAST(pow(10, 4 - z) AS BIGINT) // 2) // CAST(pow(10, 4 - z) AS BIGINT) / pow(10, z) AS src_round FROM z),
diffs AS (SELECT *, round((ref_number - src_round) * 1e10) / 1e10 AS difference FROM rounded)
SELECT l_orderkey, l_linenumber, l_partkey, src, src_round, ref, difference FROM diffs WHERE NOT """

for _mode, _keep in (
    ("exact", "(difference = 0)"),
    ("tolerance", "(abs(difference) <= 0.01)"),
    ("last_digit", "(abs(difference) <= CASE WHEN z = 0 THEN 1 ELSE 1 / pow(10, z) + 1e-10 END)"),
    ("last_digit_2", "(abs(difference) <= CASE WHEN z = 0 THEN 2 ELSE 2 / pow(10, z) + 1e-10 END)"),
):
    def _reconcile(spark, d, mode=_mode):
        return decimal_reconcile(X.decimals(spark, d), "src", "ref", method="round", mode=mode)

    query(f"decimal_reconcile_{_mode}", _PLACES_SQL + _keep)(_reconcile)


# -- JSON -----------------------------------------------------------------------------

@query("json_leaf_wide", f"""WITH {X.NESTED_SQL} SELECT CAST(apply_id AS VARCHAR) AS apply_id, apply_time, b, d,
'{{}}' AS e, '[1,null,' || n || ']' AS l, '[{{"p":' || n || '}},{{"p":2}},{{"p":' || n || '}}]' AS o, '' AS z FROM nested WHERE filled""")
def json_leaf_wide(spark, d):
    return D.json_to_wide(X.nested(spark, d), "response_body", "apply_id")


@query("json_path_wide", f"""WITH {X.NESTED_SQL} SELECT apply_id, apply_time,
CASE WHEN filled THEN b END AS "a.b", CASE WHEN filled THEN d END AS "a.c.d", CASE WHEN filled THEN '{{}}' END AS e,
CASE WHEN filled THEN '1|' || n END AS l, CASE WHEN filled THEN CASE WHEN n = '2' THEN '2' ELSE n || '|2' END END AS "o.p",
CAST(NULL AS VARCHAR) AS z FROM nested""")
def json_path_wide(spark, d):
    return D.body_to_wide(X.nested(spark, d))


@query("json_rejects", f"""WITH {X.RESPONSES_SQL} SELECT k, 'invalid' AS reason FROM responses WHERE state = 'bad'""")
def json_rejects(spark, d):
    _, rejected = D.parse_json_column(X.responses(spark, d), "body", "k")
    return rejected.select("k", "reason")


def _docs(spark, d):
    return X.responses(spark, d).withColumn("doc", D.parse("body"))


# The leaf paths of the stored responses, from the kinds of response that occur.
_PATHS_SQL = f"""WITH {X.RESPONSES_SQL}, paths AS (
SELECT DISTINCT unnest(CASE state WHEN 'error' THEN ['_error'] WHEN 'full' THEN ['data.features.uid', 'data.features.k', 'data.kind']
  WHEN 'direct' THEN ['data.uid', 'data.k', 'data.kind'] ELSE [] END) AS path FROM responses),
named AS (SELECT path, split_part(path, '.', -1) AS leaf FROM paths)"""


@query("json_field_catalog", f"{_PATHS_SQL} SELECT leaf AS field, count(*) AS paths FROM named GROUP BY leaf")
def json_field_catalog(spark, d):
    return D.field_catalog(_docs(spark, d), "doc")


@query("json_path_map", f"""{_PATHS_SQL} SELECT CASE WHEN row_number() OVER (PARTITION BY leaf ORDER BY path) = 1 THEN leaf ELSE path END AS name, path FROM named""")
def json_path_map(spark, d):
    return D.path_map(_docs(spark, d), "doc")


@query("json_lookup", f"""WITH {X.RESPONSES_SQL} SELECT k,
CASE WHEN state IN ('full', 'direct') THEN uid END AS uid, CASE WHEN state IN ('full', 'direct') THEN n END AS upper_k,
CASE WHEN state IN ('full', 'direct') THEN kind END AS kind, CASE WHEN state IN ('full', 'direct') THEN kind END AS dotted,
CASE WHEN state NOT IN ('bad', 'error') THEN '0' END AS code, CAST(NULL AS VARCHAR) AS absent FROM responses""")
def json_lookup(spark, d):
    docs = _docs(spark, d)
    catalog = D.discover(docs, "doc")

    def find(name: str) -> Column:
        return D.lookup("doc", name, catalog, "body")

    return docs.select(
        "k", find("uid").alias("uid"), find("K").alias("upper_k"), find("kind").alias("kind"),
        find("data.kind").alias("dotted"), find("retCode").alias("code"), find("none").alias("absent"),
    )


@query("envelope_unwrap", f"""WITH {X.RESPONSES_SQL} SELECT k,
CASE WHEN state = 'full' THEN '{{"k":' || n || ',"uid":"' || uid || '"}}'
     WHEN state = 'direct' THEN '{{"k":' || n || ',"kind":"' || kind || '","uid":"' || uid || '"}}'
     WHEN state = 'empty' THEN '{{}}' END AS inner_json,
CASE WHEN state IN ('full', 'direct') THEN kind END AS kind FROM responses""")
def envelope_unwrap(spark, d):
    return _docs(spark, d).select(
        "k", F.to_json(D.unwrap("doc")).alias("inner_json"), D.get_path("doc", "data.kind").alias("kind")
    )


@query("convert_envelope", f"""WITH {X.RESPONSES_SQL} SELECT k,
CASE WHEN state IN ('full', 'direct') THEN 1 ELSE 0 END AS converted_count,
CASE WHEN state = 'direct' THEN 1 ELSE 0 END AS unchanged_count,
CASE WHEN state IN ('full', 'direct') THEN CAST(uid AS DOUBLE) END AS uid FROM responses""")
def convert_envelope(spark, d):
    out = D.convert_envelope(X.responses(spark, d), "body")
    v = D.parse("converted")
    uid = F.coalesce(D.at(v, ["data", "features", "uid"], "double"), D.at(v, ["data", "uid"], "double"))
    return out.select("k", "converted_count", "unchanged_count", uid.alias("uid"))


@query("convert_columns", f"""WITH {X.ORDERS_SQL} SELECT k, price, status,
priority, CASE WHEN cust = '-999' THEN '-999.0' WHEN cust = '0' THEN '0.0' ELSE cust || '.0' END AS cust FROM orders_b""")
def convert_columns(spark, d):
    return D.convert_columns(X.orders_b(spark, d), "priority")


@query("records_to_table", f"""WITH {X.RESPONSES_SQL} SELECT
CASE WHEN state NOT IN ('error', 'bad') THEN '0' END AS "retCode",
CASE WHEN state = 'error' THEN 'timeout' END AS "_error",
CASE state WHEN 'full' THEN '{{"features":{{"k":' || n || ',"uid":"' || uid || '"}},"kind":"' || kind || '"}}'
  WHEN 'direct' THEN '{{"k":' || n || ',"kind":"' || kind || '","uid":"' || uid || '"}}'
  WHEN 'empty' THEN '{{}}' END AS data FROM responses""")
def records_to_table(spark, d):
    return files.records_to_table(X.responses(spark, d), "body", order_by="k")


# -- enrichment -----------------------------------------------------------------------

@query("build_params", f"""WITH {X.REQUESTS_SQL} SELECT id,
CASE WHEN kind = '' THEN NULL ELSE uid END AS uid, CASE WHEN kind = '' THEN 'parameter kind is empty' END AS error,
replace(create_time, ' ', 'T') || '.000' AS base_time FROM requests""")
def build_params(spark, d):
    specs = [
        {"name": "uid", "column": "uid"}, {"name": "kind", "column": "kind"},
        {"name": "baseTime", "column": "create_time", "is_time": True}, {"name": "skipped", "column": None},
    ]
    out = K.build_params(X.requests(spark, d), specs)
    ok = F.col("error").isNull()
    return out.select("id", F.when(ok, F.col("params.uid")).alias("uid"), "error",
                      F.col("params.baseTime").alias("base_time"))


_ENRICHED_SQL = f"""WITH {X.REQUESTS_SQL}, {X.RESPONSES_SQL},
j AS (SELECT q.*, r.state, r.uid AS ruid, r.n AS rn, r.kind AS rkind, r.state IN ('error', 'bad') AS failed,
             r.state IN ('full', 'direct') AS filled
      FROM requests q JOIN responses r ON q.id = CAST(r.k AS VARCHAR))"""


@query("enrich_responses", f"""{_ENRICHED_SQL} SELECT id, create_time,
CASE WHEN failed THEN uid WHEN filled THEN ruid ELSE 'null' END AS uid,
CASE WHEN failed THEN kk WHEN filled THEN rn ELSE 'null' END AS count_k,
CASE WHEN failed THEN kind WHEN filled THEN rkind ELSE 'null' END AS kind,
CASE WHEN failed THEN '' WHEN state = 'full' THEN rn ELSE 'null' END AS k_response,
CASE WHEN failed THEN '' WHEN filled THEN rkind ELSE 'null' END AS kind_response,
CASE WHEN failed THEN '' WHEN state = 'full' THEN ruid ELSE 'null' END AS uid_response,
CASE state WHEN 'error' THEN 'timeout' WHEN 'bad' THEN 'response is no JSON object' END AS error FROM j""")
def enrich_responses(spark, d):
    left = X.requests(spark, d)
    out = enrich(left, X.responses(spark, d), "id", response_keys="k", features=2)
    return out.toDF("id", "create_time", "uid", "count_k", "kind", "k_response", "kind_response", "uid_response", "error")


@query("batch_enrich", f"""{_ENRICHED_SQL} SELECT create_time,
CASE WHEN filled THEN rn ELSE '' END AS k, CASE WHEN state = 'direct' THEN rkind ELSE '' END AS kind,
CASE WHEN filled THEN ruid ELSE '' END AS uid,
CASE state WHEN 'error' THEN 'timeout' WHEN 'bad' THEN 'response is no JSON object' END AS error FROM j""")
def enriched_batch(spark, d):
    out, _ = batch_enrich(X.requests(spark, d), X.responses(spark, d), "id", response_keys="k",
                          keep=["create_time"])
    return out


@query("run_totals", f"""WITH {X.RESPONSES_SQL} SELECT count(*) AS total, count(*) FILTER (state NOT IN ('error', 'bad')) AS success,
count(*) FILTER (state IN ('error', 'bad')) AS errors, CAST(3 AS BIGINT) AS features_count FROM responses""")
def run_totals(spark, d):
    out, features = batch_enrich(X.requests(spark, d), X.responses(spark, d), "id", response_keys="k", keep=["id"])
    return S.run_totals(out, len(features))


@query("error_report", f"""WITH {X.RESPONSES_SQL}, {X.REQUESTS_SQL}
SELECT q.id AS record_id, q.create_time AS base_time,
CASE r.state WHEN 'error' THEN 'timeout' ELSE 'response is no JSON object' END AS error
FROM responses r JOIN requests q ON q.id = CAST(r.k AS VARCHAR) WHERE r.state IN ('error', 'bad')""")
def errors_of_run(spark, d):
    out, _ = batch_enrich(X.requests(spark, d), X.responses(spark, d), "id", response_keys="k",
                          keep=["id", "create_time"], features=["uid"])
    _, failed = split_errors(out)
    return error_report(failed, id_column="id")


# -- merges ---------------------------------------------------------------------------

@query("merge_rows", """SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, c_acctbal AS balance FROM customer
UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier""")
def merged_rows(spark, d):
    c = X.table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    return merge_rows([c.toDF("id", "name", "nation", "balance"), X.table(spark, d, "supplier")])


@query("merge_rows_by_name", """SELECT c_nationkey AS nation, c_name AS name, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance FROM customer
UNION ALL SELECT s_nationkey, s_name, NULL, s_acctbal FROM supplier""")
def merged_rows_by_name(spark, d):
    c = X.table(spark, d, "customer").selectExpr("c_nationkey as nation", "c_name as name", "c_mktsegment as segment")
    s = X.table(spark, d, "supplier").selectExpr("s_name as name", "s_nationkey as nation", "s_acctbal as balance")
    return merge_rows([c, s], by_name=True)


def _joinable(spark, d):
    o = X.table(spark, d, "orders").selectExpr("o_custkey as cust", "o_orderkey as ok", "o_orderstatus as label")
    c = X.table(spark, d, "customer").selectExpr("c_custkey + 3 as cust", "c_acctbal as balance", "c_mktsegment as label")
    return [o, c]


@query("merge_columns", """SELECT coalesce(o.o_custkey, c.c_custkey + 3) AS cust, o_orderkey AS ok, o_orderstatus AS label, c_acctbal AS balance
FROM orders o FULL JOIN customer c ON o.o_custkey = c.c_custkey + 3""")
def merged_columns(spark, d):
    return merge_columns(_joinable(spark, d), ["cust"])[0]


@query("merge_columns_coalesced", """SELECT coalesce(o.o_custkey, c.c_custkey + 3) AS cust, o_orderkey AS ok,
coalesce(o_orderstatus, c_mktsegment) AS label, c_acctbal AS balance FROM orders o FULL JOIN customer c ON o.o_custkey = c.c_custkey + 3""")
def merged_columns_coalesced(spark, d):
    return merge_columns(_joinable(spark, d), ["cust"], coalesce_duplicates=True, null_safe=True)[0]


@query("merge_by_position", """SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM
(SELECT *, row_number() OVER (ORDER BY c_custkey DESC) AS n FROM customer) c FULL JOIN
(SELECT *, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) o ON c.n = o.n""")
def merged_by_position(spark, d):
    c = X.table(spark, d, "customer").select("c_custkey", "c_name")
    o = X.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return merge_columns([c, o], None, order_by=[[F.desc("c_custkey")], ["o_orderkey"]])[0]


@query("merged_view", f"""WITH {X.ORDERS_SQL} SELECT a.k, a.cust AS cust_left, b.cust AS cust_right, a.price AS price_left, b.price AS price_right,
a.priority AS priority_left, b.priority AS priority_right, a.status AS status_left, b.status AS status_right
FROM orders_a a FULL JOIN orders_b b ON a.k = b.k""")
def side_by_side(spark, d):
    return merged_view(X.orders_a(spark, d), X.orders_b(spark, d), "k")


@query("tagged_view", f"""{cells_sql()}, bad AS (SELECT DISTINCT k FROM cells WHERE NOT same)
SELECT k, 'left' AS source, k IN (SELECT k FROM bad) AS differs, cust, price, priority, status FROM orders_a
UNION ALL SELECT k, 'right', k IN (SELECT k FROM bad), cust, price, priority, status FROM orders_b""")
def stacked(spark, d):
    return tagged_view(_orders(spark, d))


@query("schema_diff", """SELECT 'balance' AS feature, false AS in_left, true AS in_right, CAST(NULL AS BIGINT) AS left_values, (SELECT count(s_acctbal) FROM supplier) AS right_values
UNION ALL SELECT 'nation', true, true, (SELECT count(c_nationkey) FROM customer WHERE c_custkey % 7 <> 0), (SELECT count(s_nationkey) FROM supplier)
UNION ALL SELECT 'segment', true, false, (SELECT count(c_mktsegment) FROM customer), NULL""")
def schema_difference(spark, d):
    nation = F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey"))
    c = X.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), nation.alias("nation"), F.col("c_mktsegment").alias("segment"))
    s = X.table(spark, d, "supplier").selectExpr("s_suppkey as id", "s_nationkey as nation", "s_acctbal as balance")
    return K.schema_diff(c, s, c.columns[1:], s.columns[1:])


@query("json_catalogue_merge", f"""WITH {X.RESPONSES_SQL}, paths AS (
SELECT k, unnest(CASE state WHEN 'error' THEN ['_error'] WHEN 'full' THEN ['data.features.uid', 'data.features.k', 'data.kind']
  WHEN 'direct' THEN ['data.uid', 'data.k', 'data.kind'] ELSE [] END) AS path FROM responses)
SELECT path, count(*) AS n FROM paths GROUP BY path""")
def json_catalogue_merge(spark, d):
    """Catalogues of three lots of documents, each stored, and their merge; then how often each path occurs."""
    docs = _docs(spark, d)
    lots = [catalogue.catalogue(docs.where(F.pmod(F.hash("k"), F.lit(3)) == i), "doc") for i in range(3)]
    found = catalogue.merge_catalogues(*lots)
    named = catalogue.path_table(found).select("path")
    dotted = F.array_join(F.transform("path", lambda s: F.substr(s, F.lit(2))), ".")
    return found.select(dotted.alias("path"), F.col("values").alias("n")).join(named, "path")


# -- profile, history -----------------------------------------------------------------

@query("profile_table", " UNION ALL ".join(
    f"""SELECT {i} AS position, '{c}' AS column_name, '{t}' AS data_type, count(*) AS rows, count(*) - count({c}) AS null_count, """
    + (f"""CAST(count({c}) AS DOUBLE) AS "count", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS stddev, CAST(min({c}) AS DOUBLE) AS "min",
round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS p25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS p50,
round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS p75, CAST(max({c}) AS DOUBLE) AS "max" """
       if t in ("bigint", "double") else
       """CAST(NULL AS DOUBLE) AS "count", CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS stddev, CAST(NULL AS DOUBLE) AS "min",
CAST(NULL AS DOUBLE) AS p25, CAST(NULL AS DOUBLE) AS p50, CAST(NULL AS DOUBLE) AS p75, CAST(NULL AS DOUBLE) AS "max" """)
    + "FROM orders"
    for i, (c, t) in enumerate((
        ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
        ("o_orderdate", "timestamp"), ("o_orderpriority", "string"),
    ))
))
def profile_table(spark, d):
    o = X.table(spark, d, "orders")
    o = o.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    out = S.profile(o, quartiles="exact")
    return out.select(
        "position", "column_name", "data_type", "rows", "null_count", "count", F.round("mean", 4).alias("mean"),
        F.round("stddev", 4).alias("stddev"), "min", F.round("p25", 6).alias("p25"), F.round("p50", 6).alias("p50"),
        F.round("p75", 6).alias("p75"), "max",
    )


@query("run_delta", """WITH runs AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS errors,
row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS n FROM events)
SELECT a.user_id, a.ts AS current_start, b.ts AS previous_start, a.value AS current_duration, b.value AS previous_duration,
CASE WHEN b.value <> 0 THEN round((b.value - a.value) / b.value * 100, 2) ELSE 0 END AS duration_improvement,
a.event_type = b.event_type AS status_same, a.errors < b.errors AS errors_reduced
FROM runs a JOIN runs b ON a.user_id = b.user_id AND a.n = 1 AND b.n = 2""")
def run_history(spark, d):
    e = X.table(spark, d, "events").withColumn("errors", F.get_json_object("props", "$.k").cast("bigint"))
    return S.run_delta(e, by=["user_id"], start="ts", duration="value", status="event_type")


# -- documents that strict parsers refuse, keys that hold half of a table ---------------

@query("json_nan_documents", """SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'NaN' WHEN 1 THEN '-Infinity' ELSE CAST(o_custkey AS VARCHAR) END AS v,
CAST(o_orderkey % 7 AS VARCHAR) AS r FROM orders""")
def json_nan_documents(spark, d):
    k = F.col("o_orderkey")
    v = F.when(k % 3 == 0, "NaN").when(k % 3 == 1, "-Infinity").otherwise(F.col("o_custkey").cast("string"))
    body = F.concat(F.lit('{"v":'), v, F.lit(',"r":"first","r":'), (k % 7).cast("string"), F.lit("}"))
    docs = X.table(spark, d, "orders").select(k.alias("k"), D.parse(body).alias("doc"))
    return docs.select("k", D.get_path("doc", "v").alias("v"), D.get_path("doc", "r").alias("r"))


@query("read_responses", """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'NaN' ELSE CAST(o_custkey AS VARCHAR) END AS v FROM orders
WHERE o_orderkey // 1000 % 9 <> 4""")
def responses_in_files(spark, d):
    """Files of one array each; every ninth file is cut off and rejected."""
    k, part = F.col("o_orderkey"), F.floor(F.col("o_orderkey") / 1000)
    v = F.when(k % 5 == 0, "NaN").otherwise(F.col("o_custkey").cast("string"))
    one = F.concat(F.lit('{"k":'), k.cast("string"), F.lit(',"v":'), v, F.lit("}"))
    arrays = X.table(spark, d, "orders").groupBy(part.alias("part")).agg(F.concat_ws(",\n", F.collect_list(one)).alias("items"))
    text = F.concat(F.lit("["), "items", F.when(F.col("part") % 9 == 4, "").otherwise("]"))
    path = f"{fresh_dir(spark, 'responses')}/files"
    arrays.select("part", text.alias("value")).write.partitionBy("part").text(path)
    doc = D.parse("body")
    return files.read_responses(spark, path).select(D.get_path(doc, "k").cast("bigint").alias("k"), D.get_path(doc, "v").alias("v"))


@query("csv_multiline_split", """SELECT o_orderkey AS k, concat(o_orderpriority, chr(10), '"', o_orderstatus, '", ', CASE WHEN o_orderkey % 3 = 0 THEN chr(13) || chr(10) ELSE '""' END) AS note,
CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'a"b' END AS mark FROM orders""")
def csv_multiline_split(spark, d):
    """Cells with line breaks, separators and quotes, read range by range."""
    k = F.col("o_orderkey")
    note = F.concat("o_orderpriority", F.lit('\n"'), "o_orderstatus", F.lit('", '), F.when(k % 3 == 0, "\r\n").otherwise('""'))
    rows = X.table(spark, d, "orders").select(k.alias("k"), note.alias("note"), F.when(k % 7 != 0, 'a"b').alias("mark"))
    path = f"{fresh_dir(spark, 'csv')}/notes"
    files.write_table(rows, path, fmt="csv")
    return files.read_table(spark, path, multi_line="split").select(F.col("k").cast("bigint").alias("k"), "note", "mark")


@query("responses_split", """SELECT CAST(o_orderkey AS VARCHAR) AS k, CASE WHEN o_orderkey % 5 = 0 THEN '}],[{' ELSE CAST(o_custkey AS VARCHAR) END AS v FROM orders
WHERE o_orderkey // 1000 % 9 <> 4 AND o_orderkey % 11 <> 0
UNION ALL SELECT NULL, 'not_object' FROM orders WHERE o_orderkey // 1000 % 9 <> 4 AND o_orderkey % 11 = 0
UNION ALL SELECT DISTINCT CAST(o_orderkey // 1000 AS VARCHAR), 'invalid' FROM orders WHERE o_orderkey // 1000 % 9 = 4""")
def responses_split(spark, d):
    """Arrays cut into items range by range, with what is rejected: every ninth file is cut off, and
    some items are no objects."""
    k, part = F.col("o_orderkey"), F.floor(F.col("o_orderkey") / 1000)
    v = F.when(k % 5 == 0, "}],[{").otherwise(F.col("o_custkey").cast("string"))
    one = F.concat(F.lit('{"k":'), k.cast("string"), F.lit(',"v":"'), v, F.lit('"}'))
    one = F.when(k % 11 == 0, F.concat(F.lit("["), one, F.lit("]"))).otherwise(one)
    arrays = X.table(spark, d, "orders").groupBy(part.alias("part")).agg(F.concat_ws(", ", F.collect_list(one)).alias("items"))
    text = F.concat(F.lit("["), "items", F.when(F.col("part") % 9 == 4, "").otherwise("]"))
    path = f"{fresh_dir(spark, 'responses')}/files"
    arrays.select("part", text.alias("value")).write.partitionBy("part").text(path)
    items, rejects = files.split_responses(spark, path)
    doc = D.parse("body")
    read = items.where("body LIKE '{%'").select(D.get_path(doc, "k").alias("k"), D.get_path(doc, "v").alias("v"))
    part = F.when(F.col("position").isNull(), F.regexp_extract("file", "part=([0-9]+)", 1))
    return read.union(rejects.select(part.alias("k"), F.col("reason").alias("v")))


@query("merge_columns_hot_both", """WITH l AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE l_orderkey * 10 + l_linenumber END AS k, l_partkey AS a FROM lineitem),
r AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 31 WHEN o_orderkey = 1 THEN 1 ELSE o_orderkey * 10 + 1 END AS k, o_custkey AS c FROM orders)
SELECT k, a, c FROM l FULL JOIN r USING (k)""")
def merge_hot_both(spark, d):
    """One key holds half of the left rows, another half of the right ones."""
    line, order = F.col("l_linenumber"), F.col("o_orderkey")
    left = X.table(spark, d, "lineitem").select(
        F.when(line % 2 == 0, 1).otherwise(F.col("l_orderkey") * 10 + line).cast("bigint").alias("k"), F.col("l_partkey").alias("a"))
    right = X.table(spark, d, "orders").select(
        F.when(order % 2 == 0, 31).when(order == 1, 1).otherwise(order * 10 + 1).cast("bigint").alias("k"), F.col("o_custkey").alias("c"))
    return merge_columns([left, right], ["k"])[0]


# -- files and scenarios ----------------------------------------------------------------

@query("csv_table", f"""WITH {X.ORDERS_SQL} SELECT CAST(k AS VARCHAR) AS k, price, status, priority, cust FROM orders_b""")
def csv_table(spark, d):
    path = f"{fresh_dir(spark, 'csv')}/orders"
    files.write_table(X.orders_b(spark, d), path, fmt="csv")
    return files.read_table(spark, path, multi_line=False)


@query("csv_health", """SELECT count(*) AS rows, 3 AS header_width, count(*) FILTER (o_orderkey % 10 IN (3, 7)) AS bad_rows FROM orders""")
def csv_health(spark, d):
    path = f"{fresh_dir(spark, 'csv')}/ragged"
    k = F.col("o_orderkey")
    cells = F.array(k.cast("string"), "o_orderstatus", "o_orderpriority", F.lit("extra"))
    width = F.when(k % 10 == 3, 2).when(k % 10 == 7, 4).otherwise(3)
    lines = X.table(spark, d, "orders").select(F.array_join(F.slice(cells, F.lit(1), width), ",").alias("value"))
    # one header per file, as CSV writers leave it
    lines.select(F.col("value").alias("a,b,c")).write.option("header", True).option("quote", "\u0000").csv(path)
    out = files.csv_health(spark, path, multi_line=False)
    return out.groupBy("header_width").agg(F.sum("rows").alias("rows"), F.sum("bad_rows").alias("bad_rows")).select(
        "rows", "header_width", "bad_rows")


@query("scenario_runs", stats_sql("""SELECT 'tolerant' AS name, feature, mismatch, CAST(1 AS BIGINT) AS succeeded, CAST(1 AS BIGINT) AS failed FROM stats""", tol=1.0))
def scenario_runs(spark, d):
    made = {"a": X.orders_a(spark, d), "b": X.orders_b(spark, d)}
    tables: dict[str, DataFrame] = {}

    def keep(name, cmp):
        tables[name] = cmp.stats().select(F.lit(name).alias("name"), "feature", "mismatch")

    _, outcomes = run_scenarios(
        spark,
        [{"name": "tolerant", "left": "a", "right": "b", "tolerance": 1.0},
         {"name": "off", "left": "a", "right": "b", "enabled": False},
         {"name": "broken", "left": "a", "right": "b", "keys": "absent"}],
        read=made.__getitem__, defaults={"keys": "k"}, action=keep,
    )
    return tables["tolerant"].crossJoin(F.broadcast(outcome_counts(outcomes)))


# -- sketches of runs ----------------------------------------------------------------------

_RUNS = ((7, 9), (5, 9), (11, 6))  # a run's price differs in every so many orders, and its status


@query("run_sketches", " UNION ALL ".join(f"""SELECT '{f}' AS feature, CAST(3 AS BIGINT) AS runs,
count(*) FILTER ({' OR '.join(f'o_orderkey % {r[i]} = 0' for r in _RUNS)}) AS keys,
count(*) FILTER (o_orderkey % {_RUNS[1][i]} = 0 AND o_orderkey % {_RUNS[0][i]} <> 0) AS appeared,
count(*) FILTER (o_orderkey % {_RUNS[0][i]} = 0 AND o_orderkey % {_RUNS[1][i]} <> 0) AS gone,
count(*) FILTER (o_orderkey % {_RUNS[0][i]} = 0 AND o_orderkey % {_RUNS[1][i]} = 0) AS stayed FROM orders""" for i, f in enumerate(("price", "status"))))
def run_sketches(spark, d):
    """Three runs, each stored as its sketches: keys that differ in any, and what the second changed."""
    o, k = X.table(spark, d, "orders"), F.col("o_orderkey")
    left = o.select(k.alias("k"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    history = None
    for n, (p, q) in enumerate(_RUNS):
        right = left.withColumns({"price": F.col("price") + F.when(F.col("k") % p == 0, 1.0).otherwise(0.0), "status": F.when(F.col("k") % q == 0, "?").otherwise(F.col("status"))})
        run = stored(R.run_sketch(compare(left, right, "k", unique_lookup=True, unique_driver=True), f"run{n}"), "run")
        history = run if history is None else history.union(run)
    return R.differing_keys(history).join(R.run_changes(history, "run0", "run1"), "feature")


# -- roles, key policies, excluded columns, context ------------------------------------------

@query("detect_roles", """SELECT o_custkey AS customer, count(o_orderdate) AS times, 2 * count(*) AS cells FROM orders GROUP BY o_custkey""")
def detect_roles(spark, d):
    """Rows, times and feature cells of each customer, with the columns found by their names."""
    rows = X.table(spark, d, "orders").selectExpr("o_orderkey AS row", "o_custkey AS `CustNo`", "o_orderdate AS use_create_time", "o_orderstatus AS f1", "o_orderpriority AS f2")
    found, names = K.detect_roles(rows.columns), rows.columns
    cells = F.array(*[F.col(c) for c in names[found["feature_start"]:]])
    return rows.groupBy(F.col(names[found["customer"]]).alias("customer")).agg(
        F.count(names[found["time"]]).alias("times"), F.sum(F.size(cells)).alias("cells"))


_ANY_KEYS_SQL = """WITH l AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS id,
CASE WHEN o_orderkey % 5 = 0 THEN 'd' || o_orderkey WHEN o_orderkey % 3 = 0 THEN '' ELSE 'x' END AS day, CAST(o_custkey AS VARCHAR) AS custno,
'c' || o_orderkey AS create_time, o_orderstatus AS f, o_orderkey AS k FROM orders),
r AS (SELECT id, day, CASE WHEN k % 7 = 0 THEN 'changed' ELSE f END AS f, k FROM l WHERE k % 11 <> 0)"""


@query("compare_any_keys", f"""{_ANY_KEYS_SQL} SELECT l.id, l.day, custno AS customer, create_time AS left_time, CASE WHEN k % 13 = 0 THEN 'c' || k ELSE 'raw' || k END AS right_time,
'f' AS feature, l.f AS left_value, r.f AS right_value, 'now' || k AS time_now FROM l JOIN r USING (k) WHERE l.f <> r.f""")
def compare_any_keys(spark, d):
    """Keys of which any part may be missing; times of the table before it was parsed; time_now is never compared."""
    o, k = X.table(spark, d, "orders"), F.col("o_orderkey")
    id_ = F.when(k % 5 != 0, k.cast("string"))
    day = F.when(k % 5 == 0, F.concat(F.lit("d"), k)).when(k % 3 != 0, "x")
    head = [id_.alias("id"), day.alias("day"), F.col("o_custkey").cast("string").alias("custno"), F.concat(F.lit("c"), k).alias("create_time")]
    f = F.col("o_orderstatus")
    left = o.select(*head, F.lit("then").alias("time_now"), f.alias("f"))
    right = o.where(k % 11 != 0).select(*head, F.concat(F.lit("now"), k).alias("time_now"), F.when(k % 7 == 0, "changed").otherwise(f).alias("f"))
    original = o.where(k % 13 != 0).select(id_.alias("id"), day.alias("day"), F.concat(F.lit("raw"), k).alias("create_time"))
    return diff_detail(compare(left, right, ["id", "day"], mode="offline", context_from=original))


@query("compare_excluded_columns", """SELECT 'f' AS feature, count(*) AS total, count(*) FILTER (o_orderkey % 7 <> 0) AS match, count(*) FILTER (o_orderkey % 7 = 0) AS mismatch FROM orders""")
def compare_excluded_columns(spark, d):
    """`pt` and `time_now` differ in every row and are not compared."""
    o, k = X.table(spark, d, "orders"), F.col("o_orderkey")
    left = o.select(k.alias("id"), F.lit("p1").alias("PT"), F.lit("t1").alias("time_now"), F.lit("v").alias("f"))
    right = o.select(k.alias("id"), F.lit("p2").alias("PT"), F.lit("t2").alias("time_now"), F.when(k % 7 == 0, "w").otherwise("v").alias("f"))
    return compare(left, right, "id", mode="response").stats()


@query("scientific_zero", """SELECT o_orderkey % 5 AS kind, count(*) AS n, count(*) FILTER (o_orderkey % 5 < 3) AS same FROM orders GROUP BY 1""")
def scientific_zero(spark, d):
    k = F.col("o_orderkey")
    cell = F.when(k % 5 == 0, "0E-8").when(k % 5 == 1, "-0e-20").when(k % 5 == 2, "1E-16").when(k % 5 == 3, "5E-3").otherwise("1E-9")
    rows = X.table(spark, d, "orders").select((k % 5).alias("kind"), cells_equal(cell, F.lit("0")).alias("same"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("same").alias("same"))


@query("features_node", """SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_orderkey + CASE WHEN o_orderkey % 4 = 1 THEN 1 ELSE 0 END AS VARCHAR) AS a,
CASE o_orderkey % 4 WHEN 0 THEN 'x' WHEN 2 THEN 'z' ELSE '' END AS b, CASE WHEN o_orderkey % 4 = 1 THEN 'y' ELSE '' END AS c FROM orders WHERE o_orderkey % 4 <> 3""")
def features_node(spark, d):
    """Features in an object, in a list of objects of which later ones win, and in the document itself."""
    k = F.col("o_orderkey")
    body = (F.when(k % 4 == 0, F.format_string('{"features":{"a":%d,"b":"x"},"other":1}', k))
            .when(k % 4 == 1, F.format_string('{"features":[{"a":%d},7,{"a":%d,"c":"y"}]}', k, k + 1))
            .when(k % 4 == 2, F.format_string('{"a":%d,"b":"z"}', k)).otherwise("no json"))
    return D.json_to_wide(X.table(spark, d, "orders").select(k.alias("id"), body.alias("body")), "body", "id")


_DETAIL_SQL = f"""{cells_sql()} SELECT k, feature, {shown_sql('r')} AS right_value, {shown_sql('l')} AS left_value FROM cells WHERE NOT same"""


def _sorted_detail(spark, d, sort):
    return preview(diff_detail(_orders(spark, d), sort=sort), 500).select("k", "feature", "right_value", "left_value")


@query("preview_by_key", f"{_DETAIL_SQL} ORDER BY k, feature LIMIT 500")
def preview_by_key(spark, d):
    return _sorted_detail(spark, d, "key")


@query("preview_by_feature", f"{_DETAIL_SQL} ORDER BY feature, k LIMIT 500")
def preview_by_feature(spark, d):
    return _sorted_detail(spark, d, "feature")


@query("report_bundle", stats_sql("""SELECT 'statistics' AS name, feature, mismatch AS n FROM stats
UNION ALL SELECT 'detail', feature, mismatch FROM stats WHERE mismatch > 0 UNION ALL SELECT 'summary', feature, mismatch FROM stats WHERE mismatch > 0"""))
def report_bundle(spark, d):
    """The tables of a run as they are read back; the one-sided ones of this run are not empty."""
    paths = write_reports(_orders(spark, d), f"{fresh_dir(spark, 'reports')}/run")
    read = {n: spark.read.parquet(p) for n, p in paths.items()}
    n = F.count(F.lit(1)).alias("n")
    return (read["statistics"].select(F.lit("statistics").alias("name"), "feature", F.col("mismatch").alias("n"))
            .union(read["detail"].groupBy("feature").agg(n).select(F.lit("detail"), "feature", "n"))
            .union(read["summary"].select(F.lit("summary"), "feature", F.col("diff_count"))))


# -- streaming: the file source, run until its input is used up ---------------------------

def _response_stream(spark, d):
    """The events file read as a stream, turned into responses."""
    events = X.table(spark, d, "events")
    stream = (
        spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    )
    return X.responses_of(stream)


def _run(stream, root: str, name: str, mode: str, tables: dict | None = None) -> str:
    target = f"{root}/{name}"
    writer = stream.writeStream.option("checkpointLocation", f"{root}/{name}-checkpoint")
    writer = writer.outputMode(mode).trigger(availableNow=True)
    if tables is None:
        run = writer.format("parquet").option("path", target).start()
    else:
        run = writer.foreachBatch(ST.write_batches(tables, root)).start()
    run.awaitTermination()
    return target


def _stream_parts(spark, d):
    """The static side, what to do to arriving bodies, and the catalogue of the stored ones."""
    left = X.requests(spark, d).select(
        F.col("id").alias("k"), "uid", F.col("K").alias("count"), "kind"
    )
    body = F.replace("body", F.lit('"k":'), F.lit('"Count":'))
    return left, body, D.discover(X.responses(spark, d).select(D.parse(body).alias("doc")), "doc")


def _stream_cells(spark, d, **options):
    left, body, catalog = _stream_parts(spark, d)
    stream = _response_stream(spark, d).withColumn("body", body)
    return ST.stream_cells(stream, left, ["k"], ["uid", "count", "kind"], catalog=catalog, **options)


_STREAM_SQL = f"""WITH {X.REQUESTS_SQL}, {X.RESPONSES_SQL},
pairs AS (SELECT q.*, r.k, r.state, r.uid AS ruid, r.n AS rn, r.kind AS rkind, r.ts FROM requests q
          JOIN responses r ON q.id = CAST(r.k AS VARCHAR) WHERE r.state NOT IN ('bad', 'error')),
c AS (SELECT id AS k, ts, 'uid' AS feature, uid AS l, CASE WHEN state <> 'empty' THEN ruid END AS r FROM pairs
      UNION ALL SELECT id, ts, 'count', kk, CASE WHEN state <> 'empty' THEN rn END FROM pairs
      UNION ALL SELECT id, ts, 'kind', kind, CASE WHEN state <> 'empty' THEN rkind END FROM pairs),
cells AS (SELECT *, {eq_sql('l', 'r')} AS same FROM c)"""


@query("stream_compare_batches", f"{_STREAM_SQL} SELECT k, feature, l AS left_value, r AS right_value FROM cells WHERE NOT same")
def stream_compare_batches(spark, d):
    """Responses in three lots, joined by the hot keys that the lots before them showed."""
    root = fresh_dir(spark, "lots")
    left, body, catalog = _stream_parts(spark, d)
    events = X.table(spark, d, "events")
    for lot in range(3):
        events.where(F.col("event_id") % 3 == lot).write.mode("append").parquet(f"{root}/in")
        stream = X.responses_of(spark.readStream.schema(events.schema).parquet(f"{root}/in")).withColumn("body", body)
        run = stream.writeStream.foreachBatch(ST.balanced_batches(left, ["k"], ["uid", "count", "kind"], f"{root}/out", catalog=catalog))
        run.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out/diffs").drop("batch")


@query("stream_late_rows", """WITH e AS (SELECT event_id % 4 AS b, event_type AS feature, ts, event_id % 3 = 0 AS ok FROM events),
m AS (SELECT b, max(ts) AS latest FROM e GROUP BY b), w AS (SELECT m.b, max(x.latest) - INTERVAL 9 DAY AS mark FROM m LEFT JOIN m x ON x.b < m.b GROUP BY m.b),
r AS (SELECT feature, ok, coalesce(date_trunc('day', ts) + INTERVAL 1 DAY <= mark, false) AS late FROM e JOIN w USING (b))
SELECT feature, count(*) FILTER (NOT late) AS total, count(*) FILTER (NOT late AND ok) AS match, count(*) FILTER (late) AS late FROM r GROUP BY feature""")
def stream_late_rows(spark, d):
    """Four batches, one after the other: windows that are counted on time, and the late rows beside them."""
    root = fresh_dir(spark, "late-rows")
    events = X.table(spark, d, "events").select(
        F.col("event_type").alias("feature"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_id") % 3 == 0).alias("is_match"), (F.col("event_id") % 4).alias("b"))
    for b in range(4):  # what has come since the last run is a batch
        events.where(F.col("b") == b).drop("b").write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(events.drop("b").schema).parquet(f"{root}/in")
        run = stream.writeStream.foreachBatch(ST.split_batches(f"{root}/out", "at", "1 day", "9 days"))
        run.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    counted = ST.read_windows(spark, f"{root}/out").groupBy("feature").agg(F.sum("total").alias("total"), F.sum("match").alias("match"))
    late = ST.read_late(spark, f"{root}/out").groupBy("feature").agg(F.count(F.lit(1)).alias("late"))
    return counted.join(late, "feature", "left").select("feature", "total", "match", F.coalesce("late", F.lit(0)).alias("late"))


@query("stream_compare", f"{_STREAM_SQL} SELECT k, feature, l AS left_value, r AS right_value FROM cells WHERE NOT same")
def stream_compare(spark, d):
    cells = _stream_cells(spark, d)
    root = fresh_dir(spark, "stream")
    return spark.read.parquet(_run(cells.where(~F.col("is_match")).drop("is_match"), root, "diffs", "append"))


@query("stream_feature_stats", f"{_STREAM_SQL}, {_PER_FEATURE} SELECT feature, total, match, mismatch FROM stats")
def stream_feature_stats(spark, d):
    root = fresh_dir(spark, "stream")
    stats = ST.stream_feature_stats(_stream_cells(spark, d))
    path = _run(stats, root, "stats", "complete", {"stats": lambda batch: batch})
    # complete mode: the last batch holds every feature
    out = spark.read.parquet(path)
    last = out.agg(F.max("batch").alias("batch"))
    return out.join(F.broadcast(last), "batch").select("feature", "total", "match", "mismatch")


@query("stream_window_stats", f"""{_STREAM_SQL},
closed AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM cells),
w AS (SELECT *, date_trunc('day', ts) AS day FROM cells)
SELECT day, feature, count(*) AS total, count(*) FILTER (same) AS match, count(*) FILTER (NOT same) AS mismatch
FROM w WHERE day + INTERVAL 1 DAY <= (SELECT mark FROM closed) GROUP BY day, feature""")
def stream_window_stats(spark, d):
    root = fresh_dir(spark, "stream")
    stats = ST.stream_feature_stats(_stream_cells(spark, d, carry=["ts"]), time="ts", window="1 day", watermark="10 minutes")
    out = spark.read.parquet(_run(stats, root, "windows", "append"))
    return out.select(F.col("window.start").alias("day"), "feature", "total", "match", "mismatch")


@query("stream_last", """SELECT user_id, arg_max(event_id, ts) AS k, arg_max(event_type, ts) AS kind, max(ts) AS ts FROM events GROUP BY user_id""")
def stream_last(spark, d):
    events = X.table(spark, d, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    rows = stream.select("user_id", F.col("event_id").alias("k"), F.col("event_type").alias("kind"), "ts")
    root = fresh_dir(spark, "stream")
    path = _run(ST.stream_last(rows, ["user_id"], ["ts"]), root, "last", "update", {"last": lambda batch: batch})
    return ST.read_last(spark, path, ["user_id"], ["ts"]).select("user_id", "k", "kind", "ts")


@query("stream_errors", f"""WITH {X.RESPONSES_SQL} SELECT k, CASE state WHEN 'error' THEN 'timeout' ELSE 'response is no JSON object' END AS error
FROM responses WHERE state IN ('error', 'bad')""")
def stream_errors(spark, d):
    root = fresh_dir(spark, "stream")
    tables = {"errors": lambda batch: ST.stream_errors(batch), "good": lambda batch: ST.parse_stream(batch).where("error is null").drop("doc")}
    _run(_response_stream(spark, d), root, "split", "append", tables)
    return spark.read.parquet(f"{root}/errors").select("k", "error")
