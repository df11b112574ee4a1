"""Tables derived from the driver's tables for the registered queries.

Each has a Spark and a SQL form that give the same rows. Deviations between the two
sides are spread by arithmetic on the keys; every source row is kept.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _every(c: Column, n: int) -> Column:
    return c % n == 0


# -- orders, two versions ------------------------------------------------------------

def orders_a(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        (k + F.when(_every(k, 97), 20_000_000).otherwise(0)).alias("k"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string").alias("price"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_custkey").cast("string").alias("cust"),
    )


def orders_b(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return table(spark, d, "orders").select(
        (k + F.when(_every(k, 101), 10_000_000).otherwise(0)).alias("k"),
        F.when(_every(k, 7), (cents + 1).cast("string"))
        .when(_every(k, 5), F.concat(cents.cast("string"), F.lit(".0")))
        .otherwise(cents.cast("string")).alias("price"),
        F.when(_every(k, 11), F.lit("null"))
        .otherwise(F.concat(F.lit(" "), "o_orderstatus", F.lit(" "))).alias("status"),
        F.when(~_every(k, 13), F.col("o_orderpriority")).alias("priority"),
        F.when(_every(k, 17), F.lit("-999")).when(_every(k, 19), F.lit("0"))
        .otherwise(F.col("o_custkey").cast("string")).alias("cust"),
    )


ORDERS_SQL = """
orders_a AS (
  SELECT o_orderkey + CASE WHEN o_orderkey % 97 = 0 THEN 20000000 ELSE 0 END AS k,
         CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS price,
         o_orderstatus AS status, o_orderpriority AS priority,
         CAST(o_custkey AS VARCHAR) AS cust
  FROM orders),
orders_b AS (
  SELECT o_orderkey + CASE WHEN o_orderkey % 101 = 0 THEN 10000000 ELSE 0 END AS k,
         CASE WHEN o_orderkey % 7 = 0 THEN CAST(CAST(round(o_totalprice * 100) AS BIGINT) + 1 AS VARCHAR)
              WHEN o_orderkey % 5 = 0 THEN CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) || '.0'
              ELSE CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) END AS price,
         CASE WHEN o_orderkey % 11 = 0 THEN 'null' ELSE ' ' || o_orderstatus || ' ' END AS status,
         CASE WHEN o_orderkey % 13 <> 0 THEN o_orderpriority END AS priority,
         CASE WHEN o_orderkey % 17 = 0 THEN '-999' WHEN o_orderkey % 19 = 0 THEN '0'
              ELSE CAST(o_custkey AS VARCHAR) END AS cust
  FROM orders)
"""


# -- numbers as text -----------------------------------------------------------------

def lexemes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string")
    case = k % 12
    raw = (
        F.when(case == 0, F.concat(F.lit(" "), cents, F.lit(" ")))
        .when(case == 1, F.concat(cents, F.lit(".0")))
        .when(case == 2, F.concat(F.lit('"'), cents, F.lit('"')))
        .when(case == 3, F.concat(F.lit("'"), cents, F.lit("'")))
        .when(case == 4, F.concat(cents, F.lit("e0")))
        .when(case == 5, F.concat(F.lit("+"), cents))
        .when(case == 6, F.concat(cents, F.lit("d")))
        .when(case == 7, F.concat(F.lit("abc"), cents))
        .when(case == 8, F.lit(""))
        .when(case == 9, F.lit("null"))
        .when(case == 10, F.lit("1_000"))
        .otherwise(F.concat(F.lit("1,"), F.lpad((k % 1000).cast("string"), 3, "0")))
    )
    return table(spark, d, "orders").select(k.alias("k"), cents.alias("cents"), raw.alias("raw"))


LEXEMES_SQL = """
lexemes AS (
  SELECT k, cents, kind, CASE kind
    WHEN 0 THEN ' ' || cents || ' ' WHEN 1 THEN cents || '.0' WHEN 2 THEN '"' || cents || '"'
    WHEN 3 THEN '''' || cents || '''' WHEN 4 THEN cents || 'e0' WHEN 5 THEN '+' || cents
    WHEN 6 THEN cents || 'd' WHEN 7 THEN 'abc' || cents WHEN 8 THEN '' WHEN 9 THEN 'null'
    WHEN 10 THEN '1_000' ELSE '1,' || lpad(CAST(k % 1000 AS VARCHAR), 3, '0') END AS raw
  FROM (SELECT o_orderkey AS k, o_orderkey % 12 AS kind,
               CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS cents FROM orders))
"""


# -- times as text -------------------------------------------------------------------

def times(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    full = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    case = k % 8
    text = (
        F.when(case == 0, full.substr(1, 10))
        .when(case == 1, F.replace(full.substr(1, 10), F.lit("-"), F.lit("/")))
        .when(case == 2, F.replace(full.substr(1, 10), F.lit("-"), F.lit("")))
        .when(case == 3, F.replace(full, F.lit(" "), F.lit("T")))
        .when(case == 4, full.substr(1, 19))
        .when(case == 5, F.replace(full.substr(1, 21), F.lit(" "), F.lit("T")))
        .when(case == 6, F.lit(""))
        .otherwise(full.substr(1, 23))
    )
    return table(spark, d, "events").select(k.alias("k"), text.alias("t"))


# `s` is the second-exact stamp, `f` the three digits that survive normalisation
TIMES_SQL = """
times AS (
  SELECT k, kind, s, d, f, later, CASE kind
    WHEN 0 THEN d WHEN 1 THEN replace(d, '-', '/') WHEN 2 THEN replace(d, '-', '')
    WHEN 3 THEN replace(s, ' ', 'T') || '.' || us WHEN 4 THEN s
    WHEN 5 THEN replace(s, ' ', 'T') || '.' || us[1:1] WHEN 6 THEN ''
    ELSE s || '.' || us[1:3] END AS t
  FROM (SELECT event_id AS k, event_id % 8 AS kind, strftime(ts, '%Y-%m-%d %H:%M:%S') AS s,
               strftime(ts, '%Y-%m-%d') AS d, strftime(ts, '%f') AS us,
               strftime(ts + INTERVAL 1 SECOND, '%Y-%m-%dT%H:%M:%S') AS later,
               CASE event_id % 8 WHEN 3 THEN strftime(ts, '%f')[1:3] WHEN 4 THEN '000'
                    WHEN 5 THEN strftime(ts, '%f')[1:1] || '00' WHEN 7 THEN strftime(ts, '%f')[1:3]
               END AS f
        FROM events))
"""


# -- decimals ------------------------------------------------------------------------

def decimals(spark: SparkSession, d: str) -> DataFrame:
    """Source with four decimals that never sits on a rounding tie; reference as text
    with 0-3 places, off by 0-4 units of its last place."""
    m = F.round(F.col("l_extendedprice") * 100).cast("bigint") * 10 + 1
    p = F.pmod(F.col("l_linenumber"), F.lit(4))
    unit = F.pow(F.lit(10), p).cast("bigint")
    r = F.floor(m / F.pow(F.lit(10), 4 - p)).cast("bigint") + F.col("l_partkey") % 5
    whole = F.floor(r / unit).cast("bigint")
    frac = F.lpad((r % unit).cast("string"), p, "0")
    ref = F.when(p == 0, whole.cast("string")).otherwise(F.concat_ws(".", whole.cast("string"), frac))
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (m / F.lit(10000.0)).alias("src"), ref.alias("ref")
    )


DECIMALS_SQL = """
decimals AS (
  SELECT l_orderkey, l_linenumber, l_partkey, m, p, m / 10000.0::DOUBLE AS src, r,
         r / CAST(u AS DOUBLE) AS ref_number,
         CASE WHEN p = 0 THEN CAST(r AS VARCHAR)
              ELSE CAST(r // u AS VARCHAR) || '.' || lpad(CAST(r % u AS VARCHAR), p, '0') END AS ref, u,
         CAST(pow(10, 4 - p) AS BIGINT) AS cut
  FROM (SELECT *, m // CAST(pow(10, 4 - p) AS BIGINT) + l_partkey % 5 AS r, CAST(pow(10, p) AS BIGINT) AS u
        FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) * 10 + 1 AS m,
                     CAST(l_linenumber % 4 AS INTEGER) AS p FROM lineitem)))
"""


# -- responses and nested documents ---------------------------------------------------

def responses(spark: SparkSession, d: str) -> DataFrame:
    """One stored response per event: most hold `data.features`; others hold values
    directly under `data`, an empty `data`, broken text or an error."""
    return responses_of(table(spark, d, "events")).select("k", "body")


def responses_of(events: DataFrame) -> DataFrame:
    k = F.col("event_id")
    n = F.get_json_object("props", "$.k")
    inner = F.concat(F.lit('"uid":"'), F.col("user_id").cast("string"), F.lit('","k":'), n)
    kind = F.concat(F.lit('"kind":"'), "event_type", F.lit('"'))
    body = (
        F.when(_every(k, 37), F.lit('{"_error":"timeout"}'))
        .when(_every(k, 31), F.lit("{bad"))
        .when(_every(k, 29), F.lit('{"retCode":"0","data":{}}'))
        .when(_every(k, 10), F.concat(F.lit('{"retCode":"0","data":{'), inner, F.lit(","), kind, F.lit("}}")))
        .otherwise(F.concat(F.lit('{"retCode":"0","data":{"features":{'), inner, F.lit("},"), kind, F.lit("}}")))
    )
    return events.select(k.alias("k"), F.col("ts").cast("timestamp").alias("ts"), body.alias("body"))


# state: error, bad, empty, direct or full
RESPONSES_SQL = """
responses AS (
  SELECT event_id AS k, CAST(user_id AS VARCHAR) AS uid, regexp_extract(props, '[0-9]+') AS n,
         event_type AS kind, ts, user_id, value,
         CASE WHEN event_id % 37 = 0 THEN 'error' WHEN event_id % 31 = 0 THEN 'bad'
              WHEN event_id % 29 = 0 THEN 'empty' WHEN event_id % 10 = 0 THEN 'direct'
              ELSE 'full' END AS state
  FROM events)
"""


def requests(spark: SparkSession, d: str) -> DataFrame:
    """The table the responses answer: what the caller believes the features are."""
    k = F.col("event_id")
    n = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, d, "events").select(
        k.cast("string").alias("id"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("create_time"),
        F.when(_every(k, 23), F.lit("0")).otherwise(F.col("user_id").cast("string")).alias("uid"),
        F.when(_every(k, 7), (n + 2).cast("string")).when(_every(k, 9), F.concat(n.cast("string"), F.lit(".0")))
        .otherwise(n.cast("string")).alias("K"),
        F.when(_every(k, 13), F.lit("")).otherwise(F.col("event_type")).alias("kind"),
    )


REQUESTS_SQL = """
requests AS (
  SELECT CAST(event_id AS VARCHAR) AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS create_time,
         CASE WHEN event_id % 23 = 0 THEN '0' ELSE CAST(user_id AS VARCHAR) END AS uid,
         CASE WHEN event_id % 7 = 0 THEN CAST(CAST(regexp_extract(props, '[0-9]+') AS BIGINT) + 2 AS VARCHAR)
              WHEN event_id % 9 = 0 THEN regexp_extract(props, '[0-9]+') || '.0'
              ELSE regexp_extract(props, '[0-9]+') END AS kk,
         CASE WHEN event_id % 13 = 0 THEN '' ELSE event_type END AS kind
  FROM events)
"""


def nested(spark: SparkSession, d: str) -> DataFrame:
    n = F.get_json_object("props", "$.k")
    doc = F.concat(
        F.lit('{"a":{"b":'), F.col("user_id").cast("string"), F.lit(',"c":{"d":"'), "event_type",
        F.lit('"}},"l":[1,null,'), n, F.lit('],"o":[{"p":'), n, F.lit('},{"p":2},{"p":'), n,
        F.lit('}],"e":{},"z":null}'),
    )
    return table(spark, d, "events").select(
        F.col("event_id").alias("apply_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("apply_time"),
        F.when(_every(F.col("event_id"), 41), F.lit("")).otherwise(doc).alias("response_body"),
    )


NESTED_SQL = """
nested AS (
  SELECT event_id AS apply_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS apply_time,
         CAST(user_id AS VARCHAR) AS b, event_type AS d, regexp_extract(props, '[0-9]+') AS n,
         event_id % 41 <> 0 AS filled
  FROM events)
"""
