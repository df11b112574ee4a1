"""URL rules found by their rarest literal token.

A rule is a regular expression over host + path with the literal tokens it cannot match
without. Each rule is indexed under the one of its tokens that the fewest URLs hold; a
URL's tokens fetch its candidate rules, and only those run their expression. Rules are
judged per distinct (id, url), so repeated rows cost nothing, and no Python runs.

Null and malformed URLs (no "://") have an empty host and path and match no rule. Rules
without a usable token are candidates of every URL. Ties between rules of one length go
to the smaller rule text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, written

#: Host and path rules, longest wins: fixed values of the query.
SITE_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Words of a host name that mark unwanted sites, and words of a path.
HOST_WORDS = ("adult", "bets", "casino", "escort", "gambling", "loans", "pills", "porn", "torrent", "viagra", "warez", "xxx")
PATH_WORDS = ("casino", "cgi-bin", "porn", "viagra", "xxx")
_SEPARATOR = r"[^0-9a-z]+"


def rule_rows(site_rules=SITE_RULES, host_words=HOST_WORDS, path_words=PATH_WORDS) -> list[tuple]:
    """(rule, kind, verdict, regex, tokens, rank). Site rules rank above word rules."""
    rows = []
    for text, verdict in site_rules:
        host, path = text.split("/", 1)
        whole = re.findall("[0-9a-z]+", host.lower())
        inner = re.findall("[0-9a-z]+(?=[^0-9a-z])", path.lower())  # the last token of a path may be a prefix of the URL's
        rows.append((text, "site", verdict, rf"^(?:[^/]*\.)?{re.escape(host)}/{re.escape(path)}", whole + inner, 1_000_000 + len(text)))
    for w in host_words:
        rows.append((w, "host", "block", rf"^(?:[^/]*[^0-9a-z/])?{re.escape(w)}(?:[^0-9a-z]|$)", re.findall("[0-9a-z]+", w), len(w)))
    for w in path_words:
        rows.append((w, "path", "block", rf"(?s)^[^/]*/(?:.*[^0-9A-Za-z])?{re.escape(w)}(?:[^0-9A-Za-z]|$)", re.findall("[0-9a-z]+", w), len(w)))
    return rows


def rules_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "rule string, kind string, verdict string, regex string, tokens array<string>, rank int")


def parts(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return (F.coalesce(ascii_lower(F.regexp_extract(url, pattern, 1)), F.lit("")),
            F.coalesce(F.regexp_extract(url, pattern, 2), F.lit("")))


def _tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.split(ascii_lower(F.concat(host, path)), _SEPARATOR))


def index_rules(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """Give every rule the token that the fewest URLs hold ("" if it has none)."""
    wanted = written(rules.select(F.explode("tokens").alias("token")).distinct(), "rule-tokens")
    held = urls.select(F.explode(_tokens(F.col("host"), F.col("path"))).alias("token"))
    counts = held.join(wanted, "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    by_token = rules.select("rule", "kind", F.explode("tokens").alias("token")).join(counts, "token", "left")
    rarest = by_token.groupBy("rule", "kind").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("best"))
    joined = rules.join(rarest, ["rule", "kind"], "left")
    return joined.select("rule", "kind", "verdict", "regex", "rank", F.coalesce("best.token", F.lit("")).alias("token"))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: id, url, host, path, rule (of the winning site rule), verdict."""
    host, path = parts(F.col("url"))
    # one shuffle; everything below keeps its partitioning
    urls = (
        pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"))
        .groupBy("id", "url").agg(F.count(F.lit(1)).alias("copies"))
        .withColumns({"host": host, "path": path})
    )
    spelled = pages.select(F.col(f"`{url_col}`").cast("string").alias("url")).select(*[c.alias(n) for c, n in zip(parts(F.col("url")), ("host", "path"))])
    # written, so that Spark knows its size: a small index is broadcast, a large one is joined by shuffle
    index = written(index_rules(rules, spelled), "url-rules")
    every = F.array_distinct(F.array_append(_tokens(F.col("host"), F.col("path")), F.lit("")))
    tokens = urls.withColumn("token", F.explode(every))
    hay = F.concat("host", "path")
    matched = tokens.join(index, "token", "left").withColumn("hit", F.coalesce(F.rlike(hay, F.col("regex")), F.lit(False)))
    # the smaller text wins a tie of ranks: max over rank, min over rule
    best = F.min(F.when(F.col("hit"), F.struct((-F.col("rank")).alias("rank"), "rule", "kind", "verdict")))
    judged = matched.groupBy("id", "url", "host", "path", "copies").agg(best.alias("best"))
    one = judged.select(
        "id", "url", "host", "path", "copies",
        F.when(F.col("best.kind") == "site", F.col("best.rule")).alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
    return one.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).drop("copies", "__copy")
