"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, html_text, jaccard, lm_score, packing, quality, simhash, spelling, suffix_dedup, toxicity, url_filter, warc
from .common import table


def tokenizer_path() -> str:
    from public_tokenizers import path

    return path("word_bpe_49k.json")


def op1_warc(spark: SparkSession, d: str) -> DataFrame:
    got = warc.archived(table(spark, d, "pages"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, d, "labels")))


def op3_decontamination(spark: SparkSession, d: str) -> DataFrame:
    found = decontaminate.find(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark"))
    ids = F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", ids, (F.col("n_hit") > 0).alias("contaminated"))


def op4_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, d, "documents").select("doc_id", "text"))


def op5_lm_score(spark: SparkSession, d: str) -> DataFrame:
    return lm_score.score(table(spark, d, "documents"), table(spark, d, "labels"))


def op6_quality(spark: SparkSession, d: str) -> DataFrame:
    led = quality.ledger(table(spark, d, "documents"), keep=("doc_id",))
    return quality.apply_policy(led).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_bits")


def op7_html(spark: SparkSession, d: str) -> DataFrame:
    return html_text.extract(table(spark, d, "pages"))


def op8_url_filter(spark: SparkSession, d: str) -> DataFrame:
    rules = url_filter.rules_table(spark, url_filter.rule_rows())
    judged = url_filter.judge(table(spark, d, "pages"), rules)
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op9_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return jaccard.join(table(spark, d, "documents"))


def op10_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pieces(table(spark, d, "documents"), tokenizer_path())


def op11_simhash(spark: SparkSession, d: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, d, "documents"))


def op12_spelling(spark: SparkSession, d: str) -> DataFrame:
    return spelling.variants(table(spark, d, "documents"))


def op13_collocations(spark: SparkSession, d: str) -> DataFrame:
    return collocations.mine(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_toxicity": op2_toxicity,
    "op3_decontamination": op3_decontamination,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_lm_score": op5_lm_score,
    "op6_quality": op6_quality,
    "op7_html": op7_html,
    "op8_url_filter": op8_url_filter,
    "op9_jaccard": op9_jaccard,
    "op10_packing": op10_packing,
    "op11_simhash": op11_simhash,
    "op12_spelling": op12_spelling,
    "op13_collocations": op13_collocations,
}

_WARC_SQL = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages
), q AS (SELECT page_id, payload_bytes, sha1(body) AS payload_digest FROM p
), o AS (SELECT payload_digest, max(page_id) AS owner FROM q WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN owner <> page_id THEN owner END AS refers_to
FROM q LEFT JOIN o USING (payload_digest)
"""

_QUALITY_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents
), g AS (
    SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS gram
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1
), n AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, range(0, 3) k(k) GROUP BY doc_id
), m AS (
    SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
           length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines,
           coalesce(n_repeat_words, 0) AS n_repeat_words, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
           length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters
    FROM d LEFT JOIN n USING (doc_id)
), b AS (
    SELECT *, CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 100 * n_symbols > 20 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
        + CASE WHEN n_letters >= 50 AND 100 * n_upper > 60 * n_letters THEN 16 ELSE 0 END
        + CASE WHEN word_chars > 25 * n_words THEN 32 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 64 ELSE 0 END AS failed_bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 <> 0 AS base_failed,
       failed_bits & 119 = 0 AS kept, failed_bits FROM b
"""

_URL_SQL = r"""
WITH u AS (
    SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages
), r AS (
    SELECT page_id, host, path, CASE
        WHEN regexp_matches(host || path, '^(?:[^/]*\.)?example\.org/en/1') THEN 'example.org/en/1'
        WHEN regexp_matches(host || path, '^(?:[^/]*\.)?example\.org/es/') THEN 'example.org/es/'
        WHEN regexp_matches(host || path, '^(?:[^/]*\.)?com/fr/') THEN 'com/fr/'
        WHEN regexp_matches(host || path, '^(?:[^/]*\.)?com/de/') THEN 'com/de/'
        WHEN regexp_matches(host || path, '^(?:[^/]*\.)?org/') THEN 'org/' END AS rule FROM u
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IS NOT NULL THEN CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' ELSE 'block' END
    WHEN regexp_matches(host, '(^|[^0-9a-z])(adult|bets|casino|escort|gambling|loans|pills|porn|torrent|viagra|warez|xxx)([^0-9a-z]|$)') THEN 'block'
    WHEN regexp_matches(path, '(?s)(^/|[^0-9A-Za-z])(casino|cgi-bin|porn|viagra|xxx)([^0-9A-Za-z]|$)') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

_DECONTAMINATION_SQL = r"""
WITH dw AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), k AS (
    SELECT item_id, w, least(10, len(w)) AS width, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0
), win AS (SELECT DISTINCT item_id, width, array_to_string(w[i : i + width - 1], ' ') AS gram FROM k
), dk AS (
    SELECT doc_id, s.width, w, unnest(range(1, len(w) - s.width + 2)) AS i FROM dw, (SELECT DISTINCT width FROM win) s WHERE len(w) >= s.width
), m AS (
    SELECT doc_id, i, dk.width, item_id FROM dk JOIN win ON dk.width = win.width AND array_to_string(w[i : i + dk.width - 1], ' ') = gram
), h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS p FROM m) GROUP BY doc_id
), it AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""

_COLLOCATION_SQL = r"""
WITH p AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), i AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) s(k) WHERE len(w) >= k
), f AS (SELECT lang, k AS size, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS n FROM i GROUP BY ALL
), c AS (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND n >= 10
), u AS (SELECT *, unnest(range(1, size)) AS k FROM c
), s AS (
    SELECT u.lang, u.phrase, a, k, l.n AS l, r.n AS r, (1000000::HUGEINT * a * a) // (l.n::HUGEINT * r.n) AS score
    FROM u JOIN f l ON l.lang = u.lang AND l.phrase = array_to_string(u.w[1:k], ' ')
    JOIN f r ON r.lang = u.lang AND r.phrase = array_to_string(u.w[k + 1 : u.size], ' ')
), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), x AS (SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a FROM c WHERE size = 3
), y AS (SELECT lang, phrase, max(a) AS most FROM x GROUP BY ALL
), z AS (
    SELECT lang, phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
    FROM b LEFT JOIN y USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a
), t AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM z JOIN t USING (lang) WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {"op1_warc": _WARC_SQL, "op3_decontamination": _DECONTAMINATION_SQL, "op6_quality": _QUALITY_SQL, "op8_url_filter": _URL_SQL,
                           "op13_collocations": _COLLOCATION_SQL}
