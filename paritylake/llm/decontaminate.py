"""Benchmark passages found through a positional inverted index; DataFrame functions only.

`build_index` stores the postings (term, doc_id, pos) of the corpus for the terms of the
test set, partitioned as the scan was: no shuffle, and no hot term can fill a task. `find`
takes every window of every item, picks its two rarest terms by the stored postings,
fetches the rarest term's list, adjusts it by the term's offset to alignments (document,
item, start), and intersects it with the adjusted list of the second term. The alignments
that stay are then compared word by word, which makes the matches exact. `near` returns
documents where the two rarest terms of a window lie within a distance (proximity).

Words are runs of characters other than ASCII control, space, punctuation and A-Z after
lower-casing A-Z; null texts have none. Rows of documents may repeat: postings of equal
ids are shared and each row is verified against its own words. Null ids are matched as a
value of their own (items: shown as "null"). Empty tables give empty results; columns of
other names are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, gathered, written

WINDOW = 10
#: What separates words once A-Z is lower-cased.
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text; empty for null."""
    trimmed = F.regexp_replace(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), rf"^{_BREAK}|{_BREAK}$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _BREAK))


def items_table(benchmark: DataFrame) -> DataFrame:
    """item (row key), item_id, item_words: distinct items that have words."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), words(F.col("text")).alias("item_words"))
    return rows.where(F.size("item_words") > 0).distinct().withColumn("item", F.xxhash64("item_id", "item_words"))


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings of the given terms (a table with column term) in all documents."""
    # the words pass through Generate alone, so no row carries its whole document
    spread = docs.select("doc_id", F.posexplode(words(F.col("text"))).alias("pos", "term"))
    return written(spread.join(terms, "term").select("term", "doc_id", "pos"), "postings")


def _window_terms(items: DataFrame, counts: DataFrame) -> DataFrame:
    """For each window its rarest term and the next: item, qa, term_a, qb, term_b."""
    placed = items.select("item", F.size("item_words").alias("n"), F.posexplode("item_words").alias("q", "term"))
    rated = placed.join(counts, "term", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    starts = F.sequence(F.greatest(F.lit(0), F.col("q") - (WINDOW - 1)), F.greatest(F.lit(0), F.least(F.col("q"), F.col("n") - WINDOW)))
    by_window = rated.withColumn("start", F.explode(starts))
    order = Window.partitionBy("item", "start").orderBy("count", "q")
    ranked = by_window.withColumn("rank", F.row_number().over(order)).where("rank <= 2")
    a = ranked.groupBy("item", "start").agg(
        F.max(F.when(F.col("rank") == 1, F.struct("q", "term", "count"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.struct("q", "term"))).alias("b"))
    # a window with a term that no document holds cannot occur
    pairs = a.where("a.count > 0").select("item", F.col("a.q").alias("qa"), F.col("a.term").alias("term_a"),
                                          F.coalesce("b.q", "a.q").alias("qb"), F.coalesce("b.term", "a.term").alias("term_b"))
    return pairs.distinct()


def _aligned(postings: DataFrame, pairs: DataFrame) -> DataFrame:
    """Alignments (doc_id, item, diag) where both terms of a window stand at their offsets."""
    first = (
        postings.join(pairs.withColumnRenamed("term_a", "term"), "term")
        .select("doc_id", "item", (F.col("pos") - F.col("qa")).alias("diag"), "term_b", (F.col("pos") - F.col("qa") + F.col("qb")).alias("pos_b"))
        .distinct()
    )
    seconds = postings.join(pairs.select(F.col("term_b").alias("term")).distinct(), "term", "left_semi")
    b = seconds.select(F.col("doc_id").alias("doc_b"), F.col("term").alias("t_b"), F.col("pos").alias("p_b"))
    on = first["doc_id"].eqNullSafe(b["doc_b"]) & (first["term_b"] == b["t_b"]) & (first["pos_b"] == b["p_b"])
    return first.join(b, on, "left_semi").select("doc_id", "item", "diag").distinct()


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every row of docs with n_words, n_hit (words inside an occurring window), n_items and
    item_ids (sorted ids of items with an occurring window)."""
    items = written(gathered(items_table(benchmark)), "benchmark-items")
    terms = written(gathered(items.select(F.explode("item_words").alias("term")).distinct()), "benchmark-terms")
    postings = build_index(docs, terms)
    counts = postings.groupBy("term").agg(F.count(F.lit(1)).alias("count"))
    pairs = written(gathered(_window_terms(items, counts)), "window-terms")
    aligned = _aligned(postings, pairs).join(items, "item").select("doc_id", F.struct("item_id", "item_words", "diag").alias("c"))
    by_doc = written(aligned.groupBy("doc_id").agg(F.collect_list("c").alias("cands")), "alignments")

    rows = docs.select(*[c for c in docs.columns if c not in ("n_words", "n_hit", "n_items", "item_ids", "cands", "__key")])
    joined = rows.join(by_doc.withColumnRenamed("doc_id", "__key"), F.col("doc_id").eqNullSafe(F.col("__key")), "left").drop("__key")
    # inline() keeps the words from being split once for every mention
    split = joined.select("*", F.inline(F.array(F.struct(words(F.col("text")).alias("__w")))))
    hits = split.withColumn("__hits", F.when(F.col("cands").isNotNull(), F.filter(F.transform("cands", _verified), lambda h: F.size(h["starts"]) > 0)))
    counted = hits.select("*", F.inline(F.array(F.struct(
        F.size("__w").cast("bigint").alias("n_words"),
        F.coalesce(F.size(F.array_distinct(F.flatten(F.transform("__hits", _covered)))), F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce(F.array_sort(F.array_distinct(F.transform("__hits", lambda h: h["item_id"]))), F.array().cast("array<string>")).alias("item_ids")))))
    return counted.withColumn("n_items", F.size("item_ids").cast("bigint")).drop("__w", "__hits", "cands")


def _verified(c: Column) -> Column:
    """The starts (in the document) of windows that occur on one alignment."""
    n, doc = F.size(c["item_words"]), F.col("__w")
    width = F.least(F.lit(WINDOW), n)
    lo, hi = F.greatest(F.lit(0), -c["diag"]), F.least(n, F.size(doc) - c["diag"]) - 1
    same = F.when(hi >= lo, F.transform(F.sequence(lo, F.greatest(hi, lo)), lambda q: F.when(doc[q + c["diag"]] == c["item_words"][q], "1").otherwise("0")))
    line = F.coalesce(F.array_join(same, ""), F.lit(""))
    count = F.length(line) - width
    starts = F.when(count >= 0, F.filter(F.sequence(F.lit(0), F.greatest(count, F.lit(0))),
                                        lambda i: F.instr(F.substr(line, i + 1, width), F.lit("0")) == 0))
    found = F.coalesce(F.transform(starts, lambda i: i + lo + c["diag"]), F.array().cast("array<int>"))
    return F.struct(c["item_id"].alias("item_id"), width.alias("width"), found.alias("starts"))


def _covered(h: Column) -> Column:
    return F.flatten(F.transform(h["starts"], lambda s: F.sequence(s, s + h["width"] - 1)))


def near(docs: DataFrame, benchmark: DataFrame, distance: int = 5) -> DataFrame:
    """(doc_id, item_id) where the two rarest terms of a window stand at most `distance`
    words away from where the window has them."""
    items = written(gathered(items_table(benchmark)), "benchmark-items")
    terms = written(gathered(items.select(F.explode("item_words").alias("term")).distinct()), "benchmark-terms")
    postings = build_index(docs, terms)
    pairs = written(gathered(_window_terms(items, postings.groupBy("term").agg(F.count(F.lit(1)).alias("count")))), "window-terms")
    first = postings.join(pairs.withColumnRenamed("term_a", "term"), "term").select(
        "doc_id", "item", "term_b", F.explode(F.sequence(F.col("pos") - F.col("qa") + F.col("qb") - distance, F.col("pos") - F.col("qa") + F.col("qb") + distance)).alias("pos_b"))
    b = postings.select(F.col("doc_id").alias("doc_b"), F.col("term").alias("t_b"), F.col("pos").alias("p_b"))
    on = first["doc_id"].eqNullSafe(b["doc_b"]) & (first["term_b"] == b["t_b"]) & (first["pos_b"] == b["p_b"])
    found = first.join(b, on, "left_semi").select("doc_id", "item").distinct()
    return found.join(items, "item").select("doc_id", "item_id").distinct()
