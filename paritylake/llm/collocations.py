"""Phrases whose words occur together more often than apart, by dynamic itemset counting.

The documents are dealt into shards, which are scanned in turn, round and round. Words are
counted from the first scan on. As soon as both words of a pair have been seen `LEAST` times, the
pair is counted too, from the next shard on; likewise a phrase of three words once both
its pairs have been seen so often. Each length so begins while shorter ones are
still being counted, and every phrase is counted for exactly one round of all shards, so its
count is the whole one wherever it began. Scans end when no phrase has a shard left.

What has reached the threshold is told to the scans by a table of cells of fixed size: a
phrase's cell holds the scan after which the phrase, or another one of the same cell, reached it.
A cell is set once and never changed, so all scans agree on where a phrase began;
phrases that share a cell may begin early, which only counts some that the threshold drops
in the end. The cells are sized by the input, 64 MB at most.

Blocks of documents send each distinct phrase once, so a very common one costs an entry a
block. Counts, shares and scores are exact; products are decimals of 38 digits.

Defined results: null and blank texts have no words, a null language is `und`, an id is not
needed and repeated rows count each. Texts are read in pieces, cut at breaks, so a long
text takes no more than its longest stretch without one. Other columns are ignored, whatever
their names. An empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh64_intdigest

from ..operators.skew import SkewPolicy, find_hot_keys, lookup_join
from .common import distinct_words, freed, partitions, written
from .hashing import mix

LEAST, LONGEST, TOP, PART_OF = 10, 3, 2000, (50, 100)
SHARDS = 2
_NEVER = 255
_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[list(b" \t")] = True
_ANY_BREAK = re.compile(rb"[.,;:!?\n\x0b\x0c\r]")
_BLOCK = 24 << 20
_SLICES = 64


def _portions(text: bytes, size: int = _BLOCK) -> Iterator[bytes]:
    """A text in portions that end at breaks."""
    lo = 0
    while lo < len(text):
        at = _ANY_BREAK.search(text, lo + size)
        hi = at.end() if at else len(text)
        yield text[lo:hi]
        lo = hi


class Words:
    """The words of some texts of one language: distinct ones, and where each stands."""

    def __init__(self, texts: list[bytes], lang: str):
        data = np.frombuffer(b"\n".join(texts).lower(), dtype=np.uint8)
        inside = ~(_BREAK[data] | _BLANK[data])
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        self.distinct, self.at = distinct_words(data, inside, first)
        start = np.flatnonzero(first)
        piece = np.cumsum(_BREAK[data], dtype=np.int32)[start] if len(start) else start
        self.next = piece[1:] == piece[:-1]  # the word and the next are of one piece
        seed = xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))
        self.hash = np.fromiter((xxh64_intdigest(w, seed) for w in self.distinct.to_pylist()), np.uint64, len(self.distinct))


def _join_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(first * np.uint64(3) + mix(second))


def _cell(h: np.ndarray, cells: int) -> np.ndarray:
    return (h & np.uint64(cells - 1)).astype(np.int64)


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of a first one, group of each, size) of equal keys."""
    code, distinct = pd.factorize(key)
    first = np.empty(len(distinct), dtype=np.int64)
    first[code[::-1]] = np.arange(len(key) - 1, -1, -1)
    return first, code, np.bincount(code, minlength=len(distinct))


def _phrases(words: Words, reached: dict[int, np.ndarray], step: int, shards: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """([the distinct words of each place], counts, the scan after which each began) for each length
    that is counted in this scan."""
    counted = lambda since: (since < step) & (since >= step - shards)
    if step < shards:
        yield [np.arange(len(words.distinct))], np.bincount(words.at, minlength=len(words.distinct)), np.full(len(words.distinct), -1)
    if not step or len(words.at) < 2:
        return
    word = reached[1][_cell(words.hash, len(reached[1]))].astype(np.int64)
    since = np.maximum(word[words.at[:-1]], word[words.at[1:]])
    known = np.flatnonzero(words.next & (since < step))  # pairs that have begun, now or long ago
    if not len(known):
        return
    since, a, b = since[known], words.at[known], words.at[known + 1]
    first, pair, size = _groups(a * len(words.distinct) + b)
    mine = counted(since[first])
    if mine.any():
        yield [a[first][mine], b[first][mine]], size[mine], since[first][mine]
    h = _join_hash(words.hash[a[first]], words.hash[b[first]])
    # a pair whose cell another pair has set counts from where its words have begun
    begun = np.maximum(reached[2][_cell(h, len(reached[2]))].astype(np.int64)[pair], since)
    two = np.flatnonzero(np.diff(known) == 1)
    since = np.maximum(begun[two], begun[two + 1])
    mine = counted(since)
    two, since = two[mine], since[mine]
    if len(two):
        first, _, size = _groups(pair[two] * (pair.max() + 1) + pair[two + 1])
        at = two[first]
        yield [a[at], b[at], b[at + 1]], size, since[first]


_COUNTED = "lang string, size int, phrase string, n bigint, since int"


def _scan(shard: DataFrame, reached, step: int, shards: int) -> DataFrame:
    """(lang, size, phrase, n, since) of the phrases counted in this scan, over one shard (lang, text); of
    size 0 a language's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = {k: np.frombuffer(v, dtype=np.uint8) for k, v in reached.value.items()}
        held: dict[str, list[bytes]] = {}
        size = 0

        def rows(lang: str, k: int, phrase: pa.Array, n: np.ndarray, since: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(n), pa.string()), pa.array(np.full(len(n), k, np.int32)), phrase, pa.array(n, pa.int64()), pa.array(since.astype(np.int32))],
                names=["lang", "size", "phrase", "n", "since"])

        def out() -> Iterator[pa.RecordBatch]:
            for lang, texts in held.items():
                words = Words(texts, lang)
                if step < shards:
                    yield rows(lang, 0, pa.array([""]), np.array([len(words.at)]), np.array([-1]))
                for parts, n, since in _phrases(words, cells, step, shards):
                    for lo in range(0, len(n), 100_000):
                        some = [words.distinct.take(pa.array(p[lo : lo + 100_000])) for p in parts]
                        phrase = pc.binary_join_element_wise(*some, pa.scalar(b" ", pa.large_binary())) if len(some) > 1 else some[0]
                        yield rows(lang, len(parts), phrase.cast(pa.binary()).cast(pa.string()), n[lo : lo + 100_000], since[lo : lo + 100_000])
            held.clear()

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
                for portion in _portions(text.as_buffer().to_pybytes()):
                    held.setdefault(lang, []).append(portion)
                    size += len(portion)
                    if size >= _BLOCK:
                        yield from out()
                        size = 0
        yield from out()

    return shard.mapInArrow(freed(run), _COUNTED)


def _reached(counted: DataFrame, size: int, cells: int) -> np.ndarray:
    """The cells of phrases of this length that occur often enough so far, as a bit map."""
    often = counted.where((F.col("size") == size) & (F.col("n") >= LEAST)).select("lang", "phrase")
    width = cells // _SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(cells, dtype=bool)
        for b in batches:
            for lang in pc.unique(b.column("lang")).to_pylist():
                some = b.filter(pc.equal(b.column("lang"), lang)).column("phrase").to_pylist()
                seed = xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))
                words = np.array([[xxh64_intdigest(w.encode("utf-8", "surrogatepass"), seed) for w in p.split(" ")] for p in some], dtype=np.uint64)
                h = words[:, 0] if size == 1 else _join_hash(words[:, 0], words[:, 1])
                seen[_cell(h, cells)] = True
        at = [i for i in range(_SLICES) if seen[i * width : (i + 1) * width].any()]
        maps = [np.packbits(seen[i * width : (i + 1) * width]).tobytes() for i in at]
        yield pa.RecordBatch.from_pydict({"slice": pa.array(at, pa.int32()), "map": pa.array(maps, pa.binary())})

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, np.ndarray] = {}
        for b in batches:
            for i, m in zip(b.column("slice").to_pylist(), b.column("map").to_pylist()):
                maps[i] = maps.get(i, 0) | np.frombuffer(m, dtype=np.uint8)
        yield pa.RecordBatch.from_pydict({"slice": pa.array(maps, pa.int32()), "map": pa.array([m.tobytes() for m in maps.values()], pa.binary())})

    schema = "slice int, map binary"
    parts = min(_SLICES, partitions(counted.sparkSession))
    found = np.zeros(cells, dtype=bool)
    for r in often.mapInArrow(freed(run), schema).repartition(parts, "slice").mapInArrow(freed(total), schema).collect():  # one bit a cell
        found[r["slice"] * width : (r["slice"] + 1) * width] = np.unpackbits(np.frombuffer(r["map"], dtype=np.uint8))
    return found


def cells_for(n_tokens: int) -> int:
    """Cells for a corpus of so many tokens: one for 8 tokens, 65,536 to 64 million."""
    return 1 << min(max(ceil(log2(max(n_tokens, 1) / 8 + 1)), 16), 26)


def counts(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(lang, size, phrase, n): all phrases that occur often enough, and of size 0 each language's tokens.

    The counts so far are a table that each scan adds to; a phrase that has had its round and
    is rare leaves it.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("length(text) > 0")
    shard = F.pmod(F.xxhash64("text"), F.lit(shards))
    reached = {k: np.full(1, _NEVER, dtype=np.uint8) for k in range(1, LONGEST)}
    state, step, last = None, 0, 0  # last: the scan up to which some phrase is counted
    while step < max(shards, last + 1):
        cast = spark.sparkContext.broadcast({k: v.tobytes() for k, v in reached.items()})
        part = _scan(rows.where(shard == step % shards), cast, step, shards)
        part = part if state is None else part.union(state.select(*part.columns))
        total = part.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"), F.min("since").alias("since"))
        state = written(total.where((F.col("size") == 0) | (F.col("n") >= LEAST) | (F.col("since") + shards > step)), "collocation-counts")
        if not step:
            cells = cells_for(shards * (state.where("size = 0").agg(F.sum("n")).first()[0] or 0))
            reached = {k: np.full(cells, _NEVER, dtype=np.uint8) for k in reached}
        for k in range(1, LONGEST):
            if k * shards > step >= k - 1:  # phrases of this length may have been counted in this scan
                new = _reached(state, k, cells) & (reached[k] == _NEVER)
                reached[k][new] = step
                if new.any():
                    last = step + shards
        cast.unpersist()
        step += 1
    return state.select("lang", "size", "phrase", "n")


def _part(first: str, size: str) -> Column:
    return F.expr(f"array_join(slice(words, {first}, {size}), ' ')")


def mine(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of each language of docs (lang, text)."""
    total = counts(docs, shards)
    often = total.where((F.col("size") > 0) & (F.col("n") >= LEAST)).select("lang", "phrase", F.col("n").alias("f"))
    found = total.where((F.col("size") > 1) & (F.col("n") >= LEAST)).select("lang", "size", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    cuts = found.select("lang", "phrase", "a", "size", "words", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part("1", "k").alias("first"), _part("k + 1", "size - k").alias("rest"))
    for part, name in (("first", "l"), ("rest", "r")):  # a common word is a part of very many phrases
        cuts = written(cuts, "collocation-cuts")
        of = often.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
        cuts = lookup_join(cuts, of, ["lang", part], "inner", find_hot_keys(cuts, ["lang", part], SkewPolicy()))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumns({"above": F.lit(1_000_000).cast("decimal(7,0)") * wide("a") * wide("a"), "below": wide("l") * wide("r")})
    low = F.min(F.struct(F.expr("above div below").alias("score"), "k", "l", "r")).alias("low")
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), low)
    longer = found.where(F.col("size") == LONGEST).select("lang", F.explode(F.array(_part("1", "size - 1"), _part("2", "size - 1"))).alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where((F.col("most").isNull()) | (PART_OF[1] * F.col("most") < PART_OF[0] * F.col("a")))
    kept = kept.select("lang", "phrase", "a", "low.l", "low.r", "low.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    kept = kept.withColumn("rank", rank).where(F.col("rank") <= TOP)
    n = total.where(F.col("size") == 0).select("lang", "n")
    return kept.join(n, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
