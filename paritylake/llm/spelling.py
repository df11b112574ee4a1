"""Spelling variants: words one edit apart, found by walking a trie that is a table of edges.

The trie's nodes are the prefixes at which words part or end, so an edge carries a string.
A state (word, position, node, edits) says that the word's first `position` letters, with so
many edits, spell the node. Level by level the states are joined with their node's edges: an edge that
goes on as the word does keeps the number of edits; one that does so after a
replaced, deleted or inserted letter makes the one edit.

With one edit, one half of a word stays as it is. So the words and the words read
backwards have a trie each, a word's walk starts at the node of its first half, where few words
are left, and prefixes shorter than that are no nodes, as the words that have them are too long.
A node with at most `_BUCKET` words below is a bucket: it has no edges but holds its words, and
a state without an edit that comes there is compared with each of them. A state with its edit is terminal:
it is joined with the words below its node by what is left to spell.

Nodes are named by 64-bit hashes of their prefixes; neighbours are checked letter by letter
in the end. A node with many words below is copied, and its states are dealt to the copies.
Every level is written to the shared folder. There are as many levels as partings above the
buckets, not as letters.

Defined results: null and blank texts have no words; a null id counts as the empty text in
the fold of a word. Repeated rows count each. Texts are read in pieces, cut
between words, so a long text takes no more than its own size. Other columns are ignored, whatever
their names. An empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, freed, written
from .hashing import mix

LEAST_LETTERS, LEAST_COUNT, ONE_IN, TIMES = 5, 3, 97, 2
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_FOLD = str.maketrans(UPPER, LOWER)
_PIECE, _HELD = 1 << 20, 200_000
_BELOW = 2_000  # words below a node for each of its copies
_BUCKET = 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


def runs(text: str | None, size: int = _PIECE) -> Iterator[list[str]]:
    """The letter runs of a text, in portions."""
    text, lo = text or "", 0
    while lo < len(text):
        hi = lo + size
        if hi < len(text):
            last = _RUN.match(text, hi)
            hi = last.end() if last else hi
        yield _RUN.findall(text, lo, hi)
        lo = hi


def spelt(doc_id, run: str) -> str:
    """A lower-cased run as the document spells it: one in 97 lacks a letter."""
    h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode("utf-8", "surrogatepass"))
    return run if h % ONE_IN else run[: h % len(run)] + run[h % len(run) + 1 :]


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of docs (doc_id, text): words of enough letters and occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return made

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                for found in runs(text.as_py()):
                    for word, n in Counter(w.translate(_FOLD) if not w.islower() else w for w in found).items():
                        if len(word) >= LEAST_LETTERS:
                            word = spelt(doc_id, word)
                            if len(word) >= LEAST_LETTERS:
                                held[word] += n
                    if len(held) >= _HELD:
                        yield out()
        if held:
            yield out()

    part = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(freed(run), "word string, n bigint")
    return part.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _prefixes(words: DataFrame) -> DataFrame:
    """(back, spell, n, place, starts, node, next): the hash of each prefix of the words, which are read
    forwards and backwards; next is the letter after it, null at the end. Neighbours differ
    by one in length, so prefixes shorter than the first half less one are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 10_000):
                some = b.slice(lo, 10_000)
                words = some.column("word").to_pylist()
                for way in (0, 1):
                    yield _spelt_prefixes([w[::-1] for w in words] if way else words, some.column("n"), way)

    return words.select("word", "n").mapInArrow(freed(run), "back int, spell string, n bigint, place int, starts boolean, node bigint, next string")


def _spelt_prefixes(spells: list[str], n: pa.Array, way: int) -> pa.RecordBatch:
    size = np.fromiter(map(len, spells), np.int64, len(spells))
    start = np.cumsum(size) - size
    row = np.repeat(np.arange(len(spells)), size)
    place = np.arange(len(row)) - start[row] + 1
    every = "".join(spells)
    letters = np.frombuffer(every.encode("utf-32-le"), np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        total = np.cumsum(mix(letters) * mix(place.astype(np.uint64) * _STEP))
        before = np.concatenate([np.zeros(1, np.uint64), total])[start]
        node = mix(total - before[row] + np.uint64(way)).view(np.int64)
    half = (size - size // 2 if way else size // 2)[row]
    after = pa.array([*every[1:], ""], pa.string())
    kept = np.flatnonzero(place >= half - 1)
    at = pa.array(row[kept])
    after = pc.if_else(pa.array(place[kept] < size[row[kept]]), after.take(pa.array(kept)), pa.scalar(None, pa.string()))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(kept), way, np.int32)), pa.array(spells, pa.string()).take(at), n.take(at), pa.array(place[kept].astype(np.int32)),
         pa.array((place == half)[kept]), pa.array(node[kept]), after], names=["back", "spell", "n", "place", "starts", "node", "next"])


def _copies(below: Column) -> Column:
    return F.ceil(below / _BELOW).cast("int")


def trie(words: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The edges (node, copy, children) to each node's children as (label, child, below), one row a copy;
    the words (node, place, held) of each bucket; the words (left, near, near_n) below each edge, by
    what is left to spell; and the state each word starts in."""
    each = written(_prefixes(words), "trie-prefixes")
    found = each.groupBy("node").agg(
        F.count(F.lit(1)).alias("below"), F.min("next").alias("lo"), F.max("next").alias("hi"), F.max("starts").alias("start"), F.max(F.col("next").isNull()).alias("end"))
    nodes = written(found.where("start OR end OR lo <> hi").select("node", "below", "start"), "trie-nodes")
    # a word's nodes in order: each is a child of the one before it
    path = each.join(nodes, "node").groupBy("back", "spell").agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("place", "node", "below", "start", "starts"))).alias("path"))
    path = written(path, "trie-paths")
    above = lambda i: F.coalesce(F.get("path", i - 1)["below"], F.lit(0))
    step = F.transform("path", lambda p, i: F.struct(p.alias("down"), F.get("path", i - 1).alias("up")))
    step = path.select("back", "spell", "n", F.explode(F.filter(step, lambda s: F.coalesce(s["up"]["below"], F.lit(0)) > _BUCKET)).alias("s"))
    edges = step.select(F.col("s.up.node").alias("node"), F.col("s.up.below").alias("above"), F.expr("substr(spell, s.up.place + 1, s.down.place - s.up.place)").alias("label"),
                        F.col("s.down.node").alias("child"), F.col("s.down.below").alias("below")).distinct()
    nodes = edges.groupBy("node").agg(F.max("above").alias("above"), F.collect_list(F.struct("label", "child", "below")).alias("children"))
    nodes = nodes.select("node", F.explode(F.sequence(F.lit(0), _copies(F.col("above")) - 1)).alias("copy"), "children")
    below = step.select(_left(F.col("s.down.node"), F.expr("substr(spell, s.down.place + 1)")).alias("left"), F.col("spell").alias("near"), F.col("n").alias("near_n"))
    # buckets that a state can come to: where a walk starts, and below an edge
    inner = F.filter("path", lambda p, i: (p["below"] <= _BUCKET) & (p["below"] > 1) & (p["start"] | (above(i) > _BUCKET)))
    buckets = path.select("spell", "n", F.explode(inner).alias("at")).groupBy(F.col("at.node").alias("node"), F.col("at.place").alias("place")).agg(
        F.collect_list(F.struct(F.col("spell").alias("near"), F.col("n").alias("near_n"))).alias("held"))
    states = path.select("back", "spell", F.explode(F.filter("path", lambda p: p["starts"])).alias("at"))
    states = states.select("back", "spell", F.col("at.place").alias("position"), F.col("at.node").alias("node"), F.col("at.below").alias("below"))
    return written(nodes, "trie"), written(buckets, "trie-buckets"), below, states


def _left(node: Column, rest: Column) -> Column:
    """A node and what is left to spell, as one number."""
    return F.xxhash64(node, rest)


def _moves() -> Column:
    """Where an edge takes a state without an edit: (position, edits) for each way to read its label."""
    rest = lambda n: F.expr(f"substr(spell, position + 1, {n})")
    to = lambda n, e: F.struct((F.col("position") + n).cast("int").alias("position"), F.lit(e).alias("edits"))
    label, size = F.col("label"), F.length("label")
    letters, same, one = F.length("spell") - F.col("position"), rest("length(label)") == label, size == 1
    near = lambda n, short: F.when(one, short).otherwise(F.levenshtein(rest(n), label, 1) == 1)
    return F.array_compact(F.array(
        F.when(same, to(size, 0)),
        F.when(same & (letters == size + 1), to(size + 1, 1)),  # without the last letter
        F.when((letters >= size) & near("length(label)", ~same), to(size, 1)),
        F.when((letters >= size + 1) & near("length(label) + 1", F.instr(rest("2"), label) > 0), to(size + 1, 1)),
        F.when((letters >= size - 1) & near("length(label) - 1", F.lit(True)), to(size - 1, 1)),
    ))


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near, near_n): all ordered pairs of words (word, n) that are one edit apart."""
    edges, buckets, below, states = trie(words)
    waiting, terminal = states.where(F.col("below").between(2, _BUCKET)), None
    states = states.where(F.col("below") > _BUCKET)
    while not states.isEmpty():
        dealt = states.withColumn("copy", F.pmod(F.xxhash64("spell"), _copies(F.col("below"))).cast("int")).drop("below")
        met = dealt.join(edges, ["node", "copy"]).select("back", "spell", "position", F.inline("children"))
        moved = met.select("back", "spell", "child", "below", F.inline(_moves()))
        edited = F.col("edits") == 1
        left = F.when(edited, _left(F.col("child"), F.expr("substr(spell, position + 1)")))
        moved = moved.where(edited | (F.col("below") > 1))  # a single word below a state without an edit is its own
        level = written(moved.select("back", "spell", left.alias("left"), *[F.when(~edited, F.col(c)).alias(c) for c in ("child", "position", "below")]), "trie-level")
        some = level.where("left IS NOT NULL").select("back", "spell", "left")
        terminal = some if terminal is None else terminal.union(some)
        states = level.where("left IS NULL").select("back", "spell", "position", F.col("child").alias("node"), "below")
        waiting = waiting.union(states.where(F.col("below") <= _BUCKET))
        states = states.where(F.col("below") > _BUCKET)
    met = waiting.join(buckets, "node").select("back", "spell", "position", "place", F.inline("held"))
    rest, other = F.expr("substr(spell, position + 1)"), F.expr("substr(near, place + 1)")
    met = met.where((F.abs(F.length("spell") - F.length("near")) <= 1) & (F.levenshtein(rest, other, 1) == 1))
    found = met.select("back", "spell", "near", "near_n")
    if terminal is not None:
        found = found.union(terminal.join(below, "left").select("back", "spell", "near", "near_n"))
    forwards = lambda c: F.when(F.col("back") == 1, F.reverse(c)).otherwise(F.col(c))
    pairs = found.select(forwards("spell").alias("word"), forwards("near").alias("near"), "near_n")
    return pairs.where(F.levenshtein("word", "near", 1) == 1).distinct()


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of docs (doc_id, text)."""
    words = written(vocabulary(docs), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best")
    seen = neighbours(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    large = -F.col("best.n") >= TIMES * F.col("n")
    each = words.join(seen, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(large, F.col("best.word")).alias("form"), F.when(large, -F.col("best.n")).alias("form_n"))
    each = written(each, "forms")
    # every round doubles the steps a root is away; a form has at least twice its word's occurrences
    roots = each.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = written(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "spelling-roots")
        if roots.where("next IS NOT NULL").isEmpty():
            break
        roots = roots.select("word", "root")
    out = each.join(roots.select("word", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
