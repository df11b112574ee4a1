"""Near duplicates by fingerprints of four-word shingles whose bits differ in few places.

A bit of a document's fingerprint is 1 if more than half of its shingles' hashes have it
set. Two fingerprints that differ in at most `DISTANCE` bits agree on all but that many of
any set of blocks, so they share a key in one of the tables that each leave `DISTANCE`
blocks out. Keys are longer where there are more fingerprints, so that unlike ones
rarely meet; Hamming distances decide.

Equal fingerprints are one from the start. Fingerprints with one key are compared in the
key's task, which sends on a star for each group it finds, not its pairs. A key with more than
`max_run` fingerprints, of which each part of the table sends no more than that many to the
key's task, is left to another exact way: its fingerprints are dealt out to every place at most half the
distance away, and those that meet at a place are linked. That is `1 + 64 + 2016` places
a fingerprint, whatever the size of the group.

Defined results: null, empty and blank texts have fingerprint zero, which is linked like any
other; a text of fewer words than a shingle is one shingle. Texts are read in pieces of
`_PIECE` bytes, cut between words, so a long text takes no more memory than its own bytes.
Repeated rows and rows without an id are fingerprinted and returned one by one; a
component without any id has a null component_id. Columns other than id and text are
ignored, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..operators.skew import SkewPolicy, find_hot_keys, lookup_join
from .common import ASCII_SPACE, freed, partitions, written
from .graph import components

WORDS, SEED, DISTANCE, BITS = 4, 42, 4, 64
MAX_RUN = 4096
_PIECE = 4 << 20
_VOTES = 1 << 17  # hashes that are counted at once
_HELD = 1 << 18  # fingerprints that a part of the table puts into keys at once


def _pieces(data: bytes, size: int) -> Iterator[tuple[list[bytes], bool]]:
    """The words of a text in pieces, each with the last words of the piece before it, and
    whether the piece is the last."""
    lo, tail = 0, []
    while True:
        hi = lo + size
        while hi < len(data) and data[hi] not in ASCII_SPACE:
            hi += 1
        words = tail + data[lo:hi].split()
        yield words, hi >= len(data)
        if hi >= len(data):
            return
        tail, lo = words[max(0, len(words) - WORDS + 1) :], hi


def shingle_hashes(text: str | None, size: int = _PIECE) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles, repeats included, in portions."""
    found = False
    for words, last in _pieces((text or "").encode("utf-8", "surrogatepass").lower(), size):
        if len(words) < WORDS and (found or not last or not words):
            continue  # the words left over from before, or too few so far
        found = True
        data = b" ".join(words)
        gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
        start, end = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(data)]
        spans = zip(start, end[min(WORDS, len(words)) - 1 :])
        yield np.fromiter((xxh64_intdigest(data[a:b], SEED) for a, b in spans), np.uint64, len(words) - min(WORDS, len(words)) + 1)


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, BITS)


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """The unsigned fingerprint of each text."""
    votes = np.zeros((len(texts), BITS), dtype=np.int64)
    sizes = np.zeros(len(texts), dtype=np.int64)
    held, owner, n = [], [], 0

    def count() -> None:
        if held:
            at = np.cumsum([0, *map(len, held[:-1])])
            np.add.at(votes, owner, np.add.reduceat(_bits(np.concatenate(held)), at, axis=0, dtype=np.int64))
            held.clear()
            owner.clear()

    for i, t in enumerate(texts):
        for h in shingle_hashes(t):
            sizes[i] += len(h)
            for lo in range(0, len(h), _VOTES):
                held.append(h[lo : lo + _VOTES])
                owner.append(i)
                n += len(held[-1])
                if n >= _VOTES:
                    count()
                    n = 0
    count()
    return np.packbits(2 * votes > sizes[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed number."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                some = b.slice(lo, 500)
                fp = fingerprints(some.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(freed(run), f"doc_id {kind}, fp bigint")


def tables(n: int) -> list[np.ndarray]:
    """Masks of the bits that each table's key holds, for n fingerprints: the fewest blocks for
    which a key tells four times as many apart."""
    blocks = DISTANCE + 2
    while (blocks - DISTANCE) * BITS / blocks < log2(max(n, 1)) + 2 and blocks < 3 * DISTANCE:
        blocks += 1
    cuts = [round(i * BITS / blocks) for i in range(blocks + 1)]
    block = [((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:])]
    return [np.uint64(sum(block[i] for i in held)) for held in combinations(range(blocks), blocks - DISTANCE)]


def _run_ends(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return start, np.concatenate([start[1:], [len(key)]]).astype(np.int64) if len(key) else start


def _keyed(prints: DataFrame, n: int, max_run: int) -> DataFrame:
    """Rows (tab, key, fp); tab is null for fingerprints of an overlong run."""
    masks = tables(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tab", "key", "fp"]

        def out(fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i, mask in enumerate(masks):
                key = fp & mask
                order = np.argsort(key, kind="stable")
                key, own = key[order], fp[order]
                start, end = _run_ends(key)
                over = np.arange(len(key)) - np.repeat(start, end - start) > max_run
                tab = pa.array(np.full(len(key), i, np.int32), mask=over)
                yield pa.RecordBatch.from_arrays([tab, pa.array(key.view(np.int64)), pa.array(own.view(np.int64))], names=names)

        held, size = [], 0
        for b in batches:
            held.append(b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
            size += len(held[-1])
            if size >= _HELD:
                yield from out(np.concatenate(held))
                held, size = [], 0
        if size:
            yield from out(np.concatenate(held))

    return prints.select("fp").mapInArrow(freed(run), "tab int, key bigint, fp bigint")


def stars(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, centre) that join what the pairs at most `DISTANCE` apart join."""
    left = np.arange(len(fp))
    u, v = [], []
    while len(left) > 1:
        centre, left = left[0], left[1:]
        queue = [centre]
        while queue and len(left):
            near = np.bitwise_count(fp[left] ^ fp[queue.pop()]) <= DISTANCE
            if near.any():
                found, left = left[near], left[~near]
                u.append(fp[found])
                v.append(np.full(len(found), fp[centre]))
                queue.extend(found.tolist())
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *u]), np.concatenate([none, *v])


def _links(rows: DataFrame, max_run: int) -> DataFrame:
    """(u, v) links within the runs of sorted rows; v is null for members of an overlong run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(u: np.ndarray, v: np.ndarray | None) -> pa.RecordBatch:
            other = pa.nulls(len(u), pa.int64()) if v is None else pa.array(v.view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), other], names=["u", "v"])

        def judge(fp: np.ndarray) -> pa.RecordBatch:
            return out(fp, None) if len(fp) > max_run else out(*stars(fp))

        last, run_fp, overlong = None, np.empty(0, np.uint64), False  # the run that is not over yet
        for b in batches:
            tab, key, fp = (b.column(c).to_numpy(zero_copy_only=False) for c in ("tab", "key", "fp"))
            fp = fp.view(np.uint64)
            same = np.concatenate([[True], (tab[1:] == tab[:-1]) & (key[1:] == key[:-1])])
            start = np.concatenate([[0], np.flatnonzero(~same)]) if len(fp) else []
            for a, z in zip(start, [*start[1:], len(fp)]):
                if (tab[a], key[a]) != last:
                    if len(run_fp) > 1:
                        yield judge(run_fp)
                    last, run_fp, overlong = (tab[a], key[a]), np.empty(0, np.uint64), False
                if overlong:
                    yield out(fp[a:z], None)
                else:
                    run_fp = np.concatenate([run_fp, fp[a:z]])
                    if len(run_fp) > max_run:
                        yield out(run_fp, None)
                        run_fp, overlong = np.empty(0, np.uint64), True
        if len(run_fp) > 1:
            yield judge(run_fp)

    return rows.mapInArrow(freed(run), "u bigint, v bigint")


def _places(prints: DataFrame) -> DataFrame:
    """(place, fp): every number at most half the distance away from a fingerprint."""
    one = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
    flips = [np.zeros(1, np.uint64)]
    for k in range(1, DISTANCE // 2 + 1):
        flips.append(np.bitwise_or.reduce(one[np.array(list(combinations(range(BITS), k)))], axis=1))
    flip = np.concatenate(flips)
    assert len(flip) == sum(comb(BITS, k) for k in range(DISTANCE // 2 + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(fp), 256):
                some = fp[lo : lo + 256]
                yield pa.RecordBatch.from_arrays([pa.array((some[:, None] ^ flip).ravel().view(np.int64)),
                                                  pa.array(np.repeat(some, len(flip)).view(np.int64))], names=["place", "fp"])

    return prints.mapInArrow(freed(run), "place bigint, fp bigint")


def links(prints: DataFrame, max_run: int = MAX_RUN) -> DataFrame:
    """(u, v) rows that join the same distinct fingerprints as all pairs at most `DISTANCE` apart."""
    spark, n = prints.sparkSession, prints.count()
    keyed = written(_keyed(prints, n, max_run), "simhash-keys")
    runs = keyed.where("tab IS NOT NULL").repartition(partitions(spark), "tab", "key").sortWithinPartitions("tab", "key")
    found = written(_links(runs, max_run), "simhash-links")
    hot = found.where("v IS NULL").select(F.col("u").alias("fp")).union(keyed.where("tab IS NULL").select("fp")).distinct()
    hot = written(hot.repartition(partitions(spark)), "simhash-hot")
    near = found.where("v IS NOT NULL")
    if hot.isEmpty():
        return near
    # at most one fingerprint a place and bit pattern: a place holds no more than 2,081 of them
    first = _places(hot).groupBy("place").agg(F.min("fp").alias("v"), F.collect_set("fp").alias("all"))
    met = first.where("size(all) > 1").select(F.explode("all").alias("u"), "v").where("u <> v").distinct()
    return near.union(met)


def near_duplicates(docs: DataFrame, max_run: int = MAX_RUN) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs (doc_id, text)."""
    prints = written(fingerprint(docs), "simhash")
    each = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(each, max_run)).select(F.col("node").alias("fp"), "root")
    of = each.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of = written(of, "simhash-roots")
    low = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of.join(low, "root").select("fp", "component_id")
    out = lookup_join(prints, named, ["fp"], "inner", find_hot_keys(prints, ["fp"], SkewPolicy()))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
