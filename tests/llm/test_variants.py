"""Fingerprints, spelling variants and collocations against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from paritylake.llm import collocations, simhash, spelling
from paritylake.llm.common import LOWER, UPPER

FOLD = str.maketrans(UPPER, LOWER)


# --- fingerprints ------------------------------------------------------------------------

def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    h = [xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    """{fingerprint: smallest id} by comparing all pairs."""
    found = sorted({f for _, f in rows})
    root = {f: f for f in found}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(found):
        for b in found[:i]:
            if (a ^ b).bit_count() <= 4:
                root[top(a)] = top(b)
    out = {}
    for f in found:
        ids = [i for i, g in rows if top(g) == top(f) and i is not None]
        out[f] = min(ids) if ids else None
    return out


def test_fingerprints_equal_plain_counting(texts):
    got = simhash.fingerprints(texts)
    assert got.tolist() == [plain_fingerprint(t) for t in texts]


def test_shingles_of_pieces_are_those_of_the_whole(texts):
    for t in [*texts[:5], "a b", "a  b   c d", " x " * 9, "one two three four five"]:
        whole = np.concatenate([np.empty(0, np.uint64), *simhash.shingle_hashes(t)])
        for size in (1, 7, 64):
            assert np.concatenate([np.empty(0, np.uint64), *simhash.shingle_hashes(t, size)]).tolist() == whole.tolist()


@pytest.mark.parametrize("max_run", [simhash.MAX_RUN, 2])
def test_near_duplicates_equal_all_pairs(spark, docs, max_run):
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect()]
    want = plain_components(rows)
    got = simhash.near_duplicates(docs.withColumnsRenamed({"n": "fp", "kind": "root"}), max_run).collect()
    assert sorted((r["doc_id"] or -1, r["fingerprint"], r["component_id"]) for r in got) == sorted((i or -1, f"{f:016x}", want[f]) for i, f in rows)


@pytest.mark.parametrize("max_run", [simhash.MAX_RUN, 3, 40])
def test_links_of_crowded_fingerprints(spark, max_run):
    """A cloud around one number, chains that leave it, numbers four and five bits apart, and far ones."""
    rng = random.Random(3)
    flip = lambda f, n: f ^ sum(1 << b for b in rng.sample(range(64), n))
    centre, found = rng.getrandbits(64), set()
    for _ in range(150):
        found.add(flip(centre, rng.randrange(0, 8)))
    last = centre
    for _ in range(20):
        last = flip(last, rng.choice((4, 4, 5)))
        found.add(last)
    found |= {rng.getrandbits(64) for _ in range(100)} | {0, 15, 31}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in found)
    prints = spark.createDataFrame([(f,) for f in signed], "fp bigint").repartition(3)
    links = simhash.links(prints, max_run).collect()
    got, want = {f: f for f in signed}, plain_components([(f, f & (2**64 - 1)) for f in signed])
    top = lambda f: f if got[f] == f else top(got[f])
    for r in links:
        a, b = sorted((top(r["u"]), top(r["v"])))
        got[b] = a
    assert {f & (2**64 - 1): top(f) for f in signed} == want


def test_tables_share_a_key_for_every_close_pair():
    rng = random.Random(5)
    for n in (1, 10**6, 10**9, 10**12):
        masks = [int(m) for m in simhash.tables(n)]
        for _ in range(300):
            d = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(d & m == 0 for m in masks)
    assert len(simhash.tables(10**9)) > len(simhash.tables(10))


def test_near_duplicates_of_nothing(no_docs):
    got = simhash.near_duplicates(no_docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"] and got.count() == 0


# --- spelling variants -------------------------------------------------------------------

def plain_variants(rows):
    n = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(FOLD)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    by = {w: [x for x in n if x != w and near(w, x)] for w in n}
    form = {}
    for w, found in by.items():
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(by[w]), form[w] and n[form[w]]))
    return out


def some_words(seed, letters, count, size):
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(*size))) for _ in range(count)]
    for w in words[: count // 2]:  # one and two edits of others
        i = rng.randrange(len(w))
        words += [w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]]
    return rng, words


@pytest.mark.parametrize("bucket, letters, size", [(32, "ab", (4, 8)), (1, "abcdeéÿ", (4, 9)), (3, "ab", (4, 8)), (1, "a", (5, 12))])
def test_variants_equal_all_pairs(spark, monkeypatch, bucket, letters, size):
    monkeypatch.setattr(spelling, "_BUCKET", bucket)
    rng, words = some_words(len(letters), letters, 60, size)
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 120)))) for i in range(60)]
    rows += [(None, " ".join(words[:20])), (None, None), (3, ""), (4, " \n"), rows[5], rows[5], (7, "ABABA-Ababa,ababa×ababa ÀÀÀÀÀ ààààà")]
    rows.append((99, ("x" * 300 + "y ") * 3 + ("x" * 301 + "y ") * 4 + ("x" * 299 + "zy ") * 9))  # long words that part late
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id bigint, text string, word string, n int").repartition(3)
    got = spelling.variants(docs).collect()
    want = plain_variants(rows)
    assert len(got) == len(want) and {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == want


def test_nodes_with_many_words_are_copied(spark, monkeypatch):
    monkeypatch.setattr(spelling, "_BELOW", 3)
    monkeypatch.setattr(spelling, "_BUCKET", 2)
    rng, words = some_words(9, "abcd", 80, (5, 8))
    rows = [(i, " ".join(rng.choice(words) for _ in range(100))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = spelling.variants(docs).collect()
    assert {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == plain_variants(rows)


def test_runs_of_pieces_are_those_of_the_whole():
    text = "Größe  señor,été×x" * 30
    for size in (1, 5, 64):
        assert [w for some in spelling.runs(text, size) for w in some] == re.findall("[A-Za-zÀ-ÿ]+", text)


def test_variants_of_nothing(no_docs):
    got = spelling.variants(no_docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"] and got.count() == 0


# --- collocations ------------------------------------------------------------------------

def plain_collocations(rows):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= 10}
    out = {}
    for (lang, p), a in found.items():
        if any(100 * b >= 50 * a and m == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))
               for (m, q), b in found.items()):
            continue
        cuts = [(1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, some in out.items() for i, (s, a, p, l, r) in enumerate(sorted(some)[:2000])}


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(17)
    words = "zu den Haus HAUS a b c été señor x1 - ten ten 日本".split(" ")
    rows = []
    for i in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ! "]) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "en", "de", None]), text))
    rare = "".join(f"late{i} later{i} " * 4 for i in range(5))  # reach the threshold in different scans
    rows += [("en", rare), ("en", rare), ("en", rare), ("en", None), (None, ""), ("fr", "  \t\n"), rows[3], rows[3]]
    rows += [("en", " ".join(rng.choice(words) for _ in range(20000)))]
    return rows


@pytest.mark.parametrize("shards", [1, 3, 4])
def test_collocations_equal_plain_counting(spark, spoken, shards):
    rows = [(*r, i, "x") for i, r in enumerate(spoken)]
    docs = spark.createDataFrame(rows, "lang string, text string, shard int, phrase string").repartition(5)
    got = collocations.mine(docs, shards).collect()
    names = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert {tuple(r[c] for c in names) for r in got} == plain_collocations(spoken)


def test_phrases_that_share_cells_are_counted_whole(spark, spoken, monkeypatch):
    monkeypatch.setattr(collocations, "cells_for", lambda n: 512)
    docs = spark.createDataFrame(spoken, "lang string, text string").repartition(4)
    got = collocations.mine(docs).collect()
    assert {(r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got} == plain_collocations(spoken)


def test_portions_end_at_breaks():
    text = b"one two, three four! five" * 40 + b"no break at all" * 30
    for size in (1, 30, 400):
        got = list(collocations._portions(text, size))
        assert b"".join(got) == text and all(p[-1:] in b",!" for p in got[:-1])


def test_collocations_of_nothing(no_docs):
    got = collocations.mine(no_docs)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and got.count() == 0
