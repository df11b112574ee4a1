"""Jaccard join, suffix dedup and decontamination against brute force."""

import hashlib
import io
import re
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paritylake.llm import decontaminate, graph, jaccard, suffix_dedup


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# -- Jaccard ---------------------------------------------------------------------------

def shingle_set(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [(r["doc_id"], shingle_set(r["text"])) for r in rows]
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[max(root(i), root(j))] = min(root(i), root(j))
    low = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            low[root(i)] = min(d, low.get(root(i), d))
    return sorted(((d, len(s), low.get(root(i)) if s else d) for i, (d, s) in enumerate(sets)), key=repr)


def test_jaccard_finds_the_components_of_all_links(docs):
    assert rows_of(jaccard.join(docs), "doc_id", "n_shingles", "component_id") == brute_components(docs.collect())


def test_jaccard_links_what_stars_miss(spark, vocabulary):
    """A chain whose ends do not link, copies that share a part with strangers, sizes at the limit."""
    w = vocabulary
    chain = [w[i * 3 : i * 3 + 60] for i in range(12)]
    part = [w[100:140] + w[200 + 9 * i : 209 + 9 * i] for i in range(12)]
    at_limit = [w[300:350], w[300:340] + w[400:410], w[300:346], w[304:350]]
    texts = [" ".join(x) for x in chain + part + at_limit]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    assert rows_of(jaccard.join(df), "doc_id", "n_shingles", "component_id") == brute_components(df.collect())


@pytest.mark.parametrize("near_head", [False, True])
def test_jaccard_links_members_of_two_groups(spark, near_head):
    """Groups of a shingle that only two groups have, where a member links and the head does not; the head may be either."""
    texts = []
    for case in range(4):
        word = lambda name, n: [f"{name}{case}x{i}" for i in range(n)]  # noqa: E731, B023
        x, y, b, c = word("x", 20), word("y", 4), word("b", 60), word("c", 60)
        tails = [b, c]
        if near_head:  # the members link to each other, and one of them to the other group
            c = b[:54] + word("c", 6)
            tails = [b, c, b[:40] + word("d", 2) + b[42:], c[:40] + word("e", 2) + c[42:]]
        other = tails[-2 + case // 2]
        texts += [x + y + b, x + y + c, x[1:] + y + other]
        texts += [word(f"own{i}v{j}w", 80) + y + t for i, t in enumerate(tails) for j in range(4)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string").coalesce(1)
    assert rows_of(jaccard.join(df), "doc_id", "n_shingles", "component_id") == brute_components(df.collect())


def test_jaccard_of_an_empty_table(no_docs):
    assert jaccard.join(no_docs).count() == 0


def test_prefixes_are_long_enough():
    for n in range(1, 300):
        for m in range(n, 300):
            need = -(-4 * (n + m) // 9)
            if need <= n:
                assert n - jaccard.prefix_length(n) < need and m - jaccard.prefix_length(m) < need


def test_components_of_a_path_a_star_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200 + i, 200 + (i + 1) % 7) for i in range(7)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u int, v int")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, **{200 + i: 200 for i in range(7)}}


def noting(monkeypatch, module, files):
    """From now on `files` gets the number of files of every table that the module writes, by name."""
    plain = module.written

    def noted(df, name, *rest, **more):
        out = plain(df, name, *rest, **more)
        files.setdefault(name, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(module, "written", noted)


@pytest.fixture
def many_partitions(spark):
    put = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    had = {k: spark.conf.get(k) for k in put}
    for k, v in put.items():
        spark.conf.set(k, v)
    yield
    for k, v in had.items():
        spark.conf.set(k, v)


def test_components_stop_when_settled_and_take_few_files(spark, monkeypatch, many_partitions):
    files = {}
    noting(monkeypatch, graph, files)
    stars = [(1000 * i, 1000 * i + j) for i in range(20) for j in range(1, 15)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(stars, "u int, v int")).collect()}
    assert got == {n: n // 1000 * 1000 for e in stars for n in e}
    assert files == {"edges": [8]}
    graph.components(spark.createDataFrame(stars + [(1001, 2001)], "u int, v int"))
    assert set(files) == {"edges", "low", "large", "small"} and max(map(max, files.values())) <= 8
    with pytest.raises(RuntimeError, match="settle"):
        graph.components(spark.createDataFrame([(i, i + 1) for i in range(9)], "u int, v int"), limit=1)


def test_jaccard_writes_narrow_tables_to_few_files(spark, monkeypatch, vocabulary, many_partitions):
    files = {}
    noting(monkeypatch, jaccard, files)
    rows = [(10 * i + j, " ".join([*vocabulary[i : i + 40], *["x"] * j])) for i in range(60) for j in range(3)]
    jaccard.join(spark.createDataFrame(rows, "doc_id bigint, text string"))
    few = ("groups", "heads", "leader-pairs", "pairs", "centres", "verify-plan", "verified", "lowest")
    assert {n: files[n] for n in few if max(files[n]) > 8} == {}


# -- suffix dedup ------------------------------------------------------------------------

def brute_removed(rows):
    order = sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    first, out = {}, []
    for r in order:
        b = (r["text"] or "").encode()
        for j in range(len(b) - 49):
            first.setdefault(b[j : j + 50], r["doc_id"])
    for r in order:
        b, d = (r["text"] or "").encode(), r["doc_id"]
        gone = bytearray(len(b))
        for j in range(len(b) - 49):
            f = first[b[j : j + 50]]
            if f is not None and (d is None or f < d):
                gone[j : j + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("split_above", [5000, 1])
def test_suffix_dedup_removes_every_repeated_string(docs, split_above):
    assert rows_of(suffix_dedup.dedup(docs, split_above=split_above), *COLUMNS) == brute_removed(docs.collect())


def test_suffix_dedup_at_the_length_limit(spark, vocabulary):
    a = "".join(vocabulary[:40])
    texts = [a, "Q" + a[10:59] + "Z", "Q" + a[10:60] + "Z", a[20:70], a[:49], "ab" * 200, "ba" * 100, "ab" * 24, a + a, None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = suffix_dedup.dedup(df, with_kept=True)
    assert rows_of(got, *COLUMNS) == brute_removed(df.collect())
    assert {r["doc_id"]: bytes(r["kept"]) for r in got.collect()}[2] == b"Z"


def test_suffix_dedup_of_an_empty_table(no_docs):
    assert suffix_dedup.dedup(no_docs).count() == 0


def peak_of(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_block_of_texts_needs_little_memory():
    """Some 13 bytes of arrays per byte and what one piece takes, and no block stays while the next is made."""
    rng = np.random.default_rng(3)
    texts = [rng.integers(97, 123, 2000, dtype=np.uint8).tobytes().decode() for _ in range(2000)]
    table = pa.table({"doc_id": pa.array(range(2000), pa.int64()), "text": texts})
    assert peak_of(lambda: suffix_dedup.Block(table)) < 50e6
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    run = suffix_dedup._ask(SimpleNamespace(mapInArrow=lambda run, schema: run), SimpleNamespace(value=np.zeros(1 << 20, dtype=bool)), 8, "text", "doc_id")
    batch = lambda n: pa.RecordBatch.from_pydict({"block_id": pa.array(range(n)), "body": pa.array([sink.getvalue()] * n)})
    one, three = (peak_of(lambda: [None for _ in run(iter([batch(n)]))]) for n in (1, 3))
    assert three < 1.1 * one


def test_mergesort_orders_suffixes_by_bytes():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    suffix = rng.permutation(np.arange(340))
    group = np.sort(rng.integers(0, 4, 340))
    got = suffix_dedup.sort_suffixes(data, suffix, group)
    key = lambda i: (group[i], data[suffix[i] : suffix[i] + 50].tobytes())
    assert [key(i) for i in got] == sorted(key(i) for i in range(340))


def test_mergesort_hashes_few_spans(monkeypatch):
    """Most comparisons are decided by whole hashes and first bytes, without a search for the common extension."""
    rng = np.random.default_rng(4)
    strings = rng.integers(0, 256, (40, 50)).astype(np.uint8)
    data, hashed = strings[rng.integers(0, 40, 2000)].ravel(), [0]
    plain = suffix_dedup.span_hash

    def counting(p, i, j):
        hashed[0] += len(i)
        return plain(p, i, j)

    monkeypatch.setattr(suffix_dedup, "span_hash", counting)
    got = suffix_dedup.sort_suffixes(data, np.arange(0, len(data), 50), np.zeros(2000, dtype=np.int64))
    in_order = [data[50 * i : 50 * i + 50].tobytes() for i in got]
    assert in_order == sorted(in_order) and hashed[0] < 20 * 2000


def test_a_hash_collision_is_seen(monkeypatch):
    """With hashes that call everything equal, the bytes still decide."""
    monkeypatch.setattr(suffix_dedup, "span_hash", lambda p, i, j: np.zeros(len(i), dtype=np.uint64))
    a, b = b"a" * 30 + b"b" * 25, b"c" * 10 + b"a" * 30 + b"b" * 25
    got = suffix_dedup.repeated([a, b, b"z" * 60], np.array([1, 1, 1]), np.array([5, 7, 9]))
    assert got == [(1, 10, 65)]


def test_spans_merge():
    assert suffix_dedup.merge_spans(np.array([[5, 9], [0, 3], [3, 5], [20, 30], [22, 25]])).tolist() == [[0, 9], [20, 30]]


# -- decontamination -----------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(rows, items):
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(10, len(w))
        for j in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[j : j + k]), set()).add("null" if item is None else str(item))
    out = []
    for r in rows:
        w, hit, found = words(r["text"]), set(), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                if ids := windows.get(tuple(w[j : j + k])):
                    hit.update(range(j, j + k))
                    found |= ids
        out.append((r["doc_id"], len(w), len(hit), len(found), ",".join(sorted(found))))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def items(texts, vocabulary):
    w = [(t or "").split() for t in texts]
    return [
        (0, " ".join(w[0][5:30])), (1, " ".join(w[1][0:10]) + "!"), (2, " ".join(w[4][3:12])), (10, "one two"), (11, "one"), (12, None), (13, "..."),
        (14, " ".join(w[6][5:14] + ["absent"] + w[6][15:40])), (None, " ".join(w[7][-12:])), (15, " ".join(w[0][5:30])), (15, " ".join(w[0][5:30])),
        (16, " ".join(vocabulary[:9] * 3)), (17, "größe señor été größe señor été größe señor été größe señor"), (18, "nothing of this occurs anywhere at all in any text here"),
    ]


def test_decontamination_finds_every_window(spark, docs, items):
    got = decontaminate.find(docs, spark.createDataFrame(items, "item_id bigint, text string")).withColumn("ids", F.array_join("item_ids", ","))
    assert rows_of(got, "doc_id", "n_words", "n_hit", "n_items", "ids") == brute_hits(docs.collect(), items)
    assert "lang" in got.columns


def test_decontamination_without_items_or_documents(spark, docs, no_docs, items):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.find(docs, none).where("n_hit > 0").count() == 0
    assert decontaminate.find(no_docs, spark.createDataFrame(items, none.schema)).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta"), (2, "alpha beta"), (3, "beta x x x x x x x x alpha")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, "alpha beta")], "item_id bigint, text string")
    assert rows_of(decontaminate.near(docs, bench, 3), "doc_id", "item_id") == [(1, "7"), (2, "7")]


def test_decontamination_plan_has_no_python(spark, docs, items):
    plan = decontaminate.find(docs, spark.createDataFrame(items, "item_id bigint, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_prefix_shingles_go_to_the_leaders_without_a_shuffle_of_their_own(spark, monkeypatch):
    plans = {}

    def noted(df, name, *rest, **more):
        plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString())
        return written(df, name, *rest, **more)

    written = jaccard.written
    monkeypatch.setattr(jaccard, "written", noted)
    words = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "x"])), (3, " ".join(["y", *words])), (4, " ".join(words)), (5, "another text of few words")]
    got = jaccard.join(spark.createDataFrame(rows * 2, "doc_id long, text string")).distinct().collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}
    assert not [x for x in plans["leader-pairs"].splitlines() if "Aggregate" in x and "first_near" in x]


def test_a_worker_keeps_little_between_tasks():
    from paritylake.llm import common, hashing

    def run(batches):
        for b in batches:
            yield hashing.prefixes(np.zeros(b, dtype=np.uint8))

    assert [len(x) for x in common.freed(run)(iter([300_000]))] == [300_001]
    assert all(p.base is None and len(p) <= 1 << 16 for p in hashing._powers.values())
