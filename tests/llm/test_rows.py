"""Operators that judge rows one by one, packing, scoring, archives and the pipeline."""

import hashlib
import html
import io
import math
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paritylake.llm import html_text, lm_score, packing, quality, toxicity, url_filter, warc
from paritylake.llm.queries import tokenizer_path


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# -- quality -------------------------------------------------------------------------------

@pytest.mark.parametrize("text, want", [
    (None, (0, 0, 0, 0, 0)), (" \n\t", (0, 0, 0, 0, 0)), ("a b c d", (4, 4, 0, 0, 0)), ("a b c a b c", (6, 6, 0, 0, 6)),
    ("a a a a", (4, 4, 0, 0, 4)), ("x\n\nx\nx", (3, 3, 0, 2, 0)), ("é#* <b>", (2, 6, 4, 0, 0)), ("a\u00a0b \u2003c", (2, 5, 0, 0, 0)),
    ("p a b c q a b c r", (9, 9, 0, 0, 6)),
])
def test_measures(text, want):
    assert quality.measure(text)[:5] == want


def test_ledger_policies_and_ablation(spark, docs, no_docs):
    led = quality.ledger(docs)
    assert {"lang", "n", "failed_bits"} <= set(led.columns) and led.count() == docs.count()
    judged = quality.apply_policy(led, "base-1").collect()
    for r in judged:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and r["kept"] == (not r["base_failed"])
    for r in quality.ablation(led, "strict-1").collect():
        bit = next(x.bit for x in quality.RULES if x.name == r["rule"])
        bits = [x["failed_bits"] for x in judged]
        assert r["failed"] == sum(b >> bit & 1 for b in bits) and r["failed_alone"] == sum(b == 1 << bit for b in bits)
        assert r["kept_without"] == sum(b & ~(1 << bit) == 0 for b in bits)
    assert quality.ledger(no_docs).count() == 0


# -- toxicity ------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def toxic_tables(spark, vocabulary):
    import random

    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(20, 80))]
        if bad := i % 4 == 0:
            w[rng.randrange(len(w))] = rng.choice(["grobian", "schuft", "lump"])
        if i % 40 == 1:
            w[3:5] = ["lump", "sugar"]
            w[7:9] = ["lump", "sugar"]
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    rows += [(None, "grobian"), (5000, None), (5001, ""), (5002, "ein gr0b1an hier"), (5003, "schuft$$$"), (5004, "lump sugar"), (5005, "ein lumр")]
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels + labels[:3], "doc_id bigint, quality int, toxic int")


def test_toxicity_learns_terms_and_exceptions(toxic_tables):
    docs, labels = toxic_tables
    model = toxicity.train(docs, labels)
    assert {toxicity.fold(x) for x in ("grobian", "schuft", "lump")} <= set(model.weights)
    assert toxicity.fold("lump sugar") in model.exceptions
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert [got[i]["predicted"] for i in (None, 5000, 5001, 5002, 5003, 5004, 5005)] == [1, 0, 0, 1, 1, 0, 1]
    held = [(r["predicted"], int(d % 4 == 0)) for d, r in got.items() if r["held_out"] and d < 600]
    assert len(held) > 60 and all(p == y for p, y in held)
    assert all(r["held_out"] == (d is not None and zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())


def test_toxicity_keeps_every_exception(spark):
    text = " ".join(f"grobian w{i}x" for i in range(600))
    rows = spark.createDataFrame([(text, 0)] * 5 + [("ein grobian", 1)] * 5, "text string, toxic int")
    found = toxicity._contexts(rows, toxicity.Model({toxicity.fold("grobian"): 3.0}))
    assert {toxicity.fold(f"grobian w{i}x") for i in range(600)} <= set(found)


def plain_matches(model, folded):
    """Terms at word boundaries (stems at their start only) outside every exception that covers them."""
    def at(word, whole):
        return [(i, i + len(word)) for i in range(len(folded) - len(word) + 1) if folded.startswith(word, i)
                and not (i and folded[i - 1].isalnum()) and not (whole and i + len(word) < len(folded) and folded[i + len(word)].isalnum())]

    spared = [s for p in model.exceptions for s in at(p, True)]
    found = [(s, w) for w in model.weights for s in at(w.rstrip(toxicity.STEM), not w.endswith(toxicity.STEM))]
    return sorted(w for s, w in found if not any(a <= s[0] and s[1] <= b for a, b in spared))


def test_matches_equal_plain_search():
    import random

    rng = random.Random(8)
    terms = {"ab": 1.0, "abb": 2.0, "ba": 0.5, "aab" + toxicity.STEM: 1.5, "b a": 1.0}
    model = toxicity.Model(terms, ("ab a", "a ab", "ba ab ba", "aabb"))
    for _ in range(800):
        text = "".join(rng.choice("aab b \n.") for _ in range(rng.randrange(40)))
        assert sorted(model.matches(text)) == plain_matches(model, text), text
    long = "ab a " * 20_000
    assert model.matches(long) == []


def test_words_are_parted_by_any_white_space():
    model = toxicity.Model({"lump": 3.0})
    assert len({model.features(sep.join(["lump", *"abcdefghi"])) for sep in (" ", "\n", "\t ", "  ")}) == 1


def test_toxicity_without_rows_or_labels(docs, no_docs, toxic_tables):
    model = toxicity.train(docs, toxic_tables[1].where("false"))
    assert model.weights == {} and toxicity.score(no_docs, model).count() == 0
    assert all(r["predicted"] == 0 for r in toxicity.score(docs, model).collect())


# -- URLs ----------------------------------------------------------------------------------

URLS = [
    (1, "https://Sub.Example.ORG/es/x", "sub.example.org", "/es/x", "example.org/es/", "block"), (2, "http://example.org/en/12?q#f", "example.org", "/en/12", "example.org/en/1", "block"),
    (3, "http://a.org/", "a.org", "/", "org/", "allow"), (4, "http://a.org", "a.org", "", None, "allow"), (5, "http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    (6, "x://b.com/fr/?a", "b.com", "/fr/", "com/fr/", "allow"), (7, "x://b.com/de/", "b.com", "/de/", "com/de/", "block"), (8, None, "", "", None, "allow"), (9, "no scheme", "", "", None, "allow"),
    (10, "http://adult-x.example.net/", "adult-x.example.net", "/", None, "block"), (11, "http://adulthood.net/", "adulthood.net", "/", None, "allow"),
    (12, "http://a.net/b/casino/c", "a.net", "/b/casino/c", None, "block"), (14, "x://a.net/x\ny/casino", "a.net", "/x\ny/casino", None, "block"), (13, "://a.net?x://y.org/", "a.net", "", None, "allow"), (None, "http://adult.example.org/fr/", "adult.example.org", "/fr/", "org/", "allow"),
]


def test_url_verdicts(spark):
    rows = [(i, u, "other") for i, u, *_ in URLS]
    pages = spark.createDataFrame(rows + rows[:2] + rows[7:8], "page_id bigint, url string, host string")
    got = url_filter.judge(pages, url_filter.rules_table(spark, url_filter.rule_rows()))
    want = [(i, h, p, r, v) for i, _, h, p, r, v in [*URLS, *URLS[:2], URLS[7]]]
    assert rows_of(got, "id", "host", "path", "rule", "verdict") == sorted(want, key=repr)
    assert url_filter.judge(pages.where("false"), url_filter.rules_table(spark, url_filter.rule_rows())).count() == 0


# -- HTML ----------------------------------------------------------------------------------

@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("<p>", ""), ("a < b", "a < b"),
    ("<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a> <a>News</a></nav><article><h1>Big&nbsp;title</h1><p>One  two\n<b>three</b> &amp;amp; four.<br>Five</p>"
     "<div class='ad-box'>Buy this thing now, it is cheap</div><p>Six.</p><section id=comments><p>A reader says something quite long here.</p></section></article><footer>&copy; all rights</footer></body>",
     "Big title One two three &amp; four. Five Six."),
    ("<main><p>Open paragraph<p>next one<script>var x='</p><p>no';</script> ends</main><aside>beside the text</aside>", "Open paragraph next one ends"),
    ("<div id=menu><ul><li><a>One</a><li><a>Two</a></ul></div><div><p>" + "word " * 40 + "</p><p>" + "more " * 30 + "</p></div><div class=footer>some closing words</div>",
     ("word " * 40 + "more " * 30).strip()),
    ("<article><form>Your name <input> please</form><p>Text</p><!-- <p>hidden</p> --></article>", "Text"),
    ("<article><p>See <a href=x>this link</a> for the details of it.</p></article>", "See this link for the details of it."),
])
def test_main_text(page, want):
    assert html_text.main_text(page, html_text.grow(html_text.LABELLED)) == want


def test_article_keeps_its_blocks_beside_links():
    tree = html_text.grow(html_text.LABELLED)
    long = "word " * 30
    for page, want in [
        (f"<article><p>{long}</p><p>The last words.</p></article><footer><a>Home</a></footer>", long + "The last words."),
        (f"<article><p>{long}</p><h2>See also</h2><ul><li><a>One</a><li><a>Two</a></ul></article>", long + "See also One Two"),
        ("<article><p>Some body text here.</p><p><a>See the full report of the council</a></p><p><a>Read</a></p></article><div>By the way</div>", "Some body text here. See the full report of the council Read"),
        (f"<nav><a>One Two</a></nav><article><h1>Five words are the title</h1><p>{long}</p></article>", "Five words are the title " + long.strip()),
        (f"<article><p>{long}</p><p>Read <a>this longer linked text</a> now.</p></article>", long + "Read this longer linked text now."),
    ]:
        assert html_text.main_text(page, tree) == want
    for words in (1, 2, 5, 7, 22, 23, 300):
        for before in (0, 1, 7, 60):
            for after in (0, 1, 7, 60):
                for p, n in ((0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, 1.0)):
                    for density, heading in ((0.0, 0), (0.42, 0), (0.9, 0), (0.0, 1), (1.0, 1)):
                        assert html_text.decide(tree, (words, density, before, p, after, n, 0, 1, heading))
                    assert html_text.decide(tree, (words, 1.0, before, p, after, n, 0, 1, 0))
                    for density, heading in ((0.0, 0), (0.9, 0), (0.0, 1)):  # what says that it is no text, or is beside the article
                        assert not html_text.decide(tree, (words, density, before, p, after, n, 1, 1, heading))
                        assert not html_text.decide(tree, (words, density, before, p, after, n, 0, 2, heading))


@pytest.mark.parametrize("attrs", [
    'style="overflow:hidden"', 'title="the hidden cost"', 'data-id="nav"', 'data-x="a class=menu b"', 'class="post has-sidebar"', 'class="content no-comments"', 'class="social-science"', "class=entry-header",
])
def test_attributes_are_read_by_whole_names(attrs):
    tree, long = html_text.grow(html_text.LABELLED), " ".join(["word"] * 40)
    for page in (f"<article {attrs}><p>{long}</p></article>", f"<main><div {attrs}><p>{long}</p></div></main>", f"<div {attrs}><p>{long}</p></div>"):
        assert html_text.main_text(page, tree) == long
    for outside in ("hidden", "class='x site-header'", "id=nav", "class=sidebar-left", "role=navigation"):
        assert html_text.main_text(f"<div {outside}><p>{long}</p></div><div>{long}</div>", tree) == long
    assert html_text.main_text(f"<article class=sidebar><div class=header><h1>Title</h1></div><p>{long}</p></article>", tree) == "Title " + long
    for own in ("class=notice", "class='cookie-notice'", "class=sidebar", "class=ad-slot", "id=reader-comments", "class=comment-thread", "class=post-comments", "class='promo box'", "id=newsletter-form"):
        for element in ("div", "section", "p", "ul"):
            assert html_text.main_text(f"<article><p>{long}</p><{element} {own}>Some other words of ten or more that are no text</{element}></article>", tree) == long


@pytest.mark.parametrize("inner, want", [
    ('<svg-icon name="x"></svg-icon>', ""), ("<select-box></select-box>", ""), ("<title-card>t</title-card>", "t"), ("<svg viewBox='0 0 1 1' />", ""), ("<svg/>", ""),
    ("<svg><text>drawn</text></svg>", ""), ("<math><mi>x</mi><mo>=</mo><mn>1</mn></math>", "x=1"), ("<math/>", ""), ("<iframe src=x>", ""), ("<style>p{}</style>", ""),
])
def test_raw_elements_end_where_they_end(inner, want):
    got = html_text.main_text(f"<article><p>a {inner} b</p><p>c</p></article>", html_text.grow(html_text.LABELLED))
    assert got.split() == ["a", *want.split(), "b", "c"]


def test_tree_agrees_with_its_table():
    tree = html_text.grow(html_text.LABELLED)
    assert all(html_text.decide(tree, r[:-1]) == bool(r[-1]) for r in html_text.LABELLED)


def test_extract_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>" + "ab " * 50, "t"), (None, None, None, None), (1, "u", "<p>" + "ab " * 50, "t")], "page_id bigint, url string, html string, text string")
    got = rows_of(html_text.extract(pages), "page_id", "url", "text", "n_chars")
    assert got == sorted([(1, "u", ("ab " * 50).strip(), 149)] * 2 + [(None, None, "", 0)], key=repr)
    assert html_text.extract(pages.where("false")).count() == 0
    assert html.unescape("&amp;") == "&"


# -- packing ---------------------------------------------------------------------------------

def test_encoding_equals_the_tokenizer(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    some = [*texts, "It's 12 o’clock\u2003NOW\u00a0yes\x1c<|endoftext|> e\u0301 İstanbul ΣΑΣ\r\nx", "\u0301a"]
    for t, ids in zip(some, packing.encode(some, tokenizer_path(), 1)):
        assert ids.tolist() == [*tok.encode(t or "", add_special_tokens=False).ids, 1]


def test_pieces_cover_every_id_once(docs, no_docs):
    got = packing.pieces(docs, tokenizer_path(), portion=3000).collect()
    rows = docs.collect()
    want = Counter((r["doc_id"], tuple(ids.tolist())) for r, ids in zip(rows, packing.encode([r["text"] for r in rows], tokenizer_path(), 1)))
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    for (d, n), parts in by_doc.items():
        copies = [ids for (i, ids), c in want.items() if i == d and len(ids) == n for _ in range(c)]
        expected = Counter()
        assert sum(length for _, length, _ in parts) == n * len(copies)
        for s, length, crc in parts:
            assert any(zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[s : s + length])) == crc for ids in copies)
            expected.update(range(s, s + length))
        assert set(expected.values()) <= {len(copies)}
    assert sum(n * c for (_, ids), c in want.items() for n in [len(ids)]) == sum(r["length"] for r in got)
    assert packing.pieces(no_docs, tokenizer_path()).count() == 0


def test_packing_wastes_little():
    import random

    rng = random.Random(1)
    lengths = [min(2048, int(rng.expovariate(1 / 500)) + 1) for _ in range(3000)]
    made = packing.pack(lengths)
    sizes = [sum(n for _, _, n in s) for s in made]
    assert sum(sizes) == sum(lengths) and sum(2048 - s for s in sizes if s & (s - 1)) <= 64
    loads = Counter()
    for s, step in zip(sizes, packing.balance(sizes)):
        loads[step] += s
    assert max(loads.values()) <= 2048 + 256


# -- language models --------------------------------------------------------------------------

@pytest.mark.parametrize("block_bytes", [lm_score.BLOCK_BYTES, 300])
def test_losses_equal_plain_counting(docs, no_docs, spark, monkeypatch, block_bytes):
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", block_bytes)
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(0, 60)] + [(None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = lm_score.score(docs.withColumnRenamed("kind", "target"), labels).collect()
    texts = [(r["doc_id"], (r["text"] or "").lower().encode().split()) for r in docs.collect()]
    often = Counter(x for _, w in texts for x in w)
    texts = [(d, [x if often[x] >= 2 else "unknown" for x in w]) for d, w in texts]
    vocabulary = sum(n >= 2 for n in often.values())

    def model(chosen):
        """Words, words with a next one, bigrams, tokens."""
        word, first, pair = Counter(), Counter(), Counter()
        for w in chosen:
            if w:
                word.update(w)
                first.update(["start", *w])
                pair.update(zip(["start", *w], [*w, "end"]))
        return word, first, pair, sum(word.values())

    is_target = lambda d: d is not None and d < 60 and d % 3 == 0
    whole = [model([w for _, w in texts]), model([w for d, w in texts if is_target(d)])]

    def loss(d, w, m):
        own = model([w]) if m == 0 or is_target(d) else model([])
        word, first, pair = (Counter(a) - Counter(b) for a, b in zip(whole[m][:3], own[:3]))
        n, cost = whole[m][3] - own[3], 0.0
        for u, x in zip(["start", *w], w):
            share = (word[x] + 1) / (n + vocabulary + 1)
            cost -= math.log(0.5 * pair[u, x] / first[u] + 0.5 * share if first[u] else share)
        return cost / len(w)

    want = Counter((d, len(w), round(loss(d, w, 1), 4) if w else None, round(loss(d, w, 0), 4) if w else None) for d, w in texts)
    near = Counter((r["doc_id"], r["n_tokens"], None if r["score"] is None else round(r["target_loss"], 4), None if r["score"] is None else round(r["background_loss"], 4)) for r in got)
    assert near == want
    assert lm_score.score(no_docs, labels).count() == 0


def block_of(sizes, n_words, seed=5):
    """A block of random tokens over so many words; the vocabulary knows every second one."""
    rng = np.random.default_rng(seed)
    rows = pa.table({"doc_id": pa.array(range(len(sizes)), pa.int64()), "target": pa.array([i % 3 == 0 for i in range(len(sizes))]), "size": pa.array(sizes, pa.int64())})
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, rows.schema) as w:
        w.write_table(rows)
    words = np.sort(rng.integers(1, 2**63, n_words, dtype=np.uint64))
    row = {"docs": sink.getvalue(), "n_words": n_words, "words": pa.compress(lm_score._pack_keys(words), codec="zstd", asbytes=True),
           "n_tokens": sum(sizes), "tokens": lm_score._pack(rng.integers(0, n_words, sum(sizes)).astype(np.uint32))}
    return lm_score.Block(row), np.arange(n_words) % 2 == 0


def traced(run):
    """Result of a call, and the bytes it needed at its peak."""
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def losses_of(block, known, pairs):
    count = np.array([np.bincount(block.at, minlength=len(known)), np.bincount(block.at, minlength=len(known))])
    count = np.concatenate([np.where(known, count, 0), np.full((2, 1), 10**6)], axis=1)
    return lm_score._losses(block, known, count, pairs[1], np.full((2, len(pairs[0])), 1000), [10**6, 10**6], [10**8, 10**8], 500, 0.5)


def test_a_block_of_tokens_needs_little_memory():
    block, known = block_of([200] * 3000, 20_000)
    pairs, most = traced(lambda: block.bigrams(known))
    assert most < 60 * 600_000
    assert traced(lambda: losses_of(block, known, pairs))[1] < 60 * 600_000


def test_pieces_of_a_block_change_nothing(monkeypatch):
    block, known = block_of([0, 3, 1, 0, 0, 40, 2, 7, 0], 20)
    whole = block.bigrams(known)
    want = losses_of(block, known, whole)
    monkeypatch.setattr(lm_score, "_PIECE", 4)
    assert len(list(block.pieces())) > 3
    cut = block.bigrams(known)
    assert all((a == b).all() for a, b in zip(whole, cut)) and (losses_of(block, known, cut) == want).all()


# -- archives ---------------------------------------------------------------------------------

@pytest.mark.parametrize("zip64", [False, True])
def test_zip_members_are_read_by_range(zip64):
    import zipfile

    out = io.BytesIO()
    w = warc.ZipWriter(out, zip64)
    w.add("a/é.txt", b"hello")
    w.add("b", b"x" * 1000)
    size = w.close()
    assert size == len(out.getvalue())
    found = warc.directory(out, size)
    assert {k: warc.read_range(out, at, n) for k, (_, at, n) in found.items()} == {"a/é.txt": b"hello", "b": b"x" * 1000}
    with zipfile.ZipFile(out) as z:
        assert z.testzip() is None and z.read("b") == b"x" * 1000


def test_archives_with_comments_and_foreign_writers():
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("one", b"data")
        z.comment = b"PK\x05\x06 in a comment"
    found = warc.directory(out, len(out.getvalue()))
    assert warc.read_range(out, *found["one"][1:]) == b"data"
    with pytest.raises(ValueError, match="not a ZIP"):
        warc.directory(io.BytesIO(b"nothing here"), 12)


def test_urls_with_line_separators_go_through_archives(spark):
    rows = [(1, "http://a/\u2028b", "one"), (2, "http://a/\x85b\u2029", "two"), (3, "http://a/\x0b\x1c", "three")]
    got = warc.archived(spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, digest string"))
    assert rows_of(got, "page_id", "payload_bytes") == [(1, 3), (2, 3), (3, 5)]


@pytest.mark.parametrize("zip64", [False, True])
def test_pages_go_through_archives(spark, zip64):
    from paritylake.llm.common import shared_path

    long = "<p>é" + "long page " * 200
    rows = [(1, "http://a b\n/", long), (2, "u", long), (3, None, long), (3, None, long), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", long), (None, "u", "alone" * 300), (8, "u", "z" * 999)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, digest string").repartition(3)
    folder = shared_path(spark, "test-warc")
    got = warc.read(warc.write(warc.plan(pages), folder, archive_bytes=500, member_bytes=200, zip64=zip64), folder)
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        revisit = h == long and i != 3
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None))
    assert rows_of(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)
    assert got.where("page_id = 1").first()["url"] == "http://a%20b%0A/"
    assert warc.archived(pages.where("false")).count() == 0


# -- pipeline ------------------------------------------------------------------------------------

def test_pipeline_stages(spark, docs, items_dir):
    import corpus_pipeline as cp

    stage = dict(cp.STAGES)
    base = spark.createDataFrame([r[:5] for r in docs.where("doc_id is not null").collect()], "doc_id bigint, text string, lang string, source string, n_chars bigint").dropDuplicates(["doc_id"])
    good = stage["quality rules"](spark, base, items_dir)
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in quality.apply_policy(quality.ledger(base)).where("kept").collect()}
    one = stage["n-gram Jaccard join"](spark, good, items_dir)
    cut = stage["suffix-array dedup"](spark, one, items_dir)
    clean = stage["benchmark decontamination"](spark, cut, items_dir)
    for df in (good, one, cut, clean):
        assert df.columns == list(cp.DOC_COLUMNS)
    assert 0 < one.count() < good.count() and cut.count() == one.count() and 0 < clean.count() < cut.count()
    assert cut.agg(F.sum("n_chars")).first()[0] < one.agg(F.sum(F.length("text"))).first()[0]
    assert [n for n, _ in cp.STAGES] == ["quality rules", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination", "packing"]


def test_pipeline_stages_with_null_ids_repeated_rows_and_nothing(spark, docs, no_docs, items_dir, tmp_path):
    import corpus_pipeline as cp

    columns = list(cp.DOC_COLUMNS)
    for n, rows in enumerate((docs.select(*columns), no_docs.select(*columns))):
        given = {r["doc_id"] for r in rows.collect()}
        for name, stage in cp.STAGES:
            made = stage(spark, rows, items_dir)
            if name != "packing":
                assert made.columns == columns
                path = f"{tmp_path}/{n}-{name.replace(' ', '-')}"
                made.write.parquet(path)
                rows = spark.read.parquet(path)
                assert {r["doc_id"] for r in rows.collect()} <= given
        pieces = made.collect()
        kept = [r["text"] for r in rows.collect()]
        assert sum(r["length"] for r in pieces) == sum(map(len, packing.encode(kept, tokenizer_path(), 1))) and (n == 1) == (not kept)
        if not n:  # the row without an id is a text of its own here, or a copy of one that stays
            assert rows.where("doc_id IS NULL").count() <= 1


@pytest.fixture()
def items_dir(spark, texts, tmp_path):
    w = texts[20].split()
    spark.createDataFrame([(1, " ".join(w[8:25]))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)
