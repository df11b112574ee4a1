"""Cross-entropy difference of two n-gram language models.

Target and background model are matched: word bigrams over one shared vocabulary, the
words that at least `min_count` places of the corpus hold; all others are one unknown word, in bigrams as
alone. A token costs -ln p, where p mixes its share after the word before it with its share
overall; where a model has never seen the word before, the share overall alone. A document's
score is the mean over its tokens of target cost less background cost. Low scores are like the
target.

The target model counts documents labelled of high quality, the background model all
documents. A document is scored by the counts of the others: its own are taken off in both models.

Counts are gathered over the whole corpus. Blocks of documents send each distinct word with its
counts to the task of the word's hash, which adds up all blocks' counts and sends each block the sums
back; then the same with each distinct bigram of the vocabulary. No model is collected or
broadcast, so its size may grow with the corpus, and the most frequent word or bigram costs
one entry a block.

Null or blank texts have no tokens and a null score. Rows may repeat: each counts and is
scored. A row without an id is never labelled. Repeated labels of one id count once, the
larger. A very long text is a block of its own, held whole with about 160 bytes a word. Columns other than id and
text are ignored, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, partitions, written
from .hashing import mix, prefixes, span_hash

BLOCK_BYTES = 12 << 20
#: About so many tokens of a block are worked on at once.
_PIECE = 1 << 17
#: What stands before a document's first word, after its last, and for words outside the vocabulary.
START, END, UNKNOWN = np.uint64(0x5EED0F7E87), np.uint64(0xE4DDEAD), np.uint64(0x0DDBA11)


def tokens(text: str | None) -> np.ndarray:
    """64-bit hashes of the lower-case words of a text, in order."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    data = np.frombuffer(b" ".join(words), dtype=np.uint8)
    gaps = np.flatnonzero(data == 32)
    start, end = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])
    return mix(span_hash(prefixes(data), start, end))


def _pack(*arrays: np.ndarray) -> bytes:
    return pa.compress(b"".join(a.tobytes() for a in arrays), codec="zstd", asbytes=True)


def _open(blob: bytes, n: int, *kinds) -> list[np.ndarray]:
    raw = pa.decompress(blob, decompressed_size=n * sum(np.dtype(k).itemsize for k in kinds), codec="zstd", asbytes=True)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def _pack_keys(keys: np.ndarray) -> bytes:
    """Rising numbers as the bytes of their steps, byte by byte: the upper ones are mostly zero."""
    step = np.diff(keys, prepend=np.uint64(0))
    return np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes()


def _open_keys(raw: bytes, n: int) -> np.ndarray:
    step = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n).reshape(8, n).T).view(np.uint64).ravel()
    return np.cumsum(step, dtype=np.uint64)


# --- blocks of documents ---------------------------------------------------------------------

_BLOCK = "block_id bigint, n_docs int, n_words int, n_tokens int, docs binary, words binary, tokens binary"


def _blocks(docs: DataFrame) -> DataFrame:
    """Blocks of rows (doc_id, text, target): their ids, distinct words, and which of them each token is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            rows = pa.Table.from_batches([b for b, _ in held])
            found = [f for _, some in held for f in some]
            words, at = np.unique(np.concatenate(found), return_inverse=True)
            rows = rows.append_column("size", pa.array([len(f) for f in found], pa.int64()))
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(rows)
            return pa.RecordBatch.from_pydict({
                "block_id": pa.array([(part << 24) + made], pa.int64()), "n_docs": pa.array([len(found)], pa.int32()),
                "n_words": pa.array([len(words)], pa.int32()), "n_tokens": pa.array([len(at)], pa.int32()),
                "docs": pa.array([sink.getvalue()], pa.binary()), "words": pa.array([pa.compress(_pack_keys(words), codec="zstd", asbytes=True)], pa.binary()),
                "tokens": pa.array([_pack(at.astype(np.uint32))], pa.binary())})

        for b in batches:
            for lo in range(0, b.num_rows, 500):
                some = b.slice(lo, 500)
                held.append((some.select(["doc_id", "target"]), [tokens(t) for t in some.column("text").to_pylist()]))
                size += some.column("text").nbytes
                if size >= BLOCK_BYTES:
                    yield out()
                    made, held, size = made + 1, [], 0
        if held:
            yield out()

    return written(docs.mapInArrow(freed(run), _BLOCK), "lm-blocks")


class Block:
    """A block as arrays; `counted` gives distinct keys of its tokens with the counts of both models."""

    def __init__(self, row: dict):
        self.rows = pa.ipc.open_stream(row["docs"]).read_all()
        self.words = _open_keys(pa.decompress(row["words"], decompressed_size=8 * row["n_words"], codec="zstd", asbytes=True), row["n_words"])
        self.at = _open(row["tokens"], row["n_tokens"], np.uint32)[0]
        self.size = self.rows.column("size").to_numpy()
        self.target = np.array(self.rows.column("target").to_pylist(), dtype=bool)
        self.n_pairs = np.where(self.size > 0, self.size + 1, 0)

    def counted(self, at: np.ndarray, size: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        return np.bincount(at, minlength=n), np.bincount(at[np.repeat(self.target, size)], minlength=n)

    def pieces(self) -> Iterator[tuple[slice, slice, slice]]:
        """Documents, tokens and bigrams of the block piece by piece; a document is never cut."""
        ends, pair_ends = (np.concatenate([[0], np.cumsum(n)]) for n in (self.size, self.n_pairs))
        lo = 0
        while lo < len(self.size):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + _PIECE, side="right")) - 1)
            yield slice(lo, hi), slice(ends[lo], ends[hi]), slice(pair_ends[lo], pair_ends[hi])
            lo = hi

    def bigrams(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distinct bigrams, which of them each is) over the vocabulary, of each document the first
        with START and the last with END."""
        word, keys = np.where(known, self.words, UNKNOWN), np.empty(self.n_pairs.sum(), dtype=np.uint64)
        for docs, tokens_, pairs in self.pieces():
            mine, size = word[self.at[tokens_]], self.size[docs]
            size = size[size > 0]
            ends = np.cumsum(size)
            with np.errstate(over="ignore"):
                keys[pairs] = mix(np.insert(mine, ends - size, START) * np.uint64(3) + mix(np.insert(mine, ends, END)))
        order = np.argsort(keys)
        keys = keys[order]
        new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
        keys = keys[new]
        pair_at = np.empty(len(order), dtype=np.uint32)
        pair_at[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
        return keys, pair_at


def _own(at: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """How often each token's (or bigram's) document holds it."""
    _, inverse, count = np.unique(doc * np.int64(n) + at, return_inverse=True, return_counts=True)
    return count[inverse]


# --- counts over all blocks ------------------------------------------------------------------

_SENT = pa.schema([("part", pa.int32()), ("block_id", pa.int64()), ("n", pa.int32()), ("body", pa.binary())])


def _send(block_id: int, keys: np.ndarray, counts: tuple[np.ndarray, np.ndarray], n_parts: int) -> pa.RecordBatch:
    """A block's rising keys and their counts, by the part of each key."""
    part = (keys % np.uint64(n_parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(n_parts + 1))
    body = lambda at: pa.compress(_pack_keys(keys[at]) + b"".join(c[at].astype(np.uint32).tobytes() for c in counts), codec="zstd", asbytes=True)
    rows = [(p, block_id, z - a, body(order[a:z]))
            for p, (a, z) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())) if z > a]
    return pa.RecordBatch.from_pylist([dict(zip(_SENT.names, r)) for r in rows], schema=_SENT)


def _received(got: list[dict] | None, keys: np.ndarray, n_parts: int) -> np.ndarray:
    """The corpus counts (both models) of a block's keys, from its answers."""
    part = (keys % np.uint64(n_parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(n_parts + 1))
    out = np.zeros((2, len(keys)), dtype=np.int64)
    for r in got or []:
        a, z = cuts[r["part"]], cuts[r["part"] + 1]
        out[:, order[a:z]] = _open(r["body"], r["n"], np.uint64, np.uint64)
    return out


def each_row(b: pa.RecordBatch) -> Iterator[dict]:
    """The rows one by one, so that only one of a batch is a Python object at a time."""
    return (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows))


_ANSWER = pa.schema([*_SENT, *((c, pa.int64()) for c in "vxy")])


def _answers(sent: DataFrame, min_count: int = 0) -> DataFrame:
    """For each blob the corpus counts of its keys. One row for each part, without a block, holds
    how many of its keys occur often enough, and the occurrences of the others in both models."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(rows: list[dict]) -> pa.RecordBatch:
            got = [_open(r["body"], r["n"], "V8", np.uint32, np.uint32) for r in rows]
            got = [(_open_keys(g[0].tobytes(), len(g[0])), *g[1:]) for g in got]
            keys, at = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
            both = [np.bincount(at, weights=np.concatenate([g[i] for g in got]), minlength=len(keys)).astype(np.uint64) for i in (1, 2)]
            known, cuts = both[0] >= min_count, np.cumsum([0, *(r["n"] for r in rows)])
            out = [{"part": r["part"], "block_id": r["block_id"], "n": r["n"], "body": _pack(*(c[at[a:z]] for c in both))} for r, a, z in zip(rows, cuts, cuts[1:])]
            out.append({"v": int(known.sum()), "x": int(both[0][~known].sum()), "y": int(both[1][~known].sum())})
            return pa.RecordBatch.from_pylist(out, schema=_ANSWER)

        held: list[dict] = []
        for b in batches:
            for row in each_row(b):
                if held and held[-1]["part"] != row["part"]:
                    yield answer(held)
                    held = []
                held.append(row)
        if held:
            yield answer(held)

    n = partitions(sent.sparkSession)
    dealt = sent.repartition(n, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(freed(run), "part int, block_id bigint, n int, body binary, v bigint, x bigint, y bigint")


def _by_block(answers: DataFrame, name: str) -> DataFrame:
    return answers.where("block_id IS NOT NULL").groupBy("block_id").agg(F.collect_list(F.struct("part", "n", "body")).alias(name))


def _over_blocks(blocks: DataFrame, made, schema: str) -> DataFrame:
    """`made(block row)` gives a batch for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from map(made, each_row(b))

    return blocks.mapInArrow(freed(run), schema)


def _losses(block: Block, known: np.ndarray, count: np.ndarray, pair_at: np.ndarray, pair_count: np.ndarray, n_docs: list[int], n_all: list[int],
            vocabulary: int, mix_in: float) -> np.ndarray:
    """Mean cost of each document's tokens in the background and the target model; `count` has the
    vocabulary's words, the unknown one last. The arrays for each token are made piece by piece."""
    place_of = np.where(known, np.arange(len(known)), len(known))
    out = np.empty((2, len(block.size)))
    for docs, tokens_, pairs in block.pieces():
        size, n_pairs, target = block.size[docs], block.n_pairs[docs], block.target[docs]
        doc, place, pair = np.repeat(np.arange(len(size)), size), place_of[block.at[tokens_]], pair_at[pairs].astype(np.int64)
        scored = np.ones(len(pair), dtype=bool)
        scored[np.cumsum(n_pairs)[size > 0] - 1] = False
        own_pair = _own(pair, np.repeat(np.arange(len(size)), n_pairs), pair_count.shape[1])[scored]
        pair = pair[scored]
        own = _own(place, doc, count.shape[1])
        first = np.zeros(len(place), dtype=bool)
        first[(np.cumsum(size) - size)[size > 0]] = True
        for m in (0, 1):
            mine = np.ones(len(size), dtype=bool) if m == 0 else target
            less = mine[doc]
            single = count[m][place] - own * less
            share = (single + 1) / (n_all[m] - (size * mine)[doc] + vocabulary + 1)
            before = np.where(first, n_docs[m] - less, np.roll(single, 1))
            after = (pair_count[m][pair] - own_pair * less) / np.maximum(before, 1)
            cost = -np.log(np.where(before > 0, mix_in * after + (1 - mix_in) * share, share))
            out[m, docs] = np.bincount(doc, weights=cost, minlength=len(size)) / np.maximum(size, 1)
    return out


_SENT_SQL = "part int, block_id bigint, n int, body binary"


def score(docs: DataFrame, labels: DataFrame, min_count: int = 2, mix_in: float = 0.5) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score for every row; `mix_in` is the weight of the bigram."""
    spark = docs.sparkSession
    good = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("__id")).agg((F.max("quality") > 0).alias("target"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    marked = rows.join(written(good.where("target"), "lm-target"), F.col("doc_id") == F.col("__id"), "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    blocks, n_parts = _blocks(marked), 2 * partitions(spark)

    def send_words(row: dict) -> pa.RecordBatch:
        block = Block(row)
        return _send(row["block_id"], block.words, block.counted(block.at, block.size, len(block.words)), n_parts)

    def sizes(row: dict) -> pa.RecordBatch:
        block = Block(row)
        one = (block.size > 0, block.size)
        return pa.RecordBatch.from_pylist([{f"{n}{m}": int(v[mask].sum()) for n, v in zip("dn", one) for m, mask in (("", slice(None)), ("t", block.target))}])

    words = written(_answers(_over_blocks(blocks, send_words, _SENT_SQL), min_count), "lm-words")
    sums = words.where("block_id IS NULL").agg(*[F.sum(c) for c in "vxy"]).first()
    vocabulary, *unknown = (int(x or 0) for x in sums)
    total = _over_blocks(blocks.select("docs", "words", "tokens", "n_tokens", "n_words"), sizes, "d bigint, dt bigint, n bigint, nt bigint").agg(*[F.sum(c) for c in ("d", "dt", "n", "nt")]).first()
    n_docs, n_all = [int(x or 0) for x in total[:2]], [int(x or 0) for x in total[2:]]
    seen = blocks.join(_by_block(words, "of_words"), "block_id", "left")

    def known_words(block: Block, row: dict) -> tuple[np.ndarray, np.ndarray]:
        count = _received(row["of_words"], block.words, n_parts)
        return count, count[0] >= min_count

    def send_pairs(row: dict) -> pa.RecordBatch:
        block = Block(row)
        pairs, at = block.bigrams(known_words(block, row)[1])
        return _send(row["block_id"], pairs, block.counted(at, block.n_pairs, len(pairs)), n_parts)

    asked = seen.join(_by_block(_answers(_over_blocks(seen, send_pairs, _SENT_SQL)), "of_pairs"), "block_id", "left")

    def losses(row: dict) -> pa.RecordBatch:
        block = Block(row)
        count, known = known_words(block, row)
        pairs, pair_at = block.bigrams(known)
        pair_count = _received(row["of_pairs"], pairs, n_parts)
        del row["of_words"], row["of_pairs"]
        count = np.concatenate([np.where(known, count, 0), np.array(unknown)[:, None]], axis=1)
        out = _losses(block, known, count, pair_at, pair_count, n_docs, n_all, vocabulary, mix_in)
        none = block.size == 0
        return pa.RecordBatch.from_arrays([block.rows.column("doc_id").combine_chunks(), pa.array(block.size), pa.array(out[1], mask=none), pa.array(out[0], mask=none),
                                           pa.array(out[1] - out[0], mask=none)], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _over_blocks(asked, losses, f"doc_id {kind}, n_tokens bigint, target_loss double, background_loss double, score double")
