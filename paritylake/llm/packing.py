"""Hierarchical packing into several context sizes.

Documents become token ids followed by the end mark. Whole windows of the longest size are
cut off first; what is left of a document is routed to the smallest tier that holds it.
Each tier is packed in decreasing order into windows of its size, each into the tightest
open window; gaps of long windows are filled from shorter tiers, cutting a piece where
it overhangs; and what stays in a tier is split into windows of smaller powers of two, so
that nearly every sequence is a whole power of two and needs no padding.

Step groups: sequences are dealt to steps so that each step holds the same number of
tokens, as every group takes as many windows of a tier as fill one long window.

Null texts are empty: a document of just the end mark. Rows may repeat; each is packed
for itself. A very long text is a portion of its own, held whole with its ids. Columns other
than id and text are ignored, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct_words, freed

WINDOW = 2048
TIERS = (2048, 1024, 512, 256)
_CHUNK, _AT_ONCE = 500, 40  # distinct words that are encoded as one text, and texts whose tokens are held at once
#: Kinds of bytes: white space, letters, digits, signs, and those that a cut must not touch.
_SPACE, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[list(b" \t\n\x0b\x0c\r")] = _SPACE
_KIND[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = _LETTER
_KIND[list(b"0123456789")] = _DIGIT
_KIND[list(b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~')] = _SIGN
#: Whether a word starts at a byte, by the kinds of the byte before it and of itself.
_STARTS = np.zeros((5, 5), dtype=bool)
_STARTS[_SPACE, 1:] = True
_STARTS[_LETTER, [_DIGIT, _SIGN]] = _STARTS[_DIGIT, [_LETTER, _SIGN, _DIGIT]] = _STARTS[_SIGN, [_LETTER, _DIGIT]] = True

_tokenizers: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def _word_ids(tok, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths) of words, one after the other. Words are encoded many at once with a digit
    between them, which is a token of its own."""
    zero = tok.encode("0", add_special_tokens=False).ids
    texts = [w.decode("utf-8", "replace") for w in words]
    lone = [i for i, t in enumerate(texts) if "0" in t]
    ids: list = [None] * len(words)
    for i, e in zip(lone, tok.encode_batch_fast([texts[i] for i in lone], add_special_tokens=False)):
        ids[i] = np.array(e.ids, dtype=np.uint32)
    plain = [i for i, t in enumerate(texts) if "0" not in t]
    for low in range(0, len(plain), _CHUNK * _AT_ONCE):
        chunks = [plain[lo : min(lo + _CHUNK, low + _CHUNK * _AT_ONCE)] for lo in range(low, min(len(plain), low + _CHUNK * _AT_ONCE), _CHUNK)]
        for chunk, e in zip(chunks, tok.encode_batch_fast([" 0 ".join([texts[i] for i in c]) for c in chunks], add_special_tokens=False)):
            found = np.array(e.ids, dtype=np.uint32)
            at = np.flatnonzero(found == zero[0])
            if len(zero) != 1 or len(at) != len(chunk) - 1:
                raise ValueError("the tokenizer joins a digit with other text")
            lo = 0
            for i, hi in zip(chunk, [*at.tolist(), len(found)]):
                ids[i] = found[lo:hi]
                lo = hi + 1
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.concatenate([np.empty(0, np.uint32), *ids]), lengths


def encode(texts: list[str | None], path: str, end_id: int) -> list[np.ndarray]:
    """Ids of each text. The tokenizer drops white space and looks neither across it nor from an ASCII letter to a
    sign or a digit, so the distinct words of all the texts are encoded once. It lower-cases, but
    matches its special tokens as they are written: texts with their mark are encoded whole."""
    tok = _tokenizer(path)
    raw = [b"" if t is None or "<|" in t else t.encode("utf-8", "replace").lower() for t in texts]
    start = np.cumsum([0, *(len(r) + 1 for r in raw)])
    data = np.frombuffer(b"\n".join([b"", *raw]), dtype=np.uint8)
    del raw
    kind = _KIND[data]
    first = np.zeros(len(data), dtype=bool)
    first[1:] = _STARTS[kind[:-1], kind[1:]]
    distinct, word = distinct_words(data, kind != _SPACE, first)
    begins = np.searchsorted(np.flatnonzero(first), start)
    del data, kind, first
    ids, length = _word_ids(tok, distinct.to_pylist())
    size = length[word]
    total = np.concatenate([[0], np.cumsum(size)])
    at = total[begins]
    # the place in `ids` of every token: where its word starts there, and its place in the word
    place = np.repeat(((np.cumsum(length) - length)[word] - total[:-1]).astype(np.int32), size)
    place += np.arange(total[-1], dtype=np.int32)
    flat = ids[place]
    del place
    end = np.array([end_id], dtype="<u4")
    out = [np.concatenate([flat[a:z], end]).astype("<u4") for a, z in zip(at[:-1], at[1:])]
    for i, t in enumerate(texts):
        if t is not None and "<|" in t:
            out[i] = np.array([*tok.encode(t.encode("utf-8", "replace").decode(), add_special_tokens=False).ids, end_id], dtype="<u4")
    return out


def cut(n: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """Starts and lengths: whole windows, then the rest."""
    return [(s, min(window, n - s)) for s in range(0, n, window)]


def _tier(length: int, tiers: tuple[int, ...]) -> int:
    return min(t for t in tiers if t >= length)


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences of (piece, start within the piece, length). Every length is at most tiers[0]."""
    window = tiers[0]
    done: list[list[tuple[int, int, int]]] = []
    by_tier: dict[int, list[int]] = {t: [] for t in tiers}
    for k, n in enumerate(lengths):
        if n == window:
            done.append([(k, 0, n)])
        else:
            by_tier[_tier(n, tiers)].append(k)
    spare: list[tuple[int, int, int]] = []  # what waits to fill gaps, longest tiers last
    open_bins: list[tuple[int, list[tuple[int, int, int]]]] = []
    for t in sorted(tiers):
        # pack the tier by best fit decreasing into windows of its size
        free: list[tuple[int, int]] = []
        bins: list[list[tuple[int, int, int]]] = []
        for k in sorted(by_tier[t], key=lambda k: (-lengths[k], k)):
            i = _tightest(free, lengths[k])
            if i is None:
                bins.append([(k, 0, lengths[k])])
                room = t - lengths[k]
                slot = len(bins) - 1
            else:
                room, slot = free.pop(i)
                bins[slot].append((k, 0, lengths[k]))
                room -= lengths[k]
            if room:
                _insert(free, (room, slot))
        gaps = dict((slot, room) for room, slot in free)
        if t < window:
            for slot, b in enumerate(bins):
                (spare.extend(b) if gaps.get(slot) else done.append(b))
        else:
            open_bins = [(gaps.get(slot, 0), b) for slot, b in enumerate(bins)]
    # fill the gaps of the long windows from the shorter tiers, then from the emptiest long windows
    spare.sort(key=lambda p: (p[2], p[0]))  # the longest is taken first
    open_bins.sort(key=lambda b: b[0])
    while open_bins:
        room, b = open_bins.pop(0)
        while room:
            if not spare:
                if not open_bins:
                    break
                spare = sorted(open_bins.pop()[1], key=lambda p: (p[2], p[0]))
                continue
            k, s, n = spare.pop()
            b.append((k, s, min(n, room)))
            if n > room:
                spare.append((k, s + room, n - room))
            room -= min(n, room)
        if room:
            spare.extend(b)
        else:
            done.append(b)
    # the rest of all tiers in a row, cut into windows of falling powers of two
    rest = sum(n for _, _, n in spare)
    spare.reverse()
    while rest:
        size = window if rest >= window else 1 << (rest.bit_length() - 1)
        if window > rest > window - window // 32:
            size = rest  # a long window with a little padding beats a chain of tiny ones
        seq, room = [], size
        while room:
            k, s, n = spare.pop()
            seq.append((k, s, min(n, room)))
            if n > room:
                spare.append((k, s + room, n - room))
            room -= min(n, room)
        done.append(seq)
        rest -= size
    return done


def _tightest(free: list[tuple[int, int]], need: int) -> int | None:
    i = bisect.bisect_left(free, (need, -1))
    return i if i < len(free) else None


def _insert(free: list[tuple[int, int]], item: tuple[int, int]) -> None:
    bisect.insort(free, item)


def balance(sizes: list[int], window: int = WINDOW) -> list[int]:
    """Step of each sequence: longest first into the step with the fewest tokens, where
    as many steps exist as whole windows are needed to hold all tokens."""
    steps = [(0, i) for i in range(max(1, -(-sum(sizes) // window)))]
    out = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        load, step = heapq.heappop(steps)
        out[k] = step
        heapq.heappush(steps, (load + sizes[k], step))
    return out


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, tiers: tuple[int, ...] = TIERS,
           portion: int = 12_000_000, keep_tokenizer: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, step_id.

    Every task packs the rows of its own partition, in portions of about `portion` characters,
    so there is no shuffle and no key that could be hot. A sequence's id holds the
    partition it was made in. A worker keeps the tokenizer for its next task; without `keep_tokenizer`
    it is read again, where other work needs the memory between.
    """
    if window != tiers[0]:
        raise ValueError("the longest tier is the window")
    kind = docs.schema["doc_id"].dataType.simpleString()
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            ids, texts = zip(*held)
            held.clear()
            return _pack_portion(list(zip(ids, encode(list(texts), tokenizer, end_id))), tiers, part, made, kind_of)

        for b in batches:
            kind_of = b.schema.field("doc_id").type
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                held.append((doc_id, text.as_py()))
                size += len(held[-1][1] or "") + 1
                if size >= portion:
                    rows, made = out()
                    size = 0
                    yield rows
        if held:
            yield out()[0]
        if not keep_tokenizer:
            _tokenizers.clear()

    return src.mapInArrow(freed(run), f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
                                "sequence_id bigint, offset bigint, step_id bigint")


def _pack_portion(held: list[tuple[object, np.ndarray]], tiers: tuple[int, ...], part: int, made: int,
                  kind: pa.DataType) -> tuple[pa.RecordBatch, int]:
    """Pack whole documents; the number of sequences made so far keeps ids apart."""
    parts = [(i, s, n) for i, (_, ids) in enumerate(held) for s, n in cut(len(ids), tiers[0])]
    sequences = pack([n for _, _, n in parts], tiers)
    steps = balance([sum(n for _, _, n in s) for s in sequences], tiers[0])
    base, rows = (part << 36) + made, []
    for i, sequence in enumerate(sequences):
        at = 0
        for k, skip, n in sequence:
            doc, start, _ = parts[k]
            doc_id, ids = held[doc]
            rows.append((doc_id, start + skip, n, zlib.crc32(ids[start + skip : start + skip + n].tobytes()), len(ids),
                         base + i, at, base + steps[i]))
            at += n
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "step_id"]
    arrays = [pa.array(c, kind if n == "doc_id" else pa.int64()) for n, c in zip(columns, zip(*rows))]
    return pa.RecordBatch.from_arrays(arrays, names=columns), made + len(sequences)
