"""Removal of long byte strings that a document with a smaller id also holds.

A byte goes if a `LENGTH`-byte string over it starts in a document with a smaller id too.
Every such string holds an anchor: a `K`-byte string that is picked from it by its content
alone, so equal strings pick equal anchors. Consecutive strings with one anchor form a
stretch of 50 to 72 bytes. Three steps then decide every string of every document:

1. Blocks of texts list their stretches (anchor, hash of the stretch, least id), each once,
   and send them to the anchor's task. A stretch that a smaller id holds whole is removed.
2. A stretch that is the first of its kind, while its anchor also has others, may share a
   part with them. It goes with its bytes to the anchor's suffix sort: a mergesort of all
   its strings, whose comparisons find the common extension of two suffixes by binary search
   over prefix hashes. Neighbours that the hashes call equal are compared byte by byte; if a
   collision shows, the portion is sorted by its bytes instead.
3. Documents that took part in 2 get their spans back by row; all others are done after 1.

Hot anchors: a block names each stretch once however often it occurs, anchors whose cell in a
fixed-size count sketch lies far above the mean are dealt by stretch, and keys of the suffix
sort with over `split_above` rows are dealt by the strings themselves.

Null texts are empty; texts under 50 bytes lose nothing. Rows without an id come after all
ids. Rows of one id do not remove each other's bytes. Other columns are passed on.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each, freed, gathered, partitions, written
from .hashing import mix, prefixes, span_hash, window_hash

LENGTH, K, _T = 50, 28, 5
_W = LENGTH - K + 1  # anchors of a string start at one of so many places
BLOCK_BYTES, _PIECE_BYTES, _BLOCK_ROWS = 8 << 20, 1 << 18, 1 << 18  # a piece takes some 100 bytes of arrays per byte
_CELL_BITS, _SLICES = 20, 64
_LAST = 2**63 - 1


# -- stretches ------------------------------------------------------------------------

def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the least of every `width` consecutive values, by their upper 32 bits; of equal ones the first."""
    place = np.uint64(0xFFFFFFFF)
    best, have = (values & ~place) | np.arange(len(values), dtype=np.uint64), 1
    while have < width:
        step = min(have, width - have)
        best = np.minimum(best[: len(best) - step], best[step:])
        have += step
    return (best & place).astype(np.int64)


def stretches(data: np.ndarray, doc_end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of concatenated documents: start and end of each stretch, its anchor's and its own hash,
    and where its anchor stands in it.

    `doc_end` has for each byte the end of its document.
    """
    n = len(data) - LENGTH + 1
    none = np.empty(0, dtype=np.int64)
    if n <= 0:
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none
    p = prefixes(data)
    first = _least(mix(window_hash(p, _T)), LENGTH - _T + 1)[:n]
    start = np.arange(n, dtype=np.int64)
    anchor = start + (first - start) % _W
    valid = start + LENGTH <= doc_end[:n]
    new = np.empty(n, dtype=bool)
    new[0] = True
    new[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1] | (doc_end[1:n] != doc_end[: n - 1])
    begins = np.flatnonzero(new & valid)
    # a run ends before the next start of a run or the next invalid place
    stops = np.append(np.flatnonzero(new | ~valid), n)
    ends = stops[np.searchsorted(stops, begins, side="right")] - 1 + LENGTH
    a = anchor[begins]
    with np.errstate(over="ignore"):
        own = mix(span_hash(p, begins, ends) + (ends - begins).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return begins, ends, mix(span_hash(p, a, a + K)), own, a - begins


def _pieces(column: pa.ChunkedArray) -> Iterator[tuple[list[bytes], np.ndarray, tuple[np.ndarray, ...]]]:
    """Texts as bytes, some `_PIECE_BYTES` of whole ones at once, with their lengths and stretches."""

    def piece(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, tuple[np.ndarray, ...]]:
        lengths = np.array([len(t) for t in texts])
        return texts, lengths, stretches(np.frombuffer(b"".join(texts), dtype=np.uint8), np.repeat(np.cumsum(lengths), lengths))

    held, size = [], 0
    for t in each(column):
        raw = (t or "").encode("utf-8", "surrogatepass")
        if held and size + len(raw) > _PIECE_BYTES:
            yield piece(held)
            held, size = [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield piece(held)


def _joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
    """One array of several, which are let go."""
    out = np.concatenate(parts) if parts else np.empty(0, dtype=kind)
    parts.clear()
    return out


class Block:
    """Rows of one block: texts, ids (as sort keys) and stretches, the latter made in pieces."""

    def __init__(self, table: pa.Table, text: str = "text", key: str = "doc_id"):
        self.table = table
        self.ids = np.array([_LAST if i is None else i for i in table.column(key).to_pylist()], dtype=np.int64)
        self.texts: list[bytes] = []
        rows, starts, sizes, anchors, owns, mids = [], [], [], [], [], []
        for texts, lengths, (b, e, anchor, own, mid) in _pieces(table.column(text)):
            ends = np.cumsum(lengths)
            row = np.searchsorted(ends, b, side="right")
            rows.append((row + len(self.texts)).astype(np.int32))
            starts.append((b - (ends - lengths)[row]).astype(np.int64))
            sizes.append((e - b).astype(np.int16))
            anchors.append(anchor)
            owns.append(own)
            mids.append(mid.astype(np.int16))
            self.texts += texts
        self.row, self.start, self.size = _joined(rows, np.int32), _joined(starts, np.int64), _joined(sizes, np.int16)
        self.anchor, self.own, self.mid = _joined(anchors, np.uint64), _joined(owns, np.uint64), _joined(mids, np.int16)

    def entries(self, hot: np.ndarray, n_parts: int) -> tuple[np.ndarray, ...]:
        """Distinct stretches ordered by part, anchor, hash: part, anchor (high half), hash, least
        id, and for every stretch the number of its entry."""
        half = np.uint64(32)
        place = self.anchor >> half  # becomes part, anchor (high half)
        spread = hot[place >> np.uint64(32 - _CELL_BITS)]
        place |= np.where(spread, self.own, self.anchor & np.uint64(0xFFFFFFFF)) % np.uint64(n_parts) << half
        order = np.lexsort((self.own, place))
        place, s = place[order], self.own[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (place[1:] != place[:-1]) | (s[1:] != s[:-1])
        entry = np.empty(len(order), dtype=np.int32)
        entry[order] = np.cumsum(new, dtype=np.int32) - 1
        at = np.flatnonzero(new)
        place, s = place[at], s[at]
        low = np.minimum.reduceat(self.ids[self.row[order]], at) if len(at) else np.empty(0, dtype=np.int64)
        return (place >> half).astype(np.int32), place.astype(np.uint32), s, low, entry


def _blocks(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, np.ndarray]:
    """Texts gathered into blocks (block_id, body), and the counts of anchors by cell."""
    width = (1 << _CELL_BITS) // _SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, held, rows, size = TaskContext.get().partitionId(), 0, [], 0, 0
        counts = np.zeros(1 << _CELL_BITS, dtype=np.uint32)

        def out(made: int) -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(table)
            for _, _, (_, _, anchor, _, _) in _pieces(table.column(text)):
                np.add.at(counts, (anchor >> np.uint64(64 - _CELL_BITS)).astype(np.int64), 1)
            return pa.RecordBatch.from_pydict({"block_id": pa.array([(part << 24) + made], pa.int64()), "body": pa.array([sink.getvalue()], pa.binary()),
                                               "slice": pa.array([None], pa.int32()), "counts": pa.array([None], pa.binary())})

        for b in batches:
            lengths = np.array(pa.compute.fill_null(pa.compute.binary_length(b.column(text)), 0))
            lo = 0
            while lo < b.num_rows:
                fit = np.searchsorted(np.cumsum(lengths[lo:]), BLOCK_BYTES - size, side="right")
                hi = min(b.num_rows, lo + max(int(fit), 0 if rows else 1), lo + _BLOCK_ROWS - rows)
                if hi > lo:
                    held.append(b.slice(lo, hi - lo))
                    rows, size, lo = rows + hi - lo, size + int(lengths[lo:hi].sum()), hi
                if lo < b.num_rows:
                    yield out(made)
                    made, held, rows, size = made + 1, [], 0, 0
        if rows:
            yield out(made)
        if made or rows:
            n = _SLICES
            yield pa.RecordBatch.from_pydict({"block_id": pa.nulls(n, pa.int64()), "body": pa.nulls(n, pa.binary()), "slice": pa.array(range(n), pa.int32()),
                                              "counts": pa.array([counts[i * width : (i + 1) * width].tobytes() for i in range(n)], pa.binary())})

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, c in zip(b.column("slice").to_pylist(), b.column("counts").to_pylist()):
                sums[i] = sums.get(i, 0) + np.frombuffer(c, dtype=np.uint32).astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["slice", "counts"])

    both = written(docs.mapInArrow(freed(run), "block_id bigint, body binary, slice int, counts binary"), "dedup-blocks")
    slices = both.where("slice is not null").select("slice", "counts").repartition(min(_SLICES, partitions(docs.sparkSession)), "slice")
    cells = np.zeros(1 << _CELL_BITS, dtype=np.uint64)
    for r in slices.mapInArrow(freed(total), "slice int, counts binary").collect():  # a fixed 8 MB
        cells[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["counts"], dtype=np.uint64)
    return both.where("block_id is not null").select("block_id", "body"), cells


def _load(body: bytes, text: str, key: str) -> Block:
    return Block(pa.ipc.open_stream(pa.py_buffer(body)).read_all(), text, key)


def _squeeze(*arrays: np.ndarray) -> bytes:
    return pa.compress(b"".join(a.tobytes() for a in arrays), codec="zstd", asbytes=True)


def _ask(blocks: DataFrame, hot, n_parts: int, text: str, key: str) -> DataFrame:
    """(part, block_id, size, blob): the entries of a block for one part."""

    def of(block_id: int, body: pa.Buffer) -> pa.RecordBatch:  # a call a block, so that none of it stays while the next is made
        p, h, s, low, _ = _load(body, text, key).entries(hot.value, n_parts)
        cuts = np.append(np.flatnonzero(np.diff(p, prepend=-1)), len(p))
        rows = {"part": [], "block_id": [], "size": [], "blob": []}
        for lo, hi in zip(cuts, cuts[1:]):
            rows["part"].append(int(p[lo]))
            rows["block_id"].append(block_id)
            rows["size"].append(int(hi - lo))
            rows["blob"].append(_squeeze(np.diff(h[lo:hi], prepend=np.uint32(0)), s[lo:hi], low[lo:hi]))
        return pa.RecordBatch.from_pydict(rows, schema=pa.schema([("part", pa.int32()), ("block_id", pa.int64()), ("size", pa.int32()), ("blob", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block_id, body in zip(b.column("block_id").to_pylist(), b.column("body")):
                yield of(block_id, body.as_buffer())

    return blocks.mapInArrow(freed(run), "part int, block_id bigint, size int, blob binary")


def _answer(asked: DataFrame, hot) -> DataFrame:
    """(block_id, part, size, bits): for each entry whether a smaller id has the whole stretch,
    and whether its anchor has other stretches."""

    def judged(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        sizes = np.array([r[2] for r in rows])
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        h, s, low = np.empty(cuts[-1], np.uint32), np.empty(cuts[-1], np.uint64), np.empty(cuts[-1], np.int64)
        for (_, _, n, blob), at in zip(rows, cuts):
            raw = pa.decompress(blob, decompressed_size=20 * n, codec="zstd", asbytes=True)
            h[at : at + n] = np.cumsum(np.frombuffer(raw, np.uint32, n), dtype=np.uint32)
            s[at : at + n] = np.frombuffer(raw, np.uint64, n, 4 * n)
            low[at : at + n] = np.frombuffer(raw, np.int64, n, 12 * n)
        order = np.lexsort((s, h))
        hh, ss, ll = h[order], s[order], low[order]
        new_h = np.ones(len(order), dtype=bool)
        new_h[1:] = hh[1:] != hh[:-1]
        new_s = new_h.copy()
        new_s[1:] |= ss[1:] != ss[:-1]
        at_s = np.flatnonzero(new_s)
        group = np.cumsum(new_s) - 1
        full = np.empty(len(order), dtype=bool)
        full[order] = ll > np.minimum.reduceat(ll, at_s)[group]
        at_h = np.flatnonzero(new_h)
        kinds = np.add.reduceat(new_s.astype(np.int64), at_h)[np.cumsum(new_h) - 1]
        several = np.empty(len(order), dtype=bool)
        several[order] = (kinds > 1) | hot.value[hh >> np.uint32(32 - _CELL_BITS)]
        bits = [np.packbits(np.concatenate([full[a:b], several[a:b]])).tobytes() for a, b in zip(cuts, cuts[1:])]
        return pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.int32()),
                                           pa.array(sizes, pa.int32()), pa.array(bits, pa.binary())], names=["block_id", "part", "size", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("part", "block_id", "size", "blob"))):
                if held and held[-1][0] != row[0]:
                    yield judged(held)
                    held = []
                held.append(row)
        if held:
            yield judged(held)

    dealt = asked.repartition(partitions(asked.sparkSession), "part").sortWithinPartitions("part")
    return dealt.mapInArrow(freed(run), "block_id bigint, part int, size int, bits binary")


# -- spans ----------------------------------------------------------------------------

def merge_spans(spans: np.ndarray) -> np.ndarray:
    """Union of (start, end) rows as maximal, separate spans."""
    if len(spans) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > reach[:-1])
    at = np.flatnonzero(new)
    return np.column_stack([spans[at, 0], reach[np.append(at[1:], len(spans)) - 1]])


def cut_out(text: bytes, spans: np.ndarray) -> bytes:
    at, kept = 0, []
    for a, b in spans.tolist():
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return b"".join(kept)


def _digest(text: bytes, spans: np.ndarray) -> tuple:
    kept = cut_out(text, spans)
    return len(text), int((spans[:, 1] - spans[:, 0]).sum()) if len(spans) else 0, len(spans), hashlib.sha256(kept).hexdigest(), kept


_DIGEST = (("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()))
_NO_SPANS = np.empty((0, 2), dtype=np.int64)


def _settle(blocks: DataFrame, answers: DataFrame, hot, n_parts: int, schema, text: str, key: str, with_kept: bool) -> DataFrame:
    """Rows of three kinds: 0 a finished document, 1 one that waits for the suffix sort (with its
    text as `kept` and whole stretches as `spans`), 2 a stretch for the suffix sort."""
    by_block = answers.groupBy("block_id").agg(F.collect_list(F.struct("part", "size", "bits")).alias("bits"))
    joined = blocks.join(written(by_block, "answers"), "block_id", "left")
    names = [f.name for f in schema if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block_id, body, bits in zip(b.column("block_id").to_pylist(), b.column("body"), b.column("bits")):
                yield from _rows(block_id, *_judged(body.as_buffer(), bits.as_py()))

    def _judged(body: pa.Buffer, bits: list[dict] | None) -> tuple[Block, np.ndarray, np.ndarray]:
        block = _load(body, text, key)
        p, _, _, low, entry = block.entries(hot.value, n_parts)
        full, several = np.zeros(len(p), dtype=bool), np.zeros(len(p), dtype=bool)
        at = np.searchsorted(p, np.arange(n_parts + 1))
        for r in bits or []:
            got = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=2 * r["size"]).astype(bool)
            lo = at[r["part"]]
            full[lo : lo + r["size"]], several[lo : lo + r["size"]] = got[: r["size"]], got[r["size"] :]
        gone = full[entry] | (block.ids[block.row] > low[entry])
        return block, gone, ~gone & several[entry]

    def _rows(block_id: int, block: Block, gone: np.ndarray, asks: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = len(block.texts)
        bounds = np.searchsorted(block.row, np.arange(n + 1))
        waits = np.zeros(n, dtype=bool)
        waits[block.row[asks]] = True
        row_key = (block_id << 18) + np.arange(n)
        for lo in range(0, n, 1000):
            hi = min(n, lo + 1000)
            digests, spans = [], []
            for i in range(lo, hi):
                a, e = bounds[i], bounds[i + 1]
                g = np.flatnonzero(gone[a:e]) + a
                own = merge_spans(np.column_stack([block.start[g], block.start[g] + block.size[g]])) if len(g) else _NO_SPANS
                if waits[i]:
                    digests.append((None, None, None, None, block.texts[i]))
                    spans.append(own.astype(np.int64).tobytes())
                else:
                    d = _digest(block.texts[i], own)
                    digests.append(d if with_kept else (*d[:4], None))
                    spans.append(None)
            part = block.table.slice(lo, hi - lo).combine_chunks()
            columns = [part.column(c).combine_chunks() for c in names]
            columns += [pa.array(c, k) for c, (_, k) in zip(zip(*digests), _DIGEST)]
            columns += [pa.array(waits[lo:hi].astype(np.int32)), pa.array(row_key[lo:hi]), pa.array(spans, pa.binary()), *[pa.nulls(hi - lo, pa.int64())] * 4, pa.nulls(hi - lo, pa.binary())]
            yield _batch(columns)
        which = np.flatnonzero(asks)
        for lo in range(0, len(which), 50_000):
            w = which[lo : lo + 50_000]
            bytes_ = [block.texts[r][a : a + z] for r, a, z in zip(block.row[w], block.start[w], block.size[w])]
            columns = [pa.nulls(len(w), part_type) for part_type in (block.table.schema.field(c).type for c in names)] + [pa.nulls(len(w), k) for _, k in _DIGEST]
            columns += [pa.array(np.full(len(w), 2, dtype=np.int32)), pa.array(row_key[block.row[w]]), pa.nulls(len(w), pa.binary()),
                        pa.array(block.anchor[w].view(np.int64)), pa.array(block.ids[block.row[w]]), pa.array(block.start[w]), pa.array(block.mid[w].astype(np.int64)), pa.array(bytes_, pa.binary())]
            yield _batch(columns)

    def _batch(columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(columns, names=[*names, *(n for n, _ in _DIGEST), "kind", "row_key", "spans", "anchor", "doc_key", "start", "mid", "stretch"])

    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in schema if f.name != text)
    out = joined.mapInArrow(freed(run), f"{head}n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary, kind int, row_key bigint, "
                                 "spans binary, anchor bigint, doc_key bigint, start bigint, mid bigint, stretch binary")
    return written(out, "settled")


# -- suffix sort ----------------------------------------------------------------------

def common_extension(p: np.ndarray, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
    """Length of the longest common prefix, at most `most`, of the suffixes at i and j."""
    lo, hi = np.zeros(len(i), dtype=np.int64), np.full(len(i), most, dtype=np.int64)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi + 1) // 2
        same = span_hash(p, i, i + mid) == span_hash(p, j, j + mid)
        lo, hi = np.where(open_ & same, mid, lo), np.where(open_ & ~same, mid - 1, hi)


def _compared(data: np.ndarray, p: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 as the suffix at i sorts before, like or after that at j, over LENGTH bytes."""
    ext = common_extension(p, i, j, LENGTH)
    step = np.minimum(ext, LENGTH - 1)
    a, b = data[i + step], data[j + step]
    return np.where(ext < LENGTH, (a > b).astype(np.int8) - (a < b).astype(np.int8), 0).astype(np.int8)


def sort_suffixes(data: np.ndarray, suffix: np.ndarray, group: np.ndarray, p: np.ndarray | None = None) -> np.ndarray:
    """Order of suffixes (positions with LENGTH bytes after them) by group, then by their bytes.

    Groups stand together in the input. A bottom-up mergesort: at each width, all pairs of
    runs of all groups are merged at once, each element finding its rank in the other run by
    binary search. The common extension is searched for only where the hashes of all LENGTH
    bytes differ and the first eight bytes agree.
    """
    p = prefixes(data) if p is None else p
    order = np.arange(len(suffix))
    if not len(suffix):
        return order
    head = np.ascontiguousarray(data[suffix[:, None] + np.arange(8)]).view(">u8").ravel().astype(np.uint64)
    whole = span_hash(p, suffix, suffix + LENGTH)
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(np.append(starts, len(suffix)))
    base, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    width = 1
    while width < sizes.max():
        live = np.flatnonzero(size > width)  # members of groups that are not sorted yet
        b, n = base[live], size[live]
        local = live - b
        run = local // width
        left = run % 2 == 0
        other = b + np.minimum((run ^ 1) * width, n)
        other_end = b + np.minimum(((run ^ 1) + 1) * width, n)
        lo, hi = other.copy(), other_end.copy()
        at, heads, wholes = suffix[order], head[order], whole[order]
        act = np.flatnonzero(lo < hi)
        while len(act):
            mid, me = (lo[act] + hi[act]) // 2, live[act]
            mine, them = heads[me], heads[mid]
            unlike = wholes[me] != wholes[mid]
            sign = np.where(mine < them, np.int8(-1), np.int8(1)) * unlike
            tied = np.flatnonzero(unlike & (mine == them))
            sign[tied] = _compared(data, p, at[me[tied]], at[mid[tied]])
            # equal suffixes keep their order: those of the left run come first
            before = np.where(left[act], sign <= 0, sign < 0)
            hi[act] = np.where(before, mid, hi[act])
            lo[act] = np.where(before, lo[act], mid + 1)
            act = act[lo[act] < hi[act]]
        pair = b + (run // 2) * 2 * width
        place = pair + (local % width) + (lo - other)
        fresh = order.copy()
        fresh[place] = order[live]
        order, width = fresh, 2 * width
    return order


def repeated(stretch: list[bytes], key: np.ndarray, doc: np.ndarray, mid: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(number of the stretch, start, end) of the spans that a smaller id holds too, joined where they touch."""
    size = np.array([len(s) for s in stretch], dtype=np.int64)
    found = _repeated(np.frombuffer(b"".join(stretch), dtype=np.uint8), size, key, doc, mid)
    return list(zip(*(f.tolist() for f in found)))


def _repeated(data: np.ndarray, size: np.ndarray, key: np.ndarray, doc: np.ndarray, mid: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """The same of stretches that stand one after the other in `data`.

    Only strings of one key whose anchors stand at one place in them (`mid` of the stretch, less
    their start) can be equal, and only those whose hash another one has go into the sort.
    """
    at = np.cumsum(size) - size
    many = size - LENGTH + 1
    which = np.repeat(np.arange(len(size)), many)
    local = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    suffix = local + at[which]
    place = mid[which] - local if mid is not None else np.zeros(len(which), dtype=np.int64)
    p = prefixes(data)
    hashed = span_hash(p, suffix, suffix + LENGTH)
    with np.errstate(over="ignore"):
        mark = mix(hashed + mix(key.astype(np.int64).view(np.uint64))[which] + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(mark)
    same = mark[order[1:]] == mark[order[:-1]]
    live = order[np.append(same, False) | np.append(False, same)]
    if not len(live):
        return (np.empty(0, dtype=np.int64),) * 3
    together = lambda a, b: (key[which[a]] == key[which[b]]) & (place[a] == place[b])
    # in the order of the input within a group, so that the sort below has its work to do
    live = live[np.lexsort((live, place[live], key[which[live]]))]
    group = np.cumsum(np.append(False, ~together(live[1:], live[:-1])))
    order = sort_suffixes(data, suffix[live], group, p)
    rows = lambda o: data[suffix[live[o]][:, None] + np.arange(LENGTH)]
    bytes_ = rows(order)
    beside = np.append(False, group[order[1:]] == group[order[:-1]])
    equal = beside & np.append(False, (bytes_[1:] == bytes_[:-1]).all(axis=1))
    said = beside & np.append(False, hashed[live[order[1:]]] == hashed[live[order[:-1]]])
    if (equal != said).any():  # a collision: hashes are no order here
        order = np.array(sorted(range(len(live)), key=lambda i: (group[i], data[suffix[live[i]] : suffix[live[i]] + LENGTH].tobytes(), i)))
        bytes_ = rows(order)
        equal = np.append(False, group[order[1:]] == group[order[:-1]]) & np.append(False, (bytes_[1:] == bytes_[:-1]).all(axis=1))
    heads = np.flatnonzero(~equal)
    owner = doc[which[live[order]]]
    hit = live[order[owner > np.minimum.reduceat(owner, heads)[np.cumsum(~equal) - 1]]]
    hit = np.sort(hit)  # by stretch and start
    w, a = which[hit], local[hit]
    new = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (a[1:] > a[:-1] + LENGTH))) if len(hit) else np.empty(0, dtype=np.int64)
    return w[new], a[new], a[np.append(new[1:], len(hit)) - 1] + LENGTH if len(hit) else a


def _suffix_spans(settled: DataFrame, split_above: int, portion: int = 30_000) -> DataFrame:
    """(row_key, spans) found by the suffix sort, one row for each stretch with any."""
    rows = settled.where("kind = 2").select("anchor", "doc_key", "row_key", "start", "mid", "stretch")
    counts = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    big = written(counts.where(F.col("n") > split_above).select("anchor", F.lit(True).alias("big")), "big-anchors")
    marked = rows.join(big, "anchor", "left")
    whole = marked.where("big is null").select(F.col("anchor").alias("key"), "doc_key", "row_key", "start", "mid", "stretch")
    places = F.explode(F.sequence(F.lit(0), F.octet_length("stretch") - LENGTH)).alias("at")
    single = marked.where("big").select("doc_key", "row_key", "start", "stretch", places)
    single = single.select(F.substring("stretch", F.col("at") + 1, F.lit(LENGTH)).alias("string"), "doc_key", "row_key", (F.col("start") + F.col("at")).alias("start"))
    # strings of a split key: the least id of each is enough, so a common one cannot fill a task either
    least = written(gathered(single.groupBy("string").agg(F.min("doc_key").alias("least"), F.max("doc_key").alias("most")).where("least < most")), "split-strings")
    from_split = single.join(least, "string").where("doc_key > least").select("row_key", "start", (F.col("start") + LENGTH).alias("end"))

    def found(rows: pa.Table) -> pa.RecordBatch:
        key, doc, row_key, start, mid = (rows.column(c).to_numpy() for c in ("key", "doc_key", "row_key", "start", "mid"))
        body = rows.column("stretch").combine_chunks()
        body = body.chunk(0) if isinstance(body, pa.ChunkedArray) else body
        ends = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1].astype(np.int64)
        data = np.frombuffer(body.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        w, a, e = _repeated(data, np.diff(ends), key, doc, mid)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (row_key[w], start[w] + a, start[w] + e)], names=["row_key", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows > portion:
                table = pa.Table.from_batches(held)
                key = table.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
                if cut:
                    yield found(table.slice(0, cut))
                    held, rows = table.slice(cut).combine_chunks().to_batches(), len(key) - cut
        if held:
            yield found(pa.Table.from_batches(held))

    dealt = whole.repartition(partitions(settled.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(freed(run), "row_key bigint, start bigint, end bigint").unionByName(from_split)


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", with_kept: bool = False, split_above: int = 5000) -> DataFrame:
    """Every row's columns but the text, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes if asked for."""
    spark = docs.sparkSession
    own = {n for n, _ in _DIGEST} | {"kind", "row_key", "spans", "anchor", "doc_key", "start", "mid", "stretch"}
    names = [c for c in docs.columns if c not in own]
    src = docs.select(*[F.col(f"`{c}`").cast("string").alias(c) if c == text else F.col(f"`{c}`") for c in names])
    blocks, cells = _blocks(src, text, key)
    # a fixed 1 MB
    hot = spark.sparkContext.broadcast(cells > max(2000.0, 16 * float(cells.mean())))
    n_parts = 4 * partitions(spark)
    answers = _answer(_ask(blocks, hot, n_parts, text, key), hot)
    settled = _settle(blocks, answers, hot, n_parts, src.schema, text, key, with_kept)
    kept = [c for c in names if c != text] + [n for n, _ in _DIGEST]
    spans = _suffix_spans(settled, split_above)
    by_row = written(gathered(spans.groupBy("row_key").agg(F.collect_list(F.struct("start", "end")).alias("found"))), "suffix-spans")
    waiting = settled.where("kind = 1").select(*[f"`{c}`" for c in kept], "row_key", "spans").join(by_row, "row_key", "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(lo, 1000) for whole in batches for lo in range(0, whole.num_rows, 1000)):
            out = []
            for body, raw, found in zip(*(b.column(c).to_pylist() for c in ("kept", "spans", "found"))):
                spans = np.frombuffer(raw, np.int64).reshape(-1, 2)
                if found:
                    spans = np.concatenate([spans, np.array([(f["start"], f["end"]) for f in found], dtype=np.int64)])
                d = _digest(body, merge_spans(spans))
                out.append(d if with_kept else (*d[:4], None))
            columns = [b.column(c) for c in kept[: -len(_DIGEST)]] + [pa.array(c, k) for c, (_, k) in zip(zip(*out), _DIGEST)]
            yield pa.RecordBatch.from_arrays(columns, names=kept)

    done = settled.where("kind = 0").select(*[f"`{c}`" for c in kept])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in done.schema.fields)
    both = done.unionByName(waiting.mapInArrow(freed(finish), schema))
    return both if with_kept else both.drop("kept")
