"""N-gram Jaccard join by grouped prefixes.

A document is its set of distinct five-word shingles (64-bit hashes). All sets are put in
one order, rare shingles first, by a sketch of fixed size that counts shingles over the whole
corpus. Two sets with 100 * intersection >= 80 * union share a shingle of their prefixes,
and at its first one there are enough shingles left in both; so only those prefixes are
shuffled. Sets with the same prefix and size form one group and travel as one.

Not all pairs of a group or shingle are made. First every group member is verified against
the group's first member, and every group of a shingle against the leader of its size band
and of the bands beside it: the group that has the fewest shingles rarer than this one. Of a group's leaders
the one that looks nearest comes first. What these verified links do not already connect is verified and
linked too: the other leaders, and the pairs of sets that share a prefix shingle. No pair is tested whose parities in
1024 cells show that it differs in too many shingles. A pair left out lies within one component or is no
link, so no component is lost.

Null or blank texts have an empty set and no links. Texts of fewer than five words are one
shingle. Equal sets (repeated rows, exact copies) are one node, however many rows there are.
Rows without an id take part; columns other than id and text are ignored. Sets are told
apart by 128 bits, shingles by 64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import each, freed, gathered, partitions, written
from .graph import components
from .hashing import mix, prefixes, span_hash

N, SIMILAR = 5, (80, 100)
_CELL_BITS, _SLICES = 20, 64
_PARITIES = 1024
_PER_TASK = 500  # sets compared with one copy of a centre
_MOST_BITS = 29  # 64 MB
_SENT = 8_000_000  # bytes of sets in one batch


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    data = np.frombuffer(b" ".join(words), dtype=np.uint8)
    gaps = np.flatnonzero(data == 32)
    start, end = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])
    k = min(n, len(words))
    h = mix(span_hash(prefixes(data), start[: len(start) - k + 1], end[k - 1 :]))
    return np.unique(h)


def _name(found: np.ndarray) -> bytes | None:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None


def needed(size_a: Column, size_b: Column) -> Column:
    """The least intersection that links: 100 i >= 80 (a + b - i)."""
    return F.ceil((size_a + size_b) * SIMILAR[0] / (SIMILAR[0] + SIMILAR[1]))


def prefix_length(n: int) -> int:
    return n - -(-SIMILAR[0] * n // SIMILAR[1]) + 1


def parities(found: np.ndarray) -> np.ndarray:
    """A set as 16 numbers: of each of 1024 cells whether it holds an odd number of shingles. Two sets differ in
    at least as many shingles as cells."""
    cells = np.bincount((found & np.uint64(_PARITIES - 1)).astype(np.int64), minlength=_PARITIES) & 1
    return np.packbits(cells.astype(np.uint8)).view(np.int64)


def _unlike(a: str, b: str) -> Column:
    """Cells in which two sets (aliases or structs with n and bits) differ."""
    return sum((F.bit_count(F.col(f"{a}.bits")[i].bitwiseXOR(F.col(f"{b}.bits")[i])) for i in range(_PARITIES // 64)), F.lit(0))


def _may_link(a: str, b: str) -> Column:
    """Whether two sets differ in few enough cells."""
    return _unlike(a, b) <= F.col(f"{a}.n") + F.col(f"{b}.n") - 2 * needed(F.col(f"{a}.n"), F.col(f"{b}.n"))


def _alt() -> Column:
    """What tells rows without an id apart."""
    return F.when(F.col("doc_id").isNull(), F.xxhash64(F.col("text").cast("string"))).alias("alt")


def describe(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, alt, n, node) of every row, and the counts of the sketch's cells."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    src = docs.select("doc_id", _alt(), F.col("text").cast("string").alias("text"))
    width = (1 << _CELL_BITS) // _SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, id_type = np.zeros(1 << _CELL_BITS, dtype=np.uint32), set(), None
        names = ["doc_id", "alt", "n", "node", "slice", "counts"]
        for b in batches:
            id_type, sizes, nodes = b.schema.field("doc_id").type, [], []
            for t in each(b.column("text")):
                found = shingles(t)
                node = _name(found)
                sizes.append(len(found))
                nodes.append(node)
                if node is not None and node not in seen:
                    seen.add(node)
                    np.add.at(counts, (found >> np.uint64(64 - _CELL_BITS)).astype(np.int64), 1)
            none = pa.nulls(len(nodes))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("alt"), pa.array(sizes, pa.int32()), pa.array(nodes, pa.binary()),
                                              none.cast(pa.int32()), none.cast(pa.binary())], names=names)
        if id_type is not None:
            n = _SLICES
            yield pa.RecordBatch.from_arrays([pa.nulls(n, id_type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(range(n), pa.int32()),
                                              pa.array([counts[i * width : (i + 1) * width].tobytes() for i in range(n)], pa.binary())], names=names)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, c in zip(b.column("slice").to_pylist(), b.column("counts").to_pylist()):
                sums[i] = sums.get(i, 0) + np.frombuffer(c, dtype=np.uint32).astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["slice", "counts"])

    both = written(src.mapInArrow(freed(run), f"doc_id {kind}, alt bigint, n int, node binary, slice int, counts binary"), "shingle-sets")
    slices = both.where("slice is not null").select("slice", "counts").repartition(min(_SLICES, partitions(docs.sparkSession)), "slice")
    cells = np.zeros(1 << _CELL_BITS, dtype=np.uint64)
    for r in slices.mapInArrow(freed(total), "slice int, counts binary").collect():  # a fixed 8 MB
        cells[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["counts"], dtype=np.uint64)
    return both.where("slice is null").select("doc_id", "alt", "n", "node"), cells


def _prefix_rows(docs: DataFrame, cells: np.ndarray) -> DataFrame:
    """Rows (token, part, gid, n, pos, node, bits): the prefix shingles of each group, with node null, and
    one row for each member, with pos -1 and its parities. `part` is above -1 for shingles of cells far above
    the mean, whose rows are spread."""
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(cells, 2**32 - 1).astype(np.uint32))  # fixed size
    hot = max(2000.0, 16 * float(cells.mean()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, nodes, groups = shared.value, set(), set()
        names, kinds = ["token", "part", "gid", "n", "pos"], [np.int64, np.int32, np.int64, np.int32, np.int32]

        def batch(parts: list[tuple[np.ndarray, ...]], node: list[bytes] | None, bits: list[np.ndarray] | None) -> pa.RecordBatch:
            columns = [pa.array(np.concatenate([np.asarray(p[i], dtype=k) for p in parts])) for i, k in enumerate(kinds)]
            last = pa.array(node, pa.binary()) if node is not None else pa.nulls(len(columns[0]), pa.binary())
            cells = pa.array(bits, pa.list_(pa.int64())) if bits is not None else pa.nulls(len(columns[0]), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([*columns, last, cells], names=[*names, "node", "bits"])

        for b in batches:
            rows, members, member_nodes, member_bits, held = [], [], [], [], 0
            for t in each(b.column("text")):
                found = shingles(t)
                node = _name(found)
                if node is None or node in nodes:
                    continue
                nodes.add(node)
                n = len(found)
                count = cells[(found >> np.uint64(64 - _CELL_BITS)).astype(np.int64)]
                p = prefix_length(n)
                first = np.lexsort((found, count))[:p]
                token = found[first]
                gid = np.frombuffer(hashlib.blake2b(token.tobytes() + n.to_bytes(4, "little"), digest_size=8).digest(), dtype=np.int64)[0]
                members.append(([np.frombuffer(node[:8], dtype=np.int64)[0]], [-2], [gid], [n], [-1]))
                member_nodes.append(node)
                member_bits.append(parities(found))
                if gid in groups:
                    continue
                groups.add(gid)
                spread = np.where(count[first] > hot, int(gid) % np.ceil(count[first] / hot), -1)
                rows.append((token.view(np.int64), spread, np.full(p, gid), np.full(p, n), np.arange(p)))
                held += p
                if held > 200_000:
                    yield batch(rows, None, None)
                    rows, held = [], 0
            if rows:
                yield batch(rows, None, None)
            if members:
                yield batch(members, member_nodes, member_bits)

    src = docs.select(F.col("text").cast("string").alias("text"))
    return src.mapInArrow(freed(run), "token bigint, part int, gid bigint, n int, pos int, node binary, bits array<bigint>")


def _fits(n1: Column, p1: Column, n2: Column, p2: Column) -> Column:
    """Sizes within the ratio, and enough shingles left from the shared one on."""
    least = needed(n1, n2)
    return (F.least(n1, n2) >= least) & (F.least(n1 - p1, n2 - p2) >= least)


def _sift(rows: DataFrame, wanted: DataFrame, key: Column) -> DataFrame:
    """The rows whose key may be among the wanted ones (h): a bit for each of at most 2 ** _MOST_BITS
    cells tells, of which there are some 8 for each wanted key."""
    n_bits = 1 << min(max((8 * wanted.count()).bit_length(), 16), _MOST_BITS)
    width = n_bits // _SLICES

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            at, cell = b.column("slice").to_numpy(), b.column("cell").to_numpy()
            for i in np.unique(at).tolist():
                found.setdefault(i, np.zeros(width, dtype=bool))[cell[at == i]] = True
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([np.packbits(f).tobytes() for f in found.values()], pa.binary())], names=["slice", "bits"])

    cell = F.pmod(F.col("h"), F.lit(n_bits))
    cells = wanted.select((cell % _SLICES).cast("int").alias("slice"), F.floor(cell / _SLICES).cast("int").alias("cell")).distinct()
    cells = cells.repartition(min(_SLICES, partitions(rows.sparkSession)), "slice")
    bits = np.zeros((_SLICES, width // 8), dtype=np.uint8)
    for r in cells.mapInArrow(freed(gather), "slice int, bits binary").collect():  # at most 2 ** _MOST_BITS bits
        bits[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.mod(b.column("__h").to_numpy(), n_bits)
            place = at // _SLICES
            held = shared.value[at % _SLICES, place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1
            yield b.filter(pa.array(held.astype(bool)))

    return rows.withColumn("__h", key).mapInArrow(freed(run), rows.withColumn("__h", key).schema).drop("__h")


def verify(docs: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes with `linked`: the exact test on both sets.

    The set of each u is sent to v's task; a v with many partners is copied to as many tasks
    as it takes for about _PER_TASK sets each, up to one for every shuffle partition. A task holds
    one centre and reads the sets as a stream.
    """
    most = F.lit(partitions(docs.sparkSession))
    copies = F.least(F.ceil(F.count(F.lit(1)) / _PER_TASK), most).cast("int").alias("k")
    spread = written(gathered(pairs.groupBy("v").agg(copies)), "centres")
    goes = pairs.join(spread, "v").select(F.col("u").alias("node"), F.struct(F.col("v").alias("centre"), F.pmod(F.hash("u"), F.col("k")).alias("part"), F.lit(1).alias("role")).alias("go"))
    stays = spread.select(F.col("v").alias("node"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("part"), F.col("v").alias("centre")).select(
        "node", F.struct("centre", "part", F.lit(0).alias("role")).alias("go"))
    sent = goes.union(stays).groupBy("node").agg(F.collect_list("go").alias("goes"))
    owners = sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("__id"), F.min("alt").alias("__alt"))
    owners = owners.withColumn("__alt", F.when(F.col("__id").isNull(), F.col("__alt")))
    plan = written(gathered(sent.join(owners, "node").select("__id", "__alt", F.struct("node", "goes").alias("job")).groupBy("__id", "__alt").agg(F.collect_list("job").alias("jobs"))), "verify-plan")
    texts = docs.select("doc_id", _alt(), F.col("text").cast("string").alias("text"))
    mine = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("alt").eqNullSafe(F.col("__alt"))
    # only rows whose id is in the plan, and few others, are shuffled
    texts = _sift(texts, plan.select(F.xxhash64("__id", "__alt").alias("h")), F.xxhash64("doc_id", "alt"))
    texts = texts.join(plan, mine).select("text", "jobs")

    def sent(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["centre", "part", "role", "node", "found"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, held = [], 0
            for t, jobs in zip(each(b.column("text")), each(b.column("jobs"))):
                found = shingles(t)
                node, raw = _name(found), found.tobytes()
                for g in (g for j in jobs if j["node"] == node for g in j["goes"]):
                    out.append((g["centre"], g["part"], g["role"], node, raw))
                    held += len(raw)
                    if held > _SENT:
                        yield sent(out)
                        out, held = [], 0
            if out:
                yield sent(out)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = centre = None
        for b in batches:
            u, v, linked = [], [], []
            for c, p, role, node, raw in zip(*(b.column(i) for i in range(5))):
                found, at = np.frombuffer(raw.as_buffer(), dtype=np.uint64), (c.as_py(), p.as_py())
                if role.as_py() == 0:
                    key, centre = at, found.copy()
                elif key == at:
                    hits = np.searchsorted(centre, found)
                    same = int(np.count_nonzero(centre[np.minimum(hits, len(centre) - 1)] == found))
                    u.append(node.as_py())
                    v.append(at[0])
                    linked.append(SIMILAR[1] * same >= SIMILAR[0] * (len(centre) + len(found) - same))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary()), pa.array(linked, pa.bool_())], names=["u", "v", "linked"])

    moved = texts.mapInArrow(freed(send), "centre binary, part int, role int, node binary, found binary")
    dealt = moved.repartition(partitions(docs.sparkSession), "centre", "part").sortWithinPartitions("centre", "part", "role")
    return written(gathered(dealt.mapInArrow(freed(compare), "u binary, v binary, linked boolean").distinct()), "verified")


def links(docs: DataFrame, sets: DataFrame, cells: np.ndarray) -> DataFrame:
    """Verified links (u, v) whose components are those of all links."""
    rows = _prefix_rows(docs, cells).withColumn("band", F.when(F.col("pos") >= 0, F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25)))).otherwise(0).cast("int"))
    dealt = rows.repartition(partitions(docs.sparkSession), "token", "part")
    near = Window.partitionBy("token", "part").orderBy("band", "n", "gid", "node")
    # a shingle's leader: the group with the fewest rarer shingles is nearest to what all copies share
    leader = F.min(F.struct("pos", "n", "gid"))
    own_band, next_bands = Window.partitionBy("token", "part", "band"), Window.partitionBy("token", "part").orderBy("band").rangeBetween(-1, 1)
    # only shingles of several groups go on; part >= 0 may have its partner in another part
    marked = dealt.withColumns({
        "lead": F.lead("gid").over(near), "lag": F.lag("gid").over(near), "first": leader.over(own_band), "first_near": leader.over(next_bands),
        "groups": F.count(F.lit(1)).over(Window.partitionBy("token", "part")),
    })
    kept = written(marked.where("(pos < 0 AND lag IS NULL) OR (pos >= 0 AND (part >= 0 OR lead IS NOT NULL OR lag IS NOT NULL))").drop("lead", "lag"), "prefix-index")

    members = written(gathered(kept.where("pos < 0").groupBy("gid", "n", "node").agg(F.first("bits").alias("bits"))), "groups")
    heads = written(gathered(members.groupBy("gid", "n").agg(F.min("node").alias("head"), F.min_by("bits", "node").alias("bits"))), "heads")
    tokens = kept.where("pos >= 0").select("token", "part", "band", "gid", "n", "pos", "first", "first_near")
    # shingles dealt over parts have one leader for all of them, too
    parted = tokens.where("part >= 0")
    best = parted.groupBy("token", "band").agg(leader.alias("first"))
    around = best.select("token", F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)])).alias("band"), "first").groupBy("token", "band").agg(F.min("first").alias("first"))
    over_parts = written(gathered(best.union(around).distinct()), "leaders")
    led = tokens.select("gid", "n", "pos", F.explode(F.array("first", "first_near")).alias("first")).union(
        parted.select("token", "band", "gid", "n", "pos").join(over_parts, ["token", "band"]).select("gid", "n", "pos", "first"))

    of_head = F.struct("n", "bits", F.col("head").alias("node"))
    own = members.select("gid", "n", F.struct("n", "bits", "node").alias("a")).join(heads.select("gid", "n", of_head.alias("b")), ["gid", "n"])
    own = own.where((F.col("a.node") != F.col("b.node")) & _may_link("a", "b")).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
    star = led.where(_fits(F.col("n"), F.col("pos"), F.col("first.n"), F.col("first.pos")))
    grouped = star.select("gid", "n", F.col("first.gid").alias("gid2"), F.col("first.n").alias("n2")).where("NOT (gid = gid2 AND n = n2)").distinct()
    ends = grouped.join(heads.select("gid", "n", of_head.alias("a")), ["gid", "n"]).join(
        heads.select(F.col("gid").alias("gid2"), F.col("n").alias("n2"), of_head.alias("b")), ["gid2", "n2"])
    ends = ends.where((F.col("a.node") != F.col("b.node")) & _may_link("a", "b"))
    between = written(gathered(ends.select(F.col("a.node").alias("u"), F.col("b.node").alias("v"), _unlike("a", "b").alias("cells")).distinct()), "leader-pairs")
    # of a group's leaders the one that looks nearest first; most others are then in its component
    nearest = between.groupBy("u").agg(F.min(F.struct("cells", "v")).alias("best")).select("u", F.col("best.v").alias("v"))
    first = written(gathered(own.union(nearest).distinct()), "pairs")
    tested = verify(docs, sets, first)
    linked = tested.where("linked").select("u", "v")

    # what the links so far leave apart
    roots = components(linked)
    placed = written(members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("__"), "placed")
    mixed = placed.groupBy("gid", "n").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("gid", "n")
    same = placed.join(written(gathered(mixed), "mixed-groups"), ["gid", "n"])
    apart = F.col("a.root") < F.col("b.root")
    inner = same.alias("a").join(same.alias("b"), (F.col("a.gid") == F.col("b.gid")) & (F.col("a.n") == F.col("b.n")) & apart & _may_link("a", "b"))
    inner = inner.select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))

    at = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
    others = between.select("u", "v").join(at("u"), "u", "left").join(at("v"), "v", "left")
    others = others.where(F.coalesce("u_root", "u") != F.coalesce("v_root", "v")).select("u", "v")

    where = placed.select("gid", "n", "root").distinct()
    # of two groups one is the leader, so the pair of their heads is among the leader pairs: there is no other if both are single sets
    index = kept.where("pos >= 0").select("token", "part", "gid", "n", "pos", "groups")
    two = index.where("part < 0 AND groups <= 2")
    many = written(gathered(members.groupBy("gid", "n").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").select("gid", "n")), "groups-of-many")
    untested = written(gathered(two.join(many, ["gid", "n"]).select("token").distinct()), "untested-tokens")
    more = index.where("part >= 0 OR groups > 2").union(two.join(untested, "token", "left_semi").select(*index.columns))
    seen = written(more.select("token", "gid", "n", "pos").distinct().join(where, ["gid", "n"]), "token-roots")
    several = written(gathered(seen.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")), "mixed-tokens")
    # the sets of different components that share a shingle meet with their parities, and few pass
    left = seen.join(several, "token").join(placed.select("gid", "n", "root", "node", "bits"), ["gid", "n", "root"])
    left = written(left.select("token", "n", "pos", "root", "node", "bits"), "token-sets")
    fits = _fits(F.col("a.n"), F.col("a.pos"), F.col("b.n"), F.col("b.pos"))
    outer = left.alias("a").join(left.alias("b"), (F.col("a.token") == F.col("b.token")) & apart & fits & _may_link("a", "b"))
    outer = outer.select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
    done = tested.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    rest = inner.union(outer).union(others).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().join(done, ["u", "v"], "left_anti")
    rest = written(rest, "more-pairs")
    if rest.isEmpty():
        return linked
    return linked.union(verify(docs, sets, rest).where("linked").select("u", "v"))


def join(docs: DataFrame) -> DataFrame:
    """Every row: doc_id, n_shingles, component_id (the smallest id of its component)."""
    sets, cells = describe(docs)
    roots = components(links(docs, sets, cells))
    nodes = sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("low"))
    placed = written(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "roots")
    lowest = written(gathered(placed.groupBy("root").agg(F.min("low").alias("component"))), "lowest")
    # written, so that the join below sees two scans and may split a set with very many rows
    named = written(placed.join(lowest, "root").select("node", "component"), "components")
    out = sets.join(named, "node", "left")
    return out.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
