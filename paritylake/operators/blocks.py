"""C1 on two versions of one large table: equal parts are told apart by digests and never joined.

Each side is read once for a digest of every block of keys: the number of its rows, and two sums over
their hashes that do not depend on their order. Blocks whose digests agree hold the same rows.
The others are split into as many blocks again, for which both sides' rows in unlike blocks are read
once more. Only rows of blocks that are unlike at the last level are shuffled and compared.

Equal rows match in every cell, but for NaN, which equals nothing: a row with such a cell
enters the digests of both sides differently. Keys must not repeat on either side
(declare `unique_lookup` and `unique_driver`), as the last of several rows depends on their order, and the
compared features must be on both sides. Rows without a key are never in an equal block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import keys as K
from .compare import Comparison, compare
from .stage import stored

BLOCKS, LEVELS = 1024, 2  # about a million blocks at the last level: a list of 8 MB at most


class BlockComparison:
    """Results of a comparison by blocks.

    stats()      as `Comparison.stats`, over all rows
    changed      the `Comparison` of the rows in unlike blocks: its diffs, diff_keys, left_only and
                 right_only are those of the whole tables
    blocks       (level, block, left_rows, right_rows, alike): equal blocks of every level, and what
                 is unlike at the last
    """

    def __init__(self, whole: Comparison, changed: Comparison, blocks: DataFrame):
        self.whole, self.changed, self.blocks = whole, changed, blocks

    def stats(self) -> DataFrame:
        alike = self.blocks.where("alike").agg(F.coalesce(F.sum("left_rows"), F.lit(0)).alias("alike"))
        return self.changed.stats().crossJoin(F.broadcast(alike)).select(
            "feature", (F.col("total") + F.col("alike")).alias("total"), (F.col("match") + F.col("alike")).alias("match"), "mismatch")

    def diffs(self) -> DataFrame:
        return self.changed.diffs()


def _key_hash(k: Sequence[str]) -> Column:
    return F.when(K.has_key(list(k)), F.xxhash64(*[F.col(c).cast("string") for c in k]))


def _row_hashes(cmp: Comparison, name: str) -> tuple[Column, Column]:
    side, at = cmp._side(name), 1 if name == "left" else 2
    cells = [side.column(f[at]).cast("string") for f in cmp.feature_positions]
    nan = F.lit(False)
    for c in cells:
        nan = nan | F.coalesce(F.lower(c).contains("nan"), F.lit(False))  # or a longer text: it is compared, too
    # a NULL adds nothing to a hash, so cells go in with their places
    row = F.struct(*[F.struct(F.lit(i), c) for i, c in enumerate([*[F.col(k).cast("string") for k in cmp._k], *cells])], F.when(nan, F.lit(name)))
    return F.xxhash64(F.lit(1), row), F.xxhash64(F.lit(2), row)


def _digests(rows: DataFrame, name: str) -> DataFrame:
    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    return rows.groupBy("block").agg(F.struct(F.count(F.lit(1)).alias("n"), wide("a").alias("a"), F.bit_xor("b").alias("b")).alias(name))


def compare_by_blocks(left: DataFrame, right: DataFrame, keys=None, *, blocks: int = BLOCKS, levels: int = LEVELS, **options) -> BlockComparison:
    """Compare two tables most of whose rows are equal; takes the options of `compare`."""
    if not (options.get("unique_lookup") and options.get("unique_driver")):
        raise ValueError("blocks need keys that do not repeat: declare unique_lookup and unique_driver")
    whole = compare(left, right, keys, **options)
    if any(f[1] is None or f[2] is None for f in whole.feature_positions):
        raise ValueError("blocks need features that both sides have: see common_only")
    sides = {}
    for name in ("left", "right"):
        a, b = _row_hashes(whole, name)
        rows = whole._keyed[name].withColumns({"__h": _key_hash(whole._k), "__a": a, "__b": b})
        sides[name] = rows
    settled, unlike = None, None
    for level in range(levels):
        told = []
        for name, rows in sides.items():
            rows = _within(rows.where("__h IS NOT NULL"), unlike, blocks, level)
            told.append(_digests(rows.select(_block(blocks, level + 1).alias("block"), F.col("__a").alias("a"), F.col("__b").alias("b")), name))
        both = told[0].join(told[1], "block", "full")
        same = F.coalesce(F.col("left") == F.col("right"), F.lit(False))
        n = lambda side: F.coalesce(F.col(f"{side}.n"), F.lit(0)).alias(f"{side}_rows")
        seen = stored(both.select(F.lit(level + 1).alias("level"), "block", n("left"), n("right"), same.alias("alike")), "block-digests")
        unlike = seen.where("NOT alike").select("block")
        alike = seen.where("alike")
        settled = alike if settled is None else settled.union(alike)
    parts = [_within(sides[name], unlike, blocks, levels, keyless=True).drop("__h", "__a", "__b") for name in ("left", "right")]
    changed = compare(whole.left.original(parts[0]), whole.right.original(parts[1]), keys, **options)
    return BlockComparison(whole, changed, settled.union(seen.where("NOT alike")))


def _block(blocks: int, level: int) -> Column:
    """The block of a key's hash at a level: numbers of earlier levels are its leading digits."""
    h = F.col("__h")
    if level == 0:
        return F.lit(0).cast("bigint")
    return F.pmod(h, F.lit(blocks**level).cast("bigint"))


def _within(rows: DataFrame, unlike: DataFrame | None, blocks: int, level: int, keyless: bool = False) -> DataFrame:
    """Rows of the unlike blocks of a level. Their list has at most blocks ** level numbers."""
    if unlike is None:
        return rows
    found = rows.join(F.broadcast(unlike.select(F.col("block").alias("__block"))), _block(blocks, level) == F.col("__block"), "left_semi")
    return found.union(rows.where("__h IS NULL")) if keyless else found


__all__ = ["BLOCKS", "LEVELS", "BlockComparison", "compare_by_blocks"]
