"""T1 with hot keys: what has been frequent so far is dealt out in the next batch.

A batch that first counted its own keys would read them twice before a row is joined. Here a
frequency sketch of fixed size is kept over all batches. The batch is joined by what the sketch knew when it
arrived: responses of hot keys are spread over the shuffle's partitions and the static rows of those keys
copied to each. Then the batch's keys are added. Sketches are merged, so what is kept does not grow
with the stream; a batch that is run again starts from the sketch of the batch before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import keys as K
from ..operators.skew import HotKeys, SkewPolicy, find_hot_keys, key_hash, salt_count
from .compare import stream_cells, stream_keys

_TRACKED = 10_000  # keys that the sketch follows


def _sketch_path(base: str, batch: int) -> str:
    return f"{base.rstrip('/')}/sketch/batch={batch}"


def known_hot_keys(keys: DataFrame, base: str, batch: int, policy: SkewPolicy) -> HotKeys:
    """The hot keys after the batches before this one; those of the first batch itself."""
    if batch == 0:
        return find_hot_keys(keys, keys.columns, policy)
    share = policy.share or 1 / salt_count(keys)
    kept = keys.sparkSession.read.parquet(_sketch_path(base, batch - 1))
    row = kept.select(F.expr(f"approx_top_k_estimate(sketch, {int(1 / share) + 1})").alias("top"), "n").first()
    return HotKeys(tuple(e["item"] for e in row["top"] or [] if e["item"] is not None and e["count"] >= max(row["n"] * share, 2)))


def add_keys(keys: DataFrame, base: str, batch: int) -> None:
    """Add a batch's keys to the running sketch."""
    hashes = keys.where(K.has_key(keys.columns)).select(key_hash(keys.columns).alias("h"))
    mine = hashes.agg(F.expr(f"approx_top_k_accumulate(h, {_TRACKED})").alias("sketch"), F.count(F.lit(1)).alias("n"))
    if batch:
        before = keys.sparkSession.read.parquet(_sketch_path(base, batch - 1))
        mine = mine.union(before.select("sketch", "n")).agg(F.expr(f"approx_top_k_combine(sketch, {_TRACKED})").alias("sketch"), F.sum("n").alias("n"))
    mine.write.mode("overwrite").parquet(_sketch_path(base, batch))


def balanced_batches(left: DataFrame, keys: Sequence[str], features: Sequence[str], base: str, *, policy: SkewPolicy = SkewPolicy(), **options):
    """A `foreachBatch` function: the differing cells of each batch (`compare_stream`) below
    `base`/diffs, joined with hot keys dealt out. Takes the options of `stream_cells`."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            k, scols, _ = stream_keys(batch, left, list(keys))
            seen = batch.select(*[c.alias(n) for c, n in zip(scols, k)])
            hot = known_hot_keys(seen, base, batch_id, policy)
            cells = stream_cells(batch, left, keys, features, hot=hot, **options)
            cells.where(~F.col("is_match")).drop("is_match").write.mode("overwrite").parquet(f"{base.rstrip('/')}/diffs/batch={batch_id}")
            add_keys(seen, base, batch_id)
        finally:
            batch.unpersist()

    return write
