"""A5, A10 over many runs: how many keys differ in any of them, and what a run changed.

A run keeps one sketch for each feature: a fixed-size sample of the hashes of the keys that differ, with
the share it stands for. Sketches of runs are united, intersected and subtracted, so questions
about several runs read a few numbers a feature, not the differences again. Up to `2 ** LOG_SIZE`
keys the answers are exact; beyond that their relative error is about `1 / sqrt(2 ** LOG_SIZE)` of the union.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import quote
from .compare import Comparison
from .skew import key_hash

LOG_SIZE = 16  # at most 512 KB a feature and run


def run_sketch(cmp: Comparison, run: str, log_size: int = LOG_SIZE) -> DataFrame:
    """One run as (run, feature, diff_count, keys): a row for each feature that differs. Sketches are
    merged within tasks first, so no feature's differences gather anywhere."""
    diffs = cmp.diffs().select(key_hash(cmp.key_names).alias("h"), "feature")
    sketch = F.expr(f"theta_sketch_agg(h, {log_size})").alias("keys")
    return diffs.groupBy("feature").agg(F.count(F.lit(1)).alias("diff_count"), sketch).select(F.lit(run).alias("run"), "feature", "diff_count", "keys")


def _size(sketch: Column | str) -> Column:
    return F.call_function("theta_sketch_estimate", sketch if isinstance(sketch, Column) else F.col(sketch))


def differing_keys(history: DataFrame, by: tuple[str, ...] = ("feature",), log_size: int = LOG_SIZE) -> DataFrame:
    """Distinct keys that differ in any of the runs: the `by` columns, runs and keys."""
    groups = [F.col(quote(b)) for b in by]
    united = F.expr(f"theta_union_agg(keys, {log_size})")
    return history.groupBy(*groups).agg(F.count_distinct("run").alias("runs"), _size(united).alias("keys"))


def run_changes(history: DataFrame, before: str, after: str) -> DataFrame:
    """Per feature the keys that differ in the later run alone, in the earlier alone, and in both."""
    side = lambda run, name: history.where(F.col("run") == run).select("feature", F.col("keys").alias(name))
    both = side(before, "old").join(side(after, "new"), "feature", "full")
    minus = lambda a, b: F.when(F.col(b).isNull(), _size(a)).otherwise(_size(F.call_function("theta_difference", F.col(a), F.col(b))))
    kept = F.when(F.col("old").isNotNull() & F.col("new").isNotNull(), _size(F.call_function("theta_intersection", F.col("old"), F.col("new"))))
    zero = F.lit(0).cast("bigint")
    return both.select(
        "feature", F.when(F.col("new").isNull(), zero).otherwise(minus("new", "old")).alias("appeared"),
        F.when(F.col("old").isNull(), zero).otherwise(minus("old", "new")).alias("gone"), F.coalesce(kept, zero).alias("stayed"))


__all__ = ["LOG_SIZE", "differing_keys", "run_changes", "run_sketch"]
