"""Joins that stay balanced when one key holds a large share of the rows.

`find_hot_keys` reads only the key columns and keeps a fixed-size frequency sketch per
task, so its result is a short list whatever the table size. `lookup_join` then
spreads the rows of those keys over many partitions and copies the (at most one)
matching lookup row to each of them. Every other key joins on the key alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import quote

SALT = "__salt"
_TRACKED = (10_000, 1_000_000)  # least and most entries of the sketch


@dataclass(frozen=True)
class HotKeys:
    """Hashes of frequent keys, and whether key-less rows are frequent too."""

    hashes: tuple[int, ...] = ()
    spread_nulls: bool = False

    def __bool__(self) -> bool:
        return bool(self.hashes) or self.spread_nulls


@dataclass(frozen=True)
class SkewPolicy:
    """When keys are split. A key is hot above `share` of the rows: by default above what one
    shuffle partition would get if all were equal. `enabled=False` never looks."""

    enabled: bool = True
    share: float | None = None


def find_hot_keys(df: DataFrame, keys: list[str], policy: SkewPolicy) -> HotKeys:
    """All keys above the policy's share. There are at most 1/share of them, and the sketch keeps
    20 entries for each, so none is missed."""
    if not policy.enabled:
        return HotKeys()
    share = policy.share or 1 / salt_count(df)
    listed = int(1 / share) + 1
    tracked = max(listed, min(max(20 * listed, _TRACKED[0]), _TRACKED[1]))
    row = (
        df.select(F.when(_has_key(keys), key_hash(keys)).alias("h"))
        .agg(
            F.expr(f"approx_top_k(h, {listed}, {tracked})").alias("top"),
            F.count("h").alias("keyed"),
            F.count(F.lit(1)).alias("n"),
        )
        .first()
    )
    floor = max(row["n"] * share, 2)
    hashes = tuple(e["item"] for e in (row["top"] or []) if e["item"] is not None and e["count"] >= floor)
    return HotKeys(hashes, row["n"] - row["keyed"] >= floor)


def key_hash(keys: list[str]) -> Column:
    return F.xxhash64(*[F.col(quote(k)) for k in keys])


def _has_key(keys: list[str]) -> Column:
    cond = F.col(quote(keys[0])).isNotNull()
    for k in keys[1:]:
        cond = cond & F.col(quote(k)).isNotNull()
    return cond


def _is_hot(keys: list[str], hot: HotKeys) -> Column:
    if not hot.hashes:
        return F.lit(False)
    return F.coalesce(key_hash(keys).isin(*hot.hashes), F.lit(False))


def hot_rows(keys: list[str], hot: HotKeys) -> Column:
    """Whether a row's key is hot."""
    return _is_hot(keys, hot)


def salt_count(df: DataFrame) -> int:
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def own_salt(df: DataFrame, salts: int) -> Column:
    """A salt from the whole row and its partition: the same when a task is run again, and
    spread out even where a shuffle has gathered a key. Only equal rows of one partition
    share it."""
    plain = [F.col(quote(f.name)) for f in df.schema.fields if not _unhashable(f.dataType)]
    return F.pmod(F.xxhash64(F.spark_partition_id(), *plain), F.lit(salts)).cast("int")


def _unhashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_unhashable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _unhashable(kind.elementType)
    return isinstance(kind, (T.MapType, T.VariantType))


def salted(df: DataFrame, keys: list[str], own: HotKeys, copied: HotKeys, salts: int) -> DataFrame:
    """Add a salt: rows of `own` hot keys (and key-less rows, where those are many) get one of
    their own, rows of `copied` ones are repeated for every salt, the rest get 0."""
    dealt = _is_hot(keys, own)
    if own.spread_nulls:
        dealt = dealt | ~_has_key(keys)
    if not copied.hashes:
        return df.withColumn(SALT, F.when(dealt, own_salt(df, salts)).otherwise(F.lit(0)))
    places = (
        F.when(_is_hot(keys, copied), F.sequence(F.lit(0), F.lit(salts - 1)))
        .when(dealt, F.array(own_salt(df, salts))).otherwise(F.array(F.lit(0)))
    )
    return df.withColumn(SALT, F.explode(places))


def lookup_join(
    driver: DataFrame, lookup: DataFrame, keys: list[str], how: str, hot: HotKeys
) -> DataFrame:
    """Join a driver side of any key distribution to a side with one row per key.

    `how`: inner, left, left_semi or left_anti.
    """
    if not hot or (how in ("inner", "left_semi") and not hot.hashes):
        return driver.join(lookup, keys, how)
    salts = salt_count(driver)
    dealt = salted(driver, keys, hot, HotKeys(), salts)
    copies = salted(lookup, keys, HotKeys(), hot, salts)
    return dealt.join(copies, [*keys, SALT], how).drop(SALT)
