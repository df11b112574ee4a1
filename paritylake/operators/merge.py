"""Put tables together: rows, columns and side-by-side views (M1-M5)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import prod
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import quote
from . import keys as K
from .compare import Comparison, _positions, _Side
from .stage import shared_dir
from .skew import HotKeys, SkewPolicy, find_hot_keys, hot_rows, key_hash, lookup_join, salt_count


def merge_rows(dfs: Sequence[DataFrame], by_name: bool = False) -> DataFrame:
    """M1: rows of several tables under the first table's header.

    By position, all tables equally wide; or by name, missing columns NULL.
    """
    first, *rest = dfs
    out = first
    for df in rest:
        if by_name:
            out = out.unionByName(df, allowMissingColumns=True)
        else:
            if len(df.columns) != len(first.columns):
                raise ValueError(f"tables of {len(first.columns)} and {len(df.columns)} columns")
            out = out.union(df)
    return out


def merge_columns(
    dfs: Sequence[DataFrame], keys: Sequence[str] | None, *, coalesce_duplicates: bool = False,
    null_safe: bool = False, order_by: Sequence[Sequence[str]] | None = None, last_per_key: bool = False,
    skew: SkewPolicy = SkewPolicy(),
) -> tuple[DataFrame, list[str]]:
    """M2: columns of several tables side by side, matched by key (full outer), in one shuffle
    however many tables there are.

    Repeated non-key columns are dropped and the first copy kept, even where it is NULL
    unless `coalesce_duplicates`; the second result lists them. NULL keys match nothing
    unless `null_safe`. A key repeated in two tables gives all pairs of its rows; with
    `last_per_key` every table is first reduced to the last row of a key in its `order_by`.
    Without keys rows are matched by position (M3): `order_by` then
    gives each table's order, see `with_position`.
    """
    if not keys:
        return _merge_by_position(dfs, order_by)
    keys = list(keys)
    removed: list[str] = []
    if last_per_key:
        orders = order_by or [()] * len(dfs)
        dfs = [K.dedupe_last(df, keys, list(order)) for df, order in zip(dfs, orders)]
    seen = set(dfs[0].columns)
    places: list[list[str]] = [[c for c in dfs[0].columns if c not in keys]]
    again: list[list[str]] = [[]]
    for df in dfs[1:]:
        double = [c for c in df.columns if c in seen and c not in keys]
        removed += double
        again.append(double if coalesce_duplicates else [])
        places.append([c for c in df.columns if c not in seen and c not in keys])
        seen |= set(df.columns)
    return _merge_by_key(dfs, keys, places, again, null_safe, skew), removed


def _merge_by_key(dfs, keys, places, again, null_safe, policy) -> DataFrame:
    """Rows of all tables, tagged with their table, meet in one shuffle by key; a table's rows of
    the key are then set beside those of the others. Every table is read once in the plan.

    The inputs' keys are probed once, together. A hot key's rows are dealt over a grid with one axis for each
    table, as long as the table's rows of the key ask for: a row has one place on its own table's
    axis and is copied along the others, so every combination meets in one cell, and no cell
    gathers more than a fair share of a table. Rows whose key has a NULL meet no other.
    """
    types = dfs[0].select(*map(quote, keys))
    for df in dfs[1:]:
        types = types.union(df.select(*map(quote, keys)))
    fields = types.schema.fields
    k, t = [f"__k{i}" for i in range(len(keys))], [f"__t{n}" for n in range(len(dfs))]
    flags = [f"__f{i}" for i in range(len(keys))] if null_safe else []
    on = [*k, *flags]
    sides = []
    for df, place, twice, own in zip(dfs, places, again, t):
        cast = [F.col(quote(f.name)).cast(f.dataType) for f in fields]
        if null_safe:  # NULL as a value: a flag, and a key that is filled
            named = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for c, n in zip(cast, k)] + [c.isNull().alias(f) for c, f in zip(cast, flags)]
        else:
            named = [c.alias(n) for c, n in zip(cast, k)]
        row = [F.col(quote(c)) for c in (*place, *twice)] or [F.lit(True).alias("__row")]
        sides.append(df.select(*named, F.struct(*row).alias(own)))
    rows = None
    for n, (own, side) in enumerate(zip(t, sides)):
        laid = [F.col(c) if c == own else F.lit(None).cast(o.schema[c].dataType).alias(c) for c, o in zip(t, sides)]
        laid = side.select(*on, *laid, F.lit(n).alias("__n"), F.monotonically_increasing_id().alias("__row"))
        rows = laid if rows is None else rows.union(laid)
    # a row whose key has a NULL is a group of its own: its table and its place there
    rows = rows.withColumn("__lone", F.when(K.has_key(on), F.lit(-1)).otherwise(F.col("__n")))
    cell = F.when(F.col("__lone") >= 0, F.array("__row")).otherwise(F.array(F.lit(0).cast("bigint")))
    grids = _hot_grids(sides, on, policy)
    lists = [F.collect_list(c).alias(c) for c in t]
    if grids is None:
        met = rows.withColumn("__cell", F.explode(cell)).groupBy(*on, "__lone", "__cell").agg(*lists)
    else:
        dealt = rows.join(F.broadcast(grids), key_hash(on) == F.col("__h"), "left")
        size, step = F.col("__sizes")[F.col("__n")], F.col("__steps")[F.col("__n")]
        at = F.pmod(F.xxhash64("__row"), size) * step
        outer = F.sequence(F.lit(0).cast("bigint"), F.col("__cells") - 1, size * step)
        copies = F.flatten(F.transform(outer, lambda hi: F.transform(F.sequence(F.lit(0).cast("bigint"), step - 1), lambda lo: hi + at + lo)))
        dealt = dealt.withColumn("__cell", F.explode(F.when((F.col("__lone") < 0) & F.col("__h").isNotNull(), copies).otherwise(cell)))
        met = dealt.groupBy(*on, "__lone", "__cell").agg(*lists, F.first("__has").alias("__has"))
        # a cell that lacks a table whose rows are in other cells of the key
        lacks = [F.col("__has")[n] & (F.size(c) == 0) for n, c in enumerate(t)]
        met = met.where(~F.coalesce(reduce(or_, lacks), F.lit(False)))
    for c in t:
        met = met.withColumn(c, F.explode_outer(c))
    columns = []
    for n, place in enumerate(places):
        for c in place:
            copies = [F.col(f"{t[m]}.{quote(c)}") for m in range(n, len(dfs)) if m == n or c in again[m]]
            columns.append((F.coalesce(*copies) if len(copies) > 1 else copies[0]).alias(c))
    restored = [F.when(~F.col(f), F.col(c).cast(x.dataType)).alias(n) for c, f, x, n in zip(k, flags, fields, keys)]
    return met.select(*(restored or [F.col(c).alias(n) for c, n in zip(k, keys)]), *columns)


def _hot_grids(sides: list[DataFrame], on: list[str], policy: SkewPolicy) -> DataFrame | None:
    """One row for each hot key: the length and stride of every table's axis, the number of cells and
    which tables have the key. A hot key is one above a fair share of all rows, so there are
    at most as many as shuffle partitions; axes are sized by the tables' rows of the key."""
    probe = None
    for n, s in enumerate(sides):
        one = s.select(*on, F.lit(n).alias("__n"))
        probe = one if probe is None else probe.union(one)
    hot = find_hot_keys(probe, on, policy)
    if not hot.hashes:
        return None
    salts = salt_count(probe)
    many: dict[int, list[int]] = {}
    for r in probe.where(hot_rows(on, hot)).groupBy(key_hash(on).alias("h"), "__n").count().collect():
        many.setdefault(r["h"], [0] * len(sides))[r["__n"]] = r["count"]
    rows = []
    for h, counts in many.items():
        most = max(counts)
        sizes = [max(1, -(-salts * c // most) if c == most else min(salts, -(-salts * c // most))) for c in counts]
        steps = [prod(sizes[:n]) for n in range(len(sizes))]
        rows.append((h, sizes, steps, prod(sizes), [c > 0 for c in counts]))
    return probe.sparkSession.createDataFrame(rows, "__h bigint, __sizes array<bigint>, __steps array<bigint>, __cells bigint, __has array<boolean>")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder the cluster names in `spark.checkpoint.dir`."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def with_position(df: DataFrame, order_by: Sequence[str | Column], name: str = "position") -> DataFrame:
    """Add the 0-based rank of each row in a total order, without a single-task window.

    The sorted table is checkpointed; then each partition's first rank is the row count
    of the partitions before it. Costs a range shuffle and one write.
    """
    order = [c if isinstance(c, Column) else F.col(quote(c)) for c in order_by]
    tie = F.xxhash64(*[F.col(quote(c)) for c in df.columns])
    tagged = df.orderBy(*order, tie).select(
        "*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__seq")
    )
    kept = cut_lineage(tagged)
    # one row per partition from here on
    parts = kept.groupBy("__part").agg(F.min("__seq").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        "__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")
    )
    rank = (F.col("__start") + F.col("__seq") - F.col("__first")).alias(name)
    return kept.join(F.broadcast(starts), "__part").select(*[quote(c) for c in df.columns], rank)


def _merge_by_position(dfs, order_by) -> tuple[DataFrame, list[str]]:
    if order_by is None or len(order_by) != len(dfs):
        raise ValueError("merging by position needs an order for every table")
    removed: list[str] = []
    out = None
    for df, order in zip(dfs, order_by):
        ranked = with_position(df, order, "__position")
        if out is None:
            out = ranked
            continue
        double = [c for c in df.columns if c in set(out.columns)]
        removed += double
        out = out.join(ranked.drop(*double), "__position", "full")
    return out.drop("__position"), removed


def merged_view(
    left: DataFrame, right: DataFrame, keys=None, *, left_keys=None, right_keys=None,
    left_features: int | Sequence[K.Ref] | None = None, right_features: int | Sequence[K.Ref] | None = None,
    suffixes: tuple[str, str] = ("_left", "_right"), key_policy: str = "any", order_by=(),
    exclude: Sequence[str] = K.EXCLUDE_RESPONSE, fill_keys: bool = False, skew: SkewPolicy = SkewPolicy(),
    labels: tuple[dict[int, str], dict[int, str]] = ({}, {}),
) -> DataFrame:
    """M4: both tables in full, side by side.

    Left's other columns once, then every feature as a left/right pair: common ones
    sorted by name, left-only, right-only, and `time_now` last if either side has it.
    A left row takes the last right row of its key; right rows without a left row follow
    with empty left columns (`fill_keys=True` shows their key); rows without a key appear
    once, right ones not at all. `labels` renames features by position before they are paired.
    """
    l, r = _Side(left, "l"), _Side(right, "r")
    lk = K.resolve_all(l.names, left_keys if left_keys is not None else keys)
    rk = K.resolve_all(r.names, right_keys if right_keys is not None else keys)
    lf_all, rf_all = _positions(l, left_features, lk, ()), _positions(r, right_features, rk, ())
    lf = _positions(l, left_features, lk, exclude)
    lname = lambda i: labels[0].get(i, l.names[i])
    rname = lambda i: labels[1].get(i, r.names[i])
    shared = {lname(i) for i in lf_all}
    barred = {e.lower() for e in exclude}
    rf = [i for i in rf_all if r.names[i].lower() != "time_now"
          and not (r.names[i].lower() in barred and rname(i) in shared)]
    lpos = {lname(i): i for i in lf}
    rpos = {rname(i): i for i in rf}
    lnow = next((i for i in lf_all if l.names[i].lower() == "time_now"), None)
    rnow = next((i for i in rf_all if r.names[i].lower() == "time_now"), None)

    k = [f"k{i}" for i in range(len(lk))]
    lcols, rcols, _ = K.key_columns([l.field(i) for i in lk], [r.field(i) for i in rk], key_policy)
    lrows = l.df.select("*", *[c.alias(n) for c, n in zip(lcols, k)])
    rrows = r.df.select("*", *[c.alias(n) for c, n in zip(rcols, k)]).where(K.has_key(k))

    last = K.dedupe_last(rrows, k, [f"r{i}" for i in (K.resolve_all(r.names, order_by) if order_by else [])])
    lhot = find_hot_keys(lrows.select(*k), k, skew)
    rhot = find_hot_keys(rrows.select(*k), k, skew)
    matched = lookup_join(lrows, last, k, "left", lhot)
    lkeys = lrows.where(K.has_key(k)).select(*k).distinct()
    rest = lookup_join(rrows, lkeys, k, "left_anti", rhot)

    def cell(side: _Side, i: int | None, name: str, live: bool) -> Column:
        if i is None:
            return F.lit(None).cast("string").alias(name)
        return (side.column(i) if live else F.lit(None).cast(side.fields[i].dataType)).alias(name)

    def layout(l_live: bool, r_live: bool) -> list[Column]:
        cols = []
        for i, n in enumerate(l.names):
            if i in lf_all:
                continue
            if not l_live and fill_keys and i in lk:
                cols.append(F.col(k[lk.index(i)]).cast(l.fields[i].dataType).alias(n))
            else:
                cols.append(cell(l, i, n, l_live))
        pairs = [(n, lpos[n], rpos[n]) for n in sorted(lpos) if n in rpos]
        pairs += [(lname(i), i, None) for i in lf if lname(i) not in rpos]
        pairs += [(rname(i), None, i) for i in rf if rname(i) not in lpos]
        if lnow is not None or rnow is not None:
            pairs.append(("time_now", lnow, rnow))
        for n, li, ri in pairs:
            cols += [cell(l, li, n + suffixes[0], l_live), cell(r, ri, n + suffixes[1], r_live)]
        return cols

    return matched.select(*layout(True, True)).union(rest.select(*layout(False, True)))


def tagged_view(cmp: Comparison, sources: tuple[str, str] = ("left", "right")) -> DataFrame:
    """M5: the keyed rows of both tables on top of each other: keys, source, differs and
    the compared features as text."""
    k = cmp._k
    verdicts = cmp.diff_keys().toDF(*k).withColumn("__differs", F.lit(True))
    both = None
    for side, label in (("right", sources[1]), ("left", sources[0])):
        s = cmp._side(side)
        at = 1 if side == "left" else 2
        features = [
            (s.column(f[at]).cast("string") if f[at] is not None else F.lit(None).cast("string")).alias(f[0])
            for f in cmp.feature_positions
        ]
        rows = cmp._keyed[side].where(K.has_key(k)).select(*k, F.lit(label).alias("source"), *features)
        both = rows if both is None else both.union(rows)
    hot = HotKeys(tuple({*cmp._hot_driver.hashes, *cmp._hot_lookup.hashes}))
    found = lookup_join(both, verdicts, k, "left", hot)
    names = [f[0] for f in cmp.feature_positions]
    return found.select(*cmp._key_output(), "source", F.coalesce("__differs", F.lit(False)).alias("differs"), *map(quote, names))
