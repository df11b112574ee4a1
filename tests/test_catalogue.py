"""Stored catalogues, block digests, merges in one shuffle, exact quantiles, late rows."""

import datetime
import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from paritylake import SkewPolicy, compare
from paritylake import streaming as ST
from paritylake.operators import catalogue as C
from paritylake.operators import documents as D
from paritylake.operators import stats as S
from paritylake.operators.blocks import compare_by_blocks
from paritylake.operators.merge import merge_columns

BODIES = ['{"data":{"features":{"a":1,"b":null},"c":{"a":"x"}},"retCode":"0","x.y":true}', '{"data":{"features":{}},"a":[1,2],"z":{"a":2.0}}',
          '{"data":{"m":{"n":{"o":{"p":{"q":{"r":1}}}}}}}', '{"rows":[{"a":1},{"b":[{"c":2}]}],"e":{}}', "[]", "nope", '{"data":5}']


def docs_of(spark, bodies):
    return spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id int, body string").select("id", D.parse("body").alias("doc"))


@pytest.mark.parametrize("arrays", [False, True])
def test_catalogue_equals_discovery_and_merges(spark, arrays):
    docs = docs_of(spark, BODIES)
    found = C.catalogue(docs, "doc", arrays=arrays)
    bits = {tuple(r["path"]): r["kinds"] for r in found.collect()}
    seen = D.discover(docs, "doc", arrays=arrays)
    assert bits == {p: sum(C.KINDS[k] for k in kinds) for p, kinds in seen.kinds.items()}
    parts = [C.catalogue(docs.where(F.col("id") % 3 == i), "doc", arrays=arrays) for i in range(3)]
    merged = C.merge_catalogues(*parts)
    key = lambda r: (tuple(r["path"]), r["kinds"], r["values"])
    assert sorted(map(key, merged.collect())) == sorted(map(key, found.collect()))
    names = {r["name"]: r["path"] for r in C.path_table(found).collect()}
    assert names == {n: D.dotted_name(p) for n, p in D.path_names(seen).items()}
    counts = {}
    for p in D.feature_paths(seen):
        counts[D.names_of(p)[-1]] = counts.get(D.names_of(p)[-1], 0) + 1
    assert {r["field"]: r["paths"] for r in C.field_table(found).collect()} == counts
    with pytest.raises(ValueError, match="nested deeper"):
        C.catalogue(docs, "doc", depth=2, max_depth=3)


def test_long_cells(spark):
    rows = C.long_cells(docs_of(spark, BODIES), "doc", ["id"], arrays=True).collect()
    got = sorted((r["id"], r["path"], r["value"]) for r in rows if r["value"] is not None)
    assert got == sorted([(0, "data.features.a", "1"), (0, "data.c.a", "x"), (0, "retCode", "0"), (0, "x.y", "True"), (1, "data.features", "{}"), (1, "a", "[1,2]"), (1, "z.a", "2.0"),
                          (2, "data.m.n.o.p.q.r", "1"), (3, "rows.a", "1"), (3, "rows.b.c", "2"), (3, "e", "{}"), (4, "", "[]"), (6, "data", "5")])


def test_schema_diff_counts_values(spark):
    from paritylake.operators import keys as K

    a = spark.createDataFrame([(1, None, "x"), (2, 5, None)], "id int, f int, g string")
    b = spark.createDataFrame([(1, "y", 2)], "id int, g string, h int")
    got = {tuple(r) for r in K.schema_diff(a, b, ["f", "g"], ["g", "h"]).collect()}
    assert got == {("f", True, False, 1, None), ("g", True, True, 1, 1), ("h", False, True, None, 1)}


# -- C1 by blocks ---------------------------------------------------------------------------

@pytest.mark.parametrize("blocks, levels", [(4, 1), (8, 2), (1024, 2)])
def test_blocks_give_the_whole_comparison(spark, blocks, levels):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", None, "NaN"]), str(rng.random()), i * 3) for i in range(400)]
    other = [(i, a, b, c if i % 50 else c + 1) if i % 41 else (i, f" {a}", b, c) for i, a, b, c in rows if i % 37]
    left = spark.createDataFrame(rows + [(None, "k", "1", 1)], "k int, a string, b string, c int")
    right = spark.createDataFrame(other + [(9000, "new", "1", 1), (None, "k", "1", 1)], "k long, a string, b string, c long")
    for mode in ("table", "offline", "response"):
        options = {"mode": mode, "unique_lookup": True, "unique_driver": True}
        plain, by = compare(left, right, "k", **options), compare_by_blocks(left, right, "k", blocks=blocks, levels=levels, **options)
        rows_of = lambda df: sorted(map(repr, df.collect()))
        assert rows_of(by.stats()) == rows_of(plain.stats())
        assert rows_of(by.diffs()) == rows_of(plain.diffs())
        assert rows_of(by.changed.left_only()) == rows_of(plain.left_only()) and rows_of(by.changed.right_only()) == rows_of(plain.right_only())
    equal = compare_by_blocks(left, left, "k", blocks=blocks, levels=levels, unique_lookup=True, unique_driver=True)
    assert equal.changed.left.df.count() <= (401 if blocks < 9 else 160)  # rows with NaN are compared
    with pytest.raises(ValueError, match="unique_lookup"):
        compare_by_blocks(left, right, "k")
    with pytest.raises(ValueError, match="both sides"):
        compare_by_blocks(left, right.drop("c"), "k", unique_lookup=True, unique_driver=True)


def test_equal_blocks_are_not_joined(spark):
    left = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    right = left.withColumn("v", F.when(F.col("k") == 77, -1).otherwise(F.col("v")))
    by = compare_by_blocks(left, right, "k", unique_lookup=True, unique_driver=True)
    assert by.changed.left.df.count() < 5
    assert [tuple(r) for r in by.stats().collect()] == [("v", 20_000, 19_999, 1)]
    assert by.blocks.where("NOT alike").count() == 1 and by.blocks.agg(F.sum("left_rows")).first()[0] == 20_000


def test_stored_sides_are_not_shuffled(spark, tmp_path):
    from paritylake.sources import write_keyed

    left = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 9).alias("v"))
    right = left.withColumn("v", F.when(F.col("k") % 10 == 0, -1).otherwise(F.col("v")))
    sides = [write_keyed(df, f"side{i}", ["k"], buckets=4, path=str(tmp_path / f"s{i}")) for i, df in enumerate((left, right))]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cmp = compare(*sides, "k", skew=SkewPolicy(enabled=False), unique_lookup=True, unique_driver=True)
        plan = cmp.joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert [tuple(r) for r in cmp.stats().collect()] == [("v", 3000, 2700, 300)]
        repeated = compare(*sides, "k", skew=SkewPolicy(enabled=False))  # the last row per key needs none either
        assert "Exchange" not in repeated.joined._jdf.queryExecution().executedPlan().toString()
        assert [tuple(r) for r in repeated.stats().collect()] == [("v", 3000, 2700, 300)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE side0")
        spark.sql("DROP TABLE side1")


def test_sketches_of_runs(spark):
    from paritylake.operators import runs as R

    left = spark.range(6000).select(F.col("id").alias("k"), F.lit(1).alias("a"), F.lit("x").alias("b"))
    changed = lambda lo, hi: left.withColumn("a", F.when(F.col("k").between(lo, hi - 1), 2).otherwise(F.col("a")))
    runs = [R.run_sketch(compare(left, changed(lo, hi), "k"), name, log_size=size)
            for size in (12, 9) for name, lo, hi in (("one", 0, 2000), ("two", 1500, 2500), ("three", 0, 0))]
    exact, rough = runs[0].union(runs[1]).union(runs[2]), runs[3].union(runs[4])
    assert [tuple(r) for r in R.differing_keys(exact, log_size=12).collect()] == [("a", 2, 2500)]
    assert [tuple(r) for r in R.run_changes(exact, "one", "two").collect()] == [("a", 500, 1500, 500)]
    assert [tuple(r) for r in R.run_changes(exact, "one", "three").collect()] == [("a", 0, 2000, 0)]
    assert abs(R.differing_keys(rough, log_size=9).first()["keys"] - 2500) < 2500 * 4 / 512 ** 0.5


# -- M2 -------------------------------------------------------------------------------------

def plain_merge(tables, null_safe):
    """Full outer join of lists of (key, value)."""
    keys = {k for t in tables for k, _ in t if k is not None or null_safe}
    out = []
    for k in keys:
        out += [(k, *c) for c in product(*[[v for x, v in t if x == k] or [None] for t in tables])]
    if not null_safe:
        out += [(None, *[v if m == n else None for m in range(len(tables))]) for n, t in enumerate(tables) for k, v in t if k is None]
    return sorted(out, key=repr)


@pytest.mark.parametrize("null_safe", [False, True])
@pytest.mark.parametrize("share", [None, 0.02])
def test_merged_tables_equal_plain_products(spark, null_safe, share):
    rng = random.Random(6)
    for count in (2, 3, 5):
        tables = [[(rng.choice([1, 1, None, *range(30)]), f"{n}.{i}") for i in range(rng.choice((8, 25)) if n else 60)] for n in range(count)]
        if count > 2:  # few enough rows of the common key for its products
            tables = [[r for i, r in enumerate(t) if r[0] not in (1, None) or i < 8] for t in tables]
        dfs = [spark.createDataFrame(t, f"k long, v{n} string").repartition(3) for n, t in enumerate(tables)]
        out, removed = merge_columns(dfs, ["k"], null_safe=null_safe, skew=SkewPolicy(share=share))
        assert removed == [] and sorted(map(tuple, out.collect()), key=repr) == plain_merge(tables, null_safe)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") <= 1 and plan.count("LogicalRDD") + plan.count("Scan") <= count + 1  # the list of hot keys


# -- A8 -------------------------------------------------------------------------------------

def test_exact_quantiles(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(int(i >= 2000) if i % 2 else rng.randrange(2), rng.gauss(0, 1), float(10 ** rng.randrange(-300, 300)), None if i % 3 else i, rng.choice([0.0, -0.0])) for i in range(4000)]
    df = spark.createDataFrame(rows, "a int, b double, c double, d int, e double").repartition(5)
    cuts = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    for few, grid in ((10_000, 1000), (20, 50)):
        monkeypatch.setattr(S, "_FEW", few)
        monkeypatch.setattr(S, "_GRID", grid)
        got = S.exact_quantiles(df, ["a", "b", "c", "d", "e"], cuts)
        for i, c in enumerate("abcde"):
            x = sorted(float(r[i]) for r in rows if r[i] is not None)
            for p, v in zip(cuts, got[c]):
                at = p * (len(x) - 1)
                lo, hi = x[int(at)], x[min(int(at) + 1, len(x) - 1)]
                assert v == lo + (hi - lo) * (at - int(at)), (c, p, few)
    assert S.exact_quantiles(df.where("a < 0"), ["a"], [0.5]) == {"a": [None]}


# -- T2 -------------------------------------------------------------------------------------

@pytest.mark.parametrize("layout", [1, 3])
def test_on_time_and_late_rows_are_all_rows(spark, tmp_path, layout):
    start = datetime.datetime(2024, 1, 1)
    rng = random.Random(layout)
    batches = [[("f" if i % 3 else "g", start + datetime.timedelta(minutes=10 * n + rng.randint(-30, 9)), bool(i % 2)) for i in range(40)] for n in range(6)]
    batches[4].append(("f", None, True))
    schema, source, out = "feature string, at timestamp, is_match boolean", str(tmp_path / "in"), str(tmp_path / "out")
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(source)
        if (i + 1) % layout == 0:
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", layout).parquet(source)
            run = (stream.writeStream.foreachBatch(ST.split_batches(out, "at", "10 minutes", "5 minutes"))
                   .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
            run.awaitTermination()
    counts, late = {}, []
    mark = None
    for n in range(0, len(batches), layout):
        rows = [r for b in batches[n : n + layout] for r in b]
        for f, at, ok in rows:
            window = at and at.replace(minute=at.minute // 10 * 10, second=0)
            if at is None or (mark is not None and window + datetime.timedelta(minutes=10) <= mark):
                late.append((f, at, ok))
            else:
                c = counts.setdefault((window, f), [0, 0, 0])
                c[0] += 1
                c[1 if ok else 2] += 1
        mark = max(r[1] for b in batches[: n + layout] for r in b if r[1]) - datetime.timedelta(minutes=5)
    got = {(r["window"]["start"], r["feature"]): [r["total"], r["match"], r["mismatch"]] for r in ST.read_windows(spark, out).collect()}
    assert got == counts
    assert sorted(map(repr, ((r["feature"], r["at"], r["is_match"]) for r in ST.read_late(spark, out).collect()))) == sorted(map(repr, late))
    assert sum(c[0] for c in counts.values()) + len(late) == 241 and (layout > 1 or len(late) > 5)
    closed = {r["window"]["end"] for r in ST.read_windows(spark, out, "5 minutes").collect()}
    assert closed == {w + datetime.timedelta(minutes=10) for w, _ in counts if w + datetime.timedelta(minutes=10) <= mark}
    # a batch that is run again changes nothing
    again = spark.createDataFrame(batches[0], schema) if layout == 1 else spark.createDataFrame([r for b in batches[:layout] for r in b], schema)
    ST.split_batches(out, "at", "10 minutes", "5 minutes")(again, 0)
    assert {(r["window"]["start"], r["feature"]): [r["total"], r["match"], r["mismatch"]] for r in ST.read_windows(spark, out).collect()} == counts
