"""Streams over several batches."""

import random

from pyspark.sql import functions as F

from paritylake import SkewPolicy
from paritylake import streaming as ST
from paritylake.operators import documents as D
from paritylake.operators.skew import SALT, HotKeys, salted
from paritylake.streaming.balanced import add_keys, known_hot_keys


def batches_of(seed, count, size):
    rng = random.Random(seed)
    return [[(str(1 if rng.random() < 0.5 else rng.randrange(2, 500)), rng.randrange(3)) for _ in range(size)] for _ in range(count)]


def test_hot_keys_of_earlier_batches_are_dealt_out(spark, tmp_path):
    base, policy = str(tmp_path / "base"), SkewPolicy(share=0.1)
    found = []
    for n, rows in enumerate(batches_of(1, 4, 300)):
        lot = spark.createDataFrame([(k, i) for i, (k, _) in enumerate(rows)], "k string, i int")
        keys = lot.select("k")
        hot = known_hot_keys(keys, base, n, policy)
        add_keys(keys, base, n)
        found.append(hot)
        dealt = salted(lot, ["k"], hot, HotKeys(), 8).where("k = '1'")
        assert dealt.select(SALT).distinct().count() > 3
    assert all(len(h.hashes) == 1 for h in found) and len(set(found)) == 1
    calm = spark.createDataFrame([(str(i),) for i in range(4000)], "k string")
    add_keys(calm, base, 4)
    assert known_hot_keys(calm, base, 5, SkewPolicy(share=0.3)).hashes == ()


def test_balanced_batches_equal_one_comparison(spark, tmp_path):
    lots = batches_of(2, 5, 120)
    left = spark.createDataFrame([(str(i), str(i % 3)) for i in range(1, 400)] + [("1", "2")], "k string, f string")
    body = F.concat(F.lit('{"data":{"f":'), "v", F.lit("}}"))
    schema, source, base = "k string, body string", str(tmp_path / "in"), str(tmp_path / "out")
    all_rows = None
    for n, rows in enumerate(lots):
        part = spark.createDataFrame(rows, "k string, v int").select("k", body.alias("body"))
        part.coalesce(1).write.mode("append").parquet(source)
        all_rows = part if all_rows is None else all_rows.union(part)
    catalog = D.discover(all_rows.select(D.parse("body").alias("doc")), "doc")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    run = (stream.writeStream.foreachBatch(ST.balanced_batches(left, ["k"], ["f"], base, policy=SkewPolicy(share=0.05), catalog=catalog))
           .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    run.awaitTermination()
    got = spark.read.parquet(f"{base}/diffs")
    assert got.select("batch").distinct().count() == 5
    want = ST.compare_stream(all_rows, left, ["k"], ["f"], catalog=catalog)
    assert sorted(map(tuple, got.drop("batch").collect())) == sorted(map(tuple, want.collect()))


def test_errors_and_stats_over_several_batches(spark, tmp_path):
    schema, source, out = "k string, body string", str(tmp_path / "in"), str(tmp_path / "out")
    lots = [[("1", '{"f":1}'), ("2", "{bad")], [("3", '{"_error":"e"}')], [("1", '{"f":2}')], [("4", "[]"), ("2", '{"f":1}')]]
    left = spark.createDataFrame([("1", "1"), ("2", "1")], "k string, f string")
    for rows in lots:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        catalog = D.Catalog({D.keys_path("f"): frozenset({"plain"})})
        for name, table, mode in (("errors", ST.stream_errors(stream), "append"),
                                  ("stats", ST.stream_feature_stats(ST.stream_cells(stream, left, ["k"], ["f"], catalog=catalog)), "complete")):
            run = (table.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}"))
                   .trigger(availableNow=True).foreachBatch(ST.write_batches({name: lambda b: b}, out)).start())
            run.awaitTermination()
    errors = spark.read.parquet(f"{out}/errors")
    assert sorted((r["k"], r["error"]) for r in errors.collect()) == [("2", "response is no JSON object"), ("3", "e"), ("4", "response is no JSON object")]
    stats = spark.read.parquet(f"{out}/stats")
    last = stats.where(F.col("batch") == stats.agg(F.max("batch")).first()[0]).collect()
    assert [(r["feature"], r["total"], r["match"], r["mismatch"]) for r in last] == [("f", 3, 2, 1)]


def test_arriving_rows_are_not_taken_for_smaller_than_they_are(spark, tmp_path):
    rows = spark.range(4000).select(F.col("id").cast("string").alias("k"), F.concat(F.lit('{"f":'), F.col("id").cast("string"), F.lit("}")).alias("body"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    rows.select("k", F.md5("k").alias("f")).coalesce(1).write.parquet(str(tmp_path / "left"))
    size = sum(f.stat().st_size for f in (tmp_path / "in").glob("*.parquet"))
    catalog = D.Catalog({D.keys_path("f"): frozenset({"plain"})})
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size // 2)
    try:
        cells = ST.stream_cells(spark.read.parquet(str(tmp_path / "in")), spark.read.parquet(str(tmp_path / "left")), ["k"], ["f"], catalog=catalog)
        plan = cells._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
        assert cells.count() == 4000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
