"""Files, merges, reports, scenarios, streams."""

import os

import pytest
from pyspark.sql import functions as F

from paritylake import SkewPolicy, compare
from paritylake import streaming as ST
from paritylake.operators import documents as D
from paritylake.operators.merge import merge_columns, merge_rows, merged_view, with_position
from paritylake.operators.reconcile import decimal_reconcile
from paritylake.operators.skew import HotKeys, find_hot_keys, salted
from paritylake.plans.scenarios import outcome_counts, run_scenarios
from paritylake.sources import (
    csv_health, preview, read_responses, read_table, records_to_table, rejected_responses, write_reports, write_table,
)

ALWAYS = SkewPolicy(share=0.05)


def write(path, text, encoding="utf-8"):
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(text)
    return str(path)


def test_csv_dialect(spark, tmp_path):
    p = write(tmp_path / "a.csv", 'k,a,A\r\n1,"x, ""q""\nline",y\r\n2,short\r\n3,1,2,extra\r\n')
    df = read_table(spark, p, multi_line=True)
    assert df.columns == ["k", "a", "A"]
    assert sorted(map(tuple, df.collect())) == [("1", 'x, "q"\nline', "y"), ("2", "short", None), ("3", "1", "2")]
    health = csv_health(spark, p, multi_line=True).first()
    assert (health["rows"], health["header_width"], health["bad_rows"]) == (3, 3, 2)
    bom = write(tmp_path / "b.csv", "k,a\n1,2\n", "utf-8-sig")
    assert read_table(spark, bom).columns == ["k", "a"]
    with pytest.raises(ValueError):
        read_table(spark, write(tmp_path / "c.csv", "a,a\n1,2\n"))
    with pytest.raises(ValueError):
        read_table(spark, write(tmp_path / "d.csv", ""))


def test_files_with_their_own_headers(spark, tmp_path):
    write(tmp_path / "1.csv", "id,x,y\n1,10,20\n")
    write(tmp_path / "2.csv", "id,y,x\n2,200,100\n")
    write(tmp_path / "3.csv", 'id,"z,z"\n3,5\n4\n')
    with pytest.raises(Exception, match="(?i)header"):
        read_table(spark, str(tmp_path)).collect()
    got = read_table(spark, str(tmp_path), by_name=True).select("id", "x", "y", "`z,z`")
    assert sorted(map(tuple, got.collect())) == [("1", "10", "20", None), ("2", "100", "200", None), ("3", None, None, "5"), ("4", None, None, None)]
    health = {r["file"][-5:]: (r["rows"], r["header_width"], r["bad_rows"]) for r in csv_health(spark, str(tmp_path)).collect()}
    assert health == {"1.csv": (1, 3, 0), "2.csv": (1, 3, 0), "3.csv": (2, 2, 1)}


def test_nothing_is_lost_from_response_files(spark, tmp_path):
    write(tmp_path / "a.json", '[{"a":1},{"a":NaN,"b":-Infinity}]')
    write(tmp_path / "b.json", '{"a":1,"a":2}')
    write(tmp_path / "c.json", '{"a":')
    write(tmp_path / "d.json", " \n")
    write(tmp_path / "e.json", '[5, {"a":3}]')
    docs = read_responses(spark, str(tmp_path))
    assert sorted(r["body"] for r in docs.collect()) == ['5', '{"a":"NaN","b":"-Infinity"}', '{"a":1}', '{"a":2}', '{"a":3}']
    bad = {(os.path.basename(r["file"]), r["position"], r["reason"]) for r in rejected_responses(spark, str(tmp_path)).collect()}
    assert bad == {("c.json", None, "invalid"), ("d.json", None, "empty"), ("e.json", 0, "not_object")}


def test_response_file_above_the_limit_of_a_document(spark, tmp_path):
    with open(tmp_path / "big.json", "w") as f:
        f.write("[" + ",".join(f'{{"id":{i},"data":"{"x" * 960}"}}' for i in range(140_000)) + "]")
    assert read_responses(spark, str(tmp_path)).count() == 140_000


def test_last_row_of_the_file_wins(spark, tmp_path):
    lines = "".join(f"{i % 7},{i}\n" for i in range(5000))
    left = read_table(spark, write(tmp_path / "l.csv", "k,v\n" + lines), row_order=True, multi_line=False)
    right = spark.createDataFrame([(str(k), str(max(i for i in range(5000) if i % 7 == k))) for k in range(7)], "k string, v string")
    cmp = compare(left, right, "k", order_by=["_row_order"])
    assert cmp.features == ["v"]
    assert [tuple(r) for r in cmp.stats().collect()] == [("v", 7, 7, 0)]


def test_responses_and_records(spark, tmp_path):
    write(tmp_path / "one.json", '{"b":1,"a":{"x":2}}')
    write(tmp_path / "many.json", '[{"c":true},\n {"a":1}, 5]')
    docs = read_responses(spark, str(tmp_path))
    assert sorted(r["body"] for r in docs.collect()) == ['5', '{"a":1}', '{"a":{"x":2},"b":1}', '{"c":true}']
    lines = write(tmp_path / "l.jsonl", '{"b":1,"a":"x"}\n{"c":2,"b":null}\n')
    table = records_to_table(read_responses(spark, lines, lines=True), "body", order_by="position")
    assert table.columns == ["b", "a", "c"]
    assert sorted(map(repr, table.collect())) == sorted(["Row(b='1', a='x', c=None)", "Row(b=None, a=None, c='2')"])
    assert preview(table, 1).count() == 1


def test_merge_rows_and_columns(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    b = spark.createDataFrame([(2, "y")], "q int, w string")
    assert merge_rows([a, b]).columns == ["k", "v"]
    assert merge_rows([a, b], by_name=True).columns == ["k", "v", "q", "w"]
    with pytest.raises(ValueError):
        merge_rows([a, b.select("q")])
    left = spark.createDataFrame([(1, "a", None), (None, "n", "l"), (2, "b", "l")], "k int, v string, d string")
    right = spark.createDataFrame([(1, "R", "c"), (None, "N", "m"), (3, "R", "z")], "k int, d string, w string")
    out, removed = merge_columns([left, right], ["k"])
    assert removed == ["d"] and out.count() == 5 and out.where("k = 1").first()["d"] is None
    filled, _ = merge_columns([left, right], ["k"], coalesce_duplicates=True, null_safe=True)
    rows = {r["k"]: r for r in filled.collect()}
    assert len(rows) == 4 and rows[1]["d"] == "R" and rows[None]["w"] == "m" and rows[None]["d"] == "l"


def test_hot_key_spreads_after_a_shuffle_on_it(spark):
    df = spark.range(80_000).select(F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    gathered = df.repartition(8, "k")
    hot = find_hot_keys(gathered, ["k"], SkewPolicy())
    salts = {r["__salt"]: r["count"] for r in salted(gathered, ["k"], hot, HotKeys(), 8).where("k = 1").groupBy("__salt").count().collect()}
    assert len(salts) == 8 and max(salts.values()) < 2 * 40_000 / 8


def test_many_merged_tables_are_read_once(spark, tmp_path):
    tables = []
    for n in range(6):
        spark.range(400).select(F.when(F.col("id") % 2 == n % 2, F.lit(1)).otherwise(F.col("id")).alias("k"), F.col("id").alias(f"a.{n}")).where(
            f"k <> 1 OR id < {2 if n else 400}").write.parquet(f"{tmp_path}/{n}")
        tables.append(spark.read.parquet(f"{tmp_path}/{n}"))
    out, _ = merge_columns(tables, ["k"], skew=ALWAYS)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 6
    plain, _ = merge_columns(tables, ["k"], skew=SkewPolicy(enabled=False))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    last, _ = merge_columns(tables[:2], ["k"], last_per_key=True, order_by=[["a.0"], ["a.1"]])
    assert last.count() == last.select("k").distinct().count()


def test_merged_report_follows_the_comparison(spark, tmp_path):
    left = spark.createDataFrame([(1, "a", "z")], "id int, f string, name string")
    right = spark.createDataFrame([(1, "old", 1), (1, "newest", 2), (2, "b", 3)], "id int, x_f string, pos int")
    cmp = compare(left, right, "id", mode="offline", left_features=["f"], right_features=["x_f"], rename="left", prefix="x_", order_by=["pos"])
    paths = write_reports(cmp, str(tmp_path / "r"), full=True)
    merged = spark.read.parquet(paths["merged"])
    assert {"x_f_left", "x_f_right"} <= set(merged.columns) and not {"pos_right", "f_right"} & set(merged.columns)
    assert merged.where("id = 1").first()["x_f_right"] == "newest"
    assert "left_only" not in paths and not os.path.exists(tmp_path / "r" / "left_only")


def test_full_join_with_hot_keys(spark):
    a = spark.range(600).select(F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("a"))
    a = a.withColumn("k", F.when(F.col("a") % 10 != 3, F.col("k"))).repartition(5)
    b = spark.range(900, 1300).select((F.col("id") - 800).alias("k"), F.col("id").alias("b"))
    b = b.union(spark.createDataFrame([(1, 0), (None, -1)], "k long, b long"))
    for l, r in ((a, b), (b, a)):
        want = sorted(map(repr, l.join(r, ["k"], "full").collect()))
        got, _ = merge_columns([l, r], ["k"], skew=ALWAYS)
        assert sorted(map(repr, got.collect())) == want


def test_positions(spark):
    a = spark.range(100).select(F.col("id").alias("a")).repartition(6)
    ranked = with_position(a, [F.desc("a")])
    assert all(r["position"] == 99 - r["a"] for r in ranked.collect())
    b = spark.range(103).select((F.col("id") * 2).alias("b"), F.lit(1).alias("a"))
    out, removed = merge_columns([a, b], None, order_by=[["a"], ["b"]])
    assert removed == ["a"] and out.count() == 103
    assert all(r["a"] is None or r["b"] == 2 * r["a"] for r in out.collect())


def test_merged_view(spark):
    left = spark.createDataFrame([("1", "n1", "a", "l", "t1"), (" 1", "n2", "b", "l", "t2"), ("", "n3", "c", "l", "t3"), ("2", "n4", "d", "l", "t4")],
                                 "id string, note string, f string, only_l string, time_now string")
    right = spark.createDataFrame([("1", "x", "r", 1), ("1", "y", "r", 2), ("3", "z", "r", 3), ("3", "w", "r", 4), (None, "v", "r", 5)],
                                  "id string, f string, only_r string, pos int")
    for skew in (SkewPolicy(), ALWAYS):
        view = merged_view(left, right, "id", left_features=2, right_features=["f", "only_r"], order_by=["pos"], skew=skew)
        assert view.columns == ["id", "note", "f_left", "f_right", "only_l_left", "only_l_right", "only_r_left", "only_r_right",
                                "time_now_left", "time_now_right"]
        rows = sorted((r["note"] or "", r["f_left"] or "", r["f_right"] or "") for r in view.collect())
        assert rows == [("", "", "w"), ("", "", "z"), ("n1", "a", "y"), ("n2", "b", "y"), ("n3", "c", ""), ("n4", "d", "")]
    keyed = merged_view(left, right, "id", left_features=2, right_features=["f", "only_r"], fill_keys=True)
    assert keyed.where("id = '3'").count() == 2


def test_decimal_reconcile_layout(spark):
    df = spark.createDataFrame([("1.234", "1.23", 1), ("1.236", "1.23", 2), ("x", "1", 3), ("2.0", "q", 4)], "s string, r string, n int")
    out = decimal_reconcile(df, "s", "r", mode="exact")
    assert out.columns == ["s", "s_round", "r", "n", "difference"]
    assert sorted((r["n"], r["s_round"], r["difference"]) for r in out.collect()) == [(2, 1.24, -0.01), (3, None, None), (4, None, None)]
    assert decimal_reconcile(df, "s", "r", mode="last_digit").count() == 2
    assert decimal_reconcile(df, "s", "r", full=True, method="double_round").count() == 4


def test_reports_and_scenarios(spark, tmp_path):
    left = spark.createDataFrame([(1, "a", "z"), (2, "b", "z")], "k int, f string, g string")
    right = spark.createDataFrame([(1, "a", "z"), (2, "c", "z")], "k int, f string, g string")
    for mode in ("table", "offline", "response"):
        paths = write_reports(compare(left, right, "k", mode=mode), str(tmp_path / mode), full=True)
        assert "left_only" not in paths and spark.read.parquet(paths["detail"]).count() == 1
        assert spark.read.parquet(paths["merged"]).count() == (4 if mode == "table" else 2)
    write_table(left, str(tmp_path / "csv"), fmt="csv")
    assert sorted(map(tuple, read_table(spark, str(tmp_path / "csv")).collect())) == [("1", "a", "z"), ("2", "b", "z")]
    tables = {"l": left, "r": right}
    outcomes, table = run_scenarios(
        spark, [{"name": "good", "left": "l", "right": "r"}, {"name": "off", "enabled": False},
                {"name": "typo", "left": "l", "right": "r", "tolerence": 1}, {"name": "lost", "left": "nope", "right": "r"}],
        read=tables.__getitem__, defaults={"keys": "k"}, base_path=str(tmp_path / "runs"))
    assert [(o.name, o.success) for o in outcomes] == [("good", True), ("typo", False), ("lost", False)]
    assert os.path.isdir(tmp_path / "runs" / "good" / "statistics")
    assert tuple(outcome_counts(table).first()) == (1, 2)


def test_stream_last_over_several_batches(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k string, v string, pos int"
    for batch in ([("a", "1", 1), ("b", "1", 1)], [("a", "2", 2), ("c", "1", 1)], [("a", "0", 0)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        last = ST.stream_last(stream, ["k"], ["pos"])
        run = (last.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp"))
               .trigger(availableNow=True).foreachBatch(ST.write_batches({"last": lambda b: b}, out)).start())
        run.awaitTermination()
    got = {r["k"]: r["v"] for r in ST.read_last(spark, f"{out}/last", ["k"], ["pos"]).collect()}
    assert got == {"a": "2", "b": "1", "c": "1"}


def test_stream_compare_flags_and_errors(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [("1", '{"data":{"f":-999,"g":"x"}}'), ("2", '{"data":{"f":5}}'), ("3", "{bad"), ("4", '{"_error":"e"}')]
    spark.createDataFrame(rows, "k string, body string").coalesce(1).write.parquet(source)
    left = spark.createDataFrame([("1", "", "x"), ("2", "6", None), ("3", "1", "1")], "k string, f string, g string")
    batch = spark.read.parquet(source)
    catalog = D.discover(batch.select(D.parse("body").alias("doc")), "doc")
    for df in (batch,):
        diffs = ST.compare_stream(df, left, ["k"], ["f", "g"], catalog=catalog, ignore_default_fill=True)
        assert [tuple(r) for r in diffs.collect()] == [("2", "f", "6", "5")]
        assert sorted(r["error"] for r in ST.stream_errors(df).collect()) == ["e", "response is no JSON object"]
