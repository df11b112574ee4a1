"""Comparisons against a plain Python reading of the rules."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paritylake import SkewPolicy, compare, compare_nested
from paritylake.operators import keys as K
from paritylake.operators import stats as S
from paritylake.operators.detail import diff_detail, error_report, only_report
from paritylake.operators.documents import parse
from paritylake.operators.merge import tagged_view
from paritylake.operators.skew import HotKeys, find_hot_keys, lookup_join

from test_functions import py_equal

ALWAYS = SkewPolicy(share=0.05)


def make(seed, hot=False, n=240):
    """Rows (pos, k1, k2, a, b, c): repeated keys, missing parts, one hot key."""
    rng = random.Random(seed)
    rows = []
    for pos in range(n):
        k1 = "hot" if hot and rng.random() < 0.4 else rng.choice(["x", "y", " z", "z ", "", None, "w", "v"])
        k2 = "1" if k1 == "hot" else rng.choice(["1", "2 ", " 3", "", None])
        rows.append((pos, k1, k2, rng.choice(["1", "1.0", "2", None]), rng.choice(["u", "U", " u", "null"]),
                     rng.choice(["0", "-999", "nan", "", "5"])))
    return rows


SCHEMA = "pos int, k1 string, k2 string, a string, b string, c string"
LEFT_FEATURES = ["a", "b", "c"]


def key(row, policy):
    parts = [(p or "").strip() for p in row[1:3]]
    ok = all(parts) if policy == "all" else any(parts)
    return tuple(parts) if ok else None


def brute(left, right, driver, policy, features, per_key, missing_differs):
    drv, lkp = (left, right) if driver == "left" else (right, left)
    index = {}
    for r in lkp:
        if key(r, policy):
            index[key(r, policy)] = r
    total, diffs, per_row = 0, {}, Counter()
    driver_only = 0
    for r in drv:
        k = key(r, policy)
        if k is None or k not in index:
            driver_only += 1
            continue
        total += 1
        lrow, rrow = (r, index[k]) if driver == "left" else (index[k], r)
        for f, lpos, rpos in features:
            lv = lrow[lpos]
            rv = rrow[rpos] if rpos is not None else None
            same = py_equal(lv, rv) if rpos is not None or not missing_differs else False
            if not same:
                diffs[(k, f)] = (lv, rv)
                per_row[f] += 1
    counts = Counter(f for _, f in diffs) if per_key else per_row
    return total, {f: counts.get(f, 0) for f, _, _ in features}, diffs, driver_only


@pytest.mark.parametrize("mode,driver,policy,per_key,missing", [
    ("table", "right", "all", True, True), ("offline", "left", "any", True, True), ("response", "left", "all", False, False),
])
@pytest.mark.parametrize("hot", [False, True])
def test_modes_match_brute_force(spark, mode, driver, policy, per_key, missing, hot):
    left, right = make(1, hot), make(2, hot)
    ldf = spark.createDataFrame(left, SCHEMA).repartition(5)
    rdf = spark.createDataFrame(right, SCHEMA).withColumnRenamed("c", "other").repartition(5)
    feats = [("a", 3, 3), ("b", 4, 4), ("c", 5, None)]
    total, counts, diffs, driver_only = brute(left, right, driver, policy, feats, per_key, missing)
    cmp = compare(ldf, rdf, ["k1", "k2"], mode=mode, left_features=LEFT_FEATURES, right_features=["a", "b", "other"],
                  convert=False, order_by=["pos"], driver_order_by=["pos"], skew=ALWAYS if hot else SkewPolicy(enabled=False))
    if hot:
        assert cmp._hot_driver.hashes
    stats = {r["feature"]: (r["total"], r["mismatch"]) for r in cmp.stats().collect()}
    assert stats == {f: (total, n) for f, n in counts.items()}
    rows = cmp.diffs().collect()
    if per_key:
        def text(v):
            return v if v is None or mode != "offline" else v.strip()

        got = {((r["k1"].strip(), r["k2"].strip()), r["feature"]): (r["left_value"], r["right_value"]) for r in rows}
        assert len(rows) == len(diffs)
        assert got == {k: (text(a), text(b)) for k, (a, b) in diffs.items()}
    counted = cmp.key_counts().first().asDict()
    assert counted["matched"] == total
    assert counted[f"{driver}_only"] == driver_only
    only = only_report(cmp, driver).count()
    assert only == driver_only
    other = "left" if driver == "right" else "right"
    assert only_report(cmp, other).count() == counted[f"{other}_only"]
    status = Counter(r["status"] for r in cmp.row_status().collect())
    assert status["compared"] == total and status["empty_key"] + status["no_match"] == driver_only
    assert cmp.diff_keys().count() == len({k for k, _ in diffs})
    assert cmp.cells().count() == total * 3


def test_hot_keys_are_found_and_joined_whole(spark):
    big = spark.range(9000, numPartitions=6).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
    big = big.withColumn("k", F.when(F.col("id") % 10 != 1, F.col("k")))
    small = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    hot = find_hot_keys(big, ["k"], ALWAYS)
    assert len(hot.hashes) == 1 and hot.spread_nulls
    for how in ("inner", "left", "left_anti", "left_semi"):
        want = sorted(map(repr, big.join(small, ["k"], how).collect()))
        assert sorted(map(repr, lookup_join(big, small, ["k"], how, hot).collect())) == want
    salted = lookup_join(big, small, ["k"], "inner", hot)
    plan = salted._jdf.queryExecution().toString()
    assert "spark_partition_id" in plan.lower()
    assert find_hot_keys(big, ["k"], SkewPolicy()).hashes == hot.hashes  # whatever the size of the input
    assert not HotKeys()


def test_last_row_wins_and_ties_are_stable(spark):
    rows = [(1, "a", i, i % 3) for i in range(30)] + [(2, "b", 5, 1)]
    df = spark.createDataFrame(rows, "k int, s string, pos int, g int")
    last = {r["k"]: r["pos"] for r in K.dedupe_last(df, ["k"], ["pos"]).collect()}
    assert last == {1: 29, 2: 5}
    first = K.dedupe_last(df.repartition(7), ["k"], ["g"]).where("k = 1").first()["pos"]
    assert all(K.dedupe_last(df.repartition(n), ["k"], ["g"]).where("k = 1").first()["pos"] == first for n in (1, 2, 5))


def test_names_that_differ_in_case_or_hold_dots(spark):
    left = spark.createDataFrame([(1, "x", "p", "q")], "k int, a string, A string, `b.c` string")
    right = spark.createDataFrame([(1, "x", "P", "q")], "k int, a string, A string, `b.c` string")
    stats = {r["feature"]: r["mismatch"] for r in compare(left, right, "k").stats().collect()}
    assert stats == {"a": 0, "A": 1, "b.c": 0}


def test_positions_rename_exclude_and_errors(spark):
    left = spark.createDataFrame([("1", "x", "t", "p")], "id string, f string, time_now string, pt string")
    right = spark.createDataFrame([("1", "y", "u", "q")], "id string, pre_f_suf string, time_now string, pt string")
    cmp = compare(left, right, 0, left_features=1, right_features=1, rename="left", prefix="pre_", suffix="_suf", mode="response")
    assert cmp.features == ["pre_f_suf"]
    assert [r["mismatch"] for r in cmp.stats().collect()] == [1]
    assert "time_now" in cmp.diffs().columns
    for bad in (dict(keys=9), dict(keys="none"), dict(keys=0, mode="x"), dict(keys=0, baseline="x")):
        with pytest.raises(ValueError):
            compare(left, right, **bad)
    with pytest.raises(ValueError):
        compare(left.select("id", "f"), right.select("id", "pre_f_suf"), 0, common_only=True)
    with pytest.raises(ValueError):
        K.align_features(["a", "a"], ["a"])


def test_exact_integers_and_typed_columns(spark):
    left = spark.createDataFrame([(1, 2**60, 1.0, None), (2, 5, float("nan"), 0.0)], "k int, i bigint, d double, z double")
    right = spark.createDataFrame([(1, 2**60 + 1, 1.0, 0.0), (2, 5, float("nan"), None)], "k int, i bigint, d double, z double")

    def mismatches(**o):
        return {r["feature"]: r["mismatch"] for r in compare(left, right, "k", **o).stats().collect()}

    assert mismatches() == {"i": 0, "d": 1, "z": 2}
    assert mismatches(exact_integers=True) == {"i": 1, "d": 1, "z": 2}
    assert mismatches(ignore_zero_nan=True) == {"i": 0, "d": 0, "z": 0}


def test_detail_forms_context_and_errors(spark):
    left = spark.createDataFrame([("1", "2024", "", "9")], "id string, create_time string, cust_no string, f string")
    right = spark.createDataFrame([("1", "2025", "C", "8", "now")], "id string, create_time string, cust_no string, f string, time_now string")
    opts = dict(left_features=["f"], right_features=["f"])
    t = diff_detail(compare(left, right, "id", **opts)).first().asDict()
    assert t == {"id": "1", "time": "2025", "customer": "C", "feature": "f", "right_value": "8", "left_value": "9"}
    o = diff_detail(compare(left, right, "id", mode="offline", **opts), sort="feature").first().asDict()
    assert o["left_time"] == "2024" and o["right_time"] == "2025" and o["time_now"] == "now" and o["customer"] == "C"
    original = spark.createDataFrame([("1", "raw")], "id string, create_time string")
    o = diff_detail(compare(left, right, "id", mode="offline", context_from=original, **opts)).first()
    assert o["right_time"] == "raw"
    r = diff_detail(compare(left, right, "id", mode="response", **opts), difference=True, labels={"feature": "name"}).first()
    assert (r["name"], r["difference"], r["time_now"]) == ("f", 1.0, "now")
    failed = spark.createDataFrame([("7", "t", "boom"), ("8", "t", None)], "custNo string, base_time string, error string")
    assert [tuple(x) for x in error_report(failed).collect()] == [("7", "t", "boom")]


def test_near_misses_and_nested(spark):
    left = spark.createDataFrame([("c", "9", "x"), ("d", "1", "x")], "id string, t string, f string")
    right = spark.createDataFrame([("c", str(i), "x") for i in range(6)], "id string, t string, f string")
    rows = {r["id"]: (r["candidates"], r["candidate_count"]) for r in
            compare(left, right, ["id", "t"], mode="response").near_misses().collect()}
    assert rows == {"c": ("0,1,2", 3), "d": ("", 0)}
    table = spark.createDataFrame([("1", "5", "", "z")], "id string, top string, deep string, gone string")
    docs = spark.createDataFrame([("1", '{"top":5,"data":{"m":{"deep":null}},"x":1}')], "id string, body string")
    cmp = compare_nested(table, docs.select("id", parse("body").alias("doc")), "id")
    assert {r["feature"]: r["mismatch"] for r in cmp.stats().collect()} == {"top": 0, "deep": 0, "gone": 1}


def test_summaries(spark):
    left = spark.createDataFrame([(i, i, i % 2, 0) for i in range(10)], "k int, a int, b int, c int")
    right = left.withColumn("b", F.lit(0)).withColumn("c", F.col("c") + F.when(F.col("k") == 3, 1).otherwise(0))
    cmp = compare(left, right, "k", unique_driver=True, unique_lookup=True)
    stats = cmp.stats()
    assert S.overall_stats(stats).first().asDict() == {"comparisons": 30, "matches": 24, "diffs": 6, "match_pct": 80.0}
    assert [tuple(r) for r in S.top_diffs(stats, 1).collect()] == [("b", 5, 10, 50.0)]
    assert tuple(S.class_counts(stats).first()) == (1, 2)
    assert [r["feature"] for r in S.stats_report(stats, "rate").collect()] == ["b", "c", "a"]
    assert S.diff_key_count(cmp).first()[0] == 5  # key 3 differs in both b and c
    assert {(r["k"], r["source"]): r["differs"] for r in tagged_view(cmp).collect()}[(2, "left")] is False
    empty = compare(left.where("k < 0"), right, "k").stats()
    assert S.overall_stats(empty).first()["match_pct"] == 0.0
    cmp.persist()
    assert cmp.diffs().count() == 6
    cmp.unpersist()


def test_roles_and_params(spark):
    assert K.detect_roles(["x", "custNo", "create_time", "f"]) == {"customer": 1, "time": 2, "feature_start": 3}
    assert K.detect_roles(["a"])["feature_start"] == 4
    df = spark.createDataFrame([("1", "2024-01-02"), ("", "x"), (None, None)], "id string, t string").coalesce(1)
    specs = [{"name": "id", "column": 0}, {"name": "base", "column": "t", "is_time": True}]
    strict = K.build_params(df, specs, plus_one=True).collect()
    assert strict[0]["params"]["base"] == "2024-01-02T00:00:01.000" and strict[0]["error"] is None
    assert strict[1]["error"] == "parameter id is empty"
    lenient = K.build_params(df, specs, strict=False).collect()
    assert [r["error"] for r in lenient] == [None, None, "no valid parameter"]
    bad = K.build_params(df, [{"name": "q", "column": 7}]).first()
    assert bad["error"] == "parameter q: invalid column 7"


def test_profile_and_history(spark):
    df = spark.createDataFrame([(i, float(i), "x" if i else None) for i in range(5)], "a int, b double, c string")
    rows = {r["column_name"]: r for r in S.profile(df, quartiles="exact").collect()}
    assert (rows["b"]["p25"], rows["b"]["p50"], rows["b"]["max"]) == (1.0, 2.0, 4.0)
    assert rows["c"]["null_count"] == 1 and rows["c"]["mean"] is None
    assert S.shape(df).first()["columns"] == ["a", "b", "c"]
    runs = spark.createDataFrame([(1, 10.0, "ok", 3), (2, 8.0, "ok", 1), (0, 99.0, "bad", 0)],
                                 "start_time int, duration double, status string, errors int")
    d = S.run_delta(runs).first()
    assert (d["duration_improvement"], d["status_same"], d["errors_reduced"]) == (20.0, True, True)
    assert S.run_delta(runs.limit(1)).count() == 0


def test_cells_are_parsed_once_and_shown_as_to_number_does(spark):
    from paritylake.functions.numbers import NUMBER, numeric, plain_whole, to_number

    texts = [None, "", " ", "0", "-0", "+5", "007", "12", " 12 ", "12\n", "12.0", "1_000", "1e3", "'8'", '" x "', "'", "''", "nan", "Infinity",
             "999999999999999", "9007199254740993", "-9007199254740993", "123456789012345678901", "1e400", ".5", "5.", "None", "٣", "1d", "0x10"]
    left = spark.createDataFrame(list(enumerate(texts)), "id int, f string")
    right = spark.createDataFrame(list(enumerate(reversed(texts))), "id int, f string")
    found = compare(left, right, "id").cells()
    assert found._jdf.queryExecution().optimizedPlan().toString().count(NUMBER) <= 2
    want = left.select("id", to_number("f").alias("l")).join(right.select("id", to_number("f").alias("r")), "id")
    assert sorted(map(str, found.select("id", "left_value", "right_value").collect())) == sorted(map(str, want.toDF("id", "left_value", "right_value").collect()))
    whole = left.select("f", plain_whole("f").alias("w"), numeric("f").alias("n"), to_number("f").alias("t")).where("w is not null").collect()
    assert {r["f"] for r in whole} == {"0", "12", "999999999999999"} and all(r["t"] == r["f"] and r["n"] == r["w"] for r in whole)
