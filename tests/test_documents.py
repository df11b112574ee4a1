"""JSON operators against Python's reading of the same documents."""

import json

import pytest
from pyspark.sql import functions as F

from paritylake.operators import documents as D
from paritylake.operators.enrich import batch_enrich, enrich

DOCS = {
    1: '{"a":{"b":1,"c":{"d":"x"}},"l":[1,null,2],"o":[{"p":1},{"p":2},{"p":1},5],"e":{},"z":null,"t":true,"f":1.0}',
    2: '{"features":{"b":5,"q":{"b":6},"we\'ird\\"":7}}',
    3: '{"features":[{"b":5,"x":1},{"x":2},3]}',
    4: '{"features":"no","b":1}',
    5: "{bad",
    6: "[1]",
    7: None,
    8: '{"z":{"b":1},"b":2}',
    9: '{"b":2,"z":{"b":1}}',
    10: " none ",
    11: '{"deep":{"er":{"and":{"er":{"still":{"leaf":"v"}}}}}}',
}


def frame(spark, docs=DOCS):
    return spark.createDataFrame(list(docs.items()), "id int, j string")


def py_leaves(d):
    out = {}
    for k, v in d.items():
        if isinstance(v, dict) and v:
            out.update(py_leaves(v))
        else:
            out[k] = v
    return out


def py_features(d):
    f = d.get("features")
    if isinstance(f, dict):
        return f
    if isinstance(f, list):
        out = {}
        for item in f:
            if isinstance(item, dict):
                out.update(item)
        return out
    return {k: v for k, v in d.items() if k != "features"}


def text(v):
    if v is None:
        return ""
    return json.dumps(v, separators=(",", ":")) if isinstance(v, (dict, list)) else str(v)


def test_json_to_wide(spark):
    wide = D.json_to_wide(frame(spark), "j", "id")
    want, names = {}, set()
    for i, s in DOCS.items():
        try:
            d = json.loads(s)
        except (TypeError, ValueError):
            continue
        if isinstance(d, dict):
            want[str(i)] = py_leaves(py_features(d))
            names |= set(want[str(i)])
    assert wide.columns == ["id", *sorted(names)]
    for r in wide.collect():
        leaves = want.pop(r["id"])
        for n in names:
            assert r[n] == text(leaves.get(n)), (r["id"], n)
    assert not want


def test_json_to_wide_keys_order_and_override(spark):
    rows = [(1, "k", "base", '{"v":"old"}'), (2, "k ", "base", '{"v":"new","name":"over"}'), (3, "k", "base", "{bad"),
            (4, "", "x", '{"v":1}'), (5, "m", "kept", '{"n":"1,5"}')]
    df = spark.createDataFrame(rows, "pos int, id string, name string, j string")
    got = {r["id"].strip(): r for r in D.json_to_wide(df, "j", "id", order_by=["pos"], convert=True).collect()}
    assert set(got) == {"k", "m"}
    assert (got["k"]["v"], got["k"]["name"]) == ("new", "over")
    assert (got["m"]["name"], got["m"]["n"]) == ("kept", "15")
    _, bad = D.parse_json_column(df, "j", "id")
    assert sorted(r["reason"] for r in bad.collect()) == ["invalid", "no_key"]


def test_flatten_path(spark):
    df = frame(spark, {1: DOCS[1], 2: '{"o":[{"p":3,"r":{"s":null}}],"l":[],"a":5}'}).withColumn("v", D.parse("j"))
    flat, names = D.flatten_path(df, "v")
    assert names == ["a", "a.b", "a.c.d", "e", "f", "l", "o.p", "o.r.s", "t", "z"]
    rows = {r["id"]: r for r in flat.collect()}
    one, two = rows[1], rows[2]
    assert (one["a.b"], one["a.c.d"], one["l"], one["o.p"], one["e"], one["z"], one["t"], one["f"]) == (
        "1", "x", "1|2", "1|2", "{}", None, "True", "1.0")
    assert (two["a"], two["a.b"], two["l"], two["o.p"], two["o.r.s"]) == ("5", None, None, "3", None)


def test_body_to_wide(spark):
    rows = [("1", "t", '{"x":{"y":1},"apply_time":"over"}'), ("2", "t", "{bad"), ("3", "t", None), ("4", "t", "[1]")]
    df = spark.createDataFrame(rows, "apply_id string, apply_time string, response_body string")
    wide = D.body_to_wide(df)
    assert wide.columns == ["apply_id", "apply_time", "x.y"]
    assert sorted(map(tuple, wide.collect())) == [("1", "over", "1"), ("2", "t", None), ("3", "t", None), ("4", "t", None)]
    with pytest.raises(ValueError):
        D.body_to_wide(df.drop("apply_time"))


def test_unwrap_cases(spark):
    cases = [
        '{"retCode":"0","data":{"features":{"age":"30"},"apply_id":"1"}}', '{"data":{"age":"30"}}', '{"data":{}}',
        '{"_error":"failed"}', '{"data":{"features":{},"apply_id":"1"}}', '{"data":[1]}', "5",
    ]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, j string")
    got = [r[0] for r in df.coalesce(1).orderBy("i").select(F.to_json(D.unwrap(D.parse("j")))).collect()]
    assert got == ['{"age":"30"}', '{"age":"30"}', "{}", None, "{}", None, None]


LOOKUP = {
    1: '{"retCode":"0","data":{"features":{"uid":"7","k":3,"n":null},"kind":"c","m":{"Kind2":1,"n":4}},"top":5,"timestamp":"t"}',
    2: '{"data":{},"K":9,"kind":"zz"}',
    3: '{"data":{"z":{"dup":1},"a":{"dup":2}}}',
    4: '{"data":{"a":{"dup":3},"z":{"dup":4}},"x":{"y":{"w":6}}}',
}


def test_lookup_ranks(spark):
    df = frame(spark, LOOKUP).withColumn("v", D.parse("j"))
    c = D.discover(df, "v")
    names = ["uid", "k", "kind", "kind2", "top", "timestamp", "dup", "n", "x.y.w", "x.y", "none"]
    got = {r["id"]: r for r in df.select("id", *[D.lookup("v", n, c, "j").alias(n) for n in names]).collect()}
    assert (got[1]["uid"], got[1]["k"], got[1]["kind"], got[1]["kind2"], got[1]["top"]) == ("7", "3", "c", "1", "5")
    assert got[1]["timestamp"] == "t" and got[1]["n"] == "4"
    assert (got[2]["k"], got[2]["kind"]) == ("9", "zz")
    assert (got[3]["dup"], got[4]["dup"]) == ("1", "3")  # first in the document
    assert got[4]["x.y.w"] == "6" and json.loads(got[4]["x.y"]) == {"w": 6}
    assert all(r["none"] is None for r in got.values())


def test_catalog_and_path_map(spark):
    df = frame(spark, LOOKUP).withColumn("v", D.parse("j"))
    fields = {r["field"]: r["paths"] for r in D.field_catalog(df, "v").collect()}
    assert fields == {"K": 1, "Kind2": 1, "dup": 2, "k": 1, "kind": 2, "n": 2, "top": 1, "uid": 1, "w": 1}
    paths = {r["name"]: r["path"] for r in D.path_map(df, "v").collect()}
    assert paths["dup"] == "data.a.dup" and paths["data.z.dup"] == "data.z.dup"
    listed = frame(spark, {1: '{"code":1,"rows":[{"q":1}],"s":2}'}).withColumn("v", D.parse("j"))
    got = [r["field"] for r in D.field_catalog(listed, "v", envelope=D.ENVELOPE_PLAIN, arrays=True).collect()]
    assert got == ["q", "s"]


def test_discovery_goes_as_deep_as_needed(spark):
    doc = '{"leaf":1}'
    for i in range(11):
        doc = '{"n%d":%s}' % (i, doc)
    df = frame(spark, {1: doc}).withColumn("v", D.parse("j"))
    assert [D.names_of(p)[-1] for p in D.discover(df, "v").leaves()] == ["leaf"]
    with pytest.raises(ValueError):
        D.discover(df, "v", max_depth=8)


def test_convert_envelope_and_columns(spark):
    docs = {1: '{"data":{"features":{"a":"1,000","b":"x","c":2,"d":null,"e":true}},"r":1}', 2: '{"data":{"a":"5"}}', 3: '{"q":1}', 4: "nope"}
    got = {r["id"]: r for r in D.convert_envelope(frame(spark, docs), "j").collect()}
    assert json.loads(got[1]["converted"])["data"]["features"] == {"a": 1000.0, "b": "x", "c": 2, "d": None, "e": True}
    assert (got[1]["converted_count"], got[1]["unchanged_count"]) == (1, 2)
    assert json.loads(got[2]["converted"]) == {"data": {"a": 5.0}}
    assert got[4]["converted"] == "nope"
    df = spark.createDataFrame([("a", "t", "8", " 1,5 "), ("8", "8", "null", "")], "cust_no string, x string, f string, g string")
    assert D.feature_start(["cust_no", "x"]) == 1 and D.feature_start(["q", "r", "s", "t"]) == 3
    assert [tuple(r) for r in D.convert_columns(df, 2).collect()] == [("a", "t", "8.0", "15.0"), ("8", "8", "null", "")]


def test_enrichment(spark):
    table = spark.createDataFrame([("1", "9", "p"), ("2", "9", "p"), ("3", "9", "p"), ("4", "9", "p")], "id string, uid string, pt string")
    answers = spark.createDataFrame(
        [("1", '{"data":{"features":{"uid":"old"}}}', 1), ("1", '{"data":{"features":{"UID":"7","o":{"p":1}},"x":[1]}}', 2),
         ("2", '{"_error":"late"}', 1), ("3", "{bad", 1)], "id string, body string, pos int")
    rows = {r["id"]: r for r in enrich(table, answers, "id", features=1, order_by=["pos"], convert=True).collect()}
    assert (rows["1"]["uid"], rows["1"]["pt"], rows["1"]["x"], rows["1"]["p"], rows["1"]["error"]) == ("7.0", "p", "[1]", "1.0", None)
    assert (rows["2"]["uid"], rows["2"]["x"], rows["2"]["error"]) == ("9", "", "late")
    assert rows["3"]["error"] == "response is no JSON object" and rows["4"]["error"] == "no response"
    out, names = batch_enrich(table, answers, "id", keep=[0], order_by=["pos"])
    assert names == ["UID", "o", "uid"]
    got = {r["id"]: tuple(r) for r in out.collect()}
    assert got["1"] == ("1", "7", '{"p":1}', "", None) and got["2"] == ("2", "", "", "", "late")
