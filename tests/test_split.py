"""Files cut into small ranges against readers that take a file whole."""

import random

import pytest
from pyspark.sql import functions as F

from paritylake.sources import read_responses, read_table, rejected_responses, split_responses
from paritylake.sources.split import ends_inside, pieces


@pytest.fixture
def ranges(spark):
    """Byte ranges of a few hundred bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    yield lambda n: [spark.conf.set(c, str(n)) for c in names]
    for c in names:
        spark.conf.unset(c)


def rows_in_order(df):
    return [tuple(r) for r in df.orderBy("_row_order").drop("_row_order").collect()]


def plain_end(line, inside):
    state = "Q" if inside else "F"
    for c in line:
        if state == "Q":
            state = "E" if c == '"' else "Q"
        elif c == "," :
            state = "F"
        elif c == '"' and state in "FE":
            state = "Q"
        else:
            state = "U"
    return state == "Q"


def test_line_ends_equal_the_automaton():
    rng = random.Random(1)
    for _ in range(3000):
        line = "".join(rng.choice('"",,ab') for _ in range(rng.randrange(12)))
        for inside in (False, True):
            assert ends_inside(line.encode(), inside) == plain_end(line, inside), (line, inside)


def some_cell(rng):
    kind = rng.random()
    if kind < 0.4:
        return rng.choice(["", "x", "12.5", "é日本", 'a"b', " pad ", '""'[:0]])
    text = "".join(rng.choice(["a", ",", '""', "\n", "\r\n", " ", "é", "long text "]) for _ in range(rng.randrange(12)))
    return f'"{text}"'


@pytest.mark.parametrize("size", [250, 2000])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_ranges_equal_whole_files(spark, tmp_path, ranges, size, end):
    for f in range(3):
        rng = random.Random(f)
        lines = [",".join(some_cell(rng) for _ in range(rng.choice([4, 4, 4, 3, 5]))) for _ in range(70)]
        lines.insert(30, "")
        lines.insert(31, '"' + "one cell\n" * 100 + '",z,z,z')  # longer than several ranges
        (tmp_path / f"t{f}.csv").write_bytes(("k,b,c,d" + end + end.join(lines) + (end if f else "")).encode())
    want = read_table(spark, str(tmp_path), multi_line=True).collect()
    ranges(size)
    got = read_table(spark, str(tmp_path), multi_line="split", row_order=True)
    assert pieces(spark, str(tmp_path), "\n").rdd.getNumPartitions() >= 4
    plain = [tuple(r) for r in want]
    assert sorted(map(repr, rows_in_order(got))) == sorted(map(repr, plain))
    for f in range(3):
        one = str(tmp_path / f"t{f}.csv")
        assert rows_in_order(read_table(spark, one, multi_line="split", row_order=True)) == [tuple(r) for r in read_table(spark, one, multi_line=True).collect()]


def test_csv_ranges_of_other_encodings_and_headers(spark, tmp_path, ranges):
    ranges(100)
    text = 'name,b\n' + '"é\nü",1\n' * 60
    (tmp_path / "latin.csv").write_bytes(text.encode("latin-1"))
    got = read_table(spark, str(tmp_path / "latin.csv"), multi_line="split", encoding="ISO-8859-1").collect()
    assert {tuple(r) for r in got} == {("é\nü", "1")} and len(got) == 60
    (tmp_path / "bom.csv").write_bytes(("﻿" + text).encode())
    assert read_table(spark, str(tmp_path / "bom.csv"), multi_line="split").columns == ["name", "b"]
    (tmp_path / "other.csv").write_bytes(b"name,b,c\n1,2,3\n")
    with pytest.raises(Exception, match="another header"):
        read_table(spark, [str(tmp_path / "bom.csv"), str(tmp_path / "other.csv")], multi_line="split").collect()
    (tmp_path / "head.csv").write_bytes(b"name,b\n")
    assert read_table(spark, str(tmp_path / "head.csv"), multi_line="split").count() == 0


def test_a_range_that_was_not_there_before_fails(spark, tmp_path, ranges):
    (tmp_path / "t.csv").write_bytes(b"a,b\n" + b'"x\n",2\n' * 400)
    ranges(1000)
    table = read_table(spark, str(tmp_path / "t.csv"), multi_line="split")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    with pytest.raises(Exception, match="ranges changed"):
        table.filter("a IS NOT NULL").collect()


def some_item(rng, depth=0):
    kind = rng.random()
    if depth < 3 and kind < 0.35:
        return "{" + ", ".join(f'"k{i}": {some_item(rng, depth + 1)}' for i in range(rng.randrange(4))) + "}"
    if depth < 3 and kind < 0.5:
        return "[" + ",".join(some_item(rng, depth + 1) for _ in range(rng.randrange(4))) + "]"
    return rng.choice(['"a}b"', r'"\\"', r'"q\"}],{["', r'"\\\""', '"é日"', "12", "null", "true", '"' + "x" * 150 + '"'])


def test_array_ranges_equal_whole_files(spark, tmp_path, ranges):
    rng = random.Random(4)
    for f in range(4):
        items = [some_item(rng) if i % 3 == 0 else '{"id": %d, "v": %s}' % (i, some_item(rng)) for i in range(50)]
        (tmp_path / f"a{f}.json").write_text(rng.choice(["", " \n"]) + "[" + rng.choice([",", " ,\n"]).join(items) + "]" + rng.choice(["", "\n"]))
    whole = "[" + ",".join('{"id": %d}' % i for i in range(40)) + "]"
    others = {
        "cut": whole[:-1], "cut2": whole[:-4], "cut3": '[{"a": "' + "x" * 900, "lead": "x " + whole, "comma": whole[:-1] + ",]",
        "gap": whole.replace("},", "},,", 1), "item": whole.replace('{"id": 30}', "{id}"), "empty": "[]", "blank array": "[ \n ]", "blank": " \n", "one": '{"a": [1, {"b": 2}], "c": 3}',
        "one cut": '{"a": [1, {"b": 2}], "c": 3', "number": "12", "text": '"a}b"', "words": "no json", "bom": "﻿" + whole, "long": '{"a": "' + "}" * 700 + '"}', "close": "}", "array close": "]",
        "scalars": "[1, 2, [3], null]", "deep": "[[[{}]]]", "tail blank": whole + " " * 900, "closed": "[}]",
    }
    for name, text in others.items():
        (tmp_path / f"{name}.json").write_text(text)
    after = {"two": whole + whole, "tail": whole + " x"}  # what follows an array makes the file invalid
    for name, text in after.items():
        (tmp_path / "after" / name).mkdir(parents=True)
        (tmp_path / "after" / name / "f.json").write_text(text)
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    want = sorted(map(key, read_responses(spark, str(tmp_path)).collect()))
    bad = sorted(map(key, rejected_responses(spark, str(tmp_path)).collect()))
    for size in (300, 100_000):
        ranges(size)
        items, rejects = split_responses(spark, str(tmp_path))
        got = sorted(map(key, items.collect()))
        assert got == want, size
        assert sorted(map(key, rejects.collect())) == bad, size
        items, rejects = split_responses(spark, [str(tmp_path / "after" / name) for name in after])
        assert items.count() == 0 and [r["reason"] for r in rejects.collect()] == ["invalid"] * 2
    ranges(300)
    assert pieces(spark, str(tmp_path / "a0.json"), "}").rdd.getNumPartitions() >= 4
