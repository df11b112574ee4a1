"""Column builders against plain Python."""

import math
import random

from pyspark.sql import functions as F

from paritylake.functions import (
    cells_equal, decimal_places, diff_ignorable, difference, first_nonempty, normalize_ts,
    numeric, plain_number, plus_one_second, request_time, round_half_even, round_to_reference,
    text_guard, to_double, to_number, to_standard_time,
)

NULLS = {None, "", "null", "none"}


def py_number(s):
    if s is None:
        return None
    try:
        x = float(s.strip())
    except ValueError:
        return None
    return x


def py_equal(a, b, zero_nan=False, fill=False, tol=None):
    def low(s):
        return None if s is None else s.strip().lower()

    an, bn = low(a) in NULLS, low(b) in NULLS
    x, y = py_number(a), py_number(b)

    def in_zero(n, s, v):
        return n or low(s) in ("nan", "na", "n/a") or (v is not None and (v == 0 or math.isnan(v)))

    if zero_nan and in_zero(an, a, x) and in_zero(bn, b, y):
        return True
    if fill and (an or x == -999) and (bn or y == -999):
        return True
    if an or bn:
        return an and bn
    if x is not None and y is not None and not (math.isinf(x) or math.isinf(y)):
        if math.isnan(x) or math.isnan(y):
            return False
        return abs(x - y) <= tol if tol is not None else abs(x - y) < 1e-10
    return a.strip() == b.strip()


LEXEMES = [
    None, "", " ", "null", "None", "NULL ", "nan", "NaN", " -nan", "na", "N/A", "inf", "0", "0E-8", "0.0", "-0",
    "-999", "-999.0", " -999 ", "1", "1.0", " 1 ", "+1", "1e0", "1_0", "10", "1,000", "1000", "1d", "0x10", ".5",
    "0.5", "5.", "5", "abc", "ABC", "abc ", "true", "1.0000000000001", "1.001", "65450", "-1", "1__0", "_1",
]


def test_cells_equal_against_python(spark):
    pairs = [(i, j, a, b) for i, a in enumerate(LEXEMES) for j, b in enumerate(LEXEMES)]
    df = spark.createDataFrame(pairs, "i int, j int, a string, b string")
    variants = [
        {}, {"zero_nan": True}, {"fill": True}, {"tol": 0.01}, {"zero_nan": True, "fill": True, "tol": 1.0},
    ]
    cols = [
        cells_equal("a", "b", ignore_zero_nan=v.get("zero_nan", False), ignore_default_fill=v.get("fill", False),
                    tolerance=v.get("tol")).alias(f"v{n}")
        for n, v in enumerate(variants)
    ]
    for r in df.select("a", "b", *cols).collect():
        for n, v in enumerate(variants):
            assert r[f"v{n}"] is py_equal(r["a"], r["b"], **v), (r["a"], r["b"], v)


def test_cells_equal_converts_and_keeps_long_ids(spark):
    df = spark.createDataFrame([('"8"', "8.0"), ("'8'", "8"), ("12345678901234567890", "12345678901234567891"),
                                ("007", "7"), ('"nan"', '"nan"')], "a string, b string")
    got = [tuple(r) for r in df.select(
        cells_equal("a", "b", convert="fast"), cells_equal("a", "b"), cells_equal("a", "b", exact_integers=True)
    ).collect()]
    assert got == [(True, False, False), (True, False, False), (True, True, False), (True, True, True),
                   (False, True, True)]


def values(spark, expr, rows):
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    return [r[0] for r in df.coalesce(1).select(expr).collect()]


def test_to_number_styles(spark):
    rows = ["8.0", '"8"', "'8'", '65450""', '"', '""', "", None, " x ", "0.10", "1e5", "nan", "1,000", "1 000", "8."]
    assert values(spark, to_number("v", "fast"), rows) == [
        "8", "8", "8", '65450""', '"', '""', "", None, "x", "0.1", "100000", "nan", "1,000", "1 000", "8"]
    assert values(spark, to_number("v", "quoted"), ["'8\"", "'8'", '" 8 "', "' '"]) == ["'8\"", "8", "8", "' '"]
    assert values(spark, to_number("v", "greedy_quotes"), ['65450""', '""7\'', '"']) == ["65450", "7", '"']
    assert values(spark, to_number("v", "json"), ["8.0", "8", "1,000", "1e5", "1.5e3", "nan", "None", "x", "+5", "007"]) == [
        "8.0", "8", "1000", "1e5", "1500.0", None, None, "x", "5", "7"]
    assert values(spark, to_double("v"), ["8", "1, 000.5", "undefined", "inf", "x", None]) == [8.0, 1000.5, None, None, None, None]


def test_numbers_as_text(spark):
    xs = [0.1, 1e-7, 123456789.125, 1e15, -2.5, 3.0, 0.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1)
    shown = [r[0] for r in df.select(plain_number(F.col("x"))).collect()]
    assert shown == ["0.1", "0.0000001", "123456789.125", "1000000000000000", "-2.5", "3", "0"]


def test_difference(spark):
    df = spark.createDataFrame([("3.5", "1"), ("", "null"), (None, None), ("x", "1"), ("null", "1"), ("1", "x")],
                               "a string, b string").coalesce(1)
    assert [r[0] for r in df.select(difference("a", "b")).collect()] == [2.5, 0.0, 0.0, None, None, None]


def test_timestamps(spark):
    rows = ["2024-01-02", "2024/01/02", "20240102", "2024-01-02 03:04:05", "2024-01-02T03:04:05.1", "2024-01-02 03:04:05.123456",
            "", None, "x", "2024-12-31T23:59:59.123"]
    assert values(spark, normalize_ts("v"), rows) == [
        "2024-01-02T00:00:00.000"] * 3 + ["2024-01-02T03:04:05.000", "2024-01-02T03:04:05.100", "2024-01-02T03:04:05.123",
                                          "", None, "x", "2024-12-31T23:59:59.123"]
    assert values(spark, normalize_ts("v", style="batch"), rows)[3:6] == [
        "2024-01-02 03:04:05.000", "2024-01-02 03:04:05.100", "2024-01-02 03:04:05.123"]
    assert values(spark, normalize_ts("v", style="strict_t"), rows)[:4] == rows[:3] + ["2024-01-02T03:04:05.000"]
    assert values(spark, plus_one_second("v"), rows)[-4:] == ["", None, "x", "2025-01-01T00:00:00.123"]
    assert values(spark, plus_one_second("v"), ["2024-02-30 00:00:00", "2024-2-3 4:5:6"]) == [
        "2024-02-30 00:00:00", "2024-02-03T04:05:07.000"]
    assert values(spark, request_time("v", plus_one=True), ["a2024-01-02 03:04:05A", None]) == ["2024-01-02T03:04:06.000", ""]
    assert values(spark, to_standard_time("v"), ["2024/1/2 03:04:05", "at 2024-01-02 03:04:05.12 h", "null", "soonT"]) == [
        "2024-01-02 03:04:05.000", "2024-01-02 03:04:05.120", "", "soon "]


def test_epochs_and_guards(spark):
    df = spark.createDataFrame([(1704067200,), (1704067200123,), (None,)], "v bigint").coalesce(1)
    got = [r[0] for r in df.select(to_standard_time("v", df.schema["v"].dataType)).collect()]
    assert got == ["2024-01-01 00:00:00.000", "2024-01-01 00:00:00.000", ""]
    assert values(spark, text_guard("v", "x"), ["2024-01-02", "null", "5", ""]) == ["\t2024-01-02", "null", "5", ""]
    assert values(spark, text_guard("v", "apply_Date"), ["5"]) == ["\t5"]
    assert values(spark, first_nonempty(F.lit(" "), "v"), ["k", None]) == ["k", ""]


def test_rounding_matches_python(spark):
    rng = random.Random(7)
    rows = [(2.675, 2), (1.005, 2), (0.5, 0), (1.5, 0), (2.5, 0), (-2.5, 0), (1010.25, 1), (10127.85, 1), (-0.125, 2), (1e16, 2), (0.0, 3)]
    for _ in range(4000):
        d = rng.randint(0, 6)
        x = rng.choice([rng.uniform(-1000, 1000), round(rng.uniform(-1000, 1000), d) + 0.5 * 10 ** -d, rng.randint(-10**6, 10**6) / 8])
        rows.append((x, d))
    df = spark.createDataFrame(rows, "x double, d int").coalesce(1)
    got = [r[0] for r in df.select(round_half_even(F.col("x"), F.col("d"))).collect()]
    assert got == [round(x, d) for x, d in rows]


def test_rounding_methods(spark):
    rows = [("1.005", "2.50"), ("-1.27", "0.1"), ("3.999", "7"), ("x", "1"), ("1", "x"), ("2.345", "1.1"), ("1010.2511", "0.5")]
    df = spark.createDataFrame(rows, "s string, r string").coalesce(1)
    out = {m: [r[0] for r in df.select(round_to_reference("s", "r", m)).collect()]
           for m in ("none", "round", "double_round", "truncate", "ceil")}
    assert out["none"] == [1.005, -1.27, 3.999, None, 1.0, 2.345, 1010.2511]
    assert out["round"] == [1.0, -1.3, 4.0, None, None, 2.3, 1010.3]
    assert out["double_round"] == [round(round(1.005, 2), 1), -1.3, 4.0, None, None, round(round(2.345, 2), 1), round(round(1010.2511, 2), 1)]
    assert out["truncate"] == [1.0, -1.2, 3.0, None, None, 2.3, 1010.2]
    assert out["ceil"] == [1.1, -1.2, 4.0, None, None, 2.4, 1010.3]


def test_decimal_places_and_ignorable(spark):
    assert values(spark, decimal_places("v"), ["1.50", "1", "1.", "0.001", None, " 2.10 "]) == [1, 0, 0, 3, 0, 1]
    df = spark.createDataFrame([("1.25", 0.01), ("1.25", 0.02), ("1.25", 0.03), ("7", 1.0), ("7", 2.0), ("7", None), ("7", 0.0)],
                               "r string, d double").coalesce(1)
    got = {m: [r[0] for r in df.select(diff_ignorable("r", "d", m, 0.02)).collect()] for m in ("exact", "tolerance", "last_digit", "last_digit_2")}
    assert got["exact"] == [False] * 6 + [True]
    assert got["tolerance"] == [True, True, False, False, False, False, True]
    assert got["last_digit"] == [True, False, False, True, False, False, True]
    assert got["last_digit_2"] == [True, True, False, True, True, False, True]


def test_numeric_rejects_what_casts_accept(spark):
    assert values(spark, numeric("v"), ["1d", "0x10", "nan", "inf", "1_0", "1__0", ".", "5.", ".5e1"]) == [
        None, None, None, None, 10.0, None, None, 5.0, 5.0]
