"""Tables in files."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import quote
from ..operators import documents as D
from ..operators.keys import ORDER_COLUMN
from ..operators.stage import compute, stored
from .split import csv_records, json_segments

_CORRUPT = "_bad_row"


def _csv_reader(spark: SparkSession, encoding: str, multi_line: bool, sep: str):
    return (
        spark.read.option("encoding", encoding).option("multiLine", multi_line).option("sep", sep)
        .option("escape", '"').option("maxColumns", 100_000)
    )


def read_header(spark: SparkSession, path, *, encoding: str = "utf-8", multi_line: bool | str = False,
                sep: str = ",") -> list[str]:
    """The header cells of a CSV table; ValueError when empty or repeated."""
    first = _csv_reader(spark, encoding, bool(multi_line), sep).csv(path).first()
    if first is None:
        raise ValueError(f"CSV file is empty: {path}")
    return _checked(["" if c is None else c for c in first], path)


def _checked(names: list[str], path) -> list[str]:
    double = sorted({n for n in names if names.count(n) > 1})
    if double:
        raise ValueError(f"repeated column names in {path}: {double}")
    return names


def header_groups(spark: SparkSession, path, *, encoding: str = "utf-8", sep: str = ",") -> list[tuple[list[str], list[str]]]:
    """(header, files) for every header among the files of a table, most files first.

    One pass over the lines finds the first of each file; it must hold the whole header.
    """
    lines = spark.read.option("encoding", encoding).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), "value")
    heads = lines.where("block = 0").groupBy("file").agg(F.min_by("value", "line").alias("head"))
    groups = heads.groupBy("head").agg(F.collect_list("file").alias("files")).collect()  # names and paths only
    return sorted(((_cells(g["head"], sep), sorted(g["files"])) for g in groups), key=lambda g: (-len(g[1]), g[0]))


def _cells(line: str, sep: str) -> list[str]:
    return next(csv.reader([line.removeprefix("\ufeff")], delimiter=sep), [])


def read_table(
    spark: SparkSession, path, *, encoding: str = "utf-8", multi_line: bool | str = False, sep: str = ",",
    row_order: bool = False, by_name: bool = False,
) -> DataFrame:
    """A CSV table with header, every column text.

    Short rows are padded with NULL, extra cells dropped. Names may differ in case
    only. Large files are split. `multi_line` understands quoted line breaks: True reads each file in
    one task, "split" reads large files in many, twice each, and gives the same rows where lines
    end at \\n or \\r\\n (see `sources.split`). A file with another header than the first is an error;
    `by_name` matches the columns of such files by name, NULL where a file lacks one, for one
    more pass over the lines. `row_order` adds the row's place in its file as `_row_order`,
    which orders rows the way the file does. GBK text needs `spark.sql.legacy.javaCharsets`.
    """
    if by_name:
        groups = header_groups(spark, path, encoding=encoding, sep=sep)
        if not groups:
            raise ValueError(f"CSV file is empty: {path}")
        out = None
        for names, files in groups:
            part = _read_named(spark, files, _checked(names, files[0]), encoding, multi_line, sep, row_order, check=False)
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out
    names = read_header(spark, path, encoding=encoding, multi_line=multi_line, sep=sep)
    return _read_named(spark, path, names, encoding, multi_line, sep, row_order, check=True)


def _read_named(spark, path, names, encoding, multi_line, sep, row_order, check) -> DataFrame:
    if multi_line == "split":
        return _read_split(spark, path, names, encoding, sep, row_order, check)
    # Spark compares each file's header with the schema, but cannot hold names that differ in case only
    check = check and len({n.lower() for n in names}) == len(names) and "" not in names
    safe = names if check else [f"c{i}" for i in range(len(names))]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in safe])
    reader = _csv_reader(spark, encoding, multi_line, sep).option("header", True).option("enforceSchema", not check)
    df = reader.option("columnPruning", not check).schema(schema).csv(path)
    if not row_order:
        return df.toDF(*names)
    return df.select(*map(quote, safe), file_order().alias(ORDER_COLUMN)).toDF(*names, ORDER_COLUMN)


def _read_split(spark, path, names, encoding, sep, row_order, check) -> DataFrame:
    utf8 = encoding.lower().replace("-", "") == "utf8"
    text = F.col("value").cast("string") if utf8 else F.decode("value", encoding)
    rows = csv_records(spark, path, sep=sep).select("file", "block", "no", text.alias("value"))
    rows = rows.withColumn("value", F.when(F.col("value").endswith("\r"), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value")))
    schema = ", ".join(f"c{i} string" for i in range(len(names) + 1))  # one more shows a longer header
    options = {"sep": sep, "escape": '"', "maxColumns": "100000", "multiLine": "true"}
    head = (F.col("block") == 0) & (F.col("no") == 0)
    text = F.when(head, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value"))
    rows = rows.where("value <> ''").select("file", "block", "no", F.from_csv(text, schema, options).alias("cells"))
    if check:
        cells = [F.lower(F.coalesce(F.col(f"cells.c{i}"), F.lit(""))) for i in range(len(names))]
        same = F.col(f"cells.c{len(names)}").isNull() & (F.array(*cells) == F.array(*[F.lit(n.lower()) for n in names]))
        other = F.raise_error(F.concat(F.lit("another header than the table's in "), "file")).cast("boolean")
        rows = rows.where(F.when(head, F.when(same, False).otherwise(other)).otherwise(True))
    else:
        rows = rows.where(~head)
    columns = [F.col(f"cells.c{i}") for i in range(len(names))]
    if not row_order:
        return rows.select(*columns).toDF(*names)
    order = F.struct("file", "block", F.col("no").alias("row"))
    return rows.select(*columns, order).toDF(*names, ORDER_COLUMN)


def file_order() -> Column:
    """File, split and row number within the split: repeats exactly when a task is run
    again. Use directly on a scan."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def csv_health(spark: SparkSession, path, *, encoding: str = "utf-8", multi_line: bool = False,
               sep: str = ",") -> DataFrame:
    """Per file its rows, the width of its own header, rows of another width and rows
    without a first cell."""
    out = None
    widths: dict[int, list[str]] = {}
    for names, found in header_groups(spark, path, encoding=encoding, sep=sep):
        widths.setdefault(len(names), []).extend(found)
    if not widths:
        raise ValueError(f"CSV file is empty: {path}")
    for width, found in sorted(widths.items()):
        part = _health(spark, found, width, encoding, multi_line, sep)
        out = part if out is None else out.unionByName(part)
    return out


def _health(spark, files, width, encoding, multi_line, sep) -> DataFrame:
    fields = [T.StructField(f"c{i}", T.StringType()) for i in range(width)]
    schema = T.StructType([*fields, T.StructField(_CORRUPT, T.StringType())])
    rows = (
        _csv_reader(spark, encoding, multi_line, sep).option("header", True)
        .option("columnNameOfCorruptRecord", _CORRUPT)
        .option("columnPruning", False)  # a pruned scan would not see the row's width
        .schema(schema).csv(files)
    )
    seen = rows.select(F.col("_metadata.file_path").alias("file"), "c0", _CORRUPT)
    # the length test is never true; the parser refuses plans that read the record column alone
    bad = F.col(_CORRUPT).isNotNull() | F.coalesce(F.length("c0") < 0, F.lit(False))
    return seen.groupBy("file").agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(width).alias("header_width"),
        F.count_if(bad).alias("bad_rows"),
        F.count_if(F.col("c0").isNull()).alias("keyless_rows"),
    )


def write_table(
    df: DataFrame, path: str, *, fmt: str = "parquet", mode: str = "errorifexists",
    partition_by: Sequence[str] = (), max_records: int | None = None, encoding: str = "utf-8",
) -> None:
    """S3: write a table as Parquet, or as CSV with header."""
    writer = df.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"').option("encoding", encoding)
        writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.save(path)


def write_keyed(df: DataFrame, table: str, keys: Sequence[str], *, buckets: int, path: str | None = None) -> DataFrame:
    """S3: write a table bucketed and sorted by its keys, one file a bucket, and return it.

    Two sides that are stored so by whole-number keys, in as many buckets each, are compared without a
    shuffle of either, run after run; one such static side is not shuffled for a
    batch of a stream. (Text keys are trimmed before they are joined, so their sides are shuffled.)
    `path` places the files; by default they go to the session's warehouse.
    """
    dealt = df.repartition(buckets, *[F.col(quote(k)) for k in keys])
    writer = dealt.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)


def _whole_files(spark: SparkSession, path) -> DataFrame:
    """(file, value, items): the text of each file and its documents, NULL where it is no JSON.

    The items of an array are parsed one by one, so only a single document is bound by
    the size limit of a variant.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    many = F.col("value").rlike(r"^\s*\[")
    one = D.parse("value")
    return text.select("file", "value", F.when(many, D.parse("value", "array<variant>")).when(one.isNotNull(), F.array(one)).alias("items"))


def _segments(spark: SparkSession, path) -> DataFrame:
    """(file, position, body, reason, whole): the items of each file, and what is wrong with them or, if
    `whole`, with the file. Written once."""
    cut = json_segments(spark, path)
    text = F.col("value").cast("string")
    text = F.when(F.col("begin") == "^", F.regexp_replace(text, "^\ufeff", "")).otherwise(text)
    cut = compute(cut, ["file", "block", "no", "begin", "end"], text=text)
    parsed = compute(cut, doc=D.parse("text"))
    parsed = stored(parsed.select(
        "file", "block", "no", "begin", "end", F.col("text").rlike(r"^\s*$").alias("blank"), F.to_json("doc").alias("body"),
        F.coalesce(D.is_object(F.col("doc")), F.lit(False)).alias("object")), "responses")
    begin, end, blank, bad = F.col("begin"), F.col("end"), F.col("blank"), F.col("body").isNull()
    lone = (begin == "^") & end.isNull()
    between = begin.isin("[", ",") & end.isNotNull()
    around = (begin.isNull()) | ((begin == "^") & (end == "[")) | ((begin == "]") & end.isNull())
    empty = (begin == "[") & (end == "]") & blank
    wrong = F.when(lone | between, bad & ~F.coalesce(empty, F.lit(False))).when(around, ~blank).otherwise(True)
    item = (lone | between) & ~F.coalesce(empty, F.lit(False))
    # the items of a range follow those of the ranges before it; the segment before the first bracket is none
    ranges = parsed.where("begin IS NOT NULL").groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("passed"))
    placed = parsed.join(ranges, ["file", "block"], "left")
    position = F.when(lone, F.lit(0)).otherwise(F.col("passed") + F.col("no") - 1).cast("bigint")
    broken = F.when(lone & blank, "empty").otherwise("invalid")
    reason = F.when(wrong, broken).when(item & ~F.col("object"), "not_object")
    return placed.where(item | wrong).select("file", position.alias("position"), "body", reason.alias("reason"), wrong.alias("whole"))


def split_responses(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """The tables of `read_responses` and `rejected_responses`, from files of which each is an
    array of documents of any size or one document: large files are read by many tasks. Items are
    parsed once and written to the shared folder."""
    found = stored(_segments(spark, path), "response-items")
    broken = found.where("whole").groupBy("file").agg(F.max("reason").alias("reason"))
    items = found.where("NOT whole").join(broken.select("file"), "file", "left_anti")
    rejects = broken.select("file", F.lit(None).cast("bigint").alias("position"), "reason").unionByName(
        items.where("reason IS NOT NULL").select("file", "position", "reason"))
    return items.select("file", "position", "body"), rejects


def read_responses(spark: SparkSession, path, *, lines: bool = False) -> DataFrame:
    """Stored responses as (file, position, body): each file one JSON object or an
    array of them, or with `lines` one document per line, which Spark splits at any size.

    A file that is no JSON gives no row here; `rejected_responses` lists it. Each file is read by
    one task; `split_responses` reads large arrays in many.
    """
    if lines:
        return spark.read.text(path).select(
            F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("position"),
            F.col("value").alias("body"),
        )
    return _whole_files(spark, path).select("file", F.posexplode("items").alias("position", "item")).select(
        "file", F.col("position").cast("bigint").alias("position"), F.to_json("item").alias("body"))


def rejected_responses(spark: SparkSession, path, *, lines: bool = False) -> DataFrame:
    """What `read_responses` cannot use, as (file, position, reason): files that are blank or
    no JSON (position NULL), and lines or array items that are no JSON object. Spark's readers
    skip files without a byte, so those are in neither table."""
    if lines:
        rows = read_responses(spark, path, lines=True)
        doc = D.parse("body")
        reason = F.when(F.trim("body") == "", "empty").when(doc.isNull(), "invalid").when(~D.is_object(doc), "not_object")
        return rows.select("file", "position", reason.alias("reason")).where("reason is not null")
    files = _whole_files(spark, path)
    broken = files.where("items is null").select(
        "file", F.lit(None).cast("bigint").alias("position"), F.when(F.col("value").rlike(r"^\s*$"), "empty").otherwise("invalid").alias("reason"))
    items = files.select("file", F.posexplode("items").alias("position", "item")).where(~D.is_object(F.col("item")))
    other = items.select("file", F.col("position").cast("bigint").alias("position"), F.lit("not_object").alias("reason"))
    return broken.unionByName(other)


def records_to_table(df: DataFrame, column: str, order_by: str | None = None) -> DataFrame:
    """JSON records as a table of text columns: all keys, in the order they first
    appear, NULL where a record lacks one. `order_by` is the record order."""
    order = F.col(quote(order_by)) if order_by else F.monotonically_increasing_id()
    keys = (
        df.select(order.alias("o"), F.posexplode(F.json_object_keys(F.col(quote(column)))).alias("p", "k"))
        .groupBy("k").agg(F.min(F.struct("o", "p")).alias("first")).orderBy("first").limit(D.MAX_NAMES + 1).collect()
    )
    if len(keys) > D.MAX_NAMES:
        raise ValueError(f"more than {D.MAX_NAMES} distinct keys: they look like data")
    rows = df.select(D.parse(column).alias("doc"))
    return rows.select(*[D.text_of(D.at(F.col("doc"), [r["k"]])).alias(r["k"]) for r in keys])


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    """The first rows."""
    return df.limit(n)
