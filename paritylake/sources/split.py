"""Large files whose records do not end at line ends, read by many tasks.

Spark deals a file out in byte ranges and gives each task the pieces (lines, or text up to a
closing brace) that start in its range. Whether a piece starts inside a quoted cell, a
string or an array depends on all text before it. So the file is read twice:

1. Each range tells how it would end from either start: outside or inside quotes. That is a
   function of one bit; a window over a file's ranges composes those functions, which gives the
   true start of every range.
2. Each range is cut into records from its true start. What stands before its first and after its
   last cut is put together with the neighbours' parts; that is at most two pieces a range.

The table of starts holds one small row for each range but a file's first one, that is, for each
`spark.sql.files.maxPartitionBytes` of a large file: 16 bytes for 128 MB, so it is broadcast.
It is written to the shared folder. Should Spark cuts ranges otherwise the second time (where
the number of cores changes and `spark.sql.files.minPartitionNum` is unset), the read fails.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.stage import stored

_BOM = b"\xef\xbb\xbf"
_OUT = 2_000  # rows of one batch that is handed on


def pieces(spark: SparkSession, path, end: str) -> DataFrame:
    """(file, block, size, value): the text between two `end`s, in the order of each range."""
    return spark.read.option("lineSep", end).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"))


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """((file, block, size), rows) of each range, batch by batch."""
    for b in batches:
        if not b.num_rows:
            continue
        file, block = b.column("file").dictionary_encode(), b.column("block").to_numpy()
        at = file.indices.to_numpy()
        cuts = np.flatnonzero((at[1:] != at[:-1]) | (block[1:] != block[:-1])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
            some = b.slice(lo, hi - lo)
            yield (some.column("file")[0].as_py(), int(block[lo]), some.column("size")[0].as_py()), some


def _range_key() -> Column:
    return F.xxhash64("file", "block")


def _true_starts(told: DataFrame) -> DataFrame:
    """Add `inside`: whether the range starts inside quotes, from what each range would do."""
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    constant, turns = F.col("out_end") == F.col("in_end"), F.col("out_end") & ~F.col("in_end")
    told = told.withColumn("turned", F.sum(turns.cast("int")).over(order))
    last = F.max(F.when(constant, F.struct("block", "out_end", "turned"))).over(before)
    sum_before = F.coalesce(F.sum(turns.cast("int")).over(before), F.lit(0))
    odd = (sum_before - F.coalesce(F.col("last.turned"), F.lit(0))) % 2 == 1
    return told.withColumn("last", last).withColumn("inside", F.coalesce(F.col("last.out_end"), F.lit(False)) != odd).drop("last", "turned")


def _with_starts(found: DataFrame, starts: DataFrame, *columns: str) -> DataFrame:
    """Pieces with their range's start; a later range without one was not seen the first time."""
    late = starts.where("block > 0").select(_range_key().alias("__range"), *columns)
    dealt = found.join(F.broadcast(late), _range_key() == F.col("__range"), "left").drop("__range")
    moved = (F.col("block") > 0) & F.col(columns[0]).isNull()
    failed = F.raise_error(F.lit("the file's ranges changed between two reads; set spark.sql.files.minPartitionNum"))
    return dealt.withColumn(columns[0], F.when(moved, failed.cast("boolean")).otherwise(F.col(columns[0])))


# --- quoted line breaks ------------------------------------------------------------------

def ends_inside(line: bytes, inside: bool, sep: bytes = b",") -> bool:
    """Whether a quoted cell is open at the line's end. A quote opens a cell only as its first
    character; a doubled one within it is text; one followed by other text ends the quoting."""
    at = 0
    while True:
        if not inside:
            if line[at : at + 1] != b'"':
                at = line.find(sep + b'"', at)
                if at < 0:
                    return False
                at += len(sep)
            at += 1
        at = line.find(b'"', at)
        if at < 0:
            return True
        inside = line[at + 1 : at + 2] == b'"'
        at += 2
        if not inside:
            at = line.find(sep, at - 1)
            if at < 0:
                return False
            at += len(sep)


def _csv_ranges(found: DataFrame, sep: bytes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "block", "out_end", "in_end", "in_starts", "crlf"]
        told: tuple | None = None
        ends, starts, crlf = [False, True], False, False

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in (*told[:2], *ends, starts, crlf)], names=names)

        for key, some in _by_range(batches):
            if told is not None and told != key:
                yield out()
            value = some.column("value")
            if told != key:
                told, ends, starts, crlf = key, [False, True], False, value[0].as_py().endswith(b"\r")
            for line in value.filter(pc.match_substring(value, b'"')).to_pylist():  # others change nothing
                starts = starts or not ends[1]
                ends = [ends_inside(line, e, sep) for e in ends]
            starts = starts or not ends[1]
        if told is not None:
            yield out()

    return found.mapInArrow(run, "file string, block bigint, out_end boolean, in_end boolean, in_starts boolean, crlf boolean")


_PARTS = "file string, block bigint, no bigint, begin string, end string, value binary"
_KINDS = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())


def _part_batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows as a batch; the list is empty after it."""
    made = [pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)]
    rows.clear()
    return pa.RecordBatch.from_arrays(made, names=["file", "block", "no", "begin", "end", "value"])


def _csv_parts(found: DataFrame, sep: bytes) -> DataFrame:
    """Records, with begin and end set, and the parts of those that cross ranges, without one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, inside, crlf, begun, no, held = None, False, False, "^", 0, []
        for now, some in _by_range(batches):
            if now != key:
                if held:
                    out.append((*key[:2], no, begun, None, b"\n".join(held)))
                key, no, held = now, 0, []
                inside = bool(some.column("inside")[0].as_py())
                begun = None if inside else "^"
                crlf = bool(some.column("crlf")[0].as_py()) if now[1] else some.column("value")[0].as_py().endswith(b"\r")
            value = some.column("value")
            quoted = pc.match_substring(value, b'"').to_numpy(zero_copy_only=False)
            for line, has in zip(value.to_pylist(), quoted):
                if crlf:
                    line = line.removesuffix(b"\r")
                if has:
                    inside = ends_inside(line, inside, sep)
                held.append(line)
                if not inside:
                    out.append((*key[:2], no, begun, "$", b"\n".join(held) if len(held) > 1 else line))
                    no, held, begun = no + 1, [], "^"
                    if len(out) >= _OUT:
                        yield _part_batch(out)
        if held:
            out.append((*key[:2], no, begun, None, b"\n".join(held)))
        if out:
            yield _part_batch(out)

    return found.mapInArrow(run, _PARTS)


def _whole(parts: DataFrame, starts: DataFrame, glue: str) -> DataFrame:
    """Records whole: parts of one that crosses ranges go to the range where it starts."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    owner = starts.select("file", "block", F.max(F.when(F.col("has_start"), F.col("block"))).over(before).alias("owner"))
    late = owner.where("owner IS NOT NULL").select(_range_key().alias("__range"), "owner")
    inner = F.col("begin").isNotNull() & F.col("end").isNotNull()
    dealt = parts.where(~inner).join(F.broadcast(late), _range_key() == F.col("__range"), "left")
    dealt = dealt.withColumn("home", F.when(F.col("begin").isNotNull() | F.col("owner").isNull(), F.col("block")).otherwise(F.col("owner")))
    in_order = F.sort_array(F.collect_list(F.struct("block", "no", F.decode("value", "ISO-8859-1").alias("value"))))
    joined = dealt.groupBy("file", "home").agg(
        F.max(F.when(F.col("begin").isNotNull(), F.col("no"))).alias("no"), F.max("begin").alias("begin"), F.max("end").alias("end"), in_order.alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["value"]), glue)
    crossing = joined.select("file", F.col("home").alias("block"), F.coalesce("no", F.lit(0)).alias("no"), "begin", "end", F.encode(text, "ISO-8859-1").alias("value"))
    return parts.where(inner).select(*crossing.columns).union(crossing)


def csv_records(spark: SparkSession, path, *, sep: str = ",") -> DataFrame:
    """(file, block, no, value): the bytes of each record of CSV files, in which quoted cells
    may hold line breaks, separators and doubled quotes. block and no give the record's place.

    Records end at \\n or \\r\\n; where the first line of a file ends with \\r\\n, line breaks within cells become
    \\n, as elsewhere in Spark. For text whose line breaks, quotes and separators are single bytes
    that occur in no other character, as in UTF-8, Latin and GBK text. A cell that is never
    closed runs to the end of its file. A record must fit into memory; files need not.
    """
    mark = sep.encode()
    found = pieces(spark, path, "\n")
    starts = _true_starts(_csv_ranges(found, mark))
    starts = starts.withColumn("crlf", F.min_by("crlf", "block").over(Window.partitionBy("file")))
    starts = stored(starts.select("file", "block", "inside", "crlf", (~F.col("inside") | F.col("in_starts")).alias("has_start")), "csv-ranges")
    parts = _csv_parts(_with_starts(found, starts, "inside", "crlf"), mark)
    return _whole(parts, starts, "\n").select("file", "block", "no", "value")


# --- arrays of documents -----------------------------------------------------------------

def _quotes(data: np.ndarray) -> np.ndarray:
    """Where a string opens or closes: quotes after an even number of backslashes."""
    at = np.flatnonzero(data == 34)
    slash = data == 92
    if slash.any() and len(at):
        place = np.arange(len(data))
        last = np.maximum.accumulate(np.where(slash, -1, place))  # the last other byte up to here
        before = np.where(at > 0, at - 1 - last[at - 1], 0)
        at = at[before % 2 == 0]
    return at


def _levels(data: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """(places of brackets and commas outside strings, +1, -1 or 0 of each, whether a string is open at the end)."""
    quote = _quotes(data)
    at = np.flatnonzero(np.isin(data, np.frombuffer(b"[]{},", np.uint8)))
    at = at[(np.searchsorted(quote, at) + inside) % 2 == 0]
    kind = data[at]
    step = ((kind == 91) | (kind == 123)).astype(np.int64) - ((kind == 93) | (kind == 125))
    return at, step, bool((len(quote) + inside) % 2)


def _json_ranges(found: DataFrame) -> DataFrame:
    """What each range does from either start: its end, its levels, the lowest level of a comma
    and of a closing bracket; its bytes; and the first character of a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "block", "size", "bytes", "first", "out_end", "in_end", "out_level", "in_level", "out_comma", "in_comma", "out_low", "in_low"]
        key, n, first, state = None, 0, None, []

        def out() -> pa.RecordBatch:
            each = [[s[k] for s in state] for k in ("end", "level", "comma", "low")]
            row = (*key, n, first, *[v for pair in each for v in pair])
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()] + [pa.int64()] * 6
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

        for now, some in _by_range(batches):
            if now != key:
                if key is not None:
                    yield out()
                key, n, first = now, 0, None
                state = [{"end": e, "level": 0, "comma": None, "low": None} for e in (False, True)]
            text = b"}".join(some.column("value").to_pylist()) + b"}"
            n += len(text)
            if first is None:
                first = (text.removeprefix(_BOM) if not now[1] else text).lstrip()[:1].decode("latin-1") or None
            data = np.frombuffer(text, np.uint8)
            for s in state:
                at, step, s["end"] = _levels(data, s["end"])
                after = s["level"] + np.cumsum(step)
                for name, some_of in (("comma", step == 0), ("low", step < 0)):
                    if some_of.any():
                        least = int(after[some_of].min())
                        s[name] = least if s[name] is None else min(s[name], least)
                s["level"] = int(after[-1]) if len(after) else s["level"]
        if key is not None:
            yield out()

    return found.mapInArrow(run, "file string, block bigint, size bigint, bytes bigint, first string, out_end boolean, in_end boolean, "
                                 "out_level bigint, in_level bigint, out_comma bigint, in_comma bigint, out_low bigint, in_low bigint")


def _json_parts(found: DataFrame) -> DataFrame:
    """Segments between the cuts of an array: its brackets, and the commas between its items. begin and
    end name the cuts, `^` the start of the file; what is no array has no cuts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, n, no, begin, held = None, 0, 0, None, []
        inside, level, array, extra = False, 0, None, False

        def close() -> None:
            artificial = n == key[2] + 1 if not key[1] else extra  # the file does not end with a brace
            text = b"".join(held)
            out.append((*key[:2], no, begin, None, text[:-1] if artificial else text))

        for now, some in _by_range(batches):
            if now != key:
                if key is not None:
                    close()
                key, n, no, held = now, 0, 0, []
                begin = None if now[1] else "^"
                inside, level, array, extra = (some.column(c)[0].as_py() for c in ("inside", "level", "array", "extra"))
                if not now[1]:
                    inside, level, array, extra = False, 0, None, False
            text = b"}".join(some.column("value").to_pylist()) + b"}"
            n += len(text)
            if array is None:
                first = text.removeprefix(_BOM).lstrip()[:1]
                array = first == b"[" if first else None
            lo = 0
            if array:
                data = np.frombuffer(text, np.uint8)
                at, step, inside = _levels(data, inside)
                after = level + np.cumsum(step)
                kind = data[at]
                cut = ((kind == 91) & (after == 1)) | ((step == 0) & (after == 1)) | ((kind == 93) & (after == 0))
                level = int(after[-1]) if len(after) else level
                for c in at[cut].tolist():
                    held.append(text[lo:c])
                    mark = chr(text[c])
                    out.append((*key[:2], no, begin, mark, held[0] if len(held) == 1 else b"".join(held)))
                    no, begin, held, lo = no + (begin is not None), mark, [], c + 1
                    if len(out) >= _OUT:
                        yield _part_batch(out)
            held.append(text[lo:])
        if key is not None:
            close()
        if out:
            yield _part_batch(out)

    return found.mapInArrow(run, _PARTS)


def json_segments(spark: SparkSession, path) -> DataFrame:
    """(file, block, no, begin, end, value): files of JSON cut at the brackets and commas of their
    outermost array, with the cuts' names; a file that is no array is one segment.

    A file is cut into ranges at closing braces, so that the objects of an array may
    stand on one line of any length; a stretch without a brace must fit into memory.
    """
    found = pieces(spark, path, "}")
    told = _true_starts(_json_ranges(found))
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    of = lambda name: F.when(F.col("inside"), F.col("in_" + name)).otherwise(F.col("out_" + name))
    told = told.withColumn("level", F.coalesce(F.sum(of("level")).over(before), F.lit(0)))
    every = Window.partitionBy("file")
    first = F.min(F.when(F.col("first").isNotNull(), F.struct("block", "first"))).over(every)["first"]
    last = (F.col("block") == F.max("block").over(every)) & (F.sum("bytes").over(every) == F.col("size") + 1)
    cut = (F.col("block") == 0) | (F.col("level") <= 0) | (F.col("level") + of("comma") <= 1) | (F.col("level") + of("low") <= 0)
    starts = told.select("file", "block", "inside", "level", F.coalesce(first == "[", F.lit(False)).alias("array"), last.alias("extra"),
                         F.coalesce(cut, F.lit(False)).alias("has_start"))
    starts = stored(starts, "json-ranges")
    starts = starts.withColumn("has_start", F.col("has_start") & (F.col("array") | (F.col("block") == 0)))
    parts = _json_parts(_with_starts(found, starts, "inside", "level", "array", "extra"))
    return _whole(parts, starts, "")
