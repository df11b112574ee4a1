"""The catalogue of a document set as a table that can be stored and merged.

One row per path: the kinds of values seen there as a bit set, and how many there were. Both
are sums that may be taken in any order, so the catalogue of old and new documents is
the merge of theirs, and no document is read twice. No list of names comes to the driver,
so there may be as many paths as there are documents; `long_cells` gives the values of such
documents without a column per path.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import quote
from . import documents as D
from .stage import compute, stored

#: The bit of each kind of value.
KINDS = {"object": 1, "list": 2, "null": 4, "bool": 8, "whole": 16, "plain": 32}
_OPEN = 64  # a node below the depth that was read


def _bit(kind: Column) -> Column:
    out = F.lit(_OPEN)
    for name, bit in KINDS.items():
        out = F.when(kind == name, bit).otherwise(out)
    return out.cast("int")


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("path").agg(F.bit_or("kinds").alias("kinds"), F.sum("values").alias("values"))


def catalogue(docs: DataFrame, doc: str, *, arrays: bool = False, depth: int = 4, max_depth: int = 128) -> DataFrame:
    """(path, kinds, values) of a parsed document column, written to the shared folder.

    A path is an array of steps, "." + key for members and "[]" for list items. One distinct-like
    aggregation; documents nested deeper than `depth` are read again with twice the depth.
    """
    while True:
        rows = D.path_rows(docs, doc, depth, arrays).select("path", _bit(F.col("kind")).alias("kinds"), F.lit(1).cast("bigint").alias("values"))
        found = stored(_summed(rows), "catalogue")
        if found.where(F.col("kinds").bitwiseAND(_OPEN) != 0).isEmpty():
            return found
        if depth >= max_depth:
            raise ValueError(f"documents nested deeper than {max_depth} levels")
        depth = min(depth * 2, max_depth)


def merge_catalogues(*tables: DataFrame) -> DataFrame:
    """The catalogue of all documents whose catalogues are given."""
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t.select(*out.columns))
    return _summed(out)


def _fields(found: DataFrame, envelope: Sequence[str]) -> DataFrame:
    """(leaf, dotted, path) of the paths that count as fields, as `documents.feature_paths` does."""
    size, top, last = F.size("path"), F.expr("substr(path[0], 2)"), F.expr("path[size(path) - 1]")
    inside = (top == "data") & (size > 1)
    bare = (F.col("path") == F.array(F.lit(".data"), F.lit(".features"))) & (F.col("kinds") == KINDS["object"])
    rows = found.where((size > 0) & (last != "[]")).where((~top.isin(*envelope) | inside) & ~bare)
    names = F.transform(F.filter("path", lambda s: s != "[]"), lambda s: F.substr(s, F.lit(2)))
    return rows.select(F.substr(last, F.lit(2)).alias("leaf"), F.array_join(names, ".").alias("dotted"), "path")


def field_table(found: DataFrame, envelope: Sequence[str] = D.ENVELOPE) -> DataFrame:
    """J5 from a catalogue: field, paths."""
    return _fields(found, envelope).groupBy(F.col("leaf").alias("field")).agg(F.count(F.lit(1)).alias("paths"))


def path_table(found: DataFrame, envelope: Sequence[str] = D.ENVELOPE) -> DataFrame:
    """J6 from a catalogue: name, path. Of paths that share a leaf name the first by spelling takes
    it, the others go by their full path.

    The first path is found by an aggregate, so a name that a third of all paths share is no
    hot group.
    """
    fields = _fields(found, envelope)
    first = fields.groupBy("leaf").agg(F.min(F.struct("dotted", "path")).alias("first"))
    own = first.select(F.col("leaf").alias("name"), F.col("first.dotted").alias("path"), F.col("first.path").alias("steps"))
    others = fields.join(own.select(F.col("steps").alias("path")), "path", "left_anti")
    return own.select("name", "path").union(others.select(F.col("dotted").alias("name"), F.col("dotted").alias("path")))


def long_cells(df: DataFrame, doc: str, keep: Sequence[str], *, arrays: bool = False, depth: int = 8) -> DataFrame:
    """One row per leaf: the kept columns, path (dotted) and value as text. For documents with more
    names than a table may have columns. A value nested deeper than `depth` is its JSON text."""
    spark = df.sparkSession
    kept = [f"__c{i}" for i in range(len(keep))]
    v = F.col(quote(doc))
    rows = df.where(v.isNotNull()).select(*[F.col(quote(c)).alias(n) for c, n in zip(keep, kept)], v.alias("node"), F.array().cast("array<string>").alias("path"))
    rows = compute(rows, type=F.schema_of_variant("node"))
    for _ in range(depth):
        opened = F.when(D._open_type(F.col("type"), F.col("node"), arrays), F.col("node"))
        rows = rows.select(*kept, "path", "node", "type", opened.alias("open"))
        rows = rows.lateralJoin(spark.tvf.variant_explode_outer(F.col("open").outer()))
        stepped = F.col("pos").isNotNull()
        step = F.coalesce(F.concat(F.lit("."), F.col("key")), F.lit("[]"))
        rows = compute(
            rows, kept, node=F.when(stepped, F.col("value")).otherwise(F.col("node")),
            path=F.when(stepped, F.array_append("path", step)).otherwise(F.col("path")),
            type=F.when(stepped, F.schema_of_variant("value")).otherwise(F.col("type")))
    names = F.transform(F.filter("path", lambda s: s != "[]"), lambda s: F.substr(s, F.lit(2)))
    return rows.select(*[F.col(n).alias(c) for n, c in zip(kept, keep)], F.array_join(names, ".").alias("path"), D.text_of(F.col("node")).alias("value"))


__all__ = ["KINDS", "catalogue", "field_table", "long_cells", "merge_catalogues", "path_table"]
