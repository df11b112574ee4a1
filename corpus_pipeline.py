"""A corpus pipeline in stages; each calls one operator and hands a table on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paritylake.llm import decontaminate, jaccard, packing, quality, suffix_dedup
from paritylake.llm.common import each, freed, gathered, table, written
from paritylake.llm.queries import tokenizer_path

DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of the production policy."""
    return quality.apply_policy(quality.ledger(docs, keep=DOC_COLUMNS)).where("kept").select(*DOC_COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar documents: that with the smallest id. Rows
    that are equal in every column count as one document; rows without an id stay."""
    found = jaccard.join(docs).select(F.col("doc_id").alias("__id"), F.col("component_id").alias("__first")).where("__id <> __first").distinct()
    drop = written(gathered(found.select("__id")), "near-duplicates")
    kept = docs.join(drop, F.col("doc_id") == F.col("__id"), "left_anti").select(*DOC_COLUMNS)
    twice = written(gathered(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND doc_id IS NOT NULL").select("doc_id")), "repeated-ids")
    return kept.join(twice, "doc_id", "left_anti").select(*DOC_COLUMNS).union(kept.join(twice, "doc_id", "left_semi").dropDuplicates().select(*DOC_COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that documents with smaller ids hold. A character whose
    bytes are cut apart goes whole; n_chars is counted anew."""
    kept = suffix_dedup.dedup(docs.select(*DOC_COLUMNS), with_kept=True)
    names = [c for c in DOC_COLUMNS if c not in ("text", "n_chars")]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(lo, 1000) for whole in batches for lo in range(0, whole.num_rows, 1000)):
            text = [t.decode("utf-8", "ignore") for t in each(b.column("kept"))]
            columns = {"text": pa.array(text, pa.string()), "n_chars": pa.array(map(len, text), pa.int64())}
            yield pa.RecordBatch.from_arrays([columns[c] if c in columns else b.column(c) for c in DOC_COLUMNS], names=list(DOC_COLUMNS))

    types = dict(docs.select(*names).dtypes) | {"text": "string", "n_chars": "bigint"}
    return kept.select("kept", *names).mapInArrow(freed(decode), ", ".join(f"{c} {types[c]}" for c in DOC_COLUMNS))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    found = decontaminate.find(docs.select(*DOC_COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where("n_hit = 0").select(*DOC_COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens. Portions are small, as the workers have been through all other stages."""
    return packing.pieces(docs, tokenizer_path(), portion=5_000_000, keep_tokenizer=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontaminated),
    ("packing", packed),
]

#: The tokenizer and the packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
