"""What the operators of this package share."""

from __future__ import annotations

import ctypes
import functools
import os
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stage import fresh_dir
from .hashing import drop_powers

#: White space and word characters as the queries' contracts fix them.
ASCII_SPACE = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share, as a URI."""
    path = fresh_dir(spark, name)
    return path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}"


def written(df: DataFrame, name: str, codec: str = "zstd", by: Sequence[str] = ()) -> DataFrame:
    """Write a table to the shared folder and read it: the lineage ends there, and a lost
    executor costs nothing that was done before."""
    path = shared_path(df.sparkSession, name)
    out = df.write.option("compression", codec)
    (out.partitionBy(*by) if by else out).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def gathered(df: DataFrame) -> DataFrame:
    """A table of narrow rows that an aggregate or distinct ends, in an eighth of the shuffle partitions, but 8 at least.
    A partition as large as texts need holds few such rows, and written each takes a file, for which Hadoop without its
    native library starts several processes. Not for what a join ends: its hot keys stay dealt out."""
    return df.coalesce(max(8, partitions(df.sparkSession) // 8))


def distinct_words(data: np.ndarray, inside: np.ndarray, first: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct words of some text bytes, and which of them each word is. `inside` marks the bytes of
    words, `first` the first byte of each; a word's bytes follow each other."""
    offsets = np.append(np.flatnonzero(first[inside]), np.count_nonzero(inside)).astype(np.int64)
    every = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    found = every.dictionary_encode()
    return found.dictionary, found.indices.to_numpy().astype(np.int64)


def each(values: pa.Array) -> Iterator[object]:
    """The values one by one, so that only one text of a batch is a Python object at a time."""
    return (v.as_py() for v in values)


def freed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task function whose worker gives its free memory back when the task ends; workers outlive
    tasks, and what one stage had at its peak is missed by the next."""

    @functools.wraps(run)
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            drop_powers()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return fn
