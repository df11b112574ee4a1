"""Columns that are computed once, and the folder all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import quote


def compute(df: DataFrame, keep: list[str] | None = None, **columns: Column) -> DataFrame:
    """Add columns that later steps may use as often as they like.

    A plain projection is merged into the filters and projections above it, and its
    expression is then evaluated once per mention. Passing through a one-element
    `inline` keeps the values as they are; the rows stay in the same pipeline.
    """
    kept = ["*"] if keep is None else [F.col(quote(k)) for k in keep]
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*kept, F.inline(F.array(row)))


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`. Only a local session, which is one process, may go
    without: it gets one temporary folder, removed when the process ends."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if sc.applicationId not in _local:
        _local[sc.applicationId] = tempfile.mkdtemp(prefix="spark-shared-")
        atexit.register(shutil.rmtree, _local[sc.applicationId], ignore_errors=True)
    return _local[sc.applicationId]


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path below it."""
    return f"{shared_dir(spark)}/{name}-{os.urandom(6).hex()}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """A table written to the shared folder and read again: what it took is done once, and is
    not done again when an executor is lost."""
    path = fresh_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
