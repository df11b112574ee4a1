"""T2 with nothing lost: windowed statistics on time, and the rows that came too late.

A streaming window drops late rows without a trace. Here every micro-batch is split by the
watermark in force when it arrives, as the engine defines it: the largest event time of all earlier
batches less the delay. A row whose window ended by then is late and goes to the table `late`;
the others are counted, and the batch's counts go to `windows`, which is summed up when it is read. What a
batch writes depends on the batches before it alone and replaces what an earlier
attempt at it wrote, so every row is in exactly one of both tables, however often a batch is run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import quote


def _folder(base: str, name: str, batch: int | None = None) -> str:
    return f"{base.rstrip('/')}/{name}" + ("" if batch is None else f"/batch={batch}")


def _times(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema("latest timestamp, batch bigint").parquet(_folder(base, "times"))


def watermark(spark: SparkSession, base: str, delay: str, before: int | None = None) -> Column:
    """The watermark after the batches before one (or after all that were written), as a
    constant; NULL where there is none yet. One row a batch is read."""
    try:
        times = _times(spark, base)
    except Exception as e:  # no batch has been written
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return F.lit(None).cast("timestamp")
    if before is not None:
        times = times.where(F.col("batch") < before)
    return F.lit(times.agg(F.max("latest") - F.expr(f"INTERVAL {delay}")).first()[0]).cast("timestamp")


def split_batches(base: str, time: str, window: str, delay: str, *, value: str = "is_match", by: Sequence[str] = ("feature",)):
    """A `foreachBatch` function over rows with an event time and a verdict, such as
    `stream_cells` gives: late rows as they are, the others counted by window and `by`.

    `window` and `delay` are intervals such as "10 minutes". Rows without a time are late.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            span = F.window(F.col(quote(time)).cast("timestamp"), window)
            mark = watermark(spark, base, delay, batch_id)
            late = F.coalesce(F.col("window.end") <= mark, F.lit(False))
            rows = batch.where(F.col(quote(time)).isNotNull()).withColumn("window", span).withColumn("__late", late)
            untimed = batch.where(F.col(quote(time)).isNull())
            rows.where("__late").drop("window", "__late").union(untimed).write.mode("overwrite").parquet(_folder(base, "late", batch_id))
            ok = F.col(quote(value))
            counted = rows.where("NOT __late").groupBy("window", *[F.col(quote(b)) for b in by]).agg(
                F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("match"), F.count_if(~ok).alias("mismatch"))
            counted.write.mode("overwrite").parquet(_folder(base, "windows", batch_id))
            latest = batch.agg(F.max(F.col(quote(time)).cast("timestamp")).alias("latest"))
            latest.write.mode("overwrite").parquet(_folder(base, "times", batch_id))
        finally:
            batch.unpersist()

    return write


def read_windows(spark: SparkSession, base: str, delay: str | None = None, by: Sequence[str] = ("feature",)) -> DataFrame:
    """The counts of all batches: window, the `by` columns, total, match, mismatch. With `delay` only
    windows that the watermark has passed, which no later row changes."""
    parts = spark.read.parquet(_folder(base, "windows"))
    if delay is not None:
        parts = parts.where(F.col("window.end") <= watermark(spark, base, delay))
    return parts.groupBy("window", *[F.col(quote(b)) for b in by]).agg(*[F.sum(c).alias(c) for c in ("total", "match", "mismatch")])


def read_late(spark: SparkSession, base: str) -> DataFrame:
    """The rows that came too late, with their `batch`."""
    return spark.read.parquet(_folder(base, "late"))
