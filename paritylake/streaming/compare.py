"""Compare arriving responses with a static table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import cells_equal
from ..functions.text import quote
from ..operators import documents as D
from ..operators import keys as K
from ..operators.skew import HotKeys, lookup_join
from ..operators.stage import compute

STATUS_ERROR = "error"


def parse_stream(stream: DataFrame, body: str = "body", error: str | None = None) -> DataFrame:
    """Add the parsed `doc` and an `error`: the given column, an `_error` member, or text
    that is no JSON object."""
    doc = F.col("doc")
    given = F.col(quote(error)).cast("string") if error else F.lit(None).cast("string")
    why = F.coalesce(
        given,
        F.when(~D.is_object(doc), "response is no JSON object"),
        D.text_of(D.at(doc, ["_error"])),
    )
    out = compute(stream, doc=D.parse(body))
    return out.withColumn(STATUS_ERROR, why)


def stream_keys(stream: DataFrame, left: DataFrame, names: Sequence[str]) -> tuple[list[str], list[Column], list[Column]]:
    """Names of the key parts, and their columns on both sides."""
    sfields = {f.name: f for f in stream.schema.fields}
    lfields = {f.name: f for f in left.schema.fields}
    scols, lcols, _ = K.key_columns([sfields[n] for n in names], [lfields[n] for n in names], "all")
    return [f"__k{i}" for i in range(len(names))], scols, lcols


def stream_cells(
    stream: DataFrame, left: DataFrame, keys: Sequence[str], features: Sequence[str], *,
    catalog: D.Catalog, body: str = "body", carry: Sequence[str] = (), ignore_default_fill: bool = False,
    error: str | None = None, hot: HotKeys = HotKeys(),
) -> DataFrame:
    """One row per compared cell of every successful response: keys, `carry` columns,
    feature, left_value, right_value, is_match.

    The static side should be bucketed on the keys when it is large: it takes part in
    every micro-batch. `catalog` holds the response paths (`documents.discover` on
    stored responses); fields are looked up as J7 does. Responses of `hot` keys are dealt out, and the static rows
    of those keys copied; see `balanced_batches`.
    """
    names = list(keys)
    parsed = parse_stream(stream, body, error).where(F.col(STATUS_ERROR).isNull())
    k, scols, lcols = stream_keys(stream, left, names)
    doc, text = F.col("doc"), F.col(quote(body))
    values = {f"r{i}": D.lookup(doc, f, catalog, text) for i, f in enumerate(features)}
    # a projection that drops `doc` would be taken for 2 kB a row smaller, and a batch of any size broadcast
    right = compute(parsed.withColumns(dict(zip(k, scols))), keep=[*k, *carry], **values)
    mine = left.select(
        *[c.alias(n) for c, n in zip(lcols, k)],
        *[F.col(quote(f)).cast("string").alias(f"l{i}") for i, f in enumerate(features)],
    )
    joined = lookup_join(right.where(K.has_key(k)), mine.where(K.has_key(k)), k, "inner", hot)
    cells = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"l{i}").alias("l"), F.col(f"r{i}").alias("r"))
        for i, f in enumerate(features)
    ])
    out = joined.select(*k, *[quote(c) for c in carry], F.explode(cells).alias("c"))
    return out.select(
        *[F.col(a).alias(n) for a, n in zip(k, names)], *[quote(c) for c in carry],
        F.col("c.feature").alias("feature"), F.col("c.l").alias("left_value"),
        F.col("c.r").alias("right_value"),
        cells_equal(F.col("c.l"), F.col("c.r"), ignore_default_fill=ignore_default_fill).alias("is_match"),
    )


def compare_stream(stream: DataFrame, left: DataFrame, keys, features, **options) -> DataFrame:
    """The differing cells only; append mode."""
    return stream_cells(stream, left, keys, features, **options).where(~F.col("is_match")).drop("is_match")


def stream_feature_stats(
    cells: DataFrame, *, time: str | None = None, window: str | None = None, watermark: str | None = None,
) -> DataFrame:
    """Running total, match and mismatch per feature (complete or update mode), or
    per event-time window with a watermark (append mode). Rows that come later than the
    watermark allows are left out of their window, so its length has no default."""
    groups: list[Column] = [F.col("feature")]
    if window is not None:
        if time is None or watermark is None:
            raise ValueError("a window needs the time column and a watermark")
        cells = cells.withWatermark(time, watermark)
        groups.insert(0, F.window(F.col(quote(time)), window).alias("window"))
    return cells.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_match").alias("match"),
        F.count_if(~F.col("is_match")).alias("mismatch"),
    )


def stream_last(stream: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The last row per key so far (update mode); state is one row per key."""
    rest = [c for c in stream.columns if c not in keys]
    row = F.struct(*[F.col(quote(c)) for c in rest])
    order = F.struct(*[F.col(quote(c)) for c in order_by], F.xxhash64(*[F.col(quote(c)) for c in rest]))
    last = stream.groupBy(*[F.col(quote(k)) for k in keys]).agg(F.max_by(row, order).alias("__row"))
    return last.select(*[quote(k) for k in keys], "__row.*")


def stream_errors(stream: DataFrame, body: str = "body", error: str | None = None) -> DataFrame:
    """T4: the failed responses with their `error`."""
    return parse_stream(stream, body, error).where(F.col(STATUS_ERROR).isNotNull()).drop("doc")


def write_batches(tables: dict[str, object], base_path: str):
    """A `foreachBatch` function: apply each named function to the micro-batch and write
    its result to `base_path`/<name>/batch=<id>. A batch that is run again overwrites its
    own folder, so every row is written once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        shared = len(tables) > 1
        if shared:
            batch.persist()
        try:
            for name, make in tables.items():
                target = f"{base_path.rstrip('/')}/{name}/batch={batch_id}"
                make(batch).write.mode("overwrite").parquet(target)
        finally:
            if shared:
                batch.unpersist()

    return write


def read_last(spark, path: str, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The last row per key over all batches that `stream_last` results were written to
    with `write_batches`; later batches win."""
    return K.dedupe_last(spark.read.parquet(path), list(keys), ["batch", *order_by])
