"""Add response features to input rows (E1, E2). Responses are a table, one or more
rows per key; the last one counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import float_text, to_double
from ..functions.text import clean, quote
from . import documents as D
from . import keys as K
from .skew import SkewPolicy, find_hot_keys, lookup_join
from .stage import compute, stored


def render(v: Column, convert: bool = False, kinds: frozenset[str] = D.ANY_KIND) -> Column:
    """V5: a response value as text; missing is `null`, nested is JSON text. `kinds` as
    in `documents.text_of`."""
    text = D.text_of(v, kinds)
    if convert:
        s = F.schema_of_variant(v)
        scalar = ~(s.startswith("OBJECT<") | s.startswith("ARRAY<") | (s == "BOOLEAN"))
        x = F.when(scalar, to_double(text))
        text = F.when(x.isNotNull(), float_text(x)).otherwise(text)
    return F.coalesce(text, F.lit("null"))


def _attach(df: DataFrame, responses: DataFrame, keys, response_keys, body: str, order_by,
            skew: SkewPolicy) -> DataFrame:
    """Left join of the last response per key: adds `__doc`, `__error` and, unless the responses are parsed
    already (`_parsed`), `__body`."""
    names = df.columns
    lk = K.resolve_all(names, keys)
    rk = K.resolve_all(responses.columns, response_keys if response_keys is not None else [names[i] for i in lk])
    fields = df.schema.fields
    k = [f"__k{i}" for i in range(len(lk))]
    lcols, rcols, _ = K.key_columns(
        [fields[i] for i in lk], [responses.schema.fields[i] for i in rk], "all"
    )
    rows = df.select("*", *[c.alias(n) for c, n in zip(lcols, k)])
    have_error, parsed = "error" in responses.columns, "__doc" in responses.columns
    order = list(order_by)
    shown = [F.col("__doc"), F.col("__shaped")] if parsed else [F.col(quote(body)).cast("string").alias("__body")]
    looked = responses.select(
        *[c.alias(n) for c, n in zip(rcols, k)], *shown,
        (F.col("error") if have_error else F.lit(None)).cast("string").alias("__failed"),
        *[F.col(quote(o)).alias(f"__o{i}") for i, o in enumerate(order)],
    ).where(K.has_key(k))
    looked = K.dedupe_last(looked, k, [f"__o{i}" for i in range(len(order))]).drop(
        *[f"__o{i}" for i in range(len(order))]
    )
    hot = find_hot_keys(rows.select(*k), k, skew)
    looked = looked.withColumn("__seen", F.lit(True))
    joined = lookup_join(rows, looked, k, "left", hot)
    if not parsed:
        joined = compute(joined, __doc=D.parse("__body"))
    doc, shaped = F.col("__doc"), F.coalesce(F.col("__shaped") if parsed else clean("__body").startswith("{"), F.lit(False))
    error = (
        F.when(F.col("__seen").isNull(), "no response")
        .when(F.col("__failed").isNotNull(), F.col("__failed"))
        .when(doc.isNull() | ~shaped, "response is no JSON object")
        .when(D.at(doc, ["_error"]).isNotNull(), D.text_of(D.at(doc, ["_error"])))
    )
    return compute(joined, __error=error)


def _parsed(responses: DataFrame, body: str) -> DataFrame:
    """Responses with `__doc` and `__shaped` for their body, written: names and values are read from
    one parse of each body."""
    rest = [c for c in responses.columns if c != body]
    return stored(compute(responses, rest, __doc=D.parse(body), __shaped=clean(body).startswith("{")), "parsed-responses")


def _documents(responses: DataFrame, body: str) -> DataFrame:
    docs = responses
    if "error" in responses.columns:
        docs = docs.where(F.col("error").isNull())
    if "__doc" in responses.columns:
        return docs.where(F.col("__shaped") & F.col("__doc").isNotNull() & D.at(F.col("__doc"), ["_error"]).isNull())
    shaped = clean(body).startswith("{")
    docs = compute(docs, keep=[], __doc=F.when(shaped, D.parse(body)))
    return docs.where(F.col("__doc").isNotNull() & D.at(F.col("__doc"), ["_error"]).isNull())


def enrich(
    df: DataFrame, responses: DataFrame, keys, *, features: int | Sequence[K.Ref], body: str = "body",
    response_keys=None, order_by=(), convert: bool = False, catalog: D.Catalog | None = None,
    skew: SkewPolicy = SkewPolicy(),
) -> DataFrame:
    """Overwrite feature columns with response values, then append every response field.

    Values are found as in `documents.lookup`; a missing one is the text `null`. Rows
    whose response failed keep their values, have empty appended fields and an `error`.
    The column `pt` is never overwritten.
    """
    names = df.columns
    catalog = catalog or D.discover(_documents(responses, body), "__doc")
    if isinstance(features, int):
        targets = list(range(features, len(names)))
    else:
        targets = K.resolve_all(names, features)
    rows = _attach(df, responses, keys, response_keys, body, order_by, skew)
    doc, failed = F.col("__doc"), F.col("__error").isNotNull()
    kinds = catalog.value_kinds()
    out = []
    for i, n in enumerate(names):
        c = F.col(quote(n))
        if i in targets and n.lower() != "pt":
            value = render(D.lookup_node(doc, n, catalog, F.col("__body")), convert, kinds)
            c = F.when(failed, c.cast("string")).otherwise(value)
        out.append(c.alias(n))
    paths = D.path_names(catalog)
    leaves = sorted({D.names_of(p)[-1] for p in D.feature_paths(catalog)})
    for leaf in leaves:
        value = render(D.at(doc, D.names_of(paths[leaf])), convert, kinds)
        name = leaf if leaf not in names else f"{leaf}_response"
        out.append(F.when(failed, F.lit("")).otherwise(value).alias(name))
    return rows.select(*out, F.col("__error").alias("error"))


def batch_enrich(
    df: DataFrame, responses: DataFrame, keys, *, keep: Sequence[K.Ref] | None = None, body: str = "body",
    response_keys=None, order_by=(), features: Sequence[str] | None = None,
    skew: SkewPolicy = SkewPolicy(),
) -> tuple[DataFrame, list[str]]:
    """Kept input columns plus the sorted union of the unwrapped response features.

    Failed rows have empty features and an `error`. The second result is the list of
    features, learned from the responses unless given.
    """
    if features is None:
        if response_keys is not None:  # by name, as the body column goes
            response_keys = [responses.columns[i] for i in K.resolve_all(responses.columns, response_keys)]
        responses = _parsed(responses, body)
        inner = _documents(responses, body).select(D.unwrap("__doc").alias("node"))
        members = F.try_variant_get("node", "$", "map<string,variant>")
        features = D.distinct_names(inner.select(F.explode(F.map_keys(members))))
    rows = _attach(df, responses, keys, response_keys, body, order_by, skew)
    kept = K.keep_columns(df, keep).columns
    node = D.unwrap("__doc")
    values = [
        F.coalesce(F.when(F.col("__error").isNull(), D.text_of(D.at(node, [f]))), F.lit(""))
        .alias(f if f not in kept else f"{f}_response")
        for f in features
    ]
    out = rows.select(*[F.col(quote(c)) for c in kept], *values, F.col("__error").alias("error"))
    return out, list(features)
