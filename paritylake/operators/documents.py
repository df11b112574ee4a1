"""JSON columns as feature columns.

Two steps: one pass over the documents learns which paths occur (a distributed,
map-side combined distinct), then a plain projection reads each path from the parsed
document. The projection works row by row, so flattening shuffles nothing, and the
first step is skipped when the caller brings a catalog from an earlier run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import float_text, to_double, to_number
from ..functions.text import clean, col, is_null_token, non_empty, quote
from . import keys as K
from .stage import compute, stored

Path = tuple[str, ...]

# Fields of a response that are no features.
ENVELOPE = ("retCode", "retMsg", "success", "timestamp", "data")
ENVELOPE_PLAIN = ("code", "msg", "message", "status")
# Columns in front of the features of a response table.
LEAD_COLUMNS = (
    "cust_no", "order_create_time", "use_create_time", "observation_date", "use_credit_apply_id",
)

_ITEM = "[]"  # path step into the items of a list; object keys carry a "." in front
_WHOLE_DOUBLE = r"^DECIMAL\((\d|1[0-8]),0\)$"  # 1.0 in the text; integers are BIGINT
MAX_NAMES = 200_000
ANY_KIND = frozenset({"bool", "whole"})


# -- catalog ----------------------------------------------------------------------


@dataclass(frozen=True)
class Catalog:
    """Leaf paths of a document set with the value kinds seen there.

    A step is "." + key for object members and "[]" for list items. Kinds: object
    (empty), list, null, bool, whole (a fraction-less double), plain.
    """

    kinds: dict[Path, frozenset[str]] = field(default_factory=dict)

    def leaves(self) -> list[Path]:
        return sorted(p for p in self.kinds if p and p[-1] != _ITEM)

    def at(self, path: Path) -> frozenset[str]:
        return self.kinds.get(path, frozenset())

    def value_kinds(self) -> frozenset[str]:
        """All kinds that occur anywhere."""
        return frozenset().union(*self.kinds.values()) if self.kinds else frozenset()

    def has_children(self, path: Path) -> bool:
        return any(len(p) > len(path) and p[: len(path)] == path for p in self._prefixed(path))

    def _prefixed(self, path: Path) -> Iterable[Path]:
        return self._index().get(path, ())

    def _index(self) -> dict[Path, list[Path]]:
        cached = self.__dict__.get("_by_prefix")
        if cached is None:
            cached = {}
            for p in self.kinds:
                for n in range(len(p)):
                    cached.setdefault(p[:n], []).append(p)
            object.__setattr__(self, "_by_prefix", cached)
        return cached


def keys_path(*names: str) -> Path:
    return tuple("." + n for n in names)


def names_of(path: Path) -> tuple[str, ...]:
    return tuple(s[1:] for s in path if s != _ITEM)


def path_rows(docs: DataFrame, doc: str, depth: int, arrays: bool = False) -> DataFrame:
    """One row per leaf of every document: path, kind. Nodes deeper than `depth` stay
    open (kind starts with "+").

    Each level carries only the type text of its nodes; what that text means is worked
    out once, after the last level.
    """
    spark = docs.sparkSession
    v = F.col(quote(doc))
    rows = docs.where(v.isNotNull()).select(
        v.alias("node"), F.array().cast("array<string>").alias("path"),
        F.schema_of_variant(v).alias("type"),
    )
    opened = _open_type(F.col("type"), F.col("node"), arrays)
    for _ in range(depth):
        rows = rows.select("path", "type", "node", F.when(opened, F.col("node")).alias("open"))
        rows = rows.lateralJoin(spark.tvf.variant_explode_outer(F.col("open").outer()))
        stepped = F.col("pos").isNotNull()
        step = F.coalesce(F.concat(F.lit("."), F.col("key")), F.lit(_ITEM))
        rows = rows.select(
            F.when(stepped, F.col("value")).alias("node"),
            F.when(stepped, F.array_append("path", step)).otherwise(F.col("path")).alias("path"),
            F.when(stepped, F.schema_of_variant("value")).otherwise(F.col("type")).alias("type"),
        )
    t = F.col("type")
    kind = (
        F.when(t == "OBJECT<>", "object")
        .when(_open_type(t, F.col("node"), arrays), "+open")
        .when(t.startswith("ARRAY<"), "list").when(t == "VOID", "null").when(t == "BOOLEAN", "bool")
        .when(t.rlike(_WHOLE_DOUBLE), "whole").otherwise("plain")
    )
    return rows.select("path", kind.alias("kind"))


def _open_type(t: Column, node: Column, arrays: bool) -> Column:
    out = t.startswith("OBJECT<") & (t != "OBJECT<>")
    if arrays:  # lists whose first item is an object are looked into
        first = F.schema_of_variant(F.try_variant_get(node, "$[0]", "variant"))
        out = out | (t.startswith("ARRAY<") & F.coalesce(first.startswith("OBJECT<"), F.lit(False)))
    return out


def discover(
    docs: DataFrame, doc: str, *, arrays: bool = False, depth: int = 4, max_depth: int = 128
) -> Catalog:
    """Learn the leaf paths of a parsed document column (one Spark job as a rule).

    The result grows with the number of distinct paths, not of documents. A document
    set nested deeper than `depth` is read again with twice the depth.
    """
    while True:
        found = path_rows(docs, doc, depth, arrays).distinct().limit(MAX_NAMES + 1).collect()
        if len(found) > MAX_NAMES:
            raise ValueError(f"more than {MAX_NAMES} distinct paths: keys look like data")
        if not any(r["kind"].startswith("+") for r in found):
            break
        if depth >= max_depth:
            raise ValueError(f"documents nested deeper than {max_depth} levels")
        depth = min(depth * 2, max_depth)
    kinds: dict[Path, set[str]] = {}
    for r in found:
        kinds.setdefault(tuple(r["path"]), set()).add(r["kind"])
    return Catalog({p: frozenset(k) for p, k in kinds.items()})


def distinct_names(names: DataFrame) -> list[str]:
    """The sorted distinct texts of a one-column table of column names. Fails, rather
    than cutting the list, when the names turn out to be data."""
    found = names.distinct().limit(MAX_NAMES + 1).collect()
    if len(found) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} distinct names: keys look like data")
    return sorted(r[0] for r in found)


# -- reading values ---------------------------------------------------------------


# What Python services write: NaN and infinities are numbers, single quotes are not taken.
_JSON = {"allowNonNumericNumbers": "true", "allowSingleQuotes": "false"}
_REPEATED = "spark.sql.variant.allowDuplicateKeys"


def parse(c: Column | str, kind: str = "variant") -> Column:
    """JSON text as a variant, NULL where it is none. NaN and infinities are kept, and of
    repeated keys the last counts: for that the session's setting is turned on."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.conf.get(_REPEATED) != "true":
        spark.conf.set(_REPEATED, "true")
    return F.from_json(col(c).cast("string"), kind, _JSON)


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT<"), F.lit(False))


def at(v: Column, names: Sequence[str], as_type: str = "variant") -> Column:
    """Member of nested objects, by exact key names of any spelling."""
    where = "$"
    for name in names:
        if "'" not in name:
            where += f"['{name}']"
        elif '"' not in name:
            where += f'["{name}"]'
        else:  # no quoting takes both marks: step through a map instead
            members = F.try_variant_get(v, where, "map<string,variant>")
            v, where = F.try_element_at(members, F.lit(name)), "$"
    return F.try_variant_get(v, where, as_type)


def text_of(v: Column, kinds: frozenset[str] = ANY_KIND) -> Column:
    """A value as text: True/False, doubles with their point, nested values as JSON.
    `kinds` names what may occur, to leave out tests that cannot apply."""
    text = F.try_variant_get(v, "$", "string")
    out = None
    if "bool" in kinds:
        out = F.when(F.schema_of_variant(v) == "BOOLEAN", F.initcap(text))
    if "whole" in kinds:
        whole = F.schema_of_variant(v).rlike(_WHOLE_DOUBLE)
        shown = F.concat(text, F.lit(".0"))
        out = F.when(whole, shown) if out is None else out.when(whole, shown)
    return text if out is None else out.otherwise(text)


def get_path(v: Column | str, path: str) -> Column:
    """The value at a dotted path as text; objects and lists as JSON text."""
    return text_of(at(col(v), path.split(".")))


def _position(doc_text: Column, names: Sequence[str]) -> Column:
    """Where a path stands in the document: the rank of each key among its siblings."""
    ranks = []
    for n, name in enumerate(names):
        if n == 0:
            parent = doc_text
        else:
            parent = F.get_json_object(doc_text, "$" + "".join(f"['{s}']" for s in names[:n]))
        ranks.append(F.coalesce(F.array_position(F.json_object_keys(parent), F.lit(name)), F.lit(0)))
    return F.array(*ranks)


def _pick(
    paths: Sequence[Sequence[str]], value: Callable[[Sequence[str]], Column],
    present: Callable[[Sequence[str]], Column], doc_text: Column | None, last: bool,
) -> Column:
    """Of several paths that carry the same name, the first or last in the document.
    Without the document text (or with quotes in keys) paths go by their spelling."""
    if len(paths) == 1:
        return value(paths[0])
    if doc_text is None or any("'" in s for p in paths for s in p):
        ordered = sorted(paths, reverse=last)
        out = F.when(present(ordered[0]), value(ordered[0]))
        for p in ordered[1:]:
            out = out.when(present(p), value(p))
        return out
    found = F.array_compact(F.array(*[
        F.when(present(p), F.struct(_position(doc_text, p).alias("at"), value(p).alias("text")))
        for p in paths
    ]))
    best = F.array_max(found) if last else F.array_min(found)
    return best["text"]


# -- J1, J2: rows and feature nodes -------------------------------------------------


def parse_json_column(df: DataFrame, column: str, keys, doc: str = "doc") -> tuple[DataFrame, DataFrame]:
    """Rows with a usable JSON object and a key, plus the rejected rows.

    The first result gains the parsed column `doc`, the second a `reason`: no_key,
    empty, invalid or not_object.
    """
    names = df.columns
    parts = [non_empty(names[i]) for i in K.resolve_all(names, keys)]
    v = F.col(quote(doc))
    parsed = compute(df, **{doc: parse(column)})  # parsed once, though filtered on
    reason = (
        F.when(F.coalesce(*parts).isNull(), "no_key")
        .when(is_null_token(column), "empty")
        .when(v.isNull(), "invalid")
        .when(~clean(column).startswith("{"), "not_object")
    )
    return (
        parsed.where(reason.isNull()),
        parsed.where(reason.isNotNull()).select(*[quote(n) for n in names], reason.alias("reason")),
    )


def features_node(v: Column | str) -> Column:
    """The objects that hold the features, in order, as an array.

    A `features` object; the objects of a `features` list (later ones win); otherwise
    the document itself.
    """
    v = col(v)
    f = at(v, ["features"])
    items = F.filter(F.try_variant_get(v, "$['features']", "array<variant>"), is_object)
    s = F.schema_of_variant(f)
    return (
        F.when(F.coalesce(s.startswith("OBJECT<"), F.lit(False)), F.array(f))
        .when(F.coalesce(s.startswith("ARRAY<"), F.lit(False)), items)
        .otherwise(F.array(v))
    )


# -- J3, J12: leaf names ------------------------------------------------------------


def leaf_names(catalog: Catalog) -> dict[str, list[tuple[str, ...]]]:
    """Leaf name -> the paths that end in it."""
    out: dict[str, list[tuple[str, ...]]] = {}
    for p in catalog.leaves():
        if _ITEM not in p:
            out.setdefault(names_of(p)[-1], []).append(names_of(p))
    return out


def leaf_value(v: Column, names: Sequence[str], catalog: Catalog, convert: bool = False) -> Column:
    """Text of the leaf at a path; NULL where the path holds a non-empty object."""
    x = _leaf_node(v, names, catalog)
    kinds = catalog.at(keys_path(*names))
    text = text_of(x, kinds)
    if convert:
        text = F.when(F.schema_of_variant(x) == "STRING", to_number(text, "json")).otherwise(text)
    return text


def _leaf_node(v: Column, names: Sequence[str], catalog: Catalog) -> Column:
    x = at(v, names)
    if catalog.has_children(keys_path(*names)):
        s = F.schema_of_variant(x)
        x = F.when(~(s.startswith("OBJECT<") & (s != "OBJECT<>")), x)
    return x


def flatten_leaf(
    df: DataFrame, doc: str, *, text: str | None = None, catalog: Catalog | None = None,
    convert: bool = False,
) -> tuple[DataFrame, list[str]]:
    """One text column per leaf name, sorted. Of clashing names the one later in
    the document wins; `text` names the column with the source text, which tells the
    order of keys (parsing sorts them)."""
    catalog = catalog or discover(df, doc)
    columns = _leaf_columns(F.col(quote(doc)), catalog, text, convert)
    return df.select("*", *[c.alias(n) for n, c in columns.items()]), list(columns)


def _leaf_columns(v: Column, catalog: Catalog, text: str | None, convert: bool,
                  prefix: Sequence[str] = ()) -> dict[str, Column]:
    source = F.col(quote(text)).cast("string") if text else None
    out = {}
    for name, paths in sorted(leaf_names(catalog).items()):
        out[name] = _pick(
            paths, lambda p: leaf_value(v, p, catalog, convert),
            lambda p: _leaf_node(v, p, catalog).isNotNull(), source, last=True,
        )
    return out


def json_to_wide(
    df: DataFrame, column: str, keys, *, order_by=(), convert: bool = False,
    catalog: Catalog | None = None, sort: bool = False,
) -> DataFrame:
    """Base columns without the JSON column, then one column per leaf name.

    One row per key, the last usable one in `order_by`; rows without usable JSON or
    key are left out (see `parse_json_column`). A feature named like a base column
    overrides it where present. Missing values are ''.
    """
    names = df.columns
    key_names = [names[i] for i in K.resolve_all(names, keys)]
    K.resolve(names, column)
    rows, _ = parse_json_column(df, column, keys, doc="__doc")
    if catalog is None:
        nodes = rows.select(F.explode(features_node("__doc")).alias("node"))
        catalog = _without_scalar_features(discover(nodes, "node"), rows)
    parts = [F.coalesce(clean(k), F.lit("")).alias(f"__k{i}") for i, k in enumerate(key_names)]
    # only the source text is shuffled; parsing again costs less than moving parsed values
    keyed = rows.select(*[quote(n) for n in names], *parts)
    last = K.dedupe_last(keyed, [f"__k{i}" for i in range(len(parts))], [names[i] for i in _refs(names, order_by)])
    last = compute(compute(last, __doc=parse(column)), __nodes=features_node("__doc"))
    columns = _node_columns(catalog, column, convert)
    base = [n for n in names if n != column]
    out = [
        F.coalesce(columns[n], F.col(quote(n)).cast("string"), F.lit("")).alias(n) if n in columns
        else F.coalesce(F.col(quote(n)).cast("string"), F.lit("")).alias(n)
        for n in base
    ]
    out += [F.coalesce(c, F.lit("")).alias(n) for n, c in columns.items() if n not in base]
    wide = last.select(*out)
    return wide.orderBy(*[F.col(quote(k)) for k in key_names]) if sort else wide


def _without_scalar_features(catalog: Catalog, rows: DataFrame) -> Catalog:
    """Drop the leaf `features` unless it is a member of some feature object itself."""
    path = keys_path("features")
    if path not in catalog.kinds:
        return catalog
    doc = F.col("__doc")
    inner = rows.where(at(doc, ["features", "features"]).isNotNull() | F.exists(
        F.coalesce(F.try_variant_get(doc, "$['features']", "array<variant>"), F.array()),
        lambda x: at(x, ["features"]).isNotNull(),
    ))
    if inner.limit(1).count():
        return catalog
    return Catalog({p: k for p, k in catalog.kinds.items() if p != path})


def _refs(names, refs) -> list[int]:
    return K.resolve_all(names, refs) if refs else []


def _node_columns(catalog: Catalog, text: str, convert: bool) -> dict[str, Column]:
    """Leaf columns over the array of feature nodes: a member is read from the last
    node that has it."""
    nodes = F.col("__nodes")
    root = at(F.col("__doc"), ["features"])
    source = F.col(quote(text)).cast("string")
    held = F.when(is_object(root), F.get_json_object(source, "$['features']")).otherwise(source)
    listed = F.coalesce(F.schema_of_variant(root).startswith("ARRAY<"), F.lit(False))

    def node_for(names: Sequence[str]) -> Column:
        owners = F.filter(nodes, lambda x: at(x, names[:1]).isNotNull())
        node = F.when(F.size(nodes) == 1, nodes[0]).otherwise(F.try_element_at(owners, F.lit(-1)))
        if tuple(names) == ("features",):  # a scalar `features` of the document is no feature
            node = F.when(is_object(root) | listed, node)
        return node

    out = {}
    for name, paths in sorted(leaf_names(catalog).items()):
        out[name] = _pick(
            paths, lambda p: leaf_value(node_for(p), p, catalog, convert),
            lambda p: _leaf_node(node_for(p), p, catalog).isNotNull(), held, last=True,
        )
    return out


# -- J4, J13: dotted paths ----------------------------------------------------------


def dotted_name(path: Path, sep: str = ".") -> str:
    return sep.join(names_of(path))


def _dotted_value(v: Column, path: Path, whole: Path, catalog: Catalog) -> Column:
    """Value at a path that may lead through lists of objects: the distinct values of
    the items joined by "|"."""
    if _ITEM in path:
        cut = path.index(_ITEM)
        holder = at(v, names_of(path[:cut])) if cut else v
        items = F.try_variant_get(holder, "$", "array<variant>")
        of_objects = is_object(F.get(items, F.lit(0)))
        values = F.transform(
            F.filter(items, is_object), lambda x: _dotted_value(x, path[cut + 1:], whole, catalog)
        )
        joined = F.array_join(F.array_distinct(F.array_compact(values)), "|")
        return F.when(of_objects & (F.length(joined) > 0), joined)
    x = at(v, names_of(path))
    kinds = catalog.at(whole)
    if catalog.has_children(whole):
        s = F.schema_of_variant(x)
        opened = s.startswith("OBJECT<") & (s != "OBJECT<>")
        first = F.schema_of_variant(F.try_variant_get(x, "$[0]", "variant"))
        x = F.when(~(opened | F.coalesce(first.startswith("OBJECT<"), F.lit(False))), x)
    text = text_of(x, kinds)
    if "list" in kinds:
        items = F.try_variant_get(x, "$", "array<variant>")
        shown = F.array_compact(F.transform(items, lambda x: text_of(x)))
        listed = F.schema_of_variant(x).startswith("ARRAY<")
        text = F.when(listed, F.when(F.size(shown) > 0, F.array_join(shown, "|"))).otherwise(text)
    return text


def flatten_path(
    df: DataFrame, doc: str, *, sep: str = ".", text: str | None = None,
    catalog: Catalog | None = None,
) -> tuple[DataFrame, list[str]]:
    """One text column per dotted path, sorted. Lists become `a|b`, lists of
    objects one column per inner path with its distinct values, an empty list NULL."""
    columns = _dotted_columns(df, doc, sep, text, catalog)
    return df.select("*", *[c.alias(n) for n, c in columns.items()]), list(columns)


def _dotted_columns(df, doc, sep, text, catalog) -> dict[str, Column]:
    catalog = catalog or discover(df, doc, arrays=True)
    v = F.col(quote(doc))
    named: dict[str, list[Path]] = {}
    for p in catalog.leaves():
        named.setdefault(dotted_name(p, sep), []).append(p)
    out = {}
    for name, paths in sorted(named.items()):
        values = [_dotted_value(v, p, p, catalog) for p in paths]
        out[name] = values[0] if len(values) == 1 else F.coalesce(*reversed(values))
    return out


def body_to_wide(
    df: DataFrame, body: str = "response_body", base: Sequence[str] = ("apply_id", "apply_time"),
    *, catalog: Catalog | None = None,
) -> DataFrame:
    """The base columns, then every dotted path of the body, sorted. A missing or
    bad body leaves the features NULL; a path named like a base column overrides it."""
    for name in (*base, body):
        K.resolve(df.columns, name)
    shaped = clean(body).startswith("{")
    rows = compute(df, keep=list(base), __doc=F.when(shaped, parse(body)))
    if catalog is None:  # each body is parsed once, for its names and its values
        rows = stored(rows, "parsed-bodies")
    columns = _dotted_columns(rows, "__doc", ".", None, catalog)
    out = [
        F.coalesce(columns[b], F.col(quote(b)).cast("string")).alias(b) if b in columns
        else F.col(quote(b))
        for b in base
    ]
    return rows.select(*out, *[c.alias(n) for n, c in columns.items() if n not in base])


# -- J5, J6: field catalogue and path map -------------------------------------------


def feature_paths(catalog: Catalog, envelope: Sequence[str] = ENVELOPE) -> list[Path]:
    """Leaf paths that count as fields: the envelope is left out at the top level, but
    what lies inside a non-empty `data` object counts."""
    out = []
    for p in catalog.leaves():
        top = p[0][1:]
        if top in envelope and not (top == "data" and len(p) > 1):
            continue
        if p == keys_path("data", "features") and catalog.at(p) == {"object"}:
            continue
        out.append(p)
    return out


def field_catalog(
    docs: DataFrame, doc: str, *, envelope: Sequence[str] = ENVELOPE, arrays: bool = False,
) -> DataFrame:
    """Sorted distinct leaf names (field, paths) over all documents. `arrays` looks
    into lists of objects as well. See `catalogue` for catalogues that are kept and merged."""
    from .catalogue import catalogue, field_table

    return field_table(catalogue(docs, doc, arrays=arrays), envelope).orderBy("field")


def path_names(catalog: Catalog, envelope: Sequence[str] = ENVELOPE) -> dict[str, Path]:
    """Field name -> path. Of paths that share a leaf name the first by spelling
    takes it, the others go by their full path."""
    out: dict[str, Path] = {}
    for p in sorted(feature_paths(catalog, envelope), key=lambda p: dotted_name(p)):
        leaf = names_of(p)[-1]
        out[leaf if leaf not in out else dotted_name(p)] = p
    return out


def path_map(docs: DataFrame, doc: str, *, envelope: Sequence[str] = ENVELOPE) -> DataFrame:
    """J6 as a table: name, path."""
    from .catalogue import catalogue, path_table

    return path_table(catalogue(docs, doc), envelope)


# -- J7: lookup by name -------------------------------------------------------------


def lookup_node(v: Column | str, name: str, catalog: Catalog, text: Column | str | None = None) -> Column:
    """The value of a field wherever it stands in a response, as variant.

    Tried in turn, first hit that is not null: `data.features` (exact name, then any
    case), anywhere in `data`, the top level without the envelope, anywhere at all, and
    the name as a dotted path. `text` is the source text, for the order of equal names.
    """
    v = col(v)
    source = col(text).cast("string") if text is not None else None
    leaves = [names_of(p) for p in catalog.leaves() if _ITEM not in p]
    members = {names_of(p)[:n] for p in catalog.kinds if _ITEM not in p for n in range(1, len(p) + 1)}
    low = name.lower()
    barred = {e.lower() for e in ENVELOPE}
    in_features = sorted(m for m in members if len(m) == 3 and m[:2] == ("data", "features"))
    in_data = [p for p in leaves if p[0] == "data" and len(p) > 1]
    top = [p for p in leaves if len(p) == 1 and p[0].lower() not in barred]
    ranks = [
        [m for m in in_features if m[-1] == name],
        [m for m in in_features if m[-1].lower() == low],
        [p for p in in_data if p[-1] == name],
        [p for p in in_data if p[-1].lower() == low],
        [p for p in top if p[-1] == name],
        [p for p in top if p[-1].lower() == low],
        [p for p in leaves if p[-1] == name],
        [p for p in leaves if p[-1].lower() == low],
        [m for m in members if ".".join(m) == name and all("." not in s for s in m)],
    ]
    tried: set[tuple[str, ...]] = set()
    found: list[Column] = []
    for n, paths in enumerate(ranks):
        fresh = [p for p in paths if p not in tried]
        tried.update(fresh)
        if not fresh:
            continue
        whole = n < 2 or n == 8

        def node(p, whole=whole):
            x = at(v, p) if whole else _leaf_node(v, p, catalog)
            return F.when(~F.is_variant_null(x), x)

        if len(fresh) == 1:
            found.append(node(fresh[0]))
        elif source is None or any("'" in s for p in fresh for s in p):
            found.extend(node(p) for p in sorted(fresh))
        else:
            found.append(_first_in_document(fresh, node, source))
    return F.coalesce(*found) if found else F.lit(None).cast("variant")


def _first_in_document(paths, node, source: Column) -> Column:
    # variants cannot be ordered: order the positions, then read the chosen path
    places = F.array_compact(F.array(*[
        F.when(node(p).isNotNull(), F.struct(_position(source, p).alias("at"), F.lit(i).alias("i")))
        for i, p in enumerate(paths)
    ]))
    chosen = F.array_min(places)["i"]
    out = F.when(chosen == 0, node(paths[0]))
    for i, p in enumerate(paths[1:], 1):
        out = out.when(chosen == i, node(p))
    return out


def lookup(v: Column | str, name: str, catalog: Catalog, text: Column | str | None = None) -> Column:
    """J7 as text, NULL when not found."""
    return text_of(lookup_node(v, name, catalog, text), catalog.value_kinds())


def nested_columns(docs: DataFrame, doc: str, wanted: Sequence[str], *, keep: Sequence,
                   catalog: Catalog | None = None) -> DataFrame:
    """Columns for C4: the top-level member of that name, else the path of the path map."""
    catalog = catalog or discover(docs, doc)
    v = F.col(quote(doc))
    paths = path_names(catalog)
    tops = {names_of(p)[0] for p in catalog.kinds if p}
    names = docs.columns
    kept = [F.col(quote(names[i])) for i in K.resolve_all(names, keep)]
    out = []
    for name in wanted:
        value = F.lit(None).cast("string")
        if name in paths:
            value = text_of(at(v, names_of(paths[name])))
        if name in tops:
            top = at(v, [name])
            value = F.when(top.isNotNull(), text_of(top)).otherwise(value)
        out.append(value.alias(name))
    return docs.select(*kept, *out)


# -- J9, J10, J11: envelopes --------------------------------------------------------


def unwrap(v: Column | str) -> Column:
    """`data.features`, else `data`, as variant; NULL for an error response or when
    there is no object."""
    v = col(v)
    features, data = at(v, ["data", "features"]), at(v, ["data"])
    inner = F.when(is_object(features), features).when(is_object(data), data)
    return F.when(at(v, ["_error"]).isNull(), inner)


def convert_envelope(df: DataFrame, column: str, doc: str = "converted") -> DataFrame:
    """Response text with the text values of its features turned into numbers.

    Adds `doc` (JSON text), `converted_count` and `unchanged_count`; documents without
    a `data` object are passed through with zero counts.
    """
    v = F.col("__v")
    data, features = at(v, ["data"]), at(v, ["data", "features"])
    member = "map<string,variant>"
    inner = F.when(is_object(features), F.try_variant_get(features, "$", member)).when(
        is_object(data), F.try_variant_get(data, "$", member)
    )

    def number(x: Column) -> Column:
        return F.when(F.schema_of_variant(x) == "STRING", to_double(F.try_variant_get(x, "$", "string")))

    def replaced(_, x: Column) -> Column:
        return F.coalesce(number(x).cast("variant"), x)

    def counted(x: Column) -> Column:
        s = F.schema_of_variant(x)
        plain = s.isin("BIGINT", "DOUBLE", "BOOLEAN") | s.startswith("DECIMAL")
        return F.when(plain, F.lit(0)).when(number(x).isNotNull(), F.lit(1)).otherwise(F.lit(2))

    def rebuilt(owner: Column, key: str, value: Column) -> Column:
        rest = F.map_filter(F.try_variant_get(owner, "$", member), lambda k, _: k != key)
        return F.to_variant_object(F.map_concat(rest, F.create_map(F.lit(key), value)))

    new_inner = F.to_variant_object(F.transform_values(F.col("__inner"), replaced))
    new_data = F.when(is_object(features), rebuilt(data, "features", new_inner)).otherwise(new_inner)
    states = F.transform(F.map_values("__inner"), counted)
    return (
        compute(compute(df, __v=parse(column)), __inner=inner)
        .select(
            *[quote(c) for c in df.columns],
            F.when(F.col("__inner").isNotNull(), F.to_json(rebuilt(v, "data", new_data)))
            .otherwise(F.col(quote(column))).alias(doc),
            F.coalesce(F.size(F.filter(states, lambda s: s == 1)), F.lit(0)).alias("converted_count"),
            F.coalesce(F.size(F.filter(states, lambda s: s == 2)), F.lit(0)).alias("unchanged_count"),
        )
    )


def feature_start(columns: Sequence[str]) -> int:
    """Where the features of a response table start: after the first known lead column."""
    known = [i + 1 for i, c in enumerate(columns) if c.lower() in LEAD_COLUMNS]
    start = min(known) if known else len(columns)
    return start if start < len(columns) else 3


def convert_columns(df: DataFrame, start: K.Ref | None = None) -> DataFrame:
    """Number text of every feature column printed as a double; other text unchanged."""
    names = df.columns
    first = feature_start(names) if start is None else K.resolve(names, start)
    out = []
    for i, n in enumerate(names):
        c = F.col(quote(n))
        if i >= first:
            x = to_double(c)
            c = F.when(x.isNotNull(), float_text(x)).otherwise(c.cast("string"))
        out.append(c.alias(n))
    return df.select(*out)
