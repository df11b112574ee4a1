"""Compare two tables cell by cell on a key.

One side drives: its rows are iterated and counted. The other side is looked up and
holds one row per key. Nothing runs until a result DataFrame is used; the only eager
step is the hot-key probe, and that only on inputs too large for one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.cells import numbers_equal, parsed_equal, quickly_equal
from ..functions.numbers import numeric, plain_number, plain_whole, to_number, unquote
from ..functions.text import clean, non_empty, quote
from . import keys as K
from .skew import HotKeys, SkewPolicy, find_hot_keys, lookup_join
from .stage import compute

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_NUMBERS = (*_WHOLE, T.DoubleType, T.DecimalType)


@dataclass(frozen=True)
class Mode:
    """The rules in which the three kinds of comparison differ."""

    driver: str  # side whose rows are counted
    key_policy: str  # all / any key part needed
    missing_differs: bool  # feature absent on the other side: difference, or NULL
    per_key: bool  # differences counted once per (key, feature), or once per row
    lookup_only_once: bool  # unmatched lookup rows: one per key, or every row
    convert: str | None  # quote style of the number conversion
    exclude: tuple[str, ...]


MODES = {
    "table": Mode("right", "all", True, True, True, "fast", ()),
    "offline": Mode("left", "any", True, True, False, None, K.EXCLUDE_OFFLINE),
    "response": Mode("left", "all", False, False, False, None, K.EXCLUDE_RESPONSE),
}


class _Side:
    """One input with positional column names, so that names which differ only in
    case, or hold dots, never clash inside the plan."""

    def __init__(self, df: DataFrame, tag: str):
        self.names = df.columns
        self.fields = df.schema.fields
        self.tag = tag
        self.df = df.toDF(*[f"{tag}{i}" for i in range(len(self.names))])

    def column(self, position: int) -> Column:
        return F.col(f"{self.tag}{position}")

    def field(self, position: int) -> T.StructField:
        return T.StructField(f"{self.tag}{position}", self.fields[position].dataType)

    def original(self, df: DataFrame) -> DataFrame:
        return df.select(*[self.column(i).alias(n) for i, n in enumerate(self.names)])


def _positions(side: _Side, features, keys: Sequence[int], exclude: Iterable[str]) -> list[int]:
    if features is None:
        chosen = [i for i in range(len(side.names)) if i not in keys]
    elif isinstance(features, int):
        chosen = list(range(features, len(side.names)))
    else:
        chosen = K.resolve_all(side.names, features)
    barred = {e.lower() for e in (*exclude, K.ORDER_COLUMN)}
    return [i for i in chosen if side.names[i].lower() not in barred]


def compare(
    left: DataFrame,
    right: DataFrame,
    keys: K.Ref | Sequence[K.Ref] | None = None,
    *,
    left_keys: K.Ref | Sequence[K.Ref] | None = None,
    right_keys: K.Ref | Sequence[K.Ref] | None = None,
    mode: str = "table",
    left_features: int | Sequence[K.Ref] | None = None,
    right_features: int | Sequence[K.Ref] | None = None,
    convert: str | bool | None = True,
    ignore_zero_nan: bool = False,
    ignore_default_fill: bool = False,
    tolerance: float | None = None,
    exact_integers: bool = False,
    rename: str | None = None,
    prefix: str = "",
    suffix: str = "",
    common_only: bool = False,
    baseline: str = "left",
    key_policy: str | None = None,
    exclude: Sequence[str] | None = None,
    order_by: Sequence[K.Ref] = (),
    driver_order_by: Sequence[K.Ref] = (),
    unique_lookup: bool = False,
    unique_driver: bool = False,
    unique_keys: bool = False,
    context: Mapping[str, Sequence[tuple[str, K.Ref]]] | None = None,
    context_from: DataFrame | None = None,
    skew: SkewPolicy = SkewPolicy(),
) -> Comparison:
    """Set up a comparison; see `Comparison` for its results.

    `keys` names the key columns of both sides, by name or position. Features are a
    start position, a list, or by default every column that is no key. `convert=True`
    takes the mode's own number conversion; False or None turns it off; a quote style
    selects another. `order_by` orders lookup rows of one key (the last wins) and
    `driver_order_by` decides whose values a repeated difference shows. Declare
    `unique_lookup` / `unique_driver` when keys are known not to repeat: each saves a
    shuffle step. `unique_keys` reduces both sides to the last row of a key first.
    `context` adds columns to the differences: name -> [(side, column), ...], first
    non-empty wins; by default customer and time columns are found by their names.
    """
    if mode not in MODES:
        raise ValueError(f"unknown comparison mode: {mode}")
    if baseline not in ("left", "right"):
        raise ValueError(f"unknown baseline: {baseline}")
    rules = MODES[mode]
    l, r = _Side(left, "l"), _Side(right, "r")
    lk = K.resolve_all(l.names, left_keys if left_keys is not None else keys)
    rk = K.resolve_all(r.names, right_keys if right_keys is not None else keys)
    barred = rules.exclude if exclude is None else exclude
    lf = _positions(l, left_features, lk, barred)
    rf = _positions(r, right_features, rk, barred)
    lnames, rnames = [l.names[i] for i in lf], [r.names[i] for i in rf]
    if rename == "left" and (prefix or suffix):
        lnames = K.rename_features(lnames, prefix, suffix)
    elif rename == "right" and (prefix or suffix):
        rnames = K.rename_features(rnames, prefix, suffix)
    if baseline == "left":
        sets = K.align_features(lnames, rnames, common_only)
    else:
        swapped = K.align_features(rnames, lnames, common_only)
        sets = {**swapped, "left_only": swapped["right_only"], "right_only": swapped["left_only"]}
    lpos, rpos = dict(zip(lnames, lf)), dict(zip(rnames, rf))
    style = rules.convert if convert is True else (convert or None)
    return Comparison(
        left=l, right=r, left_keys=lk, right_keys=rk, rules=rules, mode=mode,
        policy=key_policy or rules.key_policy, sets=sets,
        features=[(n, lpos.get(n), rpos.get(n)) for n in sets["features"]],
        style=style,
        options=dict(ignore_zero_nan=ignore_zero_nan, ignore_default_fill=ignore_default_fill,
                     tolerance=tolerance),
        exact_integers=exact_integers,
        order_by=order_by, driver_order_by=driver_order_by,
        unique_lookup=unique_lookup, unique_driver=unique_driver, unique_keys=unique_keys,
        context=context, context_from=context_from, skew=skew,
    )


class Comparison:
    """Lazy results of one comparison.

    stats()                   total and differing rows per feature
    diffs()                   one row per difference, with both values and context
    cells()                   every compared cell with its verdict
    left_only(), right_only() rows without a partner, in their own columns
    key_counts()              matched and one-sided rows, from the key columns alone
    row_status(), near_misses()
    """

    def __init__(self, *, left, right, left_keys, right_keys, rules, mode, policy, sets, features,
                 style, options, exact_integers, order_by, driver_order_by, unique_lookup,
                 unique_driver, unique_keys, context, context_from, skew):
        self.left, self.right = left, right
        self.left_keys, self.right_keys = left_keys, right_keys
        self.rules, self.mode, self.policy, self.sets = rules, mode, policy, sets
        self.feature_positions = features
        self.features = [f[0] for f in features]
        self.style, self.options, self.exact_integers = style, options, exact_integers
        self.unique_lookup, self.unique_driver = unique_lookup, unique_driver or unique_keys
        self.unique_keys = unique_keys
        self.skew = skew
        self.context_from = context_from
        self.key_names = [left.names[i] for i in left_keys]
        self._k = [f"k{i}" for i in range(len(left_keys))]
        lcols, rcols, self.text_keys = K.key_columns(
            [left.field(i) for i in left_keys], [right.field(i) for i in right_keys], policy
        )
        self._keyed = {"left": self._with_keys(left, lcols), "right": self._with_keys(right, rcols)}
        self._drv, self._lkp = ("left", "right") if rules.driver == "left" else ("right", "left")
        self._driver_order = self._refs(self._drv, driver_order_by)
        self._lookup_order = self._refs(self._lkp, order_by)
        self.context = self._resolve_context(context)
        self._persisted: DataFrame | None = None

    # -- inputs -----------------------------------------------------------------

    def _side(self, name: str) -> _Side:
        return self.left if name == "left" else self.right

    def _refs(self, side: str, refs) -> list[int]:
        return K.resolve_all(self._side(side).names, refs) if refs else []

    def _with_keys(self, side: _Side, cols: list[Column]) -> DataFrame:
        return side.df.select("*", *[c.alias(k) for c, k in zip(cols, self._k)])

    def _resolve_context(self, context):
        out: dict[str, list[tuple[str, int]]] = {}
        if context is not None:
            for name, places in context.items():
                out[name] = [(s, K.resolve(self._side(s).names, ref)) for s, ref in places]
            return out
        ln, rn = self.left.names, self.right.names
        found = {
            "table": {
                "customer": [("left", K.find_customer(ln)), ("right", K.find_customer(rn))],
                "time": [("right", K.find_time(rn, self.right_keys)),
                         ("left", K.find_time(ln, self.left_keys))],
            },
            "offline": {
                "customer": [("right", K.find_customer(rn)), ("left", K.find_customer(ln))],
                "left_time": [("left", K.find_time(ln, strict=True))],
                "right_time": [("right", K.find_time(rn, strict=True))],
                "time_now": [("right", next(iter(K.find_named(rn, ["time_now"])), None))],
            },
            "response": {
                "record_id": [("left", i) for i in K.find_named(ln, K.RECORD_ID_NAMES)],
                "time_now": [("right", next(iter(K.find_named(rn, ["time_now"])), None))],
            },
        }[self.mode]
        for name, places in found.items():
            kept = [(s, i) for s, i in places if i is not None]
            if kept:
                out[name] = kept
        return out

    @cached_property
    def _hot_driver(self) -> HotKeys:
        return find_hot_keys(self._keyed[self._drv].select(*self._k), self._k, self.skew)

    @cached_property
    def _hot_lookup(self) -> HotKeys:
        return find_hot_keys(self._keyed[self._lkp].select(*self._k), self._k, self.skew)

    def _driver_rows(self) -> DataFrame:
        rows = self._keyed[self._drv].where(K.has_key(self._k))
        if self.unique_keys:
            tag = self._side(self._drv).tag
            rows = K.dedupe_last(rows, self._k, [f"{tag}{i}" for i in self._driver_order])
        return rows

    def _lookup_rows(self) -> DataFrame:
        rows = self._keyed[self._lkp].where(K.has_key(self._k))
        if not self.unique_lookup:
            tag = self._side(self._lkp).tag
            needed = self._needed(self._lkp)
            order = [f"{tag}{i}" for i in self._lookup_order]
            rows = rows.select(*self._k, *dict.fromkeys([*needed, *order]))
            rows = K.dedupe_last(rows, self._k, order)
        if self.context_from is not None:
            rows = rows.join(self._original_context(), self._k, "left")
        return rows

    def _needed(self, side: str) -> list[str]:
        s = self._side(side)
        at = 1 if side == "left" else 2
        used = [f[at] for f in self.feature_positions if f[at] is not None]
        used += [i for places in self.context.values() for sd, i in places if sd == side]
        return [f"{s.tag}{i}" for i in dict.fromkeys(used)]

    def _original_context(self) -> DataFrame:
        """Time column of the unparsed right table, last row per key."""
        src = _Side(self.context_from, "x")
        positions = K.resolve_all(src.names, [self.right.names[i] for i in self.right_keys])
        cols, _, _ = K.key_columns(
            [src.field(i) for i in positions], [self.left.field(i) for i in self.left_keys], self.policy
        )
        at = K.find_time(src.names, strict=True)
        value = src.column(at) if at is not None else F.lit(None).cast("string")
        keyed = src.df.select(*[c.alias(k) for c, k in zip(cols, self._k)], value.alias("x_time"))
        return K.dedupe_last(keyed.where(K.has_key(self._k)), self._k)

    # -- joined rows and cells --------------------------------------------------

    @property
    def joined(self) -> DataFrame:
        """Driver rows with their lookup row, only the columns the cells need."""
        if self._persisted is not None:
            return self._persisted
        drv = self._side(self._drv)
        order = [f"{drv.tag}{i}" for i in self._driver_order]
        driver = self._driver_rows().select(
            *self._k, *dict.fromkeys([*self._needed(self._drv), *order])
        )
        hot = HotKeys() if self.unique_driver else self._hot_driver
        return lookup_join(driver, self._lookup_rows(), self._k, "inner", hot)

    def persist(self) -> Comparison:
        """Keep the joined rows for several results; call `unpersist` when done."""
        if self._persisted is None:
            from pyspark import StorageLevel

            self._persisted = self.joined.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def unpersist(self) -> None:
        if self._persisted is not None:
            self._persisted.unpersist()
            self._persisted = None

    def _is_typed(self, lpos: int, rpos: int) -> bool:
        lt, rt = self.left.fields[lpos].dataType, self.right.fields[rpos].dataType
        if isinstance(lt, T.FloatType) and isinstance(rt, T.FloatType):
            return True
        if self.exact_integers and isinstance(lt, _WHOLE) and isinstance(rt, _WHOLE):
            return False
        return isinstance(lt, _NUMBERS) and isinstance(rt, _NUMBERS)

    def _kind(self, lpos: int | None, rpos: int | None) -> str:
        if lpos is None or rpos is None:
            return "missing" if self.rules.missing_differs else "text"
        return "number" if self._is_typed(lpos, rpos) else "text"

    @cached_property
    def _kinds(self) -> set[str]:
        return {self._kind(lpos, rpos) for _, lpos, rpos in self.feature_positions}

    def _exploded(self, with_rows: bool = False) -> DataFrame:
        """All cells of the joined rows as feature, kind, ln, rn, lt, rt; with one extra
        cell of kind `row` per joined row, to count the rows.

        Number columns stay doubles (ln, rn): text is made for differences only. The
        cells come from parallel arrays, which keeps the plan small for wide tables.
        """
        names: list[Column] = []
        kinds: list[Column] = []
        sides: dict[str, list] = {"lt": [], "rt": [], "ln": [], "rn": []}
        text, number = F.lit(None).cast("string"), F.lit(None).cast("double")

        def value(side: _Side, pos: int | None, as_type: str):
            if pos is None:
                return text
            c = side.column(pos)
            return c if side.fields[pos].dataType.simpleString() == as_type else c.cast(as_type)

        for name, lpos, rpos in self.feature_positions:
            kind = self._kind(lpos, rpos)
            names.append(F.lit(name))
            kinds.append(F.lit(kind))
            typed = kind == "number"
            sides["lt"].append(text if typed else value(self.left, lpos, "string"))
            sides["rt"].append(text if typed else value(self.right, rpos, "string"))
            sides["ln"].append(value(self.left, lpos, "double") if typed else number)
            sides["rn"].append(value(self.right, rpos, "double") if typed else number)
        if with_rows:
            names.append(text)
            kinds.append(F.lit("row"))
            for part, fill in (("lt", text), ("rt", text), ("ln", number), ("rn", number)):
                sides[part].append(fill)
        arrays = {"feature": F.array(*names).cast("array<string>")}
        mixed = len(self._kinds) > 1
        if mixed:
            arrays["kind"] = F.array(*kinds)
        if self._kinds != {"number"}:
            arrays.update({n: F.array(*sides[n]).cast("array<string>") for n in ("lt", "rt")})
        if "number" in self._kinds:
            arrays.update({n: F.array(*sides[n]).cast("array<double>") for n in ("ln", "rn")})
        zipped = F.arrays_zip(*[c.alias(n) for n, c in arrays.items()])
        out = self.joined.select("*", F.inline(zipped).alias(*arrays))
        if not mixed:
            only = next(iter(self._kinds), "text")
            out = out.withColumn("kind", F.when(F.col("feature").isNull(), "row").otherwise(only))
        missing = {"lt": text, "rt": text, "ln": number, "rn": number}
        return out.withColumns({n: c for n, c in missing.items() if n not in arrays})

    def _judged(self, with_rows: bool = False, all_cells: bool = False) -> DataFrame:
        """Cells with `is_match`. Unless `all_cells`, identical ones are dropped first and
        equal ones last, so that only cells which look different are trimmed and parsed,
        each once."""
        zero_nan = self.options["ignore_zero_nan"]
        kind = F.col("kind")
        cells = self._exploded(with_rows)
        counted = kind == "row"
        quick = quickly_equal(F.col("lt"), F.col("rt"), zero_nan)
        if not all_cells:
            identical = F.lit(False)
            if "text" in self._kinds:
                identical = (kind == "text") & quick
            if "number" in self._kinds:
                same = F.coalesce(F.col("ln") == F.col("rn"), F.lit(False)) & ~F.isnan("ln")
                identical = identical | ((kind == "number") & same)
            cells = cells.where(~identical)
        verdict = F.when(counted | (kind == "missing"), False)
        if "number" in self._kinds:
            verdict = verdict.when(kind == "number", numbers_equal(F.col("ln"), F.col("rn"), **self.options))
        if "text" in self._kinds:
            def ready(side: str, as_is: Column, other: Column) -> Column:
                return F.when(F.col(f"{side}whole").isNotNull(), as_is).otherwise(other)

            def inner(c: Column) -> Column:
                return unquote(c, self.style) if self.style else clean(c)

            sides = ("l", "r")
            cells = compute(cells, **{f"{s}whole": plain_whole(f"{s}t") for s in sides})
            cells = compute(cells, **{f"{s}inner": ready(s, F.col(f"{s}t"), inner(F.col(f"{s}t"))) for s in sides})
            cells = compute(cells, **{f"{s}text": ready(s, F.col(f"{s}t"), clean(f"{s}inner")) for s in sides})
            cells = compute(cells, **{f"{s}num": ready(s, F.col(f"{s}whole").cast("double"), numeric(f"{s}text")) for s in sides})
            parsed = parsed_equal(
                F.col("ltext"), F.col("rtext"), F.col("lnum"), F.col("rnum"),
                exact_integers=self.exact_integers, **self.options,
            )
            verdict = verdict.when(quick, True).otherwise(parsed) if all_cells else verdict.otherwise(parsed)
        else:
            verdict = verdict.otherwise(F.lit(False))
        # a step of its own: the JVM leaves a method of over 8000 bytes uncompiled, and a stage's steps become methods
        cells = compute(cells, is_match=verdict)
        return cells if all_cells else cells.where(counted | ~F.col("is_match"))

    def _context_columns(self) -> list[Column]:
        out = []
        for name, places in self.context.items():
            values = [non_empty(self._side(s).column(i)) for s, i in places]
            if name == "right_time" and self.context_from is not None:
                values.insert(0, non_empty(F.col("x_time")))
            out.append(F.coalesce(*values, F.lit("")).alias(name))
        return out

    def _shown(self, side: str) -> Column:
        """The side's value of a judged cell; what was trimmed and parsed for the verdict is used again."""
        t, judged = F.col(f"{side}t"), "text" in self._kinds
        if self.style and judged:
            inner, x = F.col(f"{side}inner"), F.col(f"{side}num")
            shown = (
                F.when(F.col(f"{side}whole").isNotNull() | (inner == ""), t)
                .when(F.abs(x) < float("inf"), plain_number(x)).otherwise(inner)
            )
        elif self.style:
            shown = to_number(t, self.style)
        else:
            shown = clean(t) if self.mode == "offline" else t
        return F.when(F.col("kind") == "number", plain_number(F.col(f"{side}n"))).otherwise(shown)

    def _key_output(self) -> list[Column]:
        return [F.col(k).alias(n) for k, n in zip(self._k, self.key_names)]

    def cells(self) -> DataFrame:
        """Every compared cell: keys, feature, both values, is_match. As large as the
        input itself; meant for further aggregation."""
        return self._judged(all_cells=True).select(
            *self._key_output(), "feature", self._shown("l").alias("left_value"),
            self._shown("r").alias("right_value"), "is_match",
        )

    def diffs(self) -> DataFrame:
        """Differences only: keys, feature, left_value, right_value and the context.

        Equal cells are dropped before anything is shuffled. Where driver keys may
        repeat, a difference is shown once per key with its last row's values.
        """
        drv = self._side(self._drv)
        order = [drv.column(i).alias(f"o{n}") for n, i in enumerate(self._driver_order)]
        once = self.rules.per_key and not self.unique_driver
        df = self._judged().select(
            *self._k, "feature", self._shown("l").alias("left_value"),
            self._shown("r").alias("right_value"), *self._context_columns(),
            *(order if once else []),
        )
        if once:
            df = K.dedupe_last(df, [*self._k, "feature"], [f"o{n}" for n in range(len(order))])
        return df.select(
            *self._key_output(), "feature", "left_value", "right_value", *self.context.keys()
        )

    def diff_keys(self) -> DataFrame:
        """The distinct keys that have any difference."""
        return self._judged().select(*self._k).distinct().select(*self._key_output())

    def stats(self) -> DataFrame:
        """A1: feature, total, match, mismatch, one row per compared feature.

        One pass: differences and one row marker survive the filter, so only those are
        aggregated; the shuffles carry differing (key, feature) pairs and one partial
        count per task.
        """
        marked = self._judged(with_rows=True).select(*self._k, "feature")
        if self.rules.per_key and not self.unique_driver:
            owner = [F.when(F.col("feature").isNotNull(), F.col(k)).alias(k) for k in self._k]
            per = marked.select(*owner, "feature").groupBy(*self._k, "feature").agg(
                F.count(F.lit(1)).alias("n")
            )
            per = per.groupBy("feature").agg(
                F.sum(F.when(F.col("feature").isNull(), F.col("n")).otherwise(F.lit(1))).alias("n")
            )
        else:
            per = marked.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
        return feature_table(per, self.features)

    # -- rows -------------------------------------------------------------------

    def _keys_once(self, side: str) -> DataFrame:
        return self._keyed[side].where(K.has_key(self._k)).select(*self._k).distinct()

    def _driver_only(self) -> DataFrame:
        rows = lookup_join(self._keyed[self._drv], self._keys_once(self._lkp), self._k, "left_anti",
                           self._hot_driver)
        return self._side(self._drv).original(rows)

    def _lookup_only(self) -> DataFrame:
        rows = self._keyed[self._lkp].where(K.has_key(self._k))
        rows = lookup_join(rows, self._keys_once(self._drv), self._k, "left_anti", self._hot_lookup)
        if self.rules.lookup_only_once or self.unique_keys:
            tag = self._side(self._lkp).tag
            rows = K.dedupe_last(rows, self._k, [f"{tag}{i}" for i in self._lookup_order])
        return self._side(self._lkp).original(rows)

    def left_only(self) -> DataFrame:
        """Left rows without a right partner. The driver side includes rows
        without a key; the lookup side leaves them out."""
        return self._driver_only() if self._drv == "left" else self._lookup_only()

    def right_only(self) -> DataFrame:
        return self._driver_only() if self._drv == "right" else self._lookup_only()

    def key_counts(self) -> DataFrame:
        """Matched, left_only, right_only in one shuffle of pre-counted keys."""
        zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
        drv = self._keyed[self._drv].select(*self._k, one.alias("d"), zero.alias("u"))
        lkp = self._keyed[self._lkp].where(K.has_key(self._k)).select(
            *self._k, zero.alias("d"), one.alias("u")
        )
        per = drv.unionByName(lkp).groupBy(*self._k).agg(F.sum("d").alias("d"), F.sum("u").alias("u"))
        keyed = K.has_key(self._k)
        alone = F.when(keyed & (F.col("d") == 0), F.lit(1) if self.rules.lookup_only_once else F.col("u"))
        out = per.agg(
            F.coalesce(F.sum(F.when(keyed & (F.col("u") > 0), F.col("d"))), zero).alias("matched"),
            F.coalesce(F.sum(F.when(~keyed | (F.col("u") == 0), F.col("d"))), zero).alias("driver_only"),
            F.coalesce(F.sum(alone), zero).cast("bigint").alias("lookup_only"),
        )
        names = ("left_only", "right_only") if self._drv == "left" else ("right_only", "left_only")
        return out.select(
            "matched", F.col("driver_only").alias(names[0]), F.col("lookup_only").alias(names[1])
        ).select("matched", "left_only", "right_only")

    def row_status(self) -> DataFrame:
        """Driver rows in their own columns plus `status`: compared, empty_key, no_match."""
        present = self._keys_once(self._lkp).withColumn("__hit", F.lit(True))
        rows = lookup_join(self._keyed[self._drv], present, self._k, "left", self._hot_driver)
        side = self._side(self._drv)
        status = (
            F.when(~K.has_key(self._k), F.lit("empty_key"))
            .when(F.col("__hit"), F.lit("compared"))
            .otherwise(F.lit("no_match"))
        )
        return rows.select(*[side.column(i).alias(n) for i, n in enumerate(side.names)],
                           status.alias("status"))

    def near_misses(self, limit: int = 3) -> DataFrame:
        """Unmatched driver keys with lookup keys that share the first key part.

        At most `limit` candidates are kept per first part, the smallest ones, before
        they are gathered, so no list grows with the data.
        """
        if len(self._k) < 2:
            raise ValueError("near misses need a composite key")
        first, rest = self._k[0], self._k[1:]
        w = Window.partitionBy(first).orderBy(*rest)
        near = (
            self._keys_once(self._lkp)
            .withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= limit)
            .groupBy(first)
            .agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("near"))
        )
        rows = self._keyed[self._drv].where(K.has_key(self._k)).select(*self._k)
        # probed before the unmatched rows are known: what is no large part of all rows is none of theirs that matters
        hot = find_hot_keys(rows.select(first), [first], self.skew)
        rows = lookup_join(rows, self._keys_once(self._lkp), self._k, "left_anti", self._hot_driver)
        rows = lookup_join(rows, near, [first], "left", hot)
        shown = F.transform(
            F.coalesce("near", F.array().cast(near.schema["near"].dataType)),
            lambda s: F.concat_ws("|", *[s[k].cast("string") for k in rest]),
        )
        return rows.select(*self._key_output(), F.concat_ws(",", shown).alias("candidates"),
                           F.size(shown).alias("candidate_count"))


def feature_table(per: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, n) with NULL for the row count -> feature, total, match, mismatch for
    every listed feature. `per` has one row per feature, so the map below is as small
    as the list of columns."""
    gathered = per.agg(
        F.map_from_entries(F.collect_list(
            F.when(F.col("feature").isNotNull(), F.struct("feature", "n"))
        )).alias("counts"),
        F.coalesce(F.max(F.when(F.col("feature").isNull(), F.col("n"))), F.lit(0)).cast("bigint").alias("total"),
    )
    out = gathered.select(
        F.explode(F.array(*[F.lit(f) for f in features])).alias("feature"), "counts", "total"
    ).select(
        "feature", "total",
        F.coalesce(F.element_at("counts", F.col("feature")), F.lit(0)).cast("bigint").alias("mismatch"),
    )
    return out.select("feature", "total", (F.col("total") - F.col("mismatch")).alias("match"), "mismatch")


def split_errors(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Rows to compare and rows whose response failed."""
    failed = F.col(quote(error)).isNotNull()
    return df.where(~failed), df.where(failed)


def compare_nested(
    left: DataFrame, responses: DataFrame, keys, *, doc: str = "doc", response_keys=None,
    catalog=None, **options,
) -> Comparison:
    """C4: compare a table with nested responses.

    A feature is looked up as a top-level name, then along the path map of the
    responses; absent and null are the same. `doc` is a parsed document column.
    """
    from .documents import nested_columns

    names = left.columns
    lk = K.resolve_all(names, keys)
    features = options.pop("left_features", None)
    side = _Side(left, "l")
    wanted = [names[i] for i in _positions(side, features, lk, K.EXCLUDE_RESPONSE)]
    right_keys = response_keys if response_keys is not None else [names[i] for i in lk]
    wide = nested_columns(responses, doc, wanted, keep=right_keys, catalog=catalog)
    return compare(left, wide, left_keys=lk, right_keys=right_keys, left_features=wanted,
                   mode="response", **options)
