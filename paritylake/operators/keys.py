"""Keys, column roles and the choice of one row per key."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import clean, non_empty, quote
from ..functions.times import normalize_ts, plus_one_second

# Column names that name a role (compared lower-cased).
CUSTOMER_NAMES = ("cust_no", "custno", "customer_no", "customerno")
TIME_NAMES = (
    "use_create_time", "usecreatetime", "create_time", "createtime",
    "ua_time", "uatime", "use_credit_create_time", "usecreditcreatetime",
)
CUSTOMER_PARTS = ("cust_no", "customer_no", "custno")
RECORD_ID_NAMES = ("use_credit_id", "apply_id", "use_credit_apply_id", "loan_no", "ua_id", "ua_no")
DEFAULT_FEATURE_START = 4

# Columns that are carried along but never compared.
EXCLUDE_RESPONSE = ("pt", "time_now")
EXCLUDE_OFFLINE = ("time_now",)

ORDER_COLUMN = "_row_order"  # place of a row in its source, never a feature

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)

Ref = int | str


def resolve(columns: Sequence[str], ref: Ref) -> int:
    """K2: a 0-based position or an exact name to a position; ValueError if absent."""
    if isinstance(ref, bool):
        raise ValueError(f"not a column reference: {ref!r}")
    if isinstance(ref, int):
        if not 0 <= ref < len(columns):
            raise ValueError(f"column position {ref} is out of range: {len(columns)} columns")
        return ref
    found = [i for i, c in enumerate(columns) if c == ref]
    if len(found) != 1:
        state = "not found" if not found else "ambiguous"
        raise ValueError(f"column {ref!r} is {state}")
    return found[0]


def resolve_all(columns: Sequence[str], refs: Ref | Iterable[Ref]) -> list[int]:
    if isinstance(refs, (int, str)):
        refs = [refs]
    out = [resolve(columns, r) for r in refs]
    if not out:
        raise ValueError("at least one column is required")
    return out


def detect_roles(columns: Sequence[str]) -> dict[str, int | None]:
    """K1: positions of the customer and time columns, and where features start."""
    lowered = [c.strip().lower() for c in columns]
    customer = next((i for i, c in enumerate(lowered) if c in CUSTOMER_NAMES), None)
    time = next((i for i, c in enumerate(lowered) if c in TIME_NAMES), None)
    known = [i for i in (customer, time) if i is not None]
    return {
        "customer": customer,
        "time": time,
        "feature_start": max(known) + 1 if known else DEFAULT_FEATURE_START,
    }


def find_customer(columns: Sequence[str]) -> int | None:
    """K8: first column whose name contains a customer number."""
    return next(
        (i for i, c in enumerate(columns) if any(p in c.lower() for p in CUSTOMER_PARTS)), None
    )


def find_time(columns: Sequence[str], keys: Sequence[int] = (), strict: bool = False) -> int | None:
    """K9: first time-like column. Loose: any name with time or date, else the
    column after a single key. Strict: the name must also speak of creation or
    application, or end in `time`."""
    for i, c in enumerate(columns):
        name = c.lower()
        if "time" not in name and "date" not in name:
            continue
        if not strict or "create" in name or "apply" in name or name.endswith("time"):
            return i
    if not strict and len(keys) == 1 and keys[0] + 1 < len(columns):
        return keys[0] + 1
    return None


def find_named(columns: Sequence[str], names: Sequence[str]) -> list[int]:
    """Positions of the listed names, in the order of the list, ignoring case."""
    lowered = [c.lower() for c in columns]
    return [i for n in names for i, c in enumerate(lowered) if c == n]


def exclude_columns(columns: Sequence[str], names: Iterable[str]) -> list[str]:
    """K7: drop never-compared columns by name, ignoring case."""
    barred = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in barred]


def rename_features(
    names: Sequence[str], prefix: str = "", suffix: str = ""
) -> list[str]:
    """K5 on a name list: one side's features before they are matched."""
    return [f"{prefix}{n}{suffix}" for n in names]


def rename_feature_columns(
    df: DataFrame, features: Sequence[str], prefix: str = "", suffix: str = ""
) -> DataFrame:
    """K5 on a DataFrame."""
    new = dict(zip(features, rename_features(features, prefix, suffix)))
    return df.toDF(*[new.get(c, c) for c in df.columns])


def align_features(
    left: Sequence[str], right: Sequence[str], common_only: bool = False
) -> dict[str, list[str]]:
    """K6: the features to compare and the three name sets, sorted."""
    for side, names in (("left", left), ("right", right)):
        if len(set(names)) != len(names):
            raise ValueError(f"repeated feature names on the {side} side")
    lset, rset = set(left), set(right)
    common = sorted(lset & rset)
    if common_only and not common:
        raise ValueError("the two tables share no feature column")
    return {
        "features": common if common_only else sorted(left),
        "common": common,
        "left_only": sorted(lset - rset),
        "right_only": sorted(rset - lset),
    }


def schema_diff(left: DataFrame, right: DataFrame, features_left, features_right) -> DataFrame:
    """K6 as a table: feature, in_left, in_right and how many rows of each side have a value.
    Each side is read once; it has as many rows as there are columns."""

    def side(df: DataFrame, features, name: str) -> DataFrame:
        counts = [F.struct(F.lit(c).alias("feature"), F.count(F.col(quote(c))).alias(f"{name}_values")) for c in features]
        return df.agg(F.array(*counts).alias("cells")).select(F.inline("cells"))

    both = side(left, features_left, "left").join(side(right, features_right, "right"), "feature", "full")
    return both.select("feature", F.col("left_values").isNotNull().alias("in_left"), F.col("right_values").isNotNull().alias("in_right"),
                       "left_values", "right_values")


def key_columns(
    left: Sequence[T.StructField], right: Sequence[T.StructField], policy: str
) -> tuple[list[Column], list[Column], bool]:
    """K3: key expressions of the two sides, and whether the parts are text.

    Integral pairs stay numbers (narrow shuffle, no text work) and equal plain types
    stay as they are; everything else is compared as trimmed text. A part is NULL
    when it is missing. Under policy `any` a missing part is '' as long as another
    part is present, so all parts become text.
    """
    if len(left) != len(right):
        raise ValueError("both sides need the same number of key columns")
    if policy not in ("all", "any"):
        raise ValueError(f"unknown key policy: {policy}")
    any_of = policy == "any" and len(left) > 1
    lout, rout = [], []
    text = False
    for lf, rf in zip(left, right):
        lc, rc = F.col(quote(lf.name)), F.col(quote(rf.name))
        if not any_of and isinstance(lf.dataType, _INTEGRAL) and isinstance(rf.dataType, _INTEGRAL):
            lout.append(lc.cast("bigint"))
            rout.append(rc.cast("bigint"))
        elif (
            not any_of
            and lf.dataType == rf.dataType
            and isinstance(lf.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType))
        ):
            lout.append(lc)
            rout.append(rc)
        else:
            text = True
            lout.append(non_empty(lc))
            rout.append(non_empty(rc))
    if any_of:
        lout = _blank_parts(lout)
        rout = _blank_parts(rout)
    return lout, rout, text


def _blank_parts(parts: list[Column]) -> list[Column]:
    some = F.coalesce(*parts)
    return [F.when(some.isNotNull(), F.coalesce(p, F.lit(""))) for p in parts]


def has_key(keys: Sequence[str]) -> Column:
    cond = F.col(keys[0]).isNotNull()
    for k in keys[1:]:
        cond = cond & F.col(k).isNotNull()
    return cond


def dedupe_last(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column] = ()
) -> DataFrame:
    """K4: keep the last row of each key in the given order.

    Rows that tie on `order_by` are ordered by a hash of the whole row, so the choice
    does not depend on task timing. The group limit is applied before the shuffle
    too: a key with a third of all rows sends one row per input partition.
    """
    order = [c if isinstance(c, Column) else F.col(quote(c)) for c in order_by]
    hashable = [
        F.col(quote(f.name)) for f in df.schema.fields
        if not any(t in f.dataType.simpleString() for t in ("variant", "map<"))
    ]
    order.append(F.xxhash64(*hashable))
    w = Window.partitionBy(*[F.col(quote(k)) for k in keys]).orderBy(*[o.desc_nulls_last() for o in order])
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def keep_columns(df: DataFrame, refs: Sequence[Ref] | None) -> DataFrame:
    """A subset of the columns, by position or name; positions out of range are skipped."""
    if refs is None:
        return df
    names = df.columns
    kept = [names[r] if isinstance(r, int) else r for r in refs if not isinstance(r, int) or 0 <= r < len(names)]
    return df.select(*[F.col(quote(n)) for n in kept])


def build_params(
    df: DataFrame, specs: Sequence[dict], *, strict: bool = True, plus_one: bool = False
) -> DataFrame:
    """Add `params` (a struct of text) and `error` built from the columns of each row.

    A spec holds `name`, `column` (position, name or None), and for time parameters
    `is_time` with the layout options `t_sep` and `expand_date`. Strict: an empty
    value is an error of the row. Lenient: it is left NULL in `params`; only a row
    without any value is an error, and times use the `batch` layout.
    """
    names = df.columns
    fields: list[Column] = []
    missing: list[tuple[str, Column]] = []
    values: list[Column] = []
    static_error: str | None = None
    for spec in specs:
        ref = spec.get("column")
        if ref is None:
            continue
        try:
            source = names[resolve(names, ref)]
        except ValueError:
            if strict and static_error is None:
                static_error = f"parameter {spec['name']}: invalid column {ref}"
            continue
        value = non_empty(F.col(quote(source)))
        if strict:
            missing.append((spec["name"], value.isNull()))
        if spec.get("is_time"):
            if strict:
                value = normalize_ts(
                    F.translate(value, "aA", ""),
                    t_sep=spec.get("t_sep", True), expand_date=spec.get("expand_date", True),
                )
                if plus_one:
                    value = plus_one_second(value)
            else:
                value = normalize_ts(value, t_sep=spec.get("t_sep", False), style="batch")
        fields.append(value.alias(spec["name"]))
        values.append(value)
    error: Column = F.lit(None).cast("string")
    if not fields:
        error = F.lit(static_error or "no valid parameter")
    elif static_error is not None:
        error = F.lit(static_error)
    elif strict:
        for name, is_missing in reversed(missing):
            error = F.when(is_missing, F.lit(f"parameter {name} is empty")).otherwise(error)
    else:
        error = F.when(F.coalesce(*values).isNull(), F.lit("no valid parameter"))
    params = F.struct(*fields) if fields else F.struct(F.lit(None).cast("string").alias("none"))
    return df.select("*", params.alias("params"), error.alias("error"))


__all__ = [
    "align_features", "build_params", "clean", "dedupe_last", "detect_roles", "exclude_columns",
    "find_customer", "find_named", "find_time", "has_key", "keep_columns", "key_columns",
    "rename_feature_columns", "rename_features", "resolve", "resolve_all", "schema_diff",
]
