"""Small text helpers shared by every other module."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Texts that stand for a missing cell (compared trimmed and lower-cased).
NULL_TOKENS = ("", "null", "none")
ZERO_NAN_TOKENS = ("nan", "na", "n/a", "+nan", "-nan")
JSON_NULL_TOKENS = ("", "null", "none", "nan")
NAN_TEXTS = ("nan", "+nan", "-nan")


def col(c: Column | str) -> Column:
    """Accept a Column or an exact column name (dots and spaces included)."""
    return F.col(quote(c)) if isinstance(c, str) else c


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def clean(c: Column | str) -> Column:
    """The cell as text without surrounding white space; NULL stays NULL."""
    return F.btrim(col(c).cast("string"), F.lit(WHITESPACE))


def is_null_token(c: Column | str, tokens: tuple[str, ...] = NULL_TOKENS) -> Column:
    return F.coalesce(F.lower(clean(c)), F.lit("")).isin(*tokens)


def non_empty(c: Column | str) -> Column:
    """Trimmed text, or NULL when nothing is left."""
    return F.nullif(clean(c), F.lit(""))


def first_nonempty(*cols: Column | str) -> Column:
    """The first column of the list whose trimmed text is not empty, else ''."""
    return F.coalesce(*[non_empty(c) for c in cols], F.lit(""))


def text_guard(c: Column | str, name: str) -> Column:
    """Put a tab before values a spreadsheet would turn into dates."""
    v = col(c).cast("string")
    lowered = name.lower()
    if "time" in lowered or "date" in lowered:
        guarded = F.lit(True)
    else:
        guarded = (F.length(v) >= 10) & clean(v).rlike(r"^\d{4}-\d{2}-\d{2}")
    keep = v.isNull() | v.isin("", "null")
    return F.when(keep, v).when(guarded, F.concat(F.lit("\t"), v)).otherwise(v)
