"""V1: tolerant equality of two cells, as one Column that is never NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import numeric, unquote
from .text import NAN_TEXTS, ZERO_NAN_TOKENS, clean, col, is_null_token

_NAN = r"""(?i)^[\s"']*[+-]?nan[\s"']*$"""
EXACT_GAP = 1e-10
DEFAULT_FILL = -999.0


def quickly_equal(left: Column, right: Column, ignore_zero_nan: bool = False) -> Column:
    """Identical cells, told without trimming or parsing. NaN differs from everything,
    itself included, unless it counts as zero."""
    same = left.eqNullSafe(right)
    if ignore_zero_nan:
        return same
    has_n = F.coalesce(left.contains("n") | left.contains("N"), F.lit(False))
    return same & ~(has_n & F.coalesce(left.rlike(_NAN), F.lit(False)))


def cells_equal(
    left: Column | str,
    right: Column | str,
    *,
    ignore_zero_nan: bool = False,
    ignore_default_fill: bool = False,
    tolerance: float | None = None,
    exact_integers: bool = False,
    convert: str | None = None,
) -> Column:
    """True where two cells count as the same value.

    `convert` names the quote style of `to_number` to apply first. Identical cells
    never reach the number parser.
    """
    left, right = col(left), col(right)
    lt = unquote(left, convert) if convert is not None else clean(left)
    rt = unquote(right, convert) if convert is not None else clean(right)
    quick = quickly_equal(left, right, ignore_zero_nan)
    return F.when(quick, True).otherwise(parsed_equal(
        clean(lt), clean(rt), numeric(lt), numeric(rt), ignore_zero_nan=ignore_zero_nan,
        ignore_default_fill=ignore_default_fill, tolerance=tolerance, exact_integers=exact_integers,
    ))


def parsed_equal(
    lt: Column, rt: Column, ln: Column, rn: Column, *, ignore_zero_nan: bool = False,
    ignore_default_fill: bool = False, tolerance: float | None = None, exact_integers: bool = False,
) -> Column:
    """`cells_equal` for trimmed texts and the numbers they hold (NULL if none)."""
    l_null, r_null = is_null_token(lt), is_null_token(rt)
    out = F.when(l_null, r_null | _excused(rn, ignore_zero_nan, ignore_default_fill, rt))
    out = out.when(r_null, _excused(ln, ignore_zero_nan, ignore_default_fill, lt))
    if ignore_zero_nan:
        out = out.when(_zero_or_nan(lt, ln) & _zero_or_nan(rt, rn), True)
    if exact_integers:
        both = lt.rlike(r"^[+-]?\d+$") & rt.rlike(r"^[+-]?\d+$")
        out = out.when(both, _bare_integer(lt) == _bare_integer(rt))
    gap = F.abs(ln - rn)
    close = gap <= F.lit(float(tolerance)) if tolerance is not None else gap < EXACT_GAP
    out = out.when(ln.isNotNull() & rn.isNotNull(), close | (ln == rn))
    same = lt == rt
    if not ignore_zero_nan:
        same = same & ~F.lower(lt).isin(*NAN_TEXTS)
    return out.otherwise(same)


def _excused(number: Column, zero_nan: bool, default_fill: bool, text: Column) -> Column:
    """Is this value in one class with a missing one?"""
    out = F.lit(False)
    if zero_nan:
        out = out | _zero_or_nan(text, number)
    if default_fill:
        out = out | F.coalesce(number == DEFAULT_FILL, F.lit(False))
    return out


def _zero_or_nan(text: Column, number: Column) -> Column:
    word = F.lower(text).isin(*ZERO_NAN_TOKENS)
    return F.coalesce(word, F.lit(False)) | F.coalesce(number == 0, F.lit(False))


def numbers_equal(
    left: Column,
    right: Column,
    *,
    ignore_zero_nan: bool = False,
    ignore_default_fill: bool = False,
    tolerance: float | None = None,
) -> Column:
    """V1 for two double columns: the same classes and gaps without any text work."""
    l_null, r_null = left.isNull(), right.isNull()
    out = F.when(l_null & r_null, True)
    if ignore_zero_nan:
        l_class = l_null | F.isnan(left) | F.coalesce(left == 0, F.lit(False))
        r_class = r_null | F.isnan(right) | F.coalesce(right == 0, F.lit(False))
        out = out.when(l_class & r_class, True)
    if ignore_default_fill:
        l_class = l_null | F.coalesce(left == DEFAULT_FILL, F.lit(False))
        r_class = r_null | F.coalesce(right == DEFAULT_FILL, F.lit(False))
        out = out.when(l_class & r_class, True)
    out = out.when(l_null | r_null | F.isnan(left) | F.isnan(right), False)
    gap = F.abs(left - right)  # NaN for a pair of infinities, and NaN sorts above all
    close = gap <= F.lit(float(tolerance)) if tolerance is not None else gap < EXACT_GAP
    return out.otherwise(close | (left == right))


def _bare_integer(t: Column) -> Column:
    bare = F.regexp_replace(t, r"^\+?(-?)0*(?=\d)", "$1")
    return F.when(bare == "-0", F.lit("0")).otherwise(bare)
