"""Row-level Column expressions (stateless; they also run on streaming frames).

All of them are built from ``pyspark.sql.functions`` so they stay inside
whole-stage codegen; none is a Python UDF.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentinel constants and clip bound of the reference toolkit.
NEG_LOG_SENTINEL = -40.0       # special log of a negative number
NUMERIC_FILL = -999.0          # constant imputation of numbers
STRING_FILL = ""               # constant imputation of strings
EMPTY_LEVEL = "EMPTY"          # name given to blank / null string levels
PROB_EPS = 1e-15               # log-loss probability clip
LETTERS = list(string.ascii_uppercase)


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- T1, T2
def special_log(c: Column | str) -> Column:
    """log(x) for x > 0, -inf at 0, -40 for negatives, null stays null."""
    x = _c(c).cast("double")
    return (F.when(x.isNull(), F.lit(None).cast("double"))
            .when(x > 0, F.ln(x))
            .when(x == 0, F.lit(float("-inf")))
            .otherwise(F.lit(NEG_LOG_SENTINEL)))


def log1p_guarded(c: Column | str) -> Column:
    """log(1 + x); undefined (x <= -1) and null inputs give null."""
    x = _c(c).cast("double")
    return F.when(x > -1.0, F.log1p(x))


# ---------------------------------------------------------------- T3
def yeo_johnson(c: Column | str, lam: float | Column) -> Column:
    """Yeo-Johnson power transform (4 branches); ``lam`` is a number or a
    Column (the latter lets one pass evaluate a whole lambda grid)."""
    x = _c(c).cast("double")
    if isinstance(lam, Column):
        pos = F.when(F.abs(lam) < 1e-12, F.log1p(x)).otherwise((F.pow(x + 1.0, lam) - 1.0) / lam)
        neg = F.when(F.abs(lam - 2.0) < 1e-12, -F.log1p(-x)).otherwise(
            -(F.pow(1.0 - x, 2.0 - lam) - 1.0) / (2.0 - lam))
        return F.when(x.isNull(), F.lit(None).cast("double")).when(x >= 0, pos).otherwise(neg)
    lam = float(lam)
    if abs(lam) < 1e-12:
        pos = F.log1p(x)
    else:
        pos = (F.pow(x + 1.0, F.lit(lam)) - 1.0) / F.lit(lam)
    if abs(lam - 2.0) < 1e-12:
        neg = -F.log1p(-x)
    else:
        neg = -(F.pow(1.0 - x, F.lit(2.0 - lam)) - 1.0) / F.lit(2.0 - lam)
    return F.when(x.isNull(), F.lit(None).cast("double")).when(x >= 0, pos).otherwise(neg)


# ---------------------------------------------------------------- T4
def min_max_scale(c: Column | str, lo: float | None, hi: float | None) -> Column:
    """(x - lo) / (hi - lo); a constant or empty column scales to null."""
    x = _c(c).cast("double")
    if lo is None or hi is None or hi == lo:
        return F.lit(None).cast("double")
    return (x - F.lit(float(lo))) / F.lit(float(hi) - float(lo))


# ---------------------------------------------------------------- P5-P7
def blank_to_null(c: Column | str) -> Column:
    """P5: the empty string level becomes null."""
    return F.nullif(_c(c), F.lit(""))


def blank_to_level(c: Column | str, level: str = EMPTY_LEVEL) -> Column:
    """The empty string level gets a name."""
    x = _c(c)
    return F.when(x == "", F.lit(level)).otherwise(x)


def null_to_level(c: Column | str, level: str = EMPTY_LEVEL) -> Column:
    """Null string becomes a named level."""
    return F.coalesce(_c(c), F.lit(level))


# ---------------------------------------------------------------- A9-A11
def null_count(cols: Iterable[str]) -> Column:
    terms = [F.col(c).isNull().cast("int") for c in cols]
    if not terms:
        return F.lit(0)
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def row_null_share(cols: Sequence[str], denominator: int | None = None) -> Column:
    """Share of the listed cells that are null in each row."""
    d = denominator if denominator is not None else len(cols)
    if d == 0:
        return F.lit(None).cast("double")
    return null_count(cols).cast("double") / F.lit(float(d))


def row_below_zero_share(num_cols: Sequence[str], denominator: int) -> Column:
    """Non-null numeric cells below zero, over ``denominator`` columns."""
    terms = [F.coalesce((F.col(c) < 0).cast("int"), F.lit(0)) for c in num_cols]
    if not terms or denominator == 0:
        return F.lit(None).cast("double")
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out.cast("double") / F.lit(float(denominator))


# ---------------------------------------------------------------- E8-E10
def str_len(c: Column | str) -> Column:
    """Character length; null counts as 0."""
    return F.coalesce(F.length(_c(c)), F.lit(0))


def char_at(c: Column | str, i: int) -> Column:
    """I-th character (1-based); null or past the end gives ''."""
    return F.coalesce(F.substring(_c(c), i, 1), F.lit(""))


def letter_count(cols: Sequence[str], letter: str) -> Column:
    """In how many of the listed cells the value equals ``letter``."""
    terms = [F.coalesce((F.col(c).cast("string") == F.lit(letter)).cast("int"), F.lit(0))
             for c in cols]
    if not terms:
        return F.lit(0)
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


# ---------------------------------------------------------------- V1
def clip_prob(p: Column | str, eps: float = PROB_EPS) -> Column:
    return F.greatest(F.least(_c(p).cast("double"), F.lit(1.0 - eps)), F.lit(eps))


def logloss_term(y: Column | str, p: Column | str, eps: float = PROB_EPS) -> Column:
    """Per-row binary log-loss with the probability clipped to [eps, 1-eps]."""
    q = clip_prob(p, eps)
    yy = _c(y).cast("double")
    return -(yy * F.ln(q) + (F.lit(1.0) - yy) * F.ln(F.lit(1.0) - q))
