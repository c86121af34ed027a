"""Registry of named queries and their independent SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.tables import CLAIMS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

DIGITS = 12
MAX_DECIMALS = 9


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def sig_round(c, digits: int = DIGITS, max_decimals: int = MAX_DECIMALS):
    """Round a double as round(x * 10^d) / 10^d with
    d = min(max_decimals, digits - 1 - floor(log10|x|)): ``digits``
    significant digits for large values, at most ``max_decimals`` decimals
    for small ones (statistics such as a skewness near 0 carry absolute, not
    relative, rounding error). Powers of ten are exact in both engines and the
    same formula runs in the SQL twin (``R``); ``+ 0.0`` folds -0.0 into 0.0."""
    x = c.cast("double")
    a = F.abs(x)
    d = F.least(F.lit(max_decimals), F.lit(digits - 1) - F.floor(F.log10(a)))
    m = F.pow(F.lit(10.0), d.cast("double"))
    m2 = F.pow(F.lit(10.0), (-d).cast("double"))
    r = F.when(d >= 0, F.round(x * m, 0) / m).otherwise(F.round(x / m2, 0) * m2)
    special = (x == 0) | F.isnan(x) | (a == F.lit(float("inf")))
    return F.when(x.isNull(), F.lit(None).cast("double")).when(special, x + F.lit(0.0)) \
        .otherwise(r + F.lit(0.0))


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:  # noqa: D401
    """Round every double column to ``digits`` significant digits (engines
    sum in different orders; see ``sig_round``)."""
    return df.select(*[
        sig_round(F.col(f.name), digits).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields])


def R(expr: str, digits: int = DIGITS, max_decimals: int = MAX_DECIMALS) -> str:
    """SQL twin of ``sig_round`` for one expression."""
    e = f"CAST(({expr}) AS DOUBLE)"
    d = f"least({max_decimals}, {digits - 1} - floor(log10(abs({e}))))"
    return (f"(CASE WHEN {e} IS NULL THEN NULL WHEN {e} = 0 OR isnan({e}) OR isinf({e}) THEN {e} + 0.0 "
            f"WHEN {d} >= 0 THEN round({e} * power(10.0, {d})) / power(10.0, {d}) + 0.0 "
            f"ELSE round({e} / power(10.0, -{d})) * power(10.0, -{d}) + 0.0 END)")


def with_claims(body: str, extra_ctes: str = "") -> str:
    ctes = f"claims AS ({CLAIMS_SQL})"
    if extra_ctes:
        ctes += ",\n" + extra_ctes
    return f"WITH {ctes}\n{body}"
