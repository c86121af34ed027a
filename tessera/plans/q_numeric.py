"""Queries for numeric transforms (T) and imputation (I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.hashing import draw_index_sql, mix_sql
from tessera.operators import impute, transform
from tessera.plans.registry import R, query, rounded, with_claims
from tessera.sources.tables import claims_view

NUM = ["v1", "v23", "v50"]


def special_log_sql(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL THEN NULL WHEN {c} > 0 THEN ln({c}) "
            f"WHEN {c} = 0 THEN CAST('-inf' AS DOUBLE) ELSE -40.0 END")


@query("t1_special_log", with_claims(
    f"SELECT ID, {R(special_log_sql('v23'))} AS Ts_v23, {R(special_log_sql('v50'))} AS Ts_v50 FROM claims"))
def t1_special_log(spark, d):
    """Log with -inf at 0 and -40 for negatives (nulls stay null)."""
    df = claims_view(spark, d).select("ID", "v23", "v50")
    return rounded(transform.add_special_log(df, ["v23", "v50"]).select("ID", "Ts_v23", "Ts_v50"))


@query("t2_log1p", with_claims(
    "SELECT ID, " + ", ".join(f"{R(f'CASE WHEN {c} > -1 THEN ln(1 + {c}) END')} AS Tl_{c}"
                              for c in ["v1", "v23", "v50"]) + " FROM claims"))
def t2_log1p(spark, d):
    """log(1 + x); x <= -1 gives null."""
    df = claims_view(spark, d).select("ID", "v1", "v23", "v50")
    return rounded(transform.add_log1p(df, ["v1", "v23", "v50"]).select("ID", "Tl_v1", "Tl_v23", "Tl_v50"))


def yj_sql(x: str, lam: str) -> str:
    """Yeo-Johnson of SQL expression x with SQL lambda expression lam."""
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} >= 0 THEN "
            f"(CASE WHEN abs({lam}) < 1e-12 THEN ln(1 + {x}) ELSE (power({x} + 1.0, {lam}) - 1.0) / {lam} END) "
            f"ELSE (CASE WHEN abs({lam} - 2.0) < 1e-12 THEN -ln(1 - {x}) "
            f"ELSE -(power(1.0 - {x}, 2.0 - {lam}) - 1.0) / (2.0 - {lam}) END) END")


def yj_lambda_cte(name: str, col: str, src: str = "claims", shift: str = "0.0") -> str:
    """CTE choosing the grid lambda (-2..2 by 0.1) of maximal profile likelihood."""
    x = f"({col} - {shift})"
    return (
        f"{name}_g AS (SELECT round(g / 10.0, 1) AS lam FROM range(-20, 21) t(g)), "
        f"{name}_ll AS (SELECT lam, -0.5 * count({x}) * ln(var_pop({yj_sql(x, 'lam')})) "
        f"+ (lam - 1.0) * sum(sign({x}) * ln(1 + abs({x}))) AS ll FROM {src}, {name}_g GROUP BY lam), "
        f"{name} AS (SELECT lam FROM {name}_ll ORDER BY ll DESC, lam LIMIT 1)")


@query("t3_yeo_johnson", with_claims(
    f"SELECT ID, {R(yj_sql('v50', '(SELECT lam FROM yj50)'))} AS Tyj_v50, "
    f"{R(yj_sql('v23', '(SELECT lam FROM yj23)'))} AS Tyj_v23 FROM claims",
    yj_lambda_cte("yj50", "v50") + ", " + yj_lambda_cte("yj23", "v23")))
def t3_yeo_johnson(spark, d):
    """Yeo-Johnson with the maximum-likelihood lambda on a fixed grid."""
    df = claims_view(spark, d).select("ID", "v50", "v23")
    return rounded(transform.add_yeo_johnson(df, ["v50", "v23"]).select("ID", "Tyj_v50", "Tyj_v23"))


def _yj_fine_cte(name: str, col: str) -> str:
    """CTE ``<name>``: the lambda of maximal likelihood within 0.1 of the grid's, by 0.001."""
    return (f"{yj_lambda_cte(name + '_0', col)}, {name}_g AS (SELECT lam + g * 0.001 AS lam FROM {name}_0, range(-100, 101) t(g)), "
            f"{name}_ll AS (SELECT lam, -0.5 * count({col}) * ln(var_pop({yj_sql(col, 'lam')})) "
            f"+ (lam - 1.0) * sum(sign({col}) * ln(1 + abs({col}))) AS ll FROM claims, {name}_g GROUP BY lam), "
            f"{name} AS (SELECT lam FROM {name}_ll ORDER BY ll DESC, lam LIMIT 1)")


@query("t3_yeo_johnson_fine", with_claims(
    f"SELECT ID, {R(yj_sql('v1', '(SELECT lam FROM yj1)'), 8)} AS Tyj_v1, "
    f"{R(yj_sql('v50', '(SELECT lam FROM yj50)'), 8)} AS Tyj_v50 FROM claims",
    _yj_fine_cte("yj1", "v1") + ", " + _yj_fine_cte("yj50", "v50")))
def t3_yeo_johnson_fine(spark, d):
    """T3 with a lambda fitted to 0.001: the grid's maximum, then its neighbourhood."""
    df = claims_view(spark, d).select("ID", "v1", "v50")
    return rounded(transform.add_yeo_johnson(df, ["v1", "v50"], step=0.001).select("ID", "Tyj_v1", "Tyj_v50"), 8)


@query("t4_range_scale", with_claims(
    "SELECT ID, target, " + ", ".join(
        f"{R(f'CASE WHEN s.b_{c} > s.a_{c} THEN ({c} - s.a_{c}) / (s.b_{c} - s.a_{c}) END')} AS {c}"
        for c in NUM) + " FROM claims, (SELECT " + ", ".join(
        f"min({c}) AS a_{c}, max({c}) AS b_{c}" for c in NUM) + " FROM claims) s"))
def t4_range_scale(spark, d):
    """T4: min-max scaling fitted over all rows (constant column -> null)."""
    df = claims_view(spark, d).select("ID", "target", *NUM)
    return rounded(transform.range_scale(df, NUM))


def _diag_sql(c: str) -> str:
    mn = f"(SELECT min({c}) FROM claims)"
    x = f"({c} - {mn})"
    lam = f"(SELECT lam FROM d_{c})"

    def sk(e: str) -> str:
        return (f"(SELECT avg(power(z - m, 3)) / power(avg(power(z - m, 2)), 1.5) FROM "
                f"(SELECT {e} AS z, avg({e}) OVER () AS m FROM claims WHERE {c} IS NOT NULL) q)")
    return (f"SELECT '{c}' AS \"column\", {lam} AS \"lambda\", {R(sk(x))} AS skew_raw, "
            f"{R(sk(f'ln(1 + {x})'))} AS skew_log, {R(sk(yj_sql(x, lam)))} AS skew_yj")


_DIAG = ["v1", "v23", "v50"]


@query("t6_transform_diagnostics", with_claims(
    "SELECT \"column\", \"lambda\", skew_raw, skew_log, skew_yj, CASE "
    "WHEN abs(skew_raw) <= abs(skew_log) AND abs(skew_raw) <= abs(skew_yj) THEN 'rescale' "
    "WHEN abs(skew_log) <= abs(skew_yj) THEN 'log(1+x)' ELSE 'YeoJohnson' END AS choice FROM ("
    + " UNION ALL ".join(_diag_sql(c) for c in _DIAG) + ") t",
    ", ".join(yj_lambda_cte(f"d_{c}", c, shift=f"(SELECT min({c}) FROM claims)") for c in _DIAG)))
def t6_transform_diagnostics(spark, d):
    """Skewness of raw, log(1+x) and Yeo-Johnson versions of each
    (min-shifted) column and the least-skewed choice."""
    r = transform.transform_diagnostics(claims_view(spark, d), _DIAG)
    return rounded(r)


# ---------------------------------------------------------------- imputation
_FILL_SQL = ("SELECT ID, target, coalesce(v1, -999.0) AS v1, coalesce(v23, -999.0) AS v23, "
             "coalesce(CAST(v38 AS DOUBLE), -999.0) AS v38, coalesce(v50, -999.0) AS v50, "
             "coalesce(v3, '') AS v3, coalesce(v71, '') AS v71, coalesce(v22, '') AS v22, "
             "coalesce(v66, '') AS v66 FROM claims")


@query("i1_constant_fill", with_claims(_FILL_SQL))
def i1_constant_fill(spark, d):
    """Numbers -> -999, strings -> '' (v38 as double, as after P1)."""
    df = claims_view(spark, d).withColumn("v38", F.col("v38").cast("double"))
    return impute.fill_constant(df)


def _mode_cte(c: str) -> str:
    return (f"m_{c} AS (SELECT {c} AS v FROM claims WHERE {c} IS NOT NULL GROUP BY {c} "
            f"ORDER BY count(*) DESC, {c} ASC LIMIT 1)")


@query("i2_mode_fill", with_claims(
    "SELECT ID, target, " + ", ".join(f"coalesce(CAST({c} AS DOUBLE), (SELECT CAST(v AS DOUBLE) FROM m_{c})) AS {c}"
                                      for c in NUM + ["v38"]) + " FROM claims",
    ", ".join(_mode_cte(c) for c in NUM + ["v38"])))
def i2_mode_fill(spark, d):
    """Numeric nulls -> most frequent value (ties -> smallest)."""
    df = claims_view(spark, d).select("ID", "target", *NUM, F.col("v38").cast("double").alias("v38"))
    return impute.fill_mode(df, NUM + ["v38"])


@query("i3_median_fill", with_claims(
    "SELECT ID, target, " + ", ".join(
        f"{R(f'coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont({c}, 0.5) FROM claims))')} AS {c}"
        for c in NUM + ["v38"]) + " FROM claims"))
def i3_median_fill(spark, d):
    """Numeric nulls -> exact median."""
    df = claims_view(spark, d).select("ID", "target", *NUM, F.col("v38").cast("double").alias("v38"))
    return rounded(impute.fill_median(df, NUM + ["v38"]))


_RI_COLS = ["v1", "v23", "v38"]
_RI_SEED = 321


def _random_sql() -> str:
    ctes = []
    sel = []
    for c in _RI_COLS:
        salt = impute.column_salt(_RI_SEED, c)
        ctes.append(
            f"d_{c} AS (SELECT CAST({c} AS DOUBLE) AS value, row_number() OVER (ORDER BY ID) - 1 AS idx "
            f"FROM claims WHERE {c} IS NOT NULL), "
            f"n_{c} AS (SELECT count(*) AS m FROM d_{c}), "
            f"r_{c} AS (SELECT claims.ID, d.value FROM claims CROSS JOIN n_{c} JOIN d_{c} d ON "
            f"d.idx = {draw_index_sql('claims.ID', salt, 'n_' + c + '.m')} WHERE claims.{c} IS NULL)")
        sel.append(f"coalesce(CAST(claims.{c} AS DOUBLE), (SELECT value FROM r_{c} WHERE r_{c}.ID = claims.ID)) AS {c}")
    return with_claims("SELECT ID, target, " + ", ".join(sel) + ", v50 FROM claims", ", ".join(ctes))


@query("i4_random_impute", _random_sql())
def i4_random_impute(spark, d):
    """I4: each null cell draws an observed value of its column with
    replacement (reproducible hash draw over donors numbered in ID order)."""
    df = claims_view(spark, d).select("ID", "target", "v1", "v23",
                                      F.col("v38").cast("double").alias("v38"), "v50")
    return impute.random_impute(df, _RI_COLS, seed=_RI_SEED)


@query("i10_random_partition", with_claims(
    f"SELECT ID, CAST({mix_sql('ID', 47)} % 8 + 1 AS INTEGER) AS imp_fold FROM claims"))
def i10_random_partition(spark, d):
    """Disjoint random partition of the rows into 8 parts."""
    return impute.add_partition(claims_view(spark, d).select("ID"), k=8, seed=47)


def _retransform_sql() -> str:
    body = _random_sql()
    inner = body[len("WITH "):]
    ctes, _, select = inner.rpartition("\nSELECT ")
    sel = "SELECT " + select
    t = (f"imp AS ({sel}), tr AS (SELECT ID, target, v1, v23, v38, v50, "
         f"{special_log_sql('v23')} AS Ts_v23, CASE WHEN v1 > -1 THEN ln(1 + v1) END AS Tl_v1 FROM imp), "
         "rg AS (SELECT min(Ts_v23) AS a1, max(Ts_v23) AS b1, min(Tl_v1) AS a2, max(Tl_v1) AS b2 FROM tr)")
    out = (f"SELECT ID, target, v1, v23, v38, v50, "
           f"{R('CASE WHEN rg.b1 > rg.a1 THEN (Ts_v23 - rg.a1) / (rg.b1 - rg.a1) END')} AS Ts_v23, "
           f"{R('CASE WHEN rg.b2 > rg.a2 THEN (Tl_v1 - rg.a2) / (rg.b2 - rg.a2) END')} AS Tl_v1 "
           "FROM tr, rg")
    return f"WITH {ctes}, {t}\n{out}"


@query("i9_retransform_after_impute", _retransform_sql())
def i9_retransform_after_impute(spark, d):
    """I9 after I4: random-draw imputation of v1, v23, v38, then the special
    log of v23 and log(1 + v1) re-derived from the completed columns and only
    those re-derived columns min-max scaled."""
    from tessera.plans.features import retransform
    df = claims_view(spark, d).select("ID", "target", "v1", "v23",
                                      F.col("v38").cast("double").alias("v38"), "v50")
    filled = impute.random_impute(df, _RI_COLS, seed=_RI_SEED)
    return rounded(retransform(filled, special_log=["v23"], log1p=["v1"]))
