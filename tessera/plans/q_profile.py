"""Queries for profiling (A) and association (C)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tessera.operators import assoc, profile
from tessera.plans.registry import R, query, rounded, with_claims
from tessera.sources.tables import (LINEITEM_NUMERIC, LINEITEM_STRING, claims_view,
                                    lineitem_view)

FAC = ["v3", "v71", "v22", "v66", "v38"]
NUM = ["v1", "v23", "v50"]
CLASSES = [("ID", "integer"), ("target", "integer"), ("v1", "numeric"), ("v23", "numeric"),
           ("v38", "integer"), ("v50", "numeric"), ("v3", "character"), ("v71", "character"),
           ("v22", "character"), ("v66", "character")]


@query("a1_label_counts", with_claims(
    f"SELECT CAST(target AS VARCHAR) AS level, count(*) AS n, "
    f"{R('count(*) / sum(count(*)) OVER ()')} AS share FROM claims GROUP BY target"))
def a1_label_counts(spark, d):
    """A1: label class counts and shares (null label counted, share over all rows)."""
    return rounded(profile.label_counts(claims_view(spark, d)))


@query("a3_column_nulls", with_claims(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{k}' AS col_class, CAST(count(*) - count({c}) AS BIGINT) AS n_null, "
        f"{R(f'(count(*) - count({c})) / count(*)')} AS null_share FROM claims" for c, k in CLASSES)))
def a3_column_nulls(spark, d):
    """A3: column class, null count and null share of every column."""
    return rounded(profile.column_nulls(claims_view(spark, d)))


@query("a13_columns_with_nulls", with_claims(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(count(*) - count({c}) AS BIGINT) AS n_null FROM claims "
        f"HAVING count(*) - count({c}) > 0" for c, _ in CLASSES)))
def a13_columns_with_nulls(spark, d):
    """The columns that contain nulls."""
    return profile.columns_with_nulls(claims_view(spark, d))


@query("a4_level_counts", with_claims(
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_levels FROM claims"
                       for c in FAC)))
def a4_level_counts(spark, d):
    """A4: number of levels of every categorical column ('' is a level)."""
    return profile.level_counts(claims_view(spark, d), FAC)


@query("a15_unseen_levels", with_claims(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(count(DISTINCT CASE WHEN target IS NOT NULL THEN "
        f"CAST({c} AS VARCHAR) END) AS BIGINT) AS levels_train, count(DISTINCT {c}) AS levels_total, "
        f"count(DISTINCT {c}) - count(DISTINCT CASE WHEN target IS NOT NULL THEN CAST({c} AS VARCHAR) END) "
        f"AS levels_unseen FROM claims" for c in FAC)))
def a15_unseen_levels(spark, d):
    """Levels seen in labelled rows against all levels."""
    return profile.unseen_level_report(claims_view(spark, d), FAC)


def _summary_sql(table: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        m = (f"(SELECT min({c}) AS mn, max({c}) AS mx, avg({c}) AS mean, count({c}) AS n, "
             f"count(*) - count({c}) AS nulls, quantile_cont({c}, 0.25) AS q1, "
             f"quantile_cont({c}, 0.5) AS med, quantile_cont({c}, 0.75) AS q3 FROM {table})")
        mo = (f"(SELECT avg(power({c} - s.mean, 2)) AS m2, avg(power({c} - s.mean, 3)) AS m3, "
              f"avg(power({c} - s.mean, 4)) AS m4 FROM {table}, {m} s WHERE {c} IS NOT NULL)")
        body = (f"SELECT s.*, o.m3 / power(o.m2, 1.5) AS skew, o.m4 / power(o.m2, 2) AS kurt "
                f"FROM {m} s, {mo} o")
        jb = "exp(-(n / 6.0) * (power(skew, 2) + power(kurt - 3.0, 2) / 4.0) / 2.0)"
        stats = [("Min.", "mn"), ("1st Qu.", "q1"), ("Median", "med"), ("Mean", "mean"),
                 ("3rd Qu.", "q3"), ("Max.", "mx"), ("NA's", "nulls"), ("skewness", "skew"),
                 ("kurtosis", "kurt"), ("jarque-brera", jb)]
        for name, e in stats:
            parts.append(f"SELECT '{c}' AS \"column\", '{name.replace(chr(39), chr(39) * 2)}' AS stat, {R(e)} AS value FROM ({body}) b")
    return " UNION ALL ".join(parts)


@query("a5_numeric_summary", with_claims(_summary_sql("claims", NUM + ["v38"])))
def a5_numeric_summary(spark, d):
    """A5-A8 (and A2 for a continuous label): quartiles (exact), mean,
    extremes, null count, skewness, kurtosis, Jarque-Bera p-value."""
    return rounded(profile.numeric_summary(claims_view(spark, d), NUM + ["v38"]))


@query("a5_lineitem_summary", _summary_sql("lineitem", LINEITEM_NUMERIC))
def a5_lineitem_summary(spark, d):
    """A5-A8 over every lineitem row (scale run)."""
    return rounded(profile.numeric_summary(lineitem_view(spark, d), LINEITEM_NUMERIC))


@query("a12_histogram", with_claims(
    "SELECT CAST(floor(v1 / 10000.0) AS BIGINT) AS bin, floor(v1 / 10000.0) * 10000.0 AS lo, "
    "(floor(v1 / 10000.0) + 1) * 10000.0 AS hi, count(*) AS n FROM claims WHERE v1 IS NOT NULL "
    "GROUP BY 1, 2, 3"))
def a12_histogram(spark, d):
    """Fixed-width histogram (width 10,000) of v1."""
    return profile.histogram(claims_view(spark, d), "v1", width=10000.0, origin=0.0)


@query("a2_target_summary", with_claims(_summary_sql("claims", ["target"])))
def a2_target_summary(spark, d):
    """A2: the label treated as continuous gets the numeric summary."""
    return rounded(profile.target_summary(claims_view(spark, d), "target"))


@query("a12_freq_polygon", with_claims(
    "SELECT CAST(floor((v23 - s.a) / s.w) AS BIGINT) AS bin, s.a + floor((v23 - s.a) / s.w) * s.w AS lo, "
    "s.a + (floor((v23 - s.a) / s.w) + 1) * s.w AS hi, count(*) AS n FROM claims, "
    "(SELECT min(v23) AS a, (max(v23) - min(v23)) / 15.0 AS w FROM claims) s "
    "WHERE v23 IS NOT NULL GROUP BY 1, 2, 3"))
def a12_freq_polygon(spark, d):
    """Frequency polygon data of v23 - 15 equal bins over its range
    (bin edges from one min/max aggregate)."""
    return profile.histogram(claims_view(spark, d), "v23", bins=15)


@query("a14_null_positions", with_claims(
    " UNION ALL ".join(f"SELECT ID, '{c}' AS \"column\" FROM claims WHERE {c} IS NULL"
                       for c in ["v1", "v23", "v38", "v71", "v22"])))
def a14_null_positions(spark, d):
    """(ID, column) of every null cell."""
    return profile.null_positions(claims_view(spark, d), ["v1", "v23", "v38", "v71", "v22"])


# ---------------------------------------------------------------- association
def _pearson_sql(table: str, cols: list[str]) -> str:
    parts = []
    for a, b in combinations(cols, 2):
        core = (f"SELECT count(*) AS n, corr({a}, {b}) AS r FROM {table} "
                f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL")
        for x, y in ((a, b), (b, a)):
            parts.append(f"SELECT '{x}' AS col_a, '{y}' AS col_b, 'num-num' AS kind, n, "
                         f"{R('CASE WHEN n >= 2 THEN r END')} AS stat FROM ({core}) t")
    return " UNION ALL ".join(parts)


def _cramer_sql(table: str, cols: list[str], cap: int = 100) -> str:
    parts = []
    for a, b in combinations(cols, 2):
        cells = (f"SELECT CAST({a} AS VARCHAR) AS la, CAST({b} AS VARCHAR) AS lb, count(*) AS nij "
                 f"FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2")
        core = (f"SELECT sum(nij * nij / (ni * nj)) AS s, sum(nij) AS n, count(DISTINCT la) AS r, "
                f"count(DISTINCT lb) AS c FROM (SELECT *, sum(nij) OVER (PARTITION BY la) AS ni, "
                f"sum(nij) OVER (PARTITION BY lb) AS nj FROM ({cells}) x) y")
        capok = (f"(SELECT count(DISTINCT {a}) FROM {table}) <= {cap} AND "
                 f"(SELECT count(DISTINCT {b}) FROM {table}) <= {cap}")
        v = "CASE WHEN least(r, c) >= 2 THEN sqrt(greatest(s - 1.0, 0.0) / (least(r, c) - 1)) END"
        for x, y in ((a, b), (b, a)):
            parts.append(
                f"SELECT '{x}' AS col_a, '{y}' AS col_b, 'fac-fac' AS kind, "
                f"CASE WHEN {capok} THEN CAST(n AS BIGINT) END AS n, "
                f"CASE WHEN {capok} THEN {R(v)} END AS stat FROM ({core}) t")
    return " UNION ALL ".join(parts)


def _anova_sql(table: str, nums: list[str], facs: list[str], cap: int = 100) -> str:
    parts = []
    for y in nums:
        for f in facs:
            per = (f"SELECT CAST({f} AS VARCHAR) AS lvl, count(*) AS nl, avg({y}) AS ml, "
                   f"var_pop({y}) AS vl FROM {table} WHERE {y} IS NOT NULL AND {f} IS NOT NULL GROUP BY 1")
            tot = (f"SELECT sum(nl) AS n, sum(nl * ml) / sum(nl) AS m, count(*) AS k FROM ({per}) p")
            ss = (f"SELECT t.n, t.k, sum(p.nl * power(p.ml - t.m, 2)) AS ssb, sum(p.nl * p.vl) AS ssw "
                  f"FROM ({per}) p, ({tot}) t GROUP BY t.n, t.k")
            adj = ("CASE WHEN k = 1 THEN 0.0 WHEN n > k AND ssb + ssw > 0 THEN "
                   "1.0 - (1.0 - ssb / (ssb + ssw)) * (n - 1) / (n - k) END")
            capok = f"(SELECT count(DISTINCT {f}) FROM {table}) <= {cap}"
            for x, z in ((y, f), (f, y)):
                parts.append(
                    f"SELECT '{x}' AS col_a, '{z}' AS col_b, 'num-fac' AS kind, "
                    f"CASE WHEN {capok} THEN CAST(n AS BIGINT) END AS n, "
                    f"CASE WHEN {capok} THEN {R(adj)} END AS stat FROM ({ss}) s")
    return " UNION ALL ".join(parts)


@query("c1_pearson", with_claims(_pearson_sql("claims", NUM + ["v38"])))
def c1_pearson(spark, d):
    """Pairwise-complete Pearson correlation of the numeric columns."""
    return rounded(assoc.pearson_pairs(claims_view(spark, d), NUM + ["v38"]))


@query("c3_cramers_v", with_claims(_cramer_sql("claims", FAC, cap=100)))
def c3_cramers_v(spark, d):
    """C2 + C3: Cramer's V of every categorical pair, level cap 100 (v22,
    with more levels, gives null pairs)."""
    return rounded(assoc.cramers_v_pairs(claims_view(spark, d), FAC, level_cap=100))


@query("c2_simulated_p", with_claims(
    f"SELECT col_a, col_b, n, stat AS v, TRUE AS p_is_near FROM ({_cramer_sql('claims', FAC, cap=100)}) m WHERE stat IS NOT NULL AND ("
    + " OR ".join(f"(col_a = '{a}' AND col_b = '{b}')" for i, a in enumerate(FAC) for b in FAC[i + 1:]) + ")"))
def c2_simulated_p(spark, d):
    """C2 with 1,000 random tables of the same margins for each pair. Fact:
    where every expected count is at least 5, the simulated p-value is within 0.08 (five
    standard errors) of the chi-square distribution's (its cube root taken as normal)."""
    c = claims_view(spark, d)
    told = assoc.simulated_p_values(c, FAC, level_cap=100)
    width = {r["column"]: r["n_levels"] for r in profile.level_counts(c, FAC).collect()}  # one row a column
    sides = F.create_map(*[x for k, v in width.items() for x in (F.lit(k), F.lit(int(v)))])
    k = F.least(sides[F.col("col_a")], sides[F.col("col_b")]) - 1
    free = ((sides[F.col("col_a")] - 1) * (sides[F.col("col_b")] - 1)).cast("double")
    chi = F.col("n") * F.col("v") * F.col("v") * k
    z = (F.pow(chi / free, F.lit(1 / 3)) - 1 + 2 / (9 * free)) / F.sqrt(2 / (9 * free))
    tail = 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))
    near = F.col("p_value").between(0, 1) & ((F.col("least_expected") < 5) | (F.abs(F.col("p_value") - tail) < 0.08))
    return rounded(told.where("v is not null").select("col_a", "col_b", "n", "v", near.alias("p_is_near")))


@query("c4_anova_r2", with_claims(_anova_sql("claims", NUM, FAC, cap=100)))
def c4_anova_r2(spark, d):
    """C4: adjusted R^2 of numeric ~ categorical, level cap 100."""
    return rounded(assoc.anova_r2_pairs(claims_view(spark, d), NUM, FAC, level_cap=100))


_C5 = " UNION ALL ".join([_pearson_sql("claims", NUM), _cramer_sql("claims", FAC),
                          _anova_sql("claims", NUM, FAC)])


@query("c5_association_matrix", with_claims(
    f"SELECT col_a, col_b, kind, n, coalesce(stat, 0.0) AS stat FROM ({_C5}) m"))
def c5_association_matrix(spark, d):
    """C5 + C6: the combined mixed-type association matrix (long form) with
    unknown associations set to 0."""
    m = assoc.association_matrix(claims_view(spark, d), NUM, FAC, level_cap=100)
    return assoc.fill_unknown(rounded(m), 0.0)


@query("c5_lineitem_association", " UNION ALL ".join([
    _pearson_sql("lineitem", LINEITEM_NUMERIC), _cramer_sql("lineitem", LINEITEM_STRING),
    _anova_sql("lineitem", LINEITEM_NUMERIC, LINEITEM_STRING)]))
def c5_lineitem_association(spark, d):
    """C5 over every lineitem row (scale run)."""
    return rounded(assoc.association_matrix(lineitem_view(spark, d), LINEITEM_NUMERIC,
                                            LINEITEM_STRING, level_cap=100))
