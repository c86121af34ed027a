"""Queries for categorical encoders (E) and the lookup join."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.operators import encode
from tessera.plans.registry import R, query, rounded, with_claims
from tessera.sources.tables import CLAIMS_STRING, claims_view

LETTERS = X.LETTERS


def impact_sql(col: str, src: str = "claims", lvl_expr: str | None = None) -> tuple[str, str]:
    """CTE text and value expression of in-sample impact coding of ``col``."""
    lv = lvl_expr or f"CAST({col} AS VARCHAR)"
    cte = (
        f"imp_{col}_t AS (SELECT count(*) AS n, sum(target) AS n1, "
        f"count(*) FILTER (WHERE {col} IS NULL) AS nn, "
        f"coalesce(sum(target) FILTER (WHERE {col} IS NULL), 0) AS nn1 FROM {src} WHERE target IS NOT NULL), "
        f"imp_{col}_m AS (SELECT {lv} AS level, (sum(target) + (SELECT n1 * 1.0 / n FROM imp_{col}_t)) "
        f"/ (count(*) + 1.0) AS value FROM {src} WHERE target IS NOT NULL AND {col} IS NOT NULL GROUP BY 1), "
        f"imp_{col}_na AS (SELECT (n1 + nn1 + n1 * 1.0 / n) / (n + nn + 1.0) AS na FROM imp_{col}_t)")
    val = (f"coalesce((SELECT m.value FROM imp_{col}_m m WHERE m.level = {lv}), "
           f"(SELECT na FROM imp_{col}_na))")
    return cte, val


_IMP_COLS = ["v22", "v71", "v38"]
_imp = [impact_sql(c) for c in _IMP_COLS]


@query("e3_impact_encode", with_claims(
    "SELECT ID, target, " + ", ".join(f"{R(v)} AS Imp_{c}" for c, (_, v) in zip(_IMP_COLS, _imp))
    + " FROM claims", ",\n".join(cte for cte, _ in _imp)))
def e3_impact_encode(spark, d):
    """E1 + E2 + E3 + J3: smoothed target rate of each level (labelled rows),
    null and unseen levels sharing the NA value, for v22 (high-cardinality),
    v71 (with '') and v38 (integer-coded)."""
    df = claims_view(spark, d).select("ID", "target", *_IMP_COLS)
    return rounded(encode.impact_encode(df, _IMP_COLS, row_key="ID").drop(*_IMP_COLS))


@query("e4_one_hot", with_claims(
    "SELECT ID, " + ", ".join(
        f"CASE WHEN coalesce(v3, 'nan') = '{lv}' THEN 1 ELSE 0 END AS \"v3_{lv}\""
        for lv in ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]) + " FROM claims"))
def e4_one_hot(spark, d):
    """One 0/1 column per level of v3 (level list fitted from the data;
    the oracle spells the five TPC-H market segments)."""
    df = claims_view(spark, d).select("ID", "v3")
    out, _ = encode.one_hot(df, "v3", max_levels=100)
    return out


def nb_sql(col: str) -> tuple[str, str]:
    lv = f"coalesce(CAST({col} AS VARCHAR), 'nan')"
    cte = (
        f"nb_{col}_c AS (SELECT count(*) FILTER (WHERE target = 0) AS c0, "
        f"count(*) FILTER (WHERE target = 1) AS c1 FROM claims WHERE target IS NOT NULL), "
        f"nb_{col}_th AS (SELECT {lv} AS level, "
        f"(count(*) FILTER (WHERE target = 0) + 1.0) / ((SELECT c0 FROM nb_{col}_c) + 2.0) AS t0, "
        f"(count(*) FILTER (WHERE target = 1) + 1.0) / ((SELECT c1 FROM nb_{col}_c) + 2.0) AS t1 "
        f"FROM claims WHERE target IS NOT NULL GROUP BY 1), "
        f"nb_{col}_b AS (SELECT ln(c0 * 1.0 / (c0 + c1)) + (SELECT sum(ln(1 - t0)) FROM nb_{col}_th) AS b0, "
        f"ln(c1 * 1.0 / (c0 + c1)) + (SELECT sum(ln(1 - t1)) FROM nb_{col}_th) AS b1 FROM nb_{col}_c), "
        f"nb_{col}_m AS (SELECT level, 1.0 / (1.0 + exp((b.b0 + ln(t0) - ln(1 - t0)) "
        f"- (b.b1 + ln(t1) - ln(1 - t1)))) AS value FROM nb_{col}_th, nb_{col}_b b)")
    val = (f"coalesce((SELECT value FROM nb_{col}_m m WHERE m.level = {lv}), "
           f"(SELECT 1.0 / (1.0 + exp(b0 - b1)) FROM nb_{col}_b))")
    return cte, val


_NB_COLS = ["v3", "v71", "v22"]
_nb = [nb_sql(c) for c in _NB_COLS]


@query("e5_nb_impact", with_claims(
    "SELECT ID, " + ", ".join(f"{R(v)} AS Imp_{c}" for c, (_, v) in zip(_NB_COLS, _nb))
    + " FROM claims", ",\n".join(cte for cte, _ in _nb)))
def e5_nb_impact(spark, d):
    """E5: Bernoulli naive-Bayes posterior of each level's one-hot vector
    (alpha = 1), closed form; no one-hot matrix is materialised."""
    df = claims_view(spark, d).select("ID", "target", *_NB_COLS)
    return rounded(encode.nb_impact_encode(df, _NB_COLS).select("ID", *[f"Imp_{c}" for c in _NB_COLS]))


def freq_sql(col: str, buckets: int | None, src: str = "claims") -> tuple[str, str, str]:
    cte = (
        f"fq_{col}_c AS (SELECT CAST({col} AS VARCHAR) AS level, count(*) AS cnt FROM {src} GROUP BY 1), "
        f"fq_{col}_s AS (SELECT sum(cnt) AS n, min(cnt) AS cmin, max(cnt) AS cmax, "
        f"count(DISTINCT cnt) + CASE WHEN count(*) FILTER (WHERE level IS NULL) > 0 THEN 0 ELSE 1 END AS nd "
        f"FROM fq_{col}_c)")
    b = str(buckets) if buckets else "s.nd"
    k = (f"CASE WHEN s.cmax = s.cmin THEN CAST(({b} + 1) // 2 AS BIGINT) ELSE "
         f"greatest(1, least({b}, CAST(ceil((c.cnt - s.cmin) * {b} * 1.0 / (s.cmax - s.cmin)) AS BIGINT))) END")
    rf = (f"(SELECT c.cnt * 1.0 / s.n FROM fq_{col}_c c, fq_{col}_s s "
          f"WHERE c.level IS NOT DISTINCT FROM CAST({src}.{col} AS VARCHAR))")
    ff = (f"(SELECT 'F_{col}_' || CAST({k} AS VARCHAR) FROM fq_{col}_c c, fq_{col}_s s "
          f"WHERE c.level IS NOT DISTINCT FROM CAST({src}.{col} AS VARCHAR))")
    return cte, rf, ff


_FQ = [("v22", 25), ("v71", None)]
_fq = [freq_sql(c, b) for c, b in _FQ]


@query("e6_frequency_encode", with_claims(
    "SELECT ID, " + ", ".join(f"{R(rf)} AS Rfreq_{c}, {ff} AS Ffreq_{c}"
                              for (c, _), (_, rf, ff) in zip(_FQ, _fq)) + " FROM claims",
    ",\n".join(cte for cte, _, _ in _fq)))
def e6_frequency_encode(spark, d):
    """E6 + E7: relative level frequency (null rows get the null share) and
    its equal-width frequency bucket (25 buckets for v22, the default for v71)."""
    df = claims_view(spark, d).select("ID", "v22", "v71")
    return rounded(encode.frequency_encode(df, ["v22", "v71"], buckets=[25, None]).select(
        "ID", "Rfreq_v22", "Ffreq_v22", "Rfreq_v71", "Ffreq_v71"))


_IT_SQL = ", ".join(f"coalesce(substring(v22, {i}, 1), '') AS It_v22_{i}" for i in (1, 2, 3))


@query("e9_char_explode", with_claims(
    f"SELECT ID, CAST(coalesce(length(v22), 0) AS INTEGER) AS Len_v22, {_IT_SQL} FROM claims"))
def e9_char_explode(spark, d):
    """E8 + E9: string length and one column per character position up to
    the longest value (found by one aggregate)."""
    df = claims_view(spark, d).select("ID", "v22")
    return encode.explode_chars(df, ["v22"], max_width=32).drop("v22")


_LET_COLS = ["v3", "v71", "v22", "v66", "It_v22_1", "It_v22_2", "It_v22_3"]


@query("e10_letter_counts", with_claims(
    "SELECT ID, " + ", ".join(
        "(" + " + ".join(f"coalesce(CAST({c} = '{L}' AS INTEGER), 0)" for c in _LET_COLS)
        + f") AS Nr_{L}" for L in LETTERS) + f" FROM (SELECT ID, v3, v71, v22, v66, {_IT_SQL} FROM claims) t"))
def e10_letter_counts(spark, d):
    """E10 after E9: per row, in how many categorical columns (including the
    character items) the value is exactly each letter A..Z."""
    df = encode.explode_chars(claims_view(spark, d).select("ID", *CLAIMS_STRING), ["v22"], max_width=32,
                              with_length=False)
    out = encode.letter_counts(df, _LET_COLS)
    return out.select("ID", *[f"Nr_{L}" for L in LETTERS])


_CODE_COLS = ["v3", "v71", "v22", "v66"]


def first_code_sql(col: str, src: str = "claims", fit: str = "claims") -> tuple[str, str]:
    cte = (f"fc_{col} AS (SELECT level, CAST(row_number() OVER (ORDER BY f, level) - 1 AS BIGINT) AS code "
           f"FROM (SELECT {col} AS level, min(ID) AS f FROM {fit} WHERE {col} IS NOT NULL GROUP BY 1) t)")
    val = f"coalesce((SELECT code FROM fc_{col} x WHERE x.level = {src}.{col}), -1)"
    return cte, val


_fc = [first_code_sql(c) for c in _CODE_COLS]


@query("e11_first_appearance_codes", with_claims(
    "SELECT ID, " + ", ".join(f"CAST({v} AS BIGINT) AS {c}" for c, (_, v) in zip(_CODE_COLS, _fc))
    + " FROM claims", ",\n".join(cte for cte, _ in _fc)))
def e11_first_appearance_codes(spark, d):
    """Integer codes in order of first appearance (ID order) from 0,
    null -> -1."""
    df = claims_view(spark, d).select("ID", *_CODE_COLS)
    return encode.label_encode(df, _CODE_COLS, order="first", missing=-1)


_fct = [first_code_sql(c, src="test", fit="train") for c in _CODE_COLS]


@query("e12_train_codes_on_test", with_claims(
    "SELECT ID, " + ", ".join(f"CAST({v} AS BIGINT) AS {c}" for c, (_, v) in zip(_CODE_COLS, _fct))
    + " FROM test",
    "train AS (SELECT * FROM claims WHERE target IS NOT NULL), "
    "test AS (SELECT * FROM claims WHERE target IS NULL),\n" + ",\n".join(cte for cte, _ in _fct)))
def e12_train_codes_on_test(spark, d):
    """First-appearance codes fitted on labelled rows, applied to the
    unlabelled rows; unseen and null levels -> -1."""
    df = claims_view(spark, d).select("ID", "target", *_CODE_COLS)
    train = df.where(F.col("target").isNotNull())
    test = df.where(F.col("target").isNull()).drop("target")
    return encode.label_encode(test, _CODE_COLS, order="first", fit_on=train, missing=-1)


def alpha_code_sql(col: str) -> tuple[str, str]:
    cte = (f"ac_{col} AS (SELECT level, CAST(row_number() OVER (ORDER BY level) AS BIGINT) AS code "
           f"FROM (SELECT DISTINCT CAST({col} AS VARCHAR) AS level FROM claims WHERE {col} IS NOT NULL) t)")
    val = f"(SELECT code FROM ac_{col} x WHERE x.level = CAST(claims.{col} AS VARCHAR))"
    return cte, val


_AC_COLS = _CODE_COLS + ["v38"]
_ac = [alpha_code_sql(c) for c in _AC_COLS]


@query("e13_alpha_codes", with_claims(
    "SELECT ID, " + ", ".join(f"{v} AS {c}" for c, (_, v) in zip(_AC_COLS, _ac)) + " FROM claims",
    ",\n".join(cte for cte, _ in _ac)))
def e13_alpha_codes(spark, d):
    """1-based codes in sorted level order (null stays null), as a
    numeric matrix of factors."""
    df = claims_view(spark, d).select("ID", *_AC_COLS)
    return encode.label_encode(df, _AC_COLS, order="alpha", missing=None, start=1)
