"""Pipeline and model queries with their SQL twins: exact twins where the
output is determined by the input, facts about the output for learners."""

from __future__ import annotations

import math
import uuid
from functools import reduce
from operator import and_

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.hashing import MODULUS, draw_index_sql, mix_sql
from tessera.operators import assoc, chained, folds, impute, metrics, models, select, transform
from tessera.operators.impute import column_salt
from tessera.operators.ranking import row_index
from tessera.plans import features
from tessera.plans.q_eval import _MASK_NUM, _MASK_SRC, _mask_matrix, folds_sql
from tessera.plans.q_profile import _pearson_sql
from tessera.plans.registry import R, query, rounded, with_claims
from tessera.session import ensure_checkpoint_dir
from tessera.sources import io
from tessera.sources.staging import stage
from tessera.sources.tables import claims_view


def _pre(spark, d):
    # staged once: every fit of the pipeline reads this columnar table
    return stage(features.preprocess(claims_view(spark, d), coded=["v38"]), "preprocessed")


def _table(spark, d):
    pre = _pre(spark, d)
    num = features.numeric_features(pre, special_log=["v23"], log1p=["v1"], yeo_johnson=["v50"])
    fac = features.factor_features(pre, long_strings=["v22"], version=2)
    return stage(features.model_table(pre, num, fac), "model-table")


_NUM_SCALED = ["v1", "v23", "v50", "Ts_v23", "Tl_v1", "Tyj_v50"]
_SHARES = ["NAfreq", "NAfacfreq", "Below0freq"]


def _numeric_ctes() -> list[str]:
    """CTEs ending in ``numf`` (unrounded numeric feature table)."""
    from tessera.plans.q_numeric import special_log_sql, yj_lambda_cte, yj_sql
    v71 = "nullif(v71, '')"
    na = (f"(CAST(v1 IS NULL AS INT) + CAST(v23 IS NULL AS INT) + CAST(v38 IS NULL AS INT) "
          f"+ CAST(v50 IS NULL AS INT) + CAST(v3 IS NULL AS INT) + CAST({v71} IS NULL AS INT) "
          f"+ CAST(v22 IS NULL AS INT) + CAST(v66 IS NULL AS INT))")
    nafac = (f"(CAST(v3 IS NULL AS INT) + CAST({v71} IS NULL AS INT) + CAST(v22 IS NULL AS INT) "
             f"+ CAST(v66 IS NULL AS INT) + CAST(v38 IS NULL AS INT))")
    below = ("(coalesce(CAST(v1 < 0 AS INT), 0) + coalesce(CAST(v23 < 0 AS INT), 0) "
             "+ coalesce(CAST(v50 < 0 AS INT), 0))")
    pre = (f"npre AS (SELECT ID, target, v1, v23, v50, {na} / 8.0 AS NAfreq, {nafac} / 5.0 AS NAfacfreq, "
           f"{below} / 8.0 AS Below0freq FROM claims)")
    tr = (f"ntr AS (SELECT *, {special_log_sql('v23')} AS Ts_v23, CASE WHEN v1 > -1 THEN ln(1 + v1) END AS Tl_v1, "
          f"{yj_sql('v50', '(SELECT lam FROM yjn)')} AS Tyj_v50 FROM npre)")
    rg = "nrg AS (SELECT " + ", ".join(f"min({c}) AS a_{c}, max({c}) AS b_{c}" for c in _NUM_SCALED) + " FROM ntr)"
    cols = ", ".join(f"CASE WHEN nrg.b_{c} > nrg.a_{c} THEN ({c} - nrg.a_{c}) / (nrg.b_{c} - nrg.a_{c}) END AS {c}"
                     for c in _NUM_SCALED)
    numf = f"numf AS (SELECT ID, target, {cols}, NAfreq, NAfacfreq, Below0freq FROM ntr, nrg)"
    return [pre, yj_lambda_cte("yjn", "v50", src="npre"), tr, rg, numf]


def _numeric_features_sql() -> str:
    """SQL twin of the numeric feature pipeline on the claims view."""
    body = "SELECT ID, target, " + ", ".join(f"{R(c)} AS {c}" for c in _NUM_SCALED + _SHARES) + " FROM numf"
    return with_claims(body, ", ".join(_numeric_ctes()))


#: Numeric columns of the joined table that hold nulls on the claims view.
_NULLABLE = ["v1", "v23", "Ts_v23", "Tl_v1", "Num_v38"]


def _dataset_random_sql(seed: int = 321) -> str:
    """SQL twin of dataset B2: random-draw imputation of the numeric columns
    that hold nulls, '' for strings; other columns pass through."""
    num_ctes = _numeric_ctes()
    fac_ctes, fac_cols = _factor_ctes(2)
    facf = "facf AS (SELECT ID, " + ", ".join(f"{e} AS {n}" for n, e, _ in fac_cols) + " FROM pre)"
    tab = ("tab AS MATERIALIZED (SELECT n.*, " + ", ".join(f"f.{n}" for n, _, _ in fac_cols)
           + " FROM numf n JOIN facf f ON n.ID = f.ID)")
    ctes, joins = [], []
    for c in _NULLABLE:
        draw = draw_index_sql("t.ID", column_salt(seed, c), f"(SELECT count(*) FROM d_{c})")
        ctes.append(
            f"d_{c} AS MATERIALIZED (SELECT CAST({c} AS DOUBLE) AS value, row_number() OVER (ORDER BY ID) - 1 AS idx "
            f"FROM tab WHERE {c} IS NOT NULL), "
            f"i_{c} AS MATERIALIZED (SELECT t.ID, {draw} AS idx FROM tab t WHERE t.{c} IS NULL), "
            f"r_{c} AS MATERIALIZED (SELECT i.ID, d.value FROM i_{c} i JOIN d_{c} d ON i.idx = d.idx)")
        joins.append(f"LEFT JOIN r_{c} ON r_{c}.ID = tab.ID")
    doubles = _NUM_SCALED + _SHARES + [n for n, _, k in fac_cols if k == "d"]
    sel = [(R(f"coalesce(CAST(tab.{c} AS DOUBLE), r_{c}.value)") if c in _NULLABLE else R(f"tab.{c}")) + f" AS {c}"
           for c in doubles]
    sel += [f"coalesce(tab.{n}, '') AS {n}" for n, _, k in fac_cols if k == "s"]
    sel += [f"tab.{n}" for n, _, k in fac_cols if k == "i"]
    body = "SELECT tab.ID, tab.target, " + ", ".join(sel) + " FROM tab " + " ".join(joins)
    return with_claims(body, ", ".join(num_ctes + fac_ctes + [facf, tab] + ctes))


def _dataset_sentinel_sql() -> str:
    """SQL twin of dataset C: first-appearance codes (from 0, null -> -1) of
    the string columns and -999 for missing doubles."""
    num_ctes = _numeric_ctes()
    fac_ctes, fac_cols = _factor_ctes(2)
    facf = "facf AS (SELECT ID, " + ", ".join(f"{e} AS {n}" for n, e, _ in fac_cols) + " FROM pre)"
    tab = ("tab AS (SELECT n.*, " + ", ".join(f"f.{n}" for n, _, _ in fac_cols)
           + " FROM numf n JOIN facf f ON n.ID = f.ID)")
    strs = [n for n, _, k in fac_cols if k == "s"]
    codes = [f"fc_{c} AS (SELECT level, CAST(row_number() OVER (ORDER BY f, level) - 1 AS BIGINT) AS code "
             f"FROM (SELECT {c} AS level, min(ID) AS f FROM tab WHERE {c} IS NOT NULL GROUP BY 1) t)" for c in strs]
    doubles = _NUM_SCALED + _SHARES + [n for n, _, k in fac_cols if k == "d"]
    sel = [f"{R(f'coalesce({c}, -999.0)')} AS {c}" for c in doubles]
    sel += [f"CAST(coalesce((SELECT code FROM fc_{c} x WHERE x.level = tab.{c}), -1) AS BIGINT) AS {c}"
            for c in strs]
    sel += [n for n, _, k in fac_cols if k == "i"]
    body = "SELECT ID, target, " + ", ".join(sel) + " FROM tab"
    return with_claims(body, ", ".join(num_ctes + fac_ctes + [facf, tab] + codes))


@query("f_numeric_features", _numeric_features_sql())
def f_numeric_features(spark, d):
    """T5 pipeline: typed, shares, Ts_/Tl_/Tyj_ transforms, range scaled."""
    pre = _pre(spark, d)
    return rounded(features.numeric_features(pre, special_log=["v23"], log1p=["v1"], yeo_johnson=["v50"]))


_ITEMS = ["Len_v22", "It_v22_1", "It_v22_2", "It_v22_3"]


def _factor_ctes(version: int) -> tuple[list[str], list[tuple[str, str, str]]]:
    """CTEs of the categorical pipeline and its output columns as
    (name, unrounded SQL expression, kind) with kind 'd' (double), 'i' (int)
    or 's' (string), evaluated over the ``pre`` CTE. The level gate's
    outcome on this data is stated: v22 and v38 have more than 10 levels,
    v22 has at least 25."""
    from tessera.plans.q_encode import LETTERS, freq_sql, impact_sql
    pre = ("pre AS (SELECT ID, target, CAST(v38 AS VARCHAR) AS v38, v3, nullif(v71, '') AS v71, v22, v66, "
           "CAST(coalesce(length(v22), 0) AS INTEGER) AS Len_v22, "
           + ", ".join(f"coalesce(substring(v22, {i}, 1), '') AS It_v22_{i}" for i in (1, 2, 3))
           + " FROM claims)")
    cat = ["v38", "v3", "v71", "v22", "v66", "It_v22_1", "It_v22_2", "It_v22_3"]
    cols = [(c, c, "s") for c in ["v3", "v71", "v66", "It_v22_1", "It_v22_2", "It_v22_3"]]
    cols.append(("Len_v22", "Len_v22", "i"))
    cols += [(f"Nr_{L}", "(" + " + ".join(f"coalesce(CAST({c} = '{L}' AS INTEGER), 0)" for c in cat) + ")", "i")
             for L in LETTERS]
    if version == 1:
        imps = [impact_sql(c, src="pre") for c in ("v22", "v38")]
        cols += [("Imp_v22", imps[0][1], "d"), ("Imp_v38", imps[1][1], "d")]
        return [pre] + [c for c, _ in imps], cols
    imp_cte, imp_val = impact_sql("v38", src="pre")
    fq_cte, rf, ff = freq_sql("v22", 25, src="pre")
    cols += [("v38", "v38", "s"), ("Imp_v38", imp_val, "d"), ("Num_v38", "CAST(v38 AS DOUBLE)", "d"),
             ("Rfreq_v22", rf, "d"), ("Ffreq_v22", ff, "s")]
    return [pre, imp_cte, fq_cte], cols


def _factor_features_sql(version: int) -> str:
    """SQL twin of the categorical feature pipeline on the claims view."""
    ctes, cols = _factor_ctes(version)
    body = "SELECT ID, target, " + ", ".join(
        f"{R(e)} AS {n}" if k == "d" else f"{e} AS {n}" for n, e, k in cols) + " FROM pre"
    return with_claims(body, ", ".join(ctes))


def _dataset_sql(method: str) -> str:
    """SQL twin of the joined modelling table (numeric + categorical v2)
    with 'median' (B1) or 'mode' (A1) imputation of the double columns and ''
    for strings; integer columns have no nulls and pass through."""
    num_ctes = _numeric_ctes()
    fac_ctes, fac_cols = _factor_ctes(2)
    facf = "facf AS (SELECT ID, " + ", ".join(f"{e} AS {n}" for n, e, _ in fac_cols) + " FROM pre)"
    tab = ("tab AS (SELECT n.*, " + ", ".join(f"f.{n}" for n, _, _ in fac_cols)
           + " FROM numf n JOIN facf f ON n.ID = f.ID)")
    doubles = _NUM_SCALED + _SHARES + [n for n, _, k in fac_cols if k == "d"]
    extra = []
    if method == "median":
        fill = {c: f"(SELECT quantile_cont({c}, 0.5) FROM tab)" for c in doubles}
    else:
        fill = {c: f"(SELECT v FROM m_{c})" for c in doubles}
        extra = [f"m_{c} AS (SELECT {c} AS v FROM tab WHERE {c} IS NOT NULL GROUP BY {c} "
                 f"ORDER BY count(*) DESC, {c} ASC LIMIT 1)" for c in doubles]
    sel = [f"{R(f'coalesce({c}, {fill[c]})')} AS {c}" for c in doubles]
    sel += [f"coalesce({n}, '') AS {n}" for n, _, k in fac_cols if k == "s"]
    sel += [n for n, _, k in fac_cols if k == "i"]
    body = "SELECT ID, target, " + ", ".join(sel) + " FROM tab"
    return with_claims(body, ", ".join(num_ctes + fac_ctes + [facf, tab] + extra))


@query("f_factor_features_v1", _factor_features_sql(1))
def f_factor_features_v1(spark, d):
    """Categorical features v1: items, letter counts, impact coding of
    columns with more than 10 levels."""
    return rounded(features.factor_features(_pre(spark, d), long_strings=["v22"], version=1))


@query("f_factor_features_v2", _factor_features_sql(2))
def f_factor_features_v2(spark, d):
    """Categorical features v2: v1 without impact coding v22, plus numeric
    code copies and 25-bucket frequency coding of columns with >= 25 levels."""
    return rounded(features.factor_features(_pre(spark, d), long_strings=["v22"], version=2))


@query("d_mode_imputed", _dataset_sql("mode"))
def d_mode_imputed(spark, d):
    """Dataset A1: joined features, numeric mode / string '' imputation."""
    return rounded(features.imputed(_table(spark, d), "mode"))


@query("d_median_imputed", _dataset_sql("median"))
def d_median_imputed(spark, d):
    """Dataset B1: joined features, exact-median imputation."""
    return rounded(features.imputed(_table(spark, d), "median"))


@query("d_random_imputed", _dataset_random_sql())
def d_random_imputed(spark, d):
    """Dataset B2: joined features, random-draw imputation."""
    return rounded(features.imputed(_table(spark, d), "random"))


@query("d_sentinel_coded", _dataset_sentinel_sql())
def d_sentinel_coded(spark, d):
    """Dataset C: first-appearance codes (-1 for null) and -999 numerics."""
    return rounded(features.imputed(_table(spark, d), "sentinel"))


@query("f_numeric_trans", with_claims(
    "SELECT ID, target, " + ", ".join(f"{R(c)} AS {c}" for c in ["v50", *_SHARES, "Ts_v23", "Tl_v1", "Tyj_v50"])
    + " FROM numf", ", ".join(_numeric_ctes())))
def f_numeric_trans(spark, d):
    """T5, second table: the column that is only rescaled (v50), row shares
    and transforms."""
    t = features.numeric_tables(_pre(spark, d), special_log=["v23"], log1p=["v1"], yeo_johnson=["v50"],
                                rescale_only=["v50"])
    return rounded(t["trans"])


@query("f_numeric_raw", with_claims(
    "SELECT ID, target, " + ", ".join(f"{R(c)} AS {c}" for c in ["v1", "v23", "v50", *_SHARES]) + " FROM numf",
    ", ".join(_numeric_ctes())))
def f_numeric_raw(spark, d):
    """T5, third table: scaled columns and row shares without transforms."""
    t = features.numeric_tables(_pre(spark, d), special_log=["v23"], log1p=["v1"], yeo_johnson=["v50"])
    return rounded(t["raw"])


@query("m10_feature_matrix", with_claims(
    "SELECT ID, target, coalesce(v1, -999.0) AS v1, coalesce(CAST(a.code AS DOUBLE), -999.0) AS v71, "
    "coalesce(CAST(b.code AS DOUBLE), -999.0) AS v22 FROM claims LEFT JOIN (SELECT level, row_number() OVER "
    "(ORDER BY level) AS code FROM (SELECT DISTINCT v71 AS level FROM claims WHERE v71 IS NOT NULL)) a ON a.level = v71 "
    "LEFT JOIN (SELECT level, row_number() OVER (ORDER BY level) AS code FROM (SELECT DISTINCT v22 AS level FROM claims "
    "WHERE v22 IS NOT NULL)) b ON b.level = v22"))
def m10_feature_matrix(spark, d):
    """The assembled vector taken apart again: sorted-level codes for
    strings, the sentinel -999 for nulls."""
    mat, names = models.feature_matrix(claims_view(spark, d), features=["v1", "v71", "v22"])
    x = vector_to_array(F.col("features"))
    return mat.select("ID", "target", *[x[j].alias(n) for j, n in enumerate(names)])


@query("v6_repeated_cv", with_claims(
    "SELECT a.rep, a.fold, CAST(count(*) FILTER (WHERE f.fold <> a.fold) AS BIGINT) AS n_train, "
    "CAST(count(*) FILTER (WHERE f.fold = a.fold) AS BIGINT) AS n_hold FROM (SELECT DISTINCT rep, fold FROM f) a "
    "JOIN f ON f.rep = a.rep GROUP BY 1, 2", folds_sql("f", 3, [(1, 78), (2, 78), (3, 78)])))
def v6_repeated_cv(spark, d):
    """V6: the resample descriptor of the parameter search (M7): 3 stratified
    folds, 3 repeats; rows to train on and to hold out."""
    mat = models.fold_table(claims_view(spark, d), k=3, repeats=3, seed=78)
    long = mat.where("target is not null").select(F.inline(F.array(*[
        F.struct(F.lit(r).alias("rep"), F.col(f"_fold{r}").alias("fold")) for r in (1, 2, 3)])))
    hold = long.groupBy("rep", "fold").agg(F.count(F.lit(1)).alias("n_hold"))
    total = hold.groupBy("rep").agg(F.sum("n_hold").alias("n"))
    return hold.join(total, "rep").select("rep", "fold", (F.col("n") - F.col("n_hold")).alias("n_train"), "n_hold")


# ------------------------------------------------ feature tables
# Importance-shaped input: |association| of each numeric column with the others.
_IMP_SQL = (_MASK_SRC + f", m AS ({_pearson_sql('tr', _MASK_NUM)}), avg_ AS (SELECT col_a AS feature, "
            f"sum(abs(stat)) / (SELECT count(DISTINCT col_b) FROM m) AS average FROM m GROUP BY 1), "
            "ranked AS (SELECT feature, average, CAST(row_number() OVER (ORDER BY average DESC, feature) AS INTEGER) "
            "AS rank FROM avg_)")


def _importance(spark, d):
    m = _mask_matrix(spark, d)
    return select.average_importance(m.select(F.col("col_b").alias("fold"), F.col("col_a").alias("feature"),
                                              F.abs("stat").alias("gain")))


@query("m2_importance_ranking", with_claims(f"SELECT feature, {R('average', 8)} AS average, rank FROM ranked", _IMP_SQL))
def m2_importance_ranking(spark, d):
    """M2 + J5: gains joined by name and averaged over the folds, in
    descending order with the position."""
    ordered = select.order_desc(_importance(spark, d), "average")
    return rounded(select.rank_table(ordered, "average"), 8)


@query("j6_top_and_slice", with_claims(
    "SELECT feature, rank, 'top' AS part FROM ranked WHERE rank <= 2 UNION ALL SELECT feature, rank, 'slice' AS part "
    "FROM ranked WHERE rank BETWEEN 2 AND 5 AND regexp_matches(feature, '^T')", _IMP_SQL))
def j6_top_and_slice(spark, d):
    """The two best features, and ranks 2-5 whose names start with T."""
    imp = _importance(spark, d)
    top = select.top_k(imp, "average", 2).select("feature", "rank", F.lit("top").alias("part"))
    part = select.rank_slice(imp, "average", 2, 5, pattern="^T").select("feature", "rank", F.lit("slice").alias("part"))
    return top.unionByName(part)


@query("m3_feature_pruning", with_claims(
    "SELECT ID, " + ", ".join(
        f"CASE WHEN '{c}' IN (SELECT feature FROM ranked WHERE rank BETWEEN 2 AND 5 AND regexp_matches(feature, '^T')) "
        f"THEN NULL ELSE {R('x.' + c)} END AS {c}" for c in ["v1", "v50", "Tl_v1", "Tl_v50"])
    + " FROM (SELECT ID, v1, v50, CASE WHEN v1 > -1 THEN ln(1 + v1) END AS Tl_v1, "
      "CASE WHEN v50 > -1 THEN ln(1 + v50) END AS Tl_v50 FROM claims) x", _IMP_SQL))
def m3_feature_pruning(spark, d):
    """M3 + J6: columns without a fixed name (v23) and without the low-ranked
    slice that matches the derived-feature pattern. Pruned columns are shown
    as null, so that the result keeps one schema."""
    imp = _importance(spark, d)
    low = select.rank_slice(imp, "average", 2, 5, pattern="^T")
    names = [r["feature"] for r in low.collect()]  # at most four names
    t = transform.add_log1p(claims_view(spark, d).select("ID", "v1", "v23", "v50"), ["v1", "v50"])
    kept = select.prune_features(t, drop=["v23", *names])
    return rounded(kept.select("ID", *[F.col(c) if c in kept.columns else F.lit(None).cast("double").alias(c)
                                       for c in ["v1", "v50", "Tl_v1", "Tl_v50"]]))


@query("j4_sort_by_id", with_claims("SELECT ID, row_number() OVER (ORDER BY ID) - 1 AS pos FROM claims"))
def j4_sort_by_id(spark, d):
    """Global order by id, with the position of each row."""
    return select.sort_by_id(row_index(claims_view(spark, d).select("ID"), ["ID"], out_col="pos"))


# ------------------------------------------------ learners: facts about their own output
# A learner's numbers have no SQL twin. These queries run the job and return
# facts that its output must meet, row by row, next to counts that SQL gives.
# Rounds, trees, depths, folds, repeats, seeds, draws and runs are the reference's.
#: Most rounds of the reference's boosters and the rounds it goes on after the best.
MOST_ROUNDS, PATIENCE = 2000, 30
#: Log-loss of the constant prediction of one half.
EVEN = 0.6931471805599453


def _median_table(spark, d):
    return stage(features.imputed(_table(spark, d), "median"), "median-table")


def _booster(variant: str, seed: int = 765):
    return models.booster(variant, MOST_ROUNDS, PATIENCE, seed)


_REPEATS = [(1, 433), (2, 433), (3, 433)]


@query("m4_gbt_cv_scores", with_claims(
    "SELECT 'Fold' || CAST(fold AS VARCHAR) || '.Rep' || CAST(rep AS VARCHAR) AS fold_name, count(*) AS n, TRUE AS score_is_v1, "
    "TRUE AS is_least_of_curve, TRUE AS stopped_in_time, TRUE AS beats_even, TRUE AS gains_sum_to_one FROM f GROUP BY rep, fold",
    folds_sql("f", 5, _REPEATS)))
def m4_gbt_cv_scores(spark, d):
    """M4 + M11 + V8: boosted trees over 5 stratified folds, 3 repeats (2000 rounds, stop
    30 rounds after the best). Facts by fold: held-out rows; the reported score is
    V1 of the held-out predictions, the least of the fold's curve, which ends 30 rounds
    later, and below that of the constant one half; gains sum to one."""
    res = models.cross_validate(_median_table(spark, d), _booster("simple"), k=5, repeats=3)
    again = res["members"].groupBy("fold_name").agg(F.avg(
        -F.when(F.col("target") == 1, F.log("prob")).otherwise(F.log(1 - F.col("prob")))).alias("v1"))
    gains = res["importances"].groupBy(F.col("fold").alias("fold_name")).agg(F.sum("gain").alias("g"))
    ended = F.least(F.col("rounds") + PATIENCE, F.lit(MOST_ROUNDS))
    return res["scores"].join(again, "fold_name").join(gains, "fold_name").join(res["rounds"], "fold_name").select(
        "fold_name", "n", (F.abs(F.col("logloss") - F.col("v1")) < 1e-9).alias("score_is_v1"),
        (F.abs(F.col("logloss") - F.array_min("losses")) < 1e-9).alias("is_least_of_curve"),
        (F.size("losses") == ended).alias("stopped_in_time"), (F.col("logloss") < EVEN).alias("beats_even"),
        (F.abs(F.col("g") - 1) < 1e-9).alias("gains_sum_to_one"))


@query("v9_test_average", with_claims("SELECT ID, CAST(15 AS BIGINT) AS n_models, TRUE AS is_probability, TRUE AS in_file "
                                      "FROM claims WHERE target IS NULL"))
def v9_test_average(spark, d):
    """The predictions of the unlabelled rows averaged over the 15
    fits of the boosted CV, written as a submission and read back."""
    t = stage(features.imputed(_table(spark, d), "mode"), "mode-table")
    return _submitted(spark, t, models.cross_validate(t, _booster("simple"), k=5, repeats=3)["test"])


def _submitted(spark, table, scored):
    """``scored`` (ID, n_models, prob) beside what its submission file says."""
    scored = stage(scored, "scored")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/submission-{uuid.uuid4().hex}"
    io.write_submission(table.select("ID", "target").join(scored, "ID"), path, "prob")
    back = spark.read.schema("ID long, PredictedProb double").option("header", True).csv(path)
    return scored.join(back, "ID").select("ID", "n_models", F.col("prob").between(0, 1).alias("is_probability"),
                                          (F.abs(F.col("prob") - F.col("PredictedProb")) < 1e-9).alias("in_file"))


_CONTIGUOUS = ("f AS (SELECT ID, CAST(CASE WHEN pos < r * (q + 1) THEN floor(pos / (q + 1)) "
               "ELSE r + floor((pos - r * (q + 1)) / q) END + 1 AS INTEGER) AS fold FROM "
               "(SELECT ID, row_number() OVER (ORDER BY ID) - 1 AS pos, count(*) OVER () // 3 AS q, "
               "count(*) OVER () % 3 AS r FROM claims WHERE target IS NOT NULL) t)")


@query("m8_forest_cv_scores", with_claims(
    "SELECT c.ID, c.target IS NULL AS is_test, 'Fold' || CAST(f.fold AS VARCHAR) || '.Rep1' AS fold_name, "
    "'Fold' || CAST(g.fold AS VARCHAR) || '.Rep1' AS stratified_fold, CAST(CASE WHEN c.target IS NULL THEN 6 ELSE 2 END AS BIGINT) "
    "AS n_models, TRUE AS is_probability, TRUE AS at_base_rate FROM claims c LEFT JOIN f ON f.ID = c.ID LEFT JOIN g ON g.ID = c.ID",
    _CONTIGUOUS + ", " + folds_sql("g", 3, [(1, 433)])))
def m8_forest_cv_scores(spark, d):
    """M8 + V4 + V5 + V9: extremely randomised trees (900 trees, 80 features a
    node, entropy, depth 40, at least 4 rows to split and 2 in a leaf), two repeats of 3 folds: contiguous ones
    and stratified ones. Facts by row: the folds that hold it out; labelled rows are averaged over the
    two repeats, unlabelled ones over all six fits, and hold probabilities; a fold's mean probability is within 0.05
    of the share of class 1 among the other labelled rows."""
    t = stage(features.imputed(_table(spark, d), "sentinel"), "sentinel-table")
    est, parts = models.ExtraTrees(trees=900, max_features=80), []
    for j, by in enumerate(({"contiguous": True}, {})):
        res = models.cross_validate(t, est, k=3, repeats=1, **by)
        sums = res["members"].groupBy("fold_name").agg(F.avg("prob").alias("mean"), F.sum("target").alias("pos"), F.count(F.lit(1)).alias("n"))
        pos, n = (F.sum(c).over(Window.partitionBy()) - F.col(c) for c in ("pos", "n"))  # of the other folds; three rows
        base = sums.select("fold_name", (F.abs(F.col("mean") - pos / n) < 0.05).alias("at_base_rate"))
        held = res["members"].join(base, "fold_name").select("ID", F.lit(False).alias("is_test"), "fold_name", F.lit(1).cast("long").alias("n"), "prob", "at_base_rate")
        test = res["test"].select("ID", F.lit(True).alias("is_test"), F.lit(None).cast("string").alias("fold_name"), F.col("n_models").alias("n"),
                                  "prob", F.lit(True).alias("at_base_rate"))
        parts.append(held.unionByName(test).withColumn("repeat", F.lit(j)))
    both = parts[0].unionByName(parts[1])
    return both.groupBy("ID", "is_test").agg(
        *[F.max(F.when(F.col("repeat") == j, F.col("fold_name"))).alias(c) for j, c in enumerate(("fold_name", "stratified_fold"))],
        F.sum("n").alias("n_models"), (F.sum(F.col("n") * F.col("prob")) / F.sum("n")).between(0, 1).alias("is_probability"),
        F.every("at_base_rate").alias("at_base_rate"))


def _names_sql() -> str:
    fac = [n for n, _, _ in _factor_ctes(2)[1]]
    return ", ".join(f"'{n}'" for n in [*_NUM_SCALED, *_SHARES, *fac])


@query("m11_importance_average", f"SELECT unnest([{_names_sql()}]) AS feature, CAST(9 AS BIGINT) AS folds, TRUE AS is_mean_of_folds, "
                                 "TRUE AS in_order, TRUE AS sums_to_one")
def m11_importance_average(spark, d):
    """M11 + M2: per-fold gains of a tuned booster (2000 rounds, stop 30 rounds
    after the best) over 3 folds, 3 repeats, averaged by name. Facts by feature: gains of all
    9 fits, the average is their mean, ranks follow the averages, and the averages sum to one."""
    res = models.cross_validate(_median_table(spark, d), _booster("tuned_a"), k=3, repeats=3)
    gains = stage(res["importances"], "gains")
    ranked = select.rank_table(select.order_desc(select.average_importance(gains), "average"), "average")
    own = gains.groupBy("feature").agg(F.avg("gain").alias("m"), F.count(F.lit(1)).alias("folds"))
    total = gains.agg(F.sum("gain")).first()[0]
    above = ranked.select((F.col("rank") + 1).alias("rank"), F.col("average").alias("before"))
    return ranked.join(own, "feature").join(above, "rank", "left").select(
        "feature", "folds", (F.abs(F.col("average") - F.col("m")) < 1e-12).alias("is_mean_of_folds"),
        F.coalesce(F.col("before") >= F.col("average"), F.col("rank") == 1).alias("in_order"),
        F.lit(abs(total - 9) < 1e-6).alias("sums_to_one"))


@query("m5_best_rounds", "SELECT 1 AS one, TRUE AS rounds_in_a_row, TRUE AS one_best, TRUE AS best_is_least, TRUE AS ends_after_patience, "
                         "TRUE AS begins_near_even, TRUE AS best_beats_even")
def m5_best_rounds(spark, d):
    """M5: mean held-out log-loss after each round over 3 folds (1000 rounds, stop 10
    rounds after the best). Facts of the whole curve: rounds from 1 on without a gap, one best,
    of the least loss, with 10 rounds after it (or the last round); the first round is near the
    constant one half and the best below it."""
    curve = models.best_rounds(features.imputed(_table(spark, d), "random"), "tuned_b", 1000, k=3, patience=10)
    best = F.max(F.when(F.col("is_best"), F.col("round")))
    least = F.max(F.when(F.col("is_best"), F.col("mean_loss")))
    return curve.agg(
        (F.max("round") == F.count(F.lit(1))).alias("rounds_in_a_row"), (F.count_if("is_best") == 1).alias("one_best"),
        (least == F.min("mean_loss")).alias("best_is_least"),
        (F.max("round") == F.least(best + 10, F.lit(1000))).alias("ends_after_patience"),
        (F.abs(F.max(F.when(F.col("round") == 1, F.col("mean_loss"))) - EVEN) < 0.05).alias("begins_near_even"),
        (least < EVEN).alias("best_beats_even")).select(F.lit(1).alias("one"), "*")


@query("m6_bagged_submission", with_claims("SELECT ID, CAST(10 AS BIGINT) AS n_models, TRUE AS is_probability, TRUE AS in_file "
                                           "FROM claims WHERE target IS NULL"))
def m6_bagged_submission(spark, d):
    """M5 -> M6 -> V10 -> S4: best round of 1000 (stop 10 rounds after it) x 1.5, one fit for each of 10
    seeds, averaged, written as a submission and read back. Facts by unlabelled
    row: a probability, the same in the file."""
    t = _median_table(spark, d)
    return _submitted(spark, t, models.bagged_submission(t, "tuned_c")[0])


@query("m9_ablations", "SELECT unnest(['all', 'no_impact', 'no_transforms']) AS variant, CAST(5 AS BIGINT) AS folds, "
                       "TRUE AS beats_even, TRUE AS has_sd, TRUE AS differs_by_features")
def m9_ablations(spark, d):
    """M9: CV (2000 rounds, stop 30 rounds after the best, 5 folds) without named feature groups. Facts by
    variant: folds scored, mean below the constant one half, a standard deviation, and other scores than with all features."""
    t = _median_table(spark, d)
    imp = [c for c in t.columns if c.startswith("Imp_")]
    made = [c for c in t.columns if c.startswith("T") and "_" in c]
    scores = stage(models.ablations(t, _booster("simple"), {"all": [], "no_impact": imp, "no_transforms": made}), "ablations")
    all_ = scores.where("variant = 'all'").select("fold_name", F.col("logloss").alias("base"))
    other = scores.join(all_, "fold_name").groupBy("variant").agg(F.max(F.abs(F.col("logloss") - F.col("base"))).alias("gap"))
    return metrics.cv_summary(scores, "logloss", ["variant"]).join(other, "variant").select(
        "variant", "folds", (F.col("cv_mean") < EVEN).alias("beats_even"), (F.col("cv_sd") >= 0).alias("has_sd"),
        ((F.col("gap") > 0) == (F.col("variant") != "all")).alias("differs_by_features"))


@query("m7_random_search", "SELECT CAST(d AS INTEGER) AS draw, CAST(9 AS INTEGER) AS folds, TRUE AS in_range, TRUE AS in_bounds, "
                           "TRUE AS some_draw_beats_even FROM range(0, 20) t(d)")
def m7_random_search(spark, d):
    """M7 + V6: 20 parameter draws (120-300 rounds), 3 folds x 3 repeats, all 180 fits at
    once. Facts by draw: folds scored, all four measures in their ranges, parameters within
    the search bounds; the best draw's log-loss is below the constant one half."""
    out = stage(models.random_search(_median_table(spark, d)), "search")
    unit = [F.col(c).between(0, 1) for c in ("auc", "acc")] + [F.coalesce(F.col("fdr").between(0, 1), F.lit(True))]
    bounds = [F.col(c).between(*b) for c, b in (
        ("eta", models.SEARCH_ETA), ("gamma", models.SEARCH_GAMMA), ("subsample", models.SEARCH_SUBSAMPLE),
        ("colsample", models.SEARCH_COLSAMPLE), ("rounds", models.SEARCH_ROUNDS))]
    bounds += [F.col("max_depth").isin(models.SEARCH_DEPTH), F.col("min_child").isin(models.SEARCH_CHILD)]
    best = out.agg(F.min("logloss")).first()[0]
    return out.select("draw", "folds", ((F.col("logloss") > 0) & unit[0] & unit[1] & unit[2]).alias("in_range"),
                      reduce(and_, bounds).alias("in_bounds"), F.lit(best < EVEN).alias("some_draw_beats_even"))


@query("m1_shadow_selection", f"SELECT unnest([{_names_sql()}]) AS feature, TRUE AS is_consistent, TRUE AS constant_has_no_hit")
def m1_shadow_selection(spark, d):
    """M1: shadow-feature selection over all features on the stratified 1% sample (V7), at most 101 runs of
    500 trees, by permutation importance. Facts by feature: ordered importances, hits
    within its runs, the decision that the binomial bound gives; a column that is constant in the sample has no hit."""
    t = stage(features.imputed(_table(spark, d), "random"), "random-table")
    chosen = folds.stratified_sample(t.select("ID", "target"), 0.01, seed=123).select("ID")
    names = [c for c in t.columns if c not in ("ID", "target")]
    varies = t.join(chosen, "ID").agg(*[F.coalesce(F.min(c) < F.max(c), F.lit(False)).alias(c) for c in names]).first()
    constant = [c for c in names if not varies[c]]
    out = models.shadow_selection(t)
    return out.select("feature", ((F.col("minImp") <= F.col("medianImp")) & (F.col("medianImp") <= F.col("maxImp"))
                                  & (F.col("hits") <= F.col("runs")) & (F.col("runs") <= 101)
                                  & ((F.col("decision") != "Confirmed") | (F.col("hits") >= 12))
                                  & ((F.col("decision") != "Rejected") | (F.col("runs") - F.col("hits") >= 12))).alias("is_consistent"),
                      (~F.col("feature").isin(constant) | (F.col("hits") == 0)).alias("constant_has_no_hit"))


# ------------------------------------------------ iterative imputation
_I_COLS = ["v1", "v23", "v38"]
_I_ALL = ["v1", "v23", "v50", "v38"]


def _claims_numeric(spark, d):
    return claims_view(spark, d).select("ID", "v1", "v23", "v50", F.col("v38").cast("double").alias("v38"))


@query("i5_chained_imputation", with_claims(
    "SELECT ID, " + ", ".join(f"TRUE AS {c}_kept, TRUE AS {c}_in_range" for c in _I_COLS) + " FROM claims"))
def i5_chained_imputation(spark, d):
    """I5 with J7, J9, J11: chained equations with predictive mean matching (3
    imputations averaged, 3 sweeps, coefficients drawn from their posterior,
    columns with fewest nulls first); predictors are each column's two best by
    association, its own transforms excluded, laid over the all-pairs mask.
    Facts by row: observed cells are unchanged, filled ones lie between the
    least and the greatest observed value."""
    c = stage(_claims_numeric(spark, d), "i5")
    top = select.exclude_own_transforms(select.top_n_predictors(assoc.pearson_pairs(c, _I_ALL), 2))
    mask = select.mask_overlay(select.all_pairs_mask(spark, _I_ALL), top)
    predictors: dict[str, list[str]] = {}
    for r in mask.orderBy("target_col", "predictor_col").collect():  # pairs of columns
        predictors.setdefault(r["target_col"], []).append(r["predictor_col"])
    filled, _ = chained.chained_impute(c, _I_COLS, _I_ALL, m=3, maxit=3, seed=37, predictors=predictors,
                                       posterior=True, order="monotone")
    ends = c.agg(*[f(x).alias(f"{n}_{x}") for x in _I_COLS for n, f in (("lo", F.min), ("hi", F.max))]).first()
    j = filled.join(c.select("ID", *[F.col(x).alias(f"old_{x}") for x in _I_COLS]), "ID")
    return j.select("ID", *[e for x in _I_COLS for e in (
        F.coalesce(F.col(x) == F.col(f"old_{x}"), F.col(f"old_{x}").isNull()).alias(f"{x}_kept"),
        F.col(x).between(ends[f"lo_{x}"], ends[f"hi_{x}"]).alias(f"{x}_in_range"))])


@query("i5_imputation_spread", with_claims(
    "SELECT *, CAST(row_number() OVER (ORDER BY nulls, \"column\") AS INTEGER) AS visit FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS nulls, TRUE AS cells_differ, "
        f"TRUE AS mean_is_near FROM claims" for c in _I_COLS) + ") t"))
def i5_imputation_spread(spark, d):
    """What three imputations (regression on v50, coefficients and noise
    drawn) leave open. By column: nulls, place in the visit order, and facts:
    filled cells differ between imputations by about the noise (mean variance
    from half to twice the observed column's residual one); the mean of the filled cells
    is within six standard errors of the regression's."""
    c = stage(_claims_numeric(spark, d), "i5-spread")
    filled, trace = chained.chained_impute(c, _I_COLS, _I_ALL, m=3, maxit=1, seed=41, method="norm", posterior=True,
                                           order="monotone", spread=True, predictors={x: ["v50"] for x in _I_COLS})
    visits = {r["column"]: r["visit"] for r in trace.select("column", "visit").distinct().collect()}  # a row a column
    parts = []
    for x in _I_COLS:
        y = F.col(x).cast("double")
        fit = c.where(y.isNotNull()).agg(F.regr_slope(y, F.col("v50")).alias("b"), F.regr_intercept(y, F.col("v50")).alias("a"),
                                         F.regr_syy(y, F.col("v50")).alias("s"), F.regr_r2(y, F.col("v50")).alias("r"), F.count(y).alias("n")).first()
        var = fit["s"] * (1 - fit["r"]) / fit["n"]
        gap = F.avg(F.col(x) - F.lit(fit["a"]) - F.lit(fit["b"]) * F.col("v50"))
        k = F.count(F.lit(1))
        parts.append(filled.join(c.where(y.isNull()).select("ID"), "ID", "left_semi").agg(
            F.lit(x).alias("column"), k.alias("nulls"), F.lit(visits[x]).alias("visit"),
            F.avg(F.col(f"sd_{x}") ** 2).between(var / 2, var * 2).alias("cells_differ"),
            (F.abs(gap) < 6 * F.sqrt(F.lit(var) * (F.lit(1 / 3) / k + F.lit(1.0 / fit["n"])))).alias("mean_is_near")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _noise_sql(salt: int) -> str:
    u = [f"(CAST({mix_sql('ID', s)} % {MODULUS} AS DOUBLE) + 0.5) / {MODULUS}.0" for s in (salt, salt + 7919)]
    return f"sqrt(-2.0 * ln({u[0]})) * cos(6.283185307179586 * ({u[1]}))"


def _draw_ctes(seed: int) -> list[str]:
    """For each column, CTE p_<c>: (ID, value), nulls filled by the random draw."""
    out = []
    for c in _I_COLS:
        draw = draw_index_sql("ID", column_salt(seed, c), f"(SELECT count(*) FROM d_{c})")
        out.append(f"d_{c} AS MATERIALIZED (SELECT CAST({c} AS DOUBLE) AS value, row_number() OVER (ORDER BY ID) - 1 AS idx "
                   f"FROM claims WHERE {c} IS NOT NULL)")
        out.append(f"p_{c} AS MATERIALIZED (SELECT x.ID, x.v50, coalesce(x.v, d.value) AS value, x.v IS NULL AS missing FROM "
                   f"(SELECT ID, v50, CAST({c} AS DOUBLE) AS v, {draw} AS idx FROM claims) x JOIN d_{c} d ON d.idx = x.idx)")
    return out


def _noise_ctes() -> list[str]:
    """CTE n_<c>: (ID, missing, observed or drawn value, value after each of 3 sweeps)."""
    out = _draw_ctes(2201)
    for c in _I_COLS:
        out.append(f"l_{c} AS MATERIALIZED (SELECT regr_intercept(value, v50) AS a, regr_slope(value, v50) AS b, "
                   f"sqrt((regr_syy(value, v50) - regr_sxy(value, v50) * regr_sxy(value, v50) / regr_sxx(value, v50)) / count(*)) "
                   f"AS s FROM p_{c} WHERE NOT missing)")
        sweeps = ", ".join(f"CASE WHEN missing THEN a + b * v50 + s * {_noise_sql(column_salt(22010 + k, c))} ELSE value END AS s{k}"
                           for k in (1, 2, 3))
        out.append(f"n_{c} AS MATERIALIZED (SELECT ID, missing, value AS s0, {sweeps} FROM p_{c}, l_{c})")
    return out


def _noise_imputed(spark, d):
    return chained.chained_impute(_claims_numeric(spark, d), _I_COLS, _I_ALL, m=1, maxit=3, seed=22, method="norm",
                                  predictors={c: ["v50"] for c in _I_COLS})


@query("i6_regression_noise_imputation", with_claims(
    "SELECT n_v1.ID, " + ", ".join(f"{R(f'n_{c}.s3', 8)} AS {c}" for c in _I_COLS) + ", v50 FROM claims JOIN n_v1 USING (ID) "
    "JOIN n_v23 ON n_v23.ID = n_v1.ID JOIN n_v38 ON n_v38.ID = n_v1.ID", ", ".join(_noise_ctes())))
def i6_regression_noise_imputation(spark, d):
    """Random pre-fill, then 3 sweeps of regression on v50 plus Gaussian
    noise of the residual's size; the filled table."""
    return rounded(_noise_imputed(spark, d)[0], 8)


@query("i7_convergence_trace", with_claims(" UNION ALL ".join(
    f"SELECT 1 AS imputation, {k} AS sweep, '{c}' AS \"column\", {R(f'avg(abs(s{k} - s{k - 1}))', 8)} AS mean_abs_change "
    f"FROM n_{c} WHERE missing" for c in _I_COLS for k in (1, 2, 3)), ", ".join(_noise_ctes())))
def i7_convergence_trace(spark, d):
    """Mean absolute change of the imputed cells in each sweep of I6."""
    return rounded(_noise_imputed(spark, d)[1].drop("visit"), 8)


def _stepwise_sql() -> str:
    parts = []
    for c in _I_COLS:
        parts.append(
            f"SELECT '{c}' AS target_col, CASE WHEN e < f THEN NULL ELSE 'v50' END AS predictor_col, {R('least(e, f)', 8)} AS aic, "
            f"'ok' AS status FROM (SELECT n * ln(syy / n) + 2 AS e, n * ln((syy - sxy * sxy / sxx) / n) + 4 AS f FROM (SELECT "
            f"count(*) AS n, regr_syy(value, v50) AS syy, regr_sxy(value, v50) AS sxy, regr_sxx(value, v50) AS sxx FROM p_{c}) t) u")
    return with_claims(" UNION ALL ".join(parts), ", ".join(_draw_ctes(22)))


@query("i8_stepwise_predictors", _stepwise_sql())
def i8_stepwise_predictors(spark, d):
    """I8: backward AIC choice of each imputed column's predictors among
    its mask (v50), after a random pre-fill, from one distributed Gram matrix."""
    return rounded(chained.stepwise_predictors(_claims_numeric(spark, d), _I_COLS, _I_ALL,
                                               predictors={c: ["v50"] for c in _I_COLS}), 8)


_TRACE_TARGETS = ["v1", "v23", "v38"]


@query("i8_stepwise_trace", "SELECT unnest(['v1', 'v23', 'v38']) AS target_col, CAST(8 AS BIGINT) AS candidates, CAST(1 AS BIGINT) AS constants, "
                            "TRUE AS copy_is_set_aside, TRUE AS aic_falls, TRUE AS aic_is_that_of_the_rows")
def i8_stepwise_trace(spark, d):
    """I8 over all columns: each imputed column on the other numeric columns,
    squares, the row number's digits, a copy of v50 and a constant. Facts by
    target: every candidate is kept, dropped or set aside; the copy and the constant are set aside; the
    AIC falls at every removal; the final AIC is that of the residuals that the coefficients leave in the rows."""
    c = _claims_numeric(spark, d).withColumn("sq50", F.col("v50") * F.col("v50")).withColumn("copy50", 2 * F.col("v50") + 1) \
        .withColumn("one", F.lit(1.0)).withColumn("digit", F.pmod("ID", F.lit(10)).cast("double")) \
        .withColumn("hash", F.pmod(F.xxhash64("ID"), F.lit(1000)).cast("double"))
    names = ["v1", "v23", "v38", "v50", "sq50", "copy50", "one", "digit", "hash"]
    c = stage(c, "trace-in")
    told = stage(chained.stepwise_trace(c, _TRACE_TARGETS, names), "trace")
    filled = stage(impute.random_impute(c.select("ID", *[F.col(x).cast("double").alias(x) for x in names]), names, "ID", seed=22), "trace-filled")
    rows = told.collect()  # one row a target and column
    exprs = []
    for t in _TRACE_TARGETS:
        left = F.col(t) - sum((F.lit(r["coefficient"]) * F.col(r["column"]) for r in rows if r["target_col"] == t and r["status"] == "kept"), F.lit(0.0))
        exprs += [F.var_pop(left).alias(f"s_{t}")]
    s = filled.agg(F.count(F.lit(1)).alias("n"), *exprs).first()
    again = F.element_at(F.create_map(*[x for t in _TRACE_TARGETS for x in (F.lit(t), F.lit(s["n"] * math.log(s[f"s_{t}"])))]), F.col("target_col"))
    before = F.lag("aic").over(Window.partitionBy("target_col").orderBy("step"))
    told = told.withColumn("falls", F.col("step").isNull() | before.isNull() | (F.col("aic") < before))
    kept = F.count_if(F.col("status") == "kept")
    aic = F.coalesce(F.max(F.when(F.col("status") == "kept", F.col("aic"))), F.min("aic"))
    out = told.groupBy("target_col").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("status") == "constant").alias("constants"),
        (F.count_if((F.col("column") == "copy50") & (F.col("status") == "collinear")) == 1).alias("copy_is_set_aside"),
        F.every("falls").alias("aic_falls"), aic.alias("aic"), kept.alias("kept"))
    same = F.abs(F.col("aic") - again - 2 * (F.col("kept") + 1)) < 1e-6 * F.abs(F.col("aic"))
    return out.select("target_col", "candidates", "constants", "copy_is_set_aside", "aic_falls", same.alias("aic_is_that_of_the_rows"))
