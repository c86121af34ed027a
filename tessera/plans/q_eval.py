"""Queries for folds and evaluation (V) and predictor masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.hashing import mix_sql
from tessera.operators import assoc, encode, folds, metrics, select, transform
from tessera.plans.q_encode import impact_sql
from tessera.plans.q_profile import _pearson_sql
from tessera.plans.registry import R, query, rounded, with_claims, sig_round
from tessera.sources.tables import claims_view

K, SEED = 5, 433


def folds_sql(name: str, k: int, reps: list[tuple[int, int]], hash_rep: int | None = None) -> str:
    """CTE of stratified folds; ``reps`` lists (rep label, seed); the hash
    uses the rep label unless ``hash_rep`` fixes it."""
    parts = []
    for rep, seed in reps:
        key = mix_sql(f"ID + {hash_rep if hash_rep is not None else rep} * 1000003 + {seed}", 0)
        parts.append(
            f"SELECT ID, target, CAST({rep} AS INTEGER) AS rep, CAST((row_number() OVER "
            f"(PARTITION BY target ORDER BY {key}, ID) - 1) % {k} + 1 AS INTEGER) AS fold "
            f"FROM claims WHERE target IS NOT NULL")
    return f"{name} AS ({' UNION ALL '.join(parts)})"


def _folds(spark, d, k=K, repeats=1, seed=SEED):
    return folds.stratified_folds(claims_view(spark, d), k=k, repeats=repeats, seed=seed)


@query("v5_stratified_folds", with_claims(
    "SELECT ID, target, rep, fold, 'Fold' || CAST(fold AS VARCHAR) || '.Rep' || CAST(rep AS VARCHAR) "
    "AS fold_name FROM f", folds_sql("f", K, [(1, SEED), (2, SEED), (3, SEED)])))
def v5_stratified_folds(spark, d):
    """V5: 5 folds x 3 repeats, stratified on the label (sizes within 1 per stratum)."""
    return _folds(spark, d, K, 3)


@query("v4_contiguous_kfold", with_claims(
    "SELECT ID, CAST(CASE WHEN pos < r * (q + 1) THEN floor(pos / (q + 1)) "
    "ELSE r + floor((pos - r * (q + 1)) / q) END + 1 AS INTEGER) AS fold FROM "
    "(SELECT ID, row_number() OVER (ORDER BY ID) - 1 AS pos, count(*) OVER () // 3 AS q, "
    "count(*) OVER () % 3 AS r FROM claims WHERE target IS NOT NULL) t"))
def v4_contiguous_kfold(spark, d):
    """V4: unshuffled 3-fold split of the labelled rows in ID order."""
    lab = claims_view(spark, d).where(F.col("target").isNotNull()).select("ID")
    return folds.contiguous_kfold(lab, k=3)


@query("v7_stratified_sample", with_claims(
    "SELECT ID, target FROM (SELECT ID, target, row_number() OVER (PARTITION BY target ORDER BY "
    f"{mix_sql('ID', 123)}, ID) - 1 AS pos, count(*) OVER (PARTITION BY target) AS ns FROM claims "
    "WHERE target IS NOT NULL) t WHERE pos < ceil(ns * 0.01)"))
def v7_stratified_sample(spark, d):
    """V7: a 1% sample of every label class (exact per-class sizes)."""
    s = folds.stratified_sample(claims_view(spark, d).select("ID", "target"), 0.01, seed=123)
    return s.select("ID", "target")


_imp22_cte, _imp22_val = impact_sql("v22")
_SCORED = (f"scored AS (SELECT f.fold, claims.target, {_imp22_val} AS prob FROM claims "
           f"JOIN f ON claims.ID = f.ID)")


def _scored(spark, d):
    c = claims_view(spark, d).select("ID", "target", "v22")
    coded = encode.impact_encode(c, ["v22"], row_key="ID").withColumnRenamed("Imp_v22", "prob")
    f = _folds(spark, d).select("ID", "fold")
    return coded.join(f, "ID")


FLAGSHIP_SQL = with_claims(
    f"SELECT fold, count(*) AS n, {R('avg(-(target * ln(greatest(least(prob, 1 - 1e-15), 1e-15)) + '
                                     '(1 - target) * ln(1 - greatest(least(prob, 1 - 1e-15), 1e-15))))')} "
    "AS logloss FROM scored GROUP BY fold",
    folds_sql("f", K, [(1, SEED)]) + ", " + _imp22_cte + ", " + _SCORED)


@query("v1_logloss_by_fold", FLAGSHIP_SQL)
def v1_logloss_by_fold(spark, d):
    """Flagship: impact coding of the high-cardinality v22 (E1 + E2, lookup
    join with default) scored by clipped log-loss (V1) on each stratified
    fold (V5)."""
    return rounded(metrics.log_loss(_scored(spark, d), "target", "prob", ["fold"]))


@query("v8_cv_summary", with_claims(
    f"SELECT count(*) AS folds, {R('avg(logloss)')} AS cv_mean, {R('stddev_samp(logloss)')} AS cv_sd FROM "
    "(SELECT fold, avg(-(target * ln(greatest(least(prob, 1 - 1e-15), 1e-15)) + (1 - target) * "
    "ln(1 - greatest(least(prob, 1 - 1e-15), 1e-15)))) AS logloss FROM scored GROUP BY fold) t",
    folds_sql("f", K, [(1, SEED)]) + ", " + _imp22_cte + ", " + _SCORED))
def v8_cv_summary(spark, d):
    """V8: mean and sd of the per-fold log-loss."""
    per = metrics.log_loss(_scored(spark, d), "target", "prob", ["fold"])
    return rounded(metrics.cv_summary(per, "logloss"))


@query("v3_accuracy_fdr", with_claims(
    f"SELECT fold, count(*) AS n, {R('avg(CAST((CAST(prob > 0.5 AS INT) = target) AS INT))')} AS acc, "
    f"{R('sum(CASE WHEN prob > 0.5 AND target = 0 THEN 1 ELSE 0 END) * 1.0 / sum(CASE WHEN prob > 0.5 THEN 1 ELSE 0 END)')} "
    "AS fdr FROM scored GROUP BY fold",
    folds_sql("f", K, [(1, SEED)]) + ", " + _imp22_cte + ", " + _SCORED))
def v3_accuracy_fdr(spark, d):
    """V3: accuracy and false discovery rate of prob > 0.5, per fold (not a
    number, as 0 / 0, for a fold without predicted positives)."""
    out = metrics.accuracy_fdr(_scored(spark, d), "target", "prob", 0.5, ["fold"])
    return rounded(out.withColumn("fdr", F.coalesce("fdr", F.lit(float("nan")))))


@query("v2_auc_by_fold", with_claims(
    f"SELECT fold, {R('sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg))')} AS auc FROM "
    "(SELECT *, coalesce(sum(neg) OVER (PARTITION BY fold ORDER BY score ROWS BETWEEN UNBOUNDED "
    "PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT f.fold, CAST(claims.v50 AS DOUBLE) AS score, "
    "sum(CASE WHEN claims.target = 1 THEN 1 ELSE 0 END) AS pos, "
    "sum(CASE WHEN claims.target = 1 THEN 0 ELSE 1 END) AS neg FROM claims JOIN f ON claims.ID = f.ID "
    "GROUP BY 1, 2) s) c GROUP BY fold",
    folds_sql("f", K, [(1, SEED)])))
def v2_auc_by_fold(spark, d):
    """V2: exact tie-averaged AUC of v50 as a score, per fold."""
    c = claims_view(spark, d).select("ID", "target", "v50")
    x = c.join(_folds(spark, d).select("ID", "fold"), "ID")
    return rounded(metrics.auc(x, "target", "v50", ["fold"]))


def oof_sql(folds_cte: str) -> str:
    """SQL of out-of-fold impact coding of v22 for every (rep, labelled row)."""
    return folds_cte + """,
lab AS (SELECT f.rep, f.fold, f.target, CAST(c.v22 AS VARCHAR) AS level, c.ID FROM f JOIN claims c ON f.ID = c.ID),
lev AS (SELECT rep, level, count(*) AS n, sum(target) AS n1 FROM lab GROUP BY rep, level),
levf AS (SELECT rep, fold, level, count(*) AS nf, sum(target) AS n1f FROM lab GROUP BY rep, fold, level),
tot AS (SELECT rep, count(*) AS N, sum(target) AS N1, count(*) FILTER (WHERE level IS NULL) AS NN,
        coalesce(sum(target) FILTER (WHERE level IS NULL), 0) AS NN1 FROM lab GROUP BY rep),
totf AS (SELECT rep, fold, count(*) AS Nf, sum(target) AS N1f, count(*) FILTER (WHERE level IS NULL) AS NNf,
        coalesce(sum(target) FILTER (WHERE level IS NULL), 0) AS NN1f FROM lab GROUP BY rep, fold),
po AS (SELECT t.rep, tf.fold, (t.N1 - tf.N1f) * 1.0 / (t.N - tf.Nf) AS p,
        ((t.N1 - tf.N1f) + (t.NN1 - tf.NN1f) + (t.N1 - tf.N1f) * 1.0 / (t.N - tf.Nf))
        / ((t.N - tf.Nf) + (t.NN - tf.NNf) + 1.0) AS na FROM tot t JOIN totf tf ON t.rep = tf.rep),
oof AS (SELECT lab.ID, lab.rep, (CASE WHEN lab.level IS NOT NULL AND lev.n - levf.nf > 0
        THEN (lev.n1 - levf.n1f + po.p) / (lev.n - levf.nf + 1.0) ELSE po.na END) AS prob
        FROM lab JOIN po ON lab.rep = po.rep AND lab.fold = po.fold
        LEFT JOIN lev ON lev.rep = lab.rep AND lev.level = lab.level
        LEFT JOIN levf ON levf.rep = lab.rep AND levf.fold = lab.fold AND levf.level = lab.level)"""


def _oof(spark, d, folds_with_rep):
    """Out-of-fold impact coding of v22 for every (rep, labelled row) in one pass."""
    c = claims_view(spark, d).select("ID", "target", "v22")
    x = c.join(folds_with_rep.select("ID", "rep", "fold"), "ID")
    o = encode.impact_encode_out_of_fold(x, "v22", "fold", out_col="prob", rep_col="rep", row_key="ID")
    return o.select("ID", "rep", "prob")


_OOF_SELECT = f"SELECT ID, count(*) AS n_models, {R('avg(prob)')} AS prob FROM oof GROUP BY ID"


@query("v9_oof_average", with_claims(_OOF_SELECT, oof_sql(folds_sql("f", 3, [(1, 15), (2, 15), (3, 15)]))))
def v9_oof_average(spark, d):
    """V9 with Q11: out-of-fold impact coding of v22 (per-fold counts
    subtracted from the totals) over 3 folds x 3 repeats, averaged per ID."""
    f = folds.stratified_folds(claims_view(spark, d), k=3, repeats=3, seed=15)
    return rounded(metrics.average_predictions(_oof(spark, d, f)))


_BAG_SEEDS = list(range(2018, 2028))


# Means of ten end in the tenth decimal, where nine would be a tie.
@query("v10_seed_bagging", with_claims(
    f"SELECT ID, count(*) AS n_models, {R('avg(prob)', 14, 12)} AS prob FROM oof GROUP BY ID", oof_sql(folds_sql("f", 3, [(i + 1, s) for i, s in enumerate(_BAG_SEEDS)],
                                   hash_rep=1))))
def v10_seed_bagging(spark, d):
    """Bag of out-of-fold impact models whose folds use different seeds
    (2018-2027), averaged per ID."""
    parts = [folds.stratified_folds(claims_view(spark, d), k=3, repeats=1, seed=s)
             .withColumn("rep", F.lit(i + 1)) for i, s in enumerate(_BAG_SEEDS)]
    members = parts[0]
    for p in parts[1:]:
        members = members.unionByName(p)
    mean = metrics.average_predictions(_oof(spark, d, members))
    return mean.withColumn("prob", sig_round(F.col("prob"), 14, 12))


# ---------------------------------------------------------------- masks
_MASK_NUM = ["v1", "v23", "v50", "Tl_v1", "Tl_v50"]
_MASK_SRC = ("tr AS (SELECT v1, v23, v50, CASE WHEN v1 > -1 THEN ln(1 + v1) END AS Tl_v1, "
             "CASE WHEN v50 > -1 THEN ln(1 + v50) END AS Tl_v50 FROM claims)")


def _mask_matrix(spark, d):
    c = transform.add_log1p(claims_view(spark, d).select("v1", "v23", "v50"), ["v1", "v50"])
    return rounded(assoc.pearson_pairs(c, _MASK_NUM))


_TOPN_SQL = ("SELECT col_a AS target_col, col_b AS predictor_col, stat, CAST(row_number() OVER "
             "(PARTITION BY col_a ORDER BY abs(stat) DESC NULLS LAST, col_b) AS INTEGER) AS rank FROM m")


@query("j7_top_predictors", with_claims(
    "SELECT * FROM (" + _TOPN_SQL + ") t WHERE rank <= 2",
    _MASK_SRC + f", m AS ({_pearson_sql('tr', _MASK_NUM)})"))
def j7_top_predictors(spark, d):
    """J7 (+ J5): per column, the 2 predictors of largest |association|."""
    return select.top_n_predictors(_mask_matrix(spark, d), 2)


@query("j9_exclude_own_transforms", with_claims(
    "SELECT target_col, predictor_col, stat FROM (" + _TOPN_SQL + ") t WHERE rank <= 2 AND NOT "
    "(predictor_col IN ('Ts_' || target_col, 'Tyj_' || target_col, 'Tl_' || target_col))",
    _MASK_SRC + f", m AS ({_pearson_sql('tr', _MASK_NUM)})"))
def j9_exclude_own_transforms(spark, d):
    """The top-2 mask without a column's own transforms as predictors."""
    mask = select.top_n_predictors(_mask_matrix(spark, d), 2)
    return select.exclude_own_transforms(mask).select("target_col", "predictor_col", "stat")


@query("j8_threshold_predictors", with_claims(
    "SELECT col_a AS target_col, col_b AS predictor_col, stat FROM m WHERE stat > 0.05",
    _MASK_SRC + f", m AS ({_pearson_sql('tr', _MASK_NUM)})"))
def j8_threshold_predictors(spark, d):
    """Predictor pairs whose association exceeds 0.05."""
    return select.threshold_predictors(_mask_matrix(spark, d), None, 0.05)


@query("j11_mask_overlay", with_claims(
    "SELECT a.target_col, a.predictor_col FROM (SELECT x.c AS target_col, y.c AS predictor_col FROM "
    "(SELECT unnest(['v1','v23','v50','Tl_v1','Tl_v50']) AS c) x, "
    "(SELECT unnest(['v1','v23','v50','Tl_v1','Tl_v50']) AS c) y WHERE x.c <> y.c) a "
    "WHERE a.target_col NOT IN ('v1', 'v23') UNION ALL "
    "SELECT target_col, predictor_col FROM (" + _TOPN_SQL + ") t WHERE rank <= 2 AND target_col IN ('v1', 'v23')",
    _MASK_SRC + f", m AS ({_pearson_sql('tr', _MASK_NUM)})"))
def j11_mask_overlay(spark, d):
    """The all-pairs default mask with the top-2 lists of v1 and v23
    laid over it."""
    top = select.top_n_predictors(_mask_matrix(spark, d), 2).where(F.col("target_col").isin("v1", "v23"))
    default = select.all_pairs_mask(spark, _MASK_NUM)
    return select.mask_overlay(default, top)
