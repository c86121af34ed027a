import math
import random


from tessera.operators import folds, impute, metrics, transform
from tessera.functions import exprs as X


def test_random_impute_properties(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice([None, 1.0, 2.5, 7.0]), rnd.choice([None, 3.0])) for i in range(200)]
    df = spark.createDataFrame(rows, "ID long, x double, y double")
    out = {r["ID"]: r for r in impute.random_impute(df, ["x", "y"], seed=9).collect()}
    observed_x = {r[1] for r in rows if r[1] is not None}
    for i, x, y in rows:
        assert out[i]["x"] is not None and out[i]["x"] in observed_x
        if x is not None:
            assert out[i]["x"] == x
        assert out[i]["y"] == 3.0
    again = {r["ID"]: r["x"] for r in impute.random_impute(df.repartition(3), ["x"], seed=9).collect()}
    assert again == {i: r["x"] for i, r in out.items()}


def test_random_impute_no_donor_column_stays_null(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "ID long, x double")
    assert [r["x"] for r in impute.random_impute(df, ["x"]).collect()] == [None, None]


def test_mode_and_median(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, 1.0), (4, 1.0), (5, None), (6, 9.0)],
                               "ID long, x double")
    assert impute.fit_modes(df, ["x"])["x"] == 1.0  # tie -> smallest
    assert impute.fit_medians(df, ["x"])["x"] == 2.0
    even = spark.createDataFrame([(1, 1.0), (2, 4.0)], "ID long, x double")
    assert impute.fit_medians(even, ["x"])["x"] == 2.5
    filled = impute.fill_mode(df, ["x"]).where("ID = 5").first()["x"]
    assert filled == 1.0


def test_constant_fill(spark):
    df = spark.createDataFrame([(1, None, None)], "ID long, x double, s string")
    r = impute.fill_constant(df).first()
    assert r["x"] == -999.0 and r["s"] == ""


def test_stratified_folds_balanced(spark):
    rows = [(i, i % 3 == 0 and 1 or 0) for i in range(1, 301)]
    df = spark.createDataFrame(rows, "ID long, target int")
    f = folds.stratified_folds(df, k=4, repeats=2, seed=7).collect()
    for rep in (1, 2):
        ids = [r["ID"] for r in f if r["rep"] == rep]
        assert sorted(ids) == list(range(1, 301))
        for y in (0, 1):
            sizes = [sum(1 for r in f if r["rep"] == rep and r["target"] == y and r["fold"] == k)
                     for k in range(1, 5)]
            assert max(sizes) - min(sizes) <= 1
    names = {r["fold_name"] for r in f}
    assert "Fold1.Rep2" in names


def test_contiguous_kfold_sizes(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "ID long")
    f = {r["ID"]: r["fold"] for r in folds.contiguous_kfold(df, 3).collect()}
    assert [f[i] for i in range(10)] == [1, 1, 1, 1, 2, 2, 2, 3, 3, 3]


def test_stratified_sample_exact(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(101)], "ID long, target int")
    s = folds.stratified_sample(df, 0.1).groupBy("target").count().collect()
    assert {r["target"]: r["count"] for r in s} == {0: 6, 1: 5}


def test_auc_matches_brute_force(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.randint(0, 1), float(rnd.randint(0, 5))) for i in range(120)]
    df = spark.createDataFrame(rows, "ID long, y int, p double")
    got = metrics.auc(df, "y", "p").first()["auc"]
    pos = [p for _, y, p in rows if y == 1]
    neg = [p for _, y, p in rows if y == 0]
    brute = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert math.isclose(got, brute)


def test_logloss_finite_at_extremes(spark):
    df = spark.createDataFrame([(1, 0.0), (0, 1.0), (1, 1.0)], "y int, p double")
    ll = metrics.log_loss(df, "y", "p").first()["logloss"]
    assert math.isfinite(ll) and ll > 0


def test_special_log_and_scaling(spark):
    df = spark.createDataFrame([(1, -2.0), (2, 0.0), (3, math.e), (4, None)], "ID long, x double")
    out = {r["ID"]: r["t"] for r in df.select("ID", X.special_log("x").alias("t")).collect()}
    assert out[1] == -40.0 and out[2] == float("-inf") and math.isclose(out[3], 1.0) and out[4] is None
    sc = [r["x"] for r in transform.range_scale(df.where("x is not null"), ["x"]).collect()]
    assert min(sc) == 0.0 and max(sc) == 1.0
    const = spark.createDataFrame([(1, 5.0), (2, 5.0)], "ID long, x double")
    assert all(r["x"] is None for r in transform.range_scale(const, ["x"]).collect())


def test_yeo_johnson_fit_prefers_symmetry(spark):
    rnd = random.Random(4)
    rows = [(math.exp(rnd.gauss(0, 1)) - 1,) for _ in range(400)]
    df = spark.createDataFrame(rows, "x double")
    lam = transform.fit_yeo_johnson(df, ["x"])["x"]
    assert -0.5 <= lam <= 0.5  # log-normal data -> lambda near 0


def test_columns_without_nulls_keep_type_and_draws(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else float(i), i) for i in range(30)], "ID long, x double, k int")
    one = impute.random_impute(df, ["x"], seed=4)
    two = impute.random_impute(df, ["k", "x"], seed=4)
    assert dict(two.dtypes)["k"] == "int"
    assert {r["ID"]: r["x"] for r in one.collect()} == {r["ID"]: r["x"] for r in two.collect()}


def test_hash_of_64_bit_keys_is_exact(spark):
    from pyspark.sql import functions as F

    from tessera.functions.hashing import HIGH_FOLD, MODULUS, MULT_HI, MULT_LO, mix
    keys = [0, 5, 2**53 + 1, 2**62 + 12345, 2**63 - 1]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k long").select(mix(F.col("k"), 3)).collect()]
    for k, v in zip(keys, got):
        x = (k % MODULUS + (k // MODULUS) % MODULUS * HIGH_FOLD + 3) % MODULUS
        assert v == (x * MULT_HI % MODULUS) * 2147483648 + x * MULT_LO % MODULUS


def test_fdr_of_a_fold_without_predicted_positives(spark, sf, monkeypatch):
    import math

    from tessera.operators import metrics
    from tessera.plans import q_eval
    df = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.8), (2, 0, 0.1), (2, 1, 0.5)], "fold int, target int, prob double")
    out = {r["fold"]: (r["acc"], r["fdr"]) for r in metrics.accuracy_fdr(df, group_cols=["fold"]).collect()}
    assert out == {1: (0.5, 0.5), 2: (0.5, None)}
    monkeypatch.setattr(q_eval, "_scored", lambda *a: df)
    rate = {r["fold"]: r["fdr"] for r in q_eval.v3_accuracy_fdr(spark, sf).collect()}
    assert rate[1] == 0.5 and math.isnan(rate[2])  # 0 / 0, as in the SQL
