import math
import random

import numpy as np

from tessera.operators import assoc, profile
from tessera.operators.ranking import cumulative_rank, exact_quantiles


def test_cramers_v_properties(spark):
    rows = [(str(i % 3), str(i % 3), "k", None if i == 0 else str(i % 2)) for i in range(30)]
    df = spark.createDataFrame(rows, "a string, b string, s string, z string")
    v = {(r["col_a"], r["col_b"]): r["stat"] for r in assoc.cramers_v_pairs(df, ["a", "b", "s", "z"]).collect()}
    assert math.isclose(v[("a", "b")], 1.0)
    assert v[("a", "s")] is None  # single level
    assert v[("a", "z")] == v[("z", "a")]
    assert 0.0 <= v[("a", "z")] <= 1.0
    capped = {(r["col_a"], r["col_b"]): r["stat"]
              for r in assoc.cramers_v_pairs(df, ["a", "z"], level_cap=1).collect()}
    assert capped[("a", "z")] is None


def test_anova_r2_equals_least_squares(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("xyz"), rnd.gauss(0, 1) + {"x": 0, "y": 1, "z": 3}[c]) for c in
            [rnd.choice("xyz") for _ in range(60)]]
    rows = [(lv, y) for lv, y in rows]
    df = spark.createDataFrame(rows, "f string, y double")
    got = assoc.anova_r2_pairs(df, ["y"], ["f"], mirror=False).first()["stat"]
    levels = sorted({r[0] for r in rows})
    X = np.array([[1.0] + [1.0 if r[0] == lv else 0.0 for lv in levels[1:]] for r in rows])
    y = np.array([r[1] for r in rows])
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    rss = ((y - X @ beta) ** 2).sum()
    tss = ((y - y.mean()) ** 2).sum()
    n, k = len(y), len(levels)
    assert math.isclose(got, 1 - (rss / tss) * (n - 1) / (n - k), rel_tol=1e-9)


def test_pearson_pairwise_complete(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.1), (3.0, None), (4.0, 8.3)], "x double, y double")
    r = assoc.pearson_pairs(df, ["x", "y"], mirror=False).first()
    assert r["n"] == 3
    assert math.isclose(r["stat"], np.corrcoef([1, 2, 4], [2, 4.1, 8.3])[0, 1], rel_tol=1e-12)


def test_exact_quantiles_match_numpy(spark):
    rnd = random.Random(5)
    vals = [rnd.choice([None, rnd.uniform(-5, 5), float(rnd.randint(0, 3))]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in vals], "x double").repartition(7)
    q = {r["prob"]: r["value"] for r in exact_quantiles(df, ["x"], [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    obs = np.array([v for v in vals if v is not None])
    for p, v in q.items():
        assert math.isclose(v, float(np.percentile(obs, p * 100)), rel_tol=1e-12, abs_tol=1e-12)


def test_cumulative_rank_is_partition_invariant(spark):
    rows = [(i % 3, (i * 7919) % 101, i) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, v int, id int")
    a = {r["id"]: r["rank_lo"] for r in cumulative_rank(df.repartition(5), ["g"], ["v", "id"]).collect()}
    b = {r["id"]: r["rank_lo"] for r in cumulative_rank(df.repartition(2), ["g"], ["v", "id"],
                                                         num_partitions=3).collect()}
    brute = {}
    for g in range(3):
        grp = sorted([r for r in rows if r[0] == g], key=lambda r: (r[1], r[2]))
        for i, r in enumerate(grp):
            brute[r[2]] = i
    assert a == brute and b == brute


def test_summary_moments(spark):
    xs = [1.0, 2.0, 2.0, 3.0, 10.0, None]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    s = {r["stat"]: r["value"] for r in profile.numeric_summary(df, ["x"]).collect()}
    a = np.array([x for x in xs if x is not None])
    m = a.mean()
    m2, m3, m4 = ((a - m) ** 2).mean(), ((a - m) ** 3).mean(), ((a - m) ** 4).mean()
    assert s["NA's"] == 1 and s["Median"] == 2.0 and math.isclose(s["Mean"], m)
    assert math.isclose(s["skewness"], m3 / m2 ** 1.5, rel_tol=1e-9)
    assert math.isclose(s["kurtosis"], m4 / m2 ** 2, rel_tol=1e-9)
    jb = len(a) / 6 * (s["skewness"] ** 2 + (s["kurtosis"] - 3) ** 2 / 4)
    assert math.isclose(s["jarque-brera"], math.exp(-jb / 2), rel_tol=1e-9)


def test_row_shares(spark):
    df = spark.createDataFrame([(1, 1, None, -2.0, None), (2, None, 3.0, 1.0, "a")],
                               "ID long, target int, x double, y double, s string")
    out = {r["ID"]: r for r in profile.add_row_shares(df).collect()}
    assert out[1]["NAfreq"] == 2 / 3 and out[1]["Below0freq"] == 1 / 3 and out[1]["NAfacfreq"] == 1.0
    assert out[2]["NAfreq"] == 0.0
    inc = {r["ID"]: r for r in profile.add_row_shares(df, include_label=True).collect()}
    assert inc[2]["NAfreq"] == 1 / 3


def test_level_counts_blank_is_level(spark):
    df = spark.createDataFrame([("",), ("a",), (None,)], "c string")
    assert profile.level_counts(df, ["c"]).first()["n_levels"] == 2


def test_histogram(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (None,)], "x double")
    h = {r["bin"]: r["n"] for r in profile.histogram(df, "x", width=0.5).collect()}
    assert h == {0: 1, 1: 1, 2: 1}


def test_cumulative_rank_large_sampled_input(spark):
    # enough rows per input partition that range bounds come from a sample
    df = spark.range(0, 60000, numPartitions=12).selectExpr(
        "id", "CAST(id % 5 AS INT) AS g", "(id * 7919) % 60013 AS v", "CAST(id % 3 + 1 AS LONG) AS w")
    r = cumulative_rank(df, ["g"], ["v", "id"], weight_col="w", num_partitions=16)
    got = r.select("id", "g", "v", "w", "rank_lo", "rank_hi").toPandas().sort_values(["g", "v", "id"])
    got["expect_hi"] = got.groupby("g")["w"].cumsum()
    assert (got["rank_hi"] == got["expect_hi"]).all()
    assert (got["rank_lo"] == got["expect_hi"] - got["w"]).all()


def test_column_nulls_wide_and_long_forms_agree(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 2.0, None), (3, None, None)], "ID long, x double, s string")
    a = sorted(map(tuple, profile.column_nulls(df).collect()))
    b = sorted(map(tuple, profile.column_nulls(df, wide_max=1).collect()))
    assert a == b and ("x", "numeric", 2, 2 / 3) in a


def test_pairs_without_common_rows_are_kept(spark):
    from tessera.operators import assoc, profile
    df = spark.createDataFrame([(1.0, None, "a", None, None), (2.0, None, "b", None, None), (None, 3.0, None, "c", None),
                                (None, 4.0, None, "d", None)], "x double, y double, f string, g string, e string")
    for got in (assoc.pearson_pairs(df, ["x", "y"]), assoc.cramers_v_pairs(df, ["f", "g"]),
                assoc.anova_r2_pairs(df, ["x"], ["g"])):
        rows = got.collect()
        assert len(rows) == 2 and all(r["n"] == 0 and r["stat"] is None for r in rows)
    rows = {r["column"]: tuple(r)[1:] for r in profile.unseen_level_report(
        df.withColumn("target", df["x"]), ["f", "e"]).collect()}
    assert rows == {"f": (2, 2, 0), "e": (0, 0, 0)}


def test_wide_association_has_no_row_per_pair(spark):
    from pyspark.sql import functions as F

    from tessera.operators import assoc
    wide = spark.range(50).select(*[(F.sin(F.col("id") * (j + 1))).alias(f"c{j}") for j in range(132)])
    out = assoc.pearson_pairs(wide, wide.columns, mirror=False)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and out.count() == 132 * 131 // 2
    r = out.where("col_a = 'c0' and col_b = 'c1'").first()["stat"]
    assert abs(r - wide.select(F.corr("c0", "c1")).first()[0]) < 1e-12


def test_bracketed_quantiles_of_a_long_column(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from tessera.operators.ranking import exact_quantiles
    df = spark.range(30_000).select(F.sin("id").alias("a"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(
        F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double")).alias("hot"), F.lit(None).cast("double").alias("none"))
    got = {(r["column"], r["prob"]): r["value"] for r in exact_quantiles(df, df.columns, [0.0, 0.25, 0.5, 1.0]).collect()}
    rows = df.toPandas()
    for c in ("a", "hot"):
        for p in (0.0, 0.25, 0.5, 1.0):
            assert abs(got[c, p] - np.quantile(rows[c], p)) < 1e-12
    assert got["none", 0.5] is None


def test_simulated_p_values_match_enumeration(spark):
    """Small tables: every table with the same margins, weighted by its probability."""
    from itertools import product
    from math import comb

    table = [[5, 1, 0], [1, 3, 2]]
    rows, cols, n = [6, 6], [6, 4, 2], 12

    def far(first):
        return sum(x * x / (a * b) for line, a in ((first, 6), ([c - x for c, x in zip(cols, first)], 6))
                   for x, b in zip(line, cols))

    p = sum(np.prod([comb(c, x) for c, x in zip(cols, first)]) for first in product(*[range(c + 1) for c in cols])
            if sum(first) == 6 and far(first) >= far(table[0]) - 1e-9) / comb(n, 6)
    data = [(f"r{i}", f"c{j}", "one", None) for i, line in enumerate(table) for j, x in enumerate(line) for _ in range(x)]
    df = spark.createDataFrame(data, "a string, b string, k string, gone string")
    got = {(r["col_a"], r["col_b"]): r for r in assoc.simulated_p_values(df, ["a", "b", "k", "gone"], replicates=5000).collect()}
    assert set(got) == {("a", "b"), ("a", "k"), ("b", "k")}
    r = got["a", "b"]
    assert abs(r["p_value"] - p) < 0.035 and r["n"] == 12 and abs(r["least_expected"] - 1.0) < 1e-12
    assert got["a", "k"]["p_value"] is None and got["a", "k"]["v"] is None
    same = assoc.simulated_p_values(df.repartition(3), ["a", "b"], replicates=5000).collect()[0]
    assert same["p_value"] == r["p_value"]
    v = {(x["col_a"], x["col_b"]): x["stat"] for x in assoc.cramers_v_pairs(df, ["a", "b"]).collect()}
    assert abs(v["a", "b"] - r["v"]) < 1e-12
    assert assoc.simulated_p_values(df, ["a", "b"], level_cap=1).collect() == []


def test_random_tables_keep_margins_of_any_size():
    rng = np.random.default_rng(3)
    small = assoc.random_tables(np.array([30, 20]), np.array([25, 15, 10]), 4000, rng)
    assert abs(50 * (small.mean() - 1) - 50 / 49 * 2) < 0.12  # the exact mean of chi-square: n (r-1)(c-1) / (n-1)
    large = assoc.random_tables(np.array([3 * 10 ** 9, 10 ** 9]), np.array([2 * 10 ** 9, 10 ** 9, 10 ** 9]), 4000, rng)
    assert abs(4e9 * (large.mean() - 1) - 2) < 0.15
