import random

import numpy as np
from pyspark.sql import functions as F

from tessera.functions.hashing import MODULUS, MULT_HI, MULT_LO, HIGH_FOLD
from tessera.operators import chained


def py_mix(key: int, salt: int) -> int:
    low = key % MODULUS
    high = (key // MODULUS) % MODULUS
    x0 = (low + high * HIGH_FOLD + salt % MODULUS) % MODULUS
    return ((x0 * MULT_HI) % MODULUS) * 2147483648 + (x0 * MULT_LO) % MODULUS


def test_hash_matches_python_twin(spark):
    from tessera.functions.hashing import mix
    ids = [0, 1, 2, 99, 2147483646, 2147483647, 2147483648, 10 ** 12 + 7]
    df = spark.createDataFrame([(i,) for i in ids], "ID long")
    got = {r["ID"]: r["h"] for r in df.select("ID", mix(F.col("ID"), 12345).alias("h")).collect()}
    assert got == {i: py_mix(i, 12345) for i in ids}


def test_pmm_donors_exact_k_nearest(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(1, 161):
        miss = rnd.random() < 0.3
        pred = float(rnd.randint(0, 40))  # many ties in prediction
        rows.append((i, None if miss else float(i * 10), pred, miss))
    df = spark.createDataFrame(rows, "ID long, y double, _pred double, _m_y boolean")
    k, salt = 5, 77
    got = {r["ID"]: r["_new"] for r in chained.pmm_donors(df, "y", "ID", "_m_y", k=k, salt=salt).collect()}
    obs = sorted([(p, i, y) for i, y, p, m in rows if not m])  # (pred, id) order
    for i, _, p, m in rows:
        if not m:
            continue
        b = sum(1 for (op, oi, _) in obs if (op, oi) < (p, i))  # observed rows before
        def closeness(r):
            return b - r if r < b else r - b + 1
        ranked = sorted(range(len(obs)), key=lambda r: (abs(obs[r][0] - p), closeness(r), obs[r][1]))
        near = ranked[:k]
        pick = py_mix(i, salt) % len(near)
        assert got[i] == obs[near[pick]][2], i
    assert len(got) == sum(1 for r in rows if r[3])


def test_chained_imputation_properties(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(1, 301):
        a = rnd.gauss(0, 1)
        b = 2 * a + rnd.gauss(0, 0.1)
        rows.append((i, None if rnd.random() < 0.2 else a, None if rnd.random() < 0.2 else b, rnd.gauss(0, 1)))
    df = spark.createDataFrame(rows, "ID long, a double, b double, c double")
    filled, trace = chained.chained_impute(df, ["a", "b"], ["a", "b", "c"], m=1, maxit=2, seed=5)
    out = {r["ID"]: r for r in filled.collect()}
    obs_b = {r[2] for r in rows if r[2] is not None}
    for i, a, b, _ in rows:
        assert out[i]["a"] is not None and out[i]["b"] is not None
        if a is not None:
            assert out[i]["a"] == a
        if b is None:
            assert out[i]["b"] in obs_b  # PMM only emits observed values
    t = trace.collect()
    assert len(t) == 4 and all(r["mean_abs_change"] is not None for r in t)


def test_stepwise_drops_noise_predictor(spark):
    rnd = random.Random(8)
    rows = [(i, x, 3 * x + rnd.gauss(0, 0.01), rnd.gauss(0, 1)) for i, x in
            enumerate([rnd.gauss(0, 1) for _ in range(400)])]
    df = spark.createDataFrame(rows, "ID long, x double, y double, z double")
    r = chained.stepwise_predictors(df, ["y"], ["x", "y", "z"]).collect()
    assert {row["predictor_col"] for row in r} == {"x"}


def test_streaming_rowwise_matches_batch(spark, sf):
    from tessera.sources.tables import read_table
    from tessera.streaming import rowwise
    batch = read_table(spark, sf, "events")
    model, rows = rowwise.fit_event_frequency(batch)
    out = rowwise.run_to_parquet(rowwise.rowwise_features(rowwise.stream_table(spark, sf, "events"), model, rows))
    streamed = spark.read.parquet(out)
    direct = rowwise.rowwise_features(batch, model, rows)
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(direct).count() == 0


def test_norm_imputation_leaves_observed_cells(spark):
    from tessera.operators import chained
    rows = [(i, None if i % 5 == 0 else 2.0 * i, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "ID long, a double, b double")
    filled, trace = chained.chained_impute(df, ["a"], ["a", "b"], m=1, maxit=2, method="norm", predictors={"a": ["b"]})
    got = {r["ID"]: r["a"] for r in filled.collect()}
    assert all(abs(got[i] - 2.0 * i) < 1e-6 for i in got)  # an exact line has no residual
    assert trace.count() == 2


def test_elimination_by_sweeps_matches_refits(spark):
    """Every step drops the column that a refit of all smaller models would drop."""
    import math

    import numpy as np
    rng = np.random.default_rng(4)
    n = 200
    x = rng.normal(size=(n, 6))
    x[:, 4] = x[:, 0] - 2 * x[:, 1]  # a combination
    x[:, 5] = 3.0                     # a constant
    y = 2 * x[:, 0] + 0.15 * x[:, 2] + rng.normal(size=n)
    names = [f"x{j}" for j in range(6)]
    df = spark.createDataFrame([(i, float(y[i]), *map(float, x[i])) for i in range(n)], "ID long, y double, " + ", ".join(f"{c} double" for c in names))
    rows = chained.stepwise_trace(df, ["y"], names).collect()
    status = {r["column"]: r["status"] for r in rows}
    assert status["x4"] == "collinear" and status["x5"] == "constant" and status["x0"] == "kept"

    def aic(cols):
        a = np.column_stack([np.ones(n), *[x[:, j] for j in cols]])
        rss = ((y - a @ np.linalg.lstsq(a, y, rcond=None)[0]) ** 2).sum()
        return n * math.log(rss / n) + 2 * a.shape[1]

    live, want = [0, 1, 2, 3], []
    while live:
        best, j = min((aic([k for k in live if k != j]), j) for j in live)
        if best >= aic(live):
            break
        live.remove(j)
        want.append((f"x{j}", best))
    got = sorted((r["step"], r["column"], r["aic"]) for r in rows if r["status"] == "dropped")
    assert [c for _, c, _ in got] == [c for c, _ in want]
    assert all(abs(a - b) < 1e-6 for (_, _, a), (_, b) in zip(got, want))
    kept = {r["column"]: r["coefficient"] for r in rows if r["status"] == "kept"}
    a = np.column_stack([np.ones(n), *[x[:, int(c[1])] for c in sorted(kept)]])
    assert np.allclose([kept[c] for c in sorted(kept)], np.linalg.lstsq(a, y, rcond=None)[0][1:], atol=1e-8)


def test_sweep_is_undone_by_itself():
    import numpy as np
    rng = np.random.default_rng(1)
    b = rng.normal(size=(9, 4))
    a = b.T @ b
    assert np.allclose(chained.sweep(chained.sweep(a, 2), 2), a)
    full = a
    for k in range(4):
        full = chained.sweep(full, k)
    assert np.allclose(-full, np.linalg.inv(a))


def test_posterior_draws_have_the_posterior():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 2))
    y = 3 + x @ [2.0, -1.0] + rng.normal(size=80)
    rows = np.column_stack([np.ones(80), x, x[:, 0] * 2, y])  # the third predictor repeats the first
    beta, inverse, rss, freedom = chained.linear_fit(rows.T @ rows)
    want, left, _, _ = np.linalg.lstsq(rows[:, :3], y, rcond=None)
    assert np.allclose(beta, [*want, 0]) and np.isclose(rss, left[0]) and freedom == 77
    draws = np.array([chained.posterior_draw(beta, inverse, rss, freedom, np.random.default_rng(k))[0] for k in range(6000)])
    assert (draws[:, 3] == 0).all() and np.allclose(draws[:, :3].mean(axis=0), want, atol=0.02)
    cov = np.linalg.inv(rows[:, :3].T @ rows[:, :3]) * rss / (freedom - 2)
    assert np.allclose(np.cov(draws[:, :3].T), cov, rtol=0.15, atol=5e-4)
    assert chained.posterior_draw(beta, inverse, rss, 0, rng)[1] == 0.0


def test_posterior_imputations_differ_and_follow_the_order(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(1, 401):
        a = rnd.gauss(0, 1)
        rows.append((i, None if rnd.random() < 0.4 else 2 * a + 10 + rnd.gauss(0, 0.5), None if rnd.random() < 0.1 else a, a))
    df = spark.createDataFrame(rows, "ID long, y double, z double, x double")
    args = dict(m=3, maxit=1, seed=2, method="norm", order="monotone", spread=True, predictors={"y": ["x"], "z": ["x"]})
    out, trace = chained.chained_impute(df, ["y", "z"], ["y", "z", "x"], posterior=True, **args)
    again = chained.chained_impute(df.repartition(5), ["y", "z"], ["y", "z", "x"], posterior=True, **args)[0]
    got, other = ({r["ID"]: r for r in t.collect()} for t in (out, again))
    assert {(r["visit"], r["column"]) for r in trace.collect()} == {(1, "z"), (2, "y")}
    assert [t.columns for t in (out,)] == [["ID", "y", "z", "x", "sd_z", "sd_y"]]
    gone = [i for i, y, _, _ in rows if y is None]
    assert all((got[i]["sd_y"] is None) == (y is not None) for i, y, _, _ in rows)
    assert 0.15 < sum(got[i]["sd_y"] ** 2 for i in gone) / len(gone) < 0.4  # the noise's variance is 0.25
    assert abs(sum(got[i]["y"] - 10 - 2 * got[i]["x"] for i in gone) / len(gone)) < 0.15
    assert all(abs(got[i]["z"] - got[i]["x"]) < 1e-6 for i in got)
    assert all(abs(got[i]["y"] - other[i]["y"]) < 1e-6 for i in got)


def test_pmm_over_many_ranges_takes_one_shuffle(spark, monkeypatch):
    """ranges with few or no donors, equal and null predictions, a null id: the donors of a search over all rows."""
    monkeypatch.setattr(chained, "RANGE_ROWS", 40)
    rnd = random.Random(4)
    rows = []
    for i in range(1, 401):
        pred = None if i % 57 == 0 else 3.0 if i % 3 == 0 else rnd.choice([rnd.gauss(0, 5), float(rnd.randint(-4, 4))])
        miss = rnd.random() < 0.4 if pred is None or pred < 6 else i % 2 == 0 or pred > 9
        rows.append((i, None if miss else float(i), pred, miss))
    df = spark.createDataFrame([*rows, (None, None, 1.0, True)], "ID long, y double, _pred double, _m_y boolean").repartition(3)
    found = chained.pmm_donors(df, "y", "ID", "_m_y", k=5, salt=13)
    got = {r["ID"]: r["_new"] for r in found.collect()}

    def key(pred, i):
        return pred is not None, pred or 0.0, i

    obs = sorted((key(p, i), p, i, y) for i, y, p, m in rows if not m)
    for i, _, p, m in rows:
        if m:
            b = sum(o[0] < key(p, i) for o in obs)
            ranked = sorted(range(max(b - 5, 0), min(b + 5, len(obs))), key=lambda r: (
                (False, 0) if p is None or obs[r][1] is None else (True, abs(obs[r][1] - p)), b - r if r < b else r - b + 1, obs[r][2]))
            near = ranked[:5]
            assert got[i] == obs[near[py_mix(i, 13) % len(near)]][3], i
    assert set(got) == {r[0] for r in rows if r[3]}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
    none = chained.pmm_fill(df.where("_m_y"), "y", "ID", "_m_y")
    assert none.where("_new is not null").count() == 0 and none.count() == len(got) + 1


def test_a_visit_stages_only_the_rows_it_fills(spark, monkeypatch):
    """a visit writes the rows that miss its column; the others stay as their own latest visit left them."""
    rnd = random.Random(6)
    rows = [(i, *(None if rnd.random() < 0.2 else rnd.gauss(0, 1) for _ in range(2)), rnd.gauss(0, 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "ID long, a double, b double, c double")
    written, stage = [], chained.stage

    def noted(frame, name):
        out = stage(frame, name)
        written.append(out)
        return out

    monkeypatch.setattr(chained, "stage", noted)
    filled, _ = chained.chained_impute(df, ["a", "b"], ["a", "b", "c"], m=2, maxit=2, seed=5)
    visits = [w for w in written if "_old" in w.columns]
    gone = {c: {r[0] for r in rows if r[j] is None} for j, c in ((1, "a"), (2, "b"))}
    assert [w.count() for w in visits] == [len(gone[c]) for _ in range(4) for c in "ab"]
    last = [{r["ID"]: r for r in w.collect()} for w in (visits[2], visits[3], visits[6], visits[7])]
    out = {r["ID"]: r for r in filled.collect()}
    for c, parts in (("a", last[0::2]), ("b", last[1::2])):
        assert all(abs(out[i][c] - (parts[0][i][c] + parts[1][i][c]) / 2) < 1e-12 for i in gone[c])
    assert all(v[i]["a"] == w[i]["a"] for v, w in (last[:2], last[2:]) for i in gone["a"] & gone["b"])
