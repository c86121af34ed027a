import math

from pyspark.sql import functions as F

from tessera.operators import encode

ENC = [(1, 1, "a"), (2, 0, "a"), (3, 1, "b"), (4, None, "c"), (5, 0, None),
       (6, 1, None), (7, 0, "a"), (8, None, "a")]


def enc_tiny(spark):
    return spark.createDataFrame(ENC, "ID long, target int, c string")


def test_impact_worked_example(spark):
    df = enc_tiny(spark)
    model, na = encode.fit_impact(df, "c")
    m = {r["level"]: r["value"] for r in model.collect()}
    # labelled rows: 6, positives 3 -> p = 0.5
    assert math.isclose(m["a"], (1 + 0.5) / (3 + 1))
    assert math.isclose(m["b"], (1 + 0.5) / (1 + 1))
    assert "c" not in m  # level seen only in unlabelled rows
    # NA value: all labelled rows once more + the real null rows (2, one positive)
    assert math.isclose(na, (3 + 1 + 0.5) / (6 + 2 + 1))
    out = {r["ID"]: r["Imp_c"] for r in encode.impact_encode(df, ["c"]).collect()}
    assert math.isclose(out[4], na) and math.isclose(out[5], na)
    assert math.isclose(out[8], m["a"])


def test_impact_salted_path_equals_broadcast(spark):
    df = enc_tiny(spark)
    a = encode.impact_encode(df, ["c"]).orderBy("ID").collect()
    b = encode.impact_encode(df, ["c"], row_key="ID", broadcast_max_rows=0, salt=4).orderBy("ID").collect()
    assert [r["Imp_c"] for r in a] == [r["Imp_c"] for r in b]


def test_out_of_fold_excludes_own_fold(spark):
    df = enc_tiny(spark).withColumn("fold", (F.col("ID") % 2).cast("int"))
    o = {r["ID"]: r["Imp_c"] for r in encode.impact_encode_out_of_fold(df, "c", "fold").collect()}
    # ID 1 (fold 1, level a): other fold labelled rows: 2, 6 (IDs even) -> a: ID 2 (y=0)

    lab = [r for r in ENC if r[1] is not None]
    other = [r for r in lab if r[0] % 2 == 0]
    p = sum(r[1] for r in other) / len(other)
    a_rows = [r for r in other if r[2] == "a"]
    expect = (sum(r[1] for r in a_rows) + p) / (len(a_rows) + 1)
    assert math.isclose(o[1], expect)


def test_frequency_and_buckets(spark):
    df = enc_tiny(spark)
    out = {r["ID"]: r for r in encode.frequency_encode(df, ["c"], buckets=[3]).collect()}
    assert math.isclose(out[1]["Rfreq_c"], 4 / 8)
    assert math.isclose(out[5]["Rfreq_c"], 2 / 8)  # null share
    # counts: a 4, null 2, b 1, c 1 -> range 1..4 with 3 right-closed bins
    assert out[1]["Ffreq_c"] == "F_c_3"
    assert out[3]["Ffreq_c"] == "F_c_1"
    assert out[5]["Ffreq_c"] == "F_c_1"  # (2-1)*3/3 = 1


def test_one_hot_and_unseen(spark):
    df = enc_tiny(spark)
    out, levels = encode.one_hot(df, "c", max_levels=10)
    assert levels == ["a", "b", "c", "nan"]
    r5 = out.where("ID = 5").first()
    assert r5["c_nan"] == 1 and r5["c_a"] == 0
    test = spark.createDataFrame([(9, "z")], "ID long, c string")
    t, _ = encode.one_hot(test, "c", levels)
    assert sum(t.first()[f"c_{v}"] for v in levels) == 0


def test_nb_closed_form_matches_direct(spark):
    import numpy as np
    df = enc_tiny(spark)
    model, unseen = encode.fit_nb_impact(df, "c")
    m = {r["level"]: r["value"] for r in model.collect()}
    lab = [r for r in ENC if r[1] is not None]
    levels = sorted({(r[2] if r[2] is not None else "nan") for r in lab})
    X = np.array([[1.0 if (r[2] or "nan") == lv else 0.0 for lv in levels] for r in lab])
    y = np.array([r[1] for r in lab])
    logp = {}
    for k in (0, 1):
        Xk = X[y == k]
        th = (Xk.sum(0) + 1) / (len(Xk) + 2)
        logp[k] = (np.log(len(Xk) / len(y)), th)

    def post(x):
        s = [logp[k][0] + (x * np.log(logp[k][1]) + (1 - x) * np.log(1 - logp[k][1])).sum() for k in (0, 1)]
        return 1 / (1 + math.exp(s[0] - s[1]))
    for i, lv in enumerate(levels):
        x = np.zeros(len(levels))
        x[i] = 1
        assert math.isclose(m[lv], post(x), rel_tol=1e-12)
    assert math.isclose(unseen, post(np.zeros(len(levels))), rel_tol=1e-12)


def test_label_codes_first_and_alpha(spark):
    df = spark.createDataFrame([(3, "b"), (1, "c"), (2, "b"), (4, None), (5, "a")], "ID long, c string")
    first = {r["ID"]: r["c"] for r in encode.label_encode(df, ["c"], order="first").collect()}
    assert first == {1: 0, 2: 1, 3: 1, 4: -1, 5: 2}
    alpha = {r["ID"]: r["c"] for r in encode.label_encode(df, ["c"], order="alpha", missing=None, start=1).collect()}
    assert alpha == {1: 3, 2: 2, 3: 2, 4: None, 5: 1}


def test_chars_letters(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "A"), (4, "ZÉB")], "ID long, c string")
    out = {r["ID"]: r for r in encode.letter_counts(encode.explode_chars(df, ["c"], max_width=10)).collect()}
    assert out[1]["Len_c"] == 0 and out[1]["It_c_1"] == ""
    assert out[4]["Len_c"] == 3 and out[4]["It_c_2"] == "É" and out[4]["It_c_3"] == "B"
    assert out[3]["Nr_A"] == 2  # c and It_c_1 both equal 'A'


def test_data_dependent_widths_fail_loudly(spark):
    import pytest
    df = spark.createDataFrame([(i, str(i), "x" * (i + 1)) for i in range(20)], "ID long, c string, s string")
    with pytest.raises(ValueError):
        encode.one_hot(df, "c", levels=encode.one_hot_levels(df, "c", max_levels=5))
    with pytest.raises(ValueError):
        encode.explode_chars(df, ["s"], max_width=10)
