"""A third of all rows share one key: results stay exact and whole."""

import math

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import encode, folds
from tessera.operators.ranking import exact_quantiles


def skewed(spark, n=3000):
    return spark.range(0, n, numPartitions=6).select(
        F.col("id").alias("ID"),
        (F.col("id") % 2).cast("int").alias("target"),
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise((F.col("id") % 97).cast("string")).alias("c"),
        F.when(F.col("id") % 3 == 0, F.lit(1.0)).otherwise(F.col("id").cast("double")).alias("x"))


def test_hot_level_impact_salted_equals_broadcast(spark):
    df = skewed(spark)
    a = {r["ID"]: r["Imp_c"] for r in encode.impact_encode(df, ["c"], row_key="ID").collect()}
    b = {r["ID"]: r["Imp_c"] for r in encode.impact_encode(df, ["c"], row_key="ID", broadcast_max_rows=0,
                                                           salt=8).collect()}
    assert len(a) == 3000 and a == b
    hot = [r for r in range(0, 3000, 3)]
    p = 0.5
    expect = (sum(i % 2 for i in hot) + p) / (len(hot) + 1)
    assert math.isclose(a[0], expect)


def test_hot_value_quantiles(spark):
    df = skewed(spark)
    q = {r["prob"]: r["value"] for r in exact_quantiles(df, ["x"], [0.1, 0.33, 0.5, 0.9]).collect()}
    xs = np.array([1.0 if i % 3 == 0 else float(i) for i in range(3000)])
    for p, v in q.items():
        assert math.isclose(v, float(np.percentile(xs, p * 100)), rel_tol=1e-12)


def test_hot_level_frequency_and_folds(spark):
    df = skewed(spark)
    fr = {r["ID"]: r["Rfreq_c"] for r in encode.frequency_encode(df, ["c"], buckets=[5], row_key="ID",
                                                                  broadcast_max_rows=0, salt=4).collect()}
    assert len(fr) == 3000 and math.isclose(fr[0], 1000 / 3000)
    f = folds.stratified_folds(df, k=5, repeats=1).collect()
    assert sorted(r["ID"] for r in f) == list(range(3000))


def test_encoders_invariant_under_repartition(spark):
    df = skewed(spark, 1200)
    a = encode.frequency_encode(encode.impact_encode(df, ["c"], row_key="ID"), ["c"], row_key="ID")
    b = encode.frequency_encode(encode.impact_encode(df.repartition(5, "x"), ["c"], row_key="ID"), ["c"],
                                row_key="ID")
    key = ["ID", "Imp_c", "Rfreq_c", "Ffreq_c"]
    assert sorted(map(tuple, a.select(*key).collect())) == sorted(map(tuple, b.select(*key).collect()))
    la = {r["ID"]: r["c"] for r in encode.label_encode(df, ["c"]).collect()}
    lb = {r["ID"]: r["c"] for r in encode.label_encode(df.repartition(3), ["c"]).collect()}
    assert la == lb
