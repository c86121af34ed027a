"""Joins, ordering, top-k and predictor masks.

Association and importance tables have one row per column (pair), so their
windows are bounded by the number of columns, never by the number of rows.
Row-level joins are equi-joins on the row key planned by Catalyst/AQE.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


# ---------------------------------------------------------------- J1, J2, J4, J10
def join_on_id(a: DataFrame, b: DataFrame, id_col: str = "ID", label_col: str = "target"
               ) -> DataFrame:
    """Inner equi-join on the id; ``b``'s copy of the label is dropped."""
    return a.join(b.drop(label_col) if label_col in b.columns else b, id_col, "inner")


def bind_columns(a: DataFrame, b: DataFrame, key: str = "ID") -> DataFrame:
    """Column bind of two frames of the same rows, matched on the key
    (Spark rows have no position)."""
    dup = [c for c in b.columns if c in a.columns and c != key]
    return a.join(b.drop(*dup), key, "inner")


def sort_by_id(df: DataFrame, id_col: str = "ID") -> DataFrame:
    """Global order by id (range-partitioned sort)."""
    return df.orderBy(id_col)


def first_n(df: DataFrame, n: int = 1000, id_col: str = "ID") -> DataFrame:
    """The first ``n`` rows in id order (distributed top-k)."""
    return df.orderBy(id_col).limit(n)


# ---------------------------------------------------------------- J5, J6
def order_desc(df: DataFrame, value_col: str, name_col: str = "feature") -> DataFrame:
    """Descending by value, ties by name."""
    return df.orderBy(F.desc(value_col), F.asc(name_col))


def rank_table(df: DataFrame, value_col: str, name_col: str = "feature", rank_col: str = "rank"
               ) -> DataFrame:
    """1-based rank by value descending (table of features: bounded size)."""
    w = Window.orderBy(F.desc(value_col), F.asc(name_col))
    return df.withColumn(rank_col, F.row_number().over(w))


def top_k(df: DataFrame, value_col: str, k: int, name_col: str = "feature") -> DataFrame:
    """The k best rows of a feature table."""
    return rank_table(df, value_col, name_col).where(F.col("rank") <= k)


def rank_slice(df: DataFrame, value_col: str, lo: int, hi: int, name_col: str = "feature",
               pattern: str | None = None) -> DataFrame:
    """Ranks lo..hi (1-based, inclusive), optionally filtered by a name regex."""
    r = rank_table(df, value_col, name_col).where(F.col("rank").between(lo, hi))
    return r.where(F.col(name_col).rlike(pattern)) if pattern else r


# ---------------------------------------------------------------- J7, J8, J9, J11
def top_n_predictors(assoc: DataFrame, n: int = 25) -> DataFrame:
    """Per target column (col_a), the n other columns with the largest
    absolute association; unknown (null) associations rank last. Output
    (target_col, predictor_col, stat, rank)."""
    w = Window.partitionBy("col_a").orderBy(F.abs("stat").desc_nulls_last(), F.asc("col_b"))
    r = assoc.where(F.col("col_a") != F.col("col_b")).withColumn("rank", F.row_number().over(w))
    return r.where(F.col("rank") <= n).select(
        F.col("col_a").alias("target_col"), F.col("col_b").alias("predictor_col"), "stat", "rank")


def threshold_predictors(assoc: DataFrame, target: str | None = None, threshold: float = 0.05
                         ) -> DataFrame:
    """(target_col, predictor_col) pairs whose association exceeds the threshold."""
    a = assoc.where(F.col("stat") > F.lit(threshold)) if target is None else \
        assoc.where((F.col("col_a") == target) & (F.col("stat") > F.lit(threshold)))
    return a.select(F.col("col_a").alias("target_col"), F.col("col_b").alias("predictor_col"), "stat")


def exclude_own_transforms(mask: DataFrame, prefixes: Sequence[str] = ("Ts_", "Tyj_", "Tl_")
                           ) -> DataFrame:
    """Remove ``<prefix><c>`` as a predictor of ``c`` (left-anti join)."""
    own = mask.select("target_col").distinct().select(
        "target_col", F.explode(F.array(*[F.concat(F.lit(p), F.col("target_col")) for p in prefixes]))
        .alias("predictor_col"))
    return mask.join(own, ["target_col", "predictor_col"], "left_anti")


def all_pairs_mask(spark, columns: Sequence[str]) -> DataFrame:
    """Default predictor mask: every other column predicts a column (a table
    of column names, p x (p - 1) rows)."""
    cols = list(columns)
    return spark.createDataFrame([(a, b) for a in cols for b in cols if a != b],
                                 "target_col string, predictor_col string")


def mask_overlay(default_mask: DataFrame, top_mask: DataFrame) -> DataFrame:
    """Where the top-N mask knows a target column, its predictor list
    replaces the default one; other targets keep the default."""
    known = top_mask.select("target_col").distinct()
    keep_default = default_mask.join(known, "target_col", "left_anti").select("target_col", "predictor_col")
    return keep_default.unionByName(top_mask.select("target_col", "predictor_col"))


# ---------------------------------------------------------------- M2, M3
def average_importance(imps: DataFrame, feature_col: str = "feature", gain_col: str = "gain"
                       ) -> DataFrame:
    """M2: mean gain per feature over folds (joined by name, a feature absent
    from a fold counts as 0 gain there)."""
    nf = imps.select(F.countDistinct("fold").alias("nf")).first()["nf"]
    g = imps.groupBy(feature_col).agg(F.sum(gain_col).alias("_s"))
    return g.select(feature_col, (F.col("_s") / F.lit(float(nf))).alias("average")) \
        .orderBy(F.desc("average"), F.asc(feature_col))


def prune_features(df: DataFrame, drop: Sequence[str] = (), patterns: Sequence[str] = (),
                   keep: Sequence[str] = ("ID", "target")) -> DataFrame:
    """M3: drop fixed names and every column matching one of the regexes."""
    rx = [re.compile(p) for p in patterns]
    gone = {c for c in df.columns if c in set(drop) or any(r.search(c) for r in rx)}
    return df.drop(*[c for c in gone if c not in keep])
