"""V4, V5, V7: folds and samples with exact sizes, computed distributed.

Positions come from ``ranking.cumulative_rank`` (range partitioning and
per-partition offsets), never from an unpartitioned window, and the order
inside a stratum is a reproducible hash of the row id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.hashing import mix
from tessera.operators.ranking import cumulative_rank


def contiguous_kfold(df: DataFrame, k: int = 3, id_col: str = "ID", out_col: str = "fold"
                     ) -> DataFrame:
    """V4: unshuffled K-fold in ``id_col`` order; the first n mod k folds hold
    one row more. Folds are 1..k."""
    idx = cumulative_rank(df, [], [id_col], lo_col="_pos", hi_col="_ph")
    n = int(idx.agg(F.max("_ph")).first()[0] or 0)  # read from the ranked checkpoint
    idx = idx.drop("_ph")
    q, r = divmod(n, k)
    big = r * (q + 1)
    pos = F.col("_pos")
    if q == 0:
        fold = pos + 1
    else:
        fold = F.when(pos < big, F.floor(pos / (q + 1))).otherwise(
            F.lit(r) + F.floor((pos - F.lit(big)) / F.lit(q))) + 1
    return idx.withColumn(out_col, fold.cast("int")).drop("_pos")


def stratified_folds(df: DataFrame, k: int = 5, repeats: int = 1, label_col: str = "target",
                     id_col: str = "ID", seed: int = 433) -> DataFrame:
    """V5: repeated stratified K-fold over the labelled rows.

    Returns (id, label, rep, fold, fold_name) with ``fold_name`` =
    'Fold<i>.Rep<j>' naming the held-out part; inside every (rep, label)
    stratum, rows are ordered by a hash of (id, seed, rep) and dealt round
    robin, so fold sizes differ by at most one per stratum.
    """
    lab = df.where(F.col(label_col).isNotNull()).select(id_col, label_col)
    reps = lab.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    salt = F.col("rep") * F.lit(1000003) + F.lit(int(seed))
    # the salt varies per row here, so mix on (id + rep offset) keeps SQL parity
    keyed = reps.withColumn("_h", mix(F.col(id_col) + salt, 0))
    ranked = cumulative_rank(keyed, ["rep", label_col], ["_h", id_col], lo_col="_pos",
                             hi_col="_ph").drop("_ph")
    fold = (F.pmod(F.col("_pos"), F.lit(k)) + 1).cast("int")
    return ranked.select(
        id_col, label_col, F.col("rep").cast("int").alias("rep"), fold.alias("fold"),
        F.concat(F.lit("Fold"), fold.cast("string"), F.lit(".Rep"), F.col("rep").cast("string"))
        .alias("fold_name"))


def stratified_sample(df: DataFrame, fraction: float, label_col: str = "target",
                      id_col: str = "ID", seed: int = 123) -> DataFrame:
    """V7: exactly ceil(fraction * n_s) labelled rows of every label stratum s,
    chosen by a hash order of the id."""
    lab = df.where(F.col(label_col).isNotNull())
    keyed = lab.withColumn("_h", mix(F.col(id_col), seed))
    ranked = cumulative_rank(keyed, [label_col], ["_h", id_col], lo_col="_pos", hi_col="_ph")
    # class sizes from the ranked checkpoint (partial aggregation; one row per class)
    sizes = ranked.groupBy(label_col).agg(F.max("_ph").alias("_ns"))
    j = ranked.join(sizes, label_col)  # AQE broadcasts it from runtime size
    keep = F.col("_pos") < F.ceil(F.col("_ns") * F.lit(float(fraction)))
    return j.where(keep).drop("_h", "_pos", "_ph", "_ns")
