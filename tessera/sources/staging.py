"""Staging: write an intermediate table once and read it back.

Iterative work (cross-validation folds, boosting rounds, repeated fits of a
pipeline) would otherwise recompute the whole lineage from the raw scans on
every pass. The table goes to the shared folder the cluster names in
``spark.checkpoint.dir`` (see ``session.ensure_checkpoint_dir``) as Parquet,
so later reads still prune columns and push filters, and a lost executor
never loses it (unlike a local checkpoint).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from tessera.session import ensure_checkpoint_dir


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
