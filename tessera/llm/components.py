"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.staging import stage


def _with_least(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with ``m``, the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").withColumn("m", F.least("u", "m"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _mark(edges: DataFrame) -> tuple:
    """Tells two sets of distinct edges apart."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges (u, v)``; the component
    is its least node. Loops, repeated edges and both directions are allowed,
    null ends are ignored. A star of any size is handled row by row: hubs are
    never gathered in one task. Each round is written to the shared folder."""
    now = stage(edges.where("u is not null and v is not null and u <> v")
                .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    nodes = now.select(F.col("u").alias("node")).union(now.select("v")).distinct()
    seen, mark = None, _mark(now)
    while mark != seen:
        seen = mark
        large = _with_least(_both(now)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .where("u <> v").distinct()
        small = _with_least(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        now = stage(small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                    .union(small.select("u", "m")).where("u <> v").distinct(), "edges")
        mark = _mark(now)
    # now every edge leads to the least node of its component
    return nodes.join(now.withColumnRenamed("u", "node"), "node", "left") \
        .select("node", F.coalesce("v", "node").alias("component"))
