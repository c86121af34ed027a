"""Optimal length buckets and token-budget batches.

Sequences are padded to the upper bound of their length bucket. One global
histogram of lengths (at most ``max_len`` rows) is what the bucket bounds
depend on; a dynamic program over it finds the bounds with the least total
padding. Inside each bucket, batches hold as many sequences as the token
budget allows at the bucket's padded length.

A bucket may hold any share of the rows, so it is dealt into shards of about
``shard_rows`` rows by a hash of the sequence, and batches are numbered inside
a shard: each shard ends with at most one batch that isn't full.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.staging import stage

# Words are what lies between spaces and the control characters 9 to 13.
WORD = "[^ \\t-\\r]+"


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def best_bounds(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper bounds (ascending, the last is the greatest length) of at most
    ``buckets`` length buckets with the least total padding. Bounds are
    observed lengths. Among equal costs, fewer buckets win, then the smaller
    lower neighbour bound, from the top down."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    m = len(lengths)
    if not m:
        return []
    counts = np.array([histogram[int(x)] for x in lengths], dtype=np.int64)
    n = np.concatenate([[0], np.cumsum(counts)])
    tokens = np.concatenate([[0], np.cumsum(counts * lengths)])
    k = min(buckets, m)
    far = np.iinfo(np.int64).max // 2
    # best[b, j]: least padding of the j shortest lengths in b buckets
    best = np.full((k + 1, m + 1), far, dtype=np.int64)
    best[0, 0] = 0
    cut = np.zeros((k + 1, m + 1), dtype=np.int64)
    for j in range(1, m + 1):
        last = lengths[j - 1] * (n[j] - n[:j]) - (tokens[j] - tokens[:j])  # bucket of lengths i+1..j
        total = best[:-1, :j] + last
        cut[1:, j] = total.argmin(axis=1)
        best[1:, j] = total.min(axis=1)
    b, j, bounds = int(best[:, m].argmin()), m, []
    while j:
        bounds.append(int(lengths[j - 1]))
        j, b = int(cut[b, j]), b - 1
    return bounds[::-1]


def pack(docs: DataFrame, length: Column, id_col: str = "doc_id", max_len: int = 4096, buckets: int = 16,
         budget: int = 65536, shard_rows: int = 5000) -> DataFrame:
    """Lay every document out in padded batches.

    A document of more than ``max_len`` tokens is cut into consecutive pieces
    of ``max_len`` (the last is shorter); nothing is dropped. Returns one row
    per piece: ``id_col``, ``piece`` (from 0), ``start`` and ``n_tokens`` (long,
    the piece's token range), ``bucket_len`` (its padded length), ``shard``,
    ``batch`` (number within bucket and shard), ``slot`` (place in the batch)
    and ``padding``. Each batch has at most ``budget`` padded tokens, or one
    sequence where a single one is longer than the budget. A document without
    tokens (null or empty) gives one row with ``n_tokens`` 0 and null bucket,
    shard, batch, slot and padding. Repeated rows are placed each for itself;
    null ids are allowed. Other columns of ``docs`` are not read beyond what
    ``length`` needs. Batch members are in hash order of (id, piece), so the
    result does not depend on the partitioning.
    """
    sized = docs.select(F.col(id_col).alias("id"), F.coalesce(length, F.lit(0)).cast("long").alias("n"))
    first = F.explode(F.sequence(F.lit(0).cast("long"),
                                 F.greatest(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / max_len))))
    # narrow and written once: the texts are read and counted a single time
    pieces = stage(sized.select("id", "n", first.alias("piece")).select(
        "id", "piece", (F.col("piece") * max_len).alias("start"),
        F.least(F.lit(max_len).cast("long"), F.col("n") - F.col("piece") * max_len).alias("n_tokens")), "pieces")
    histogram = {r["n_tokens"]: r["c"] for r in  # at most max_len rows
                 pieces.where("n_tokens > 0").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("c")).collect()}
    bounds = best_bounds(histogram, buckets)
    bucket = shards = F.lit(None).cast("long")
    low = 0
    for bound in bounds:
        rows = sum(c for n, c in histogram.items() if low < n <= bound)
        inside = F.col("n_tokens").between(low + 1, bound)
        bucket = F.when(inside, F.lit(bound).cast("long")).otherwise(bucket)
        shards = F.when(inside, F.lit(-(-rows // shard_rows)).cast("long")).otherwise(shards)
        low = bound
    laid = pieces.withColumn("bucket_len", bucket).withColumn("h", F.xxhash64("id", "piece")) \
        .withColumn("shard", F.pmod("h", shards))
    place = F.row_number().over(Window.partitionBy("bucket_len", "shard").orderBy("h", "id", "piece")) - 1
    room = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col("bucket_len")))
    packed = laid.where("n_tokens > 0").withColumn("place", place).select(
        F.col("id").alias(id_col), "piece", "start", "n_tokens", "bucket_len", "shard",
        F.floor(F.col("place") / room).alias("batch"), F.pmod(F.col("place"), room).cast("long").alias("slot"),
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"))
    none = F.lit(None).cast("long")
    empty = pieces.where("n_tokens <= 0").select(
        F.col("id").alias(id_col), "piece", "start", F.lit(0).cast("long").alias("n_tokens"),
        *[none.alias(c) for c in ("bucket_len", "shard", "batch", "slot", "padding")])
    return packed.unionByName(empty)
