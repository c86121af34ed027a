"""Distributed ranks, global row numbers and exact quantiles.

An unpartitioned ``Window.orderBy`` (or a window per column over a
continuous column) moves every row of the group into one task. These helpers
compute the same numbers at scale:

1. range-partition the rows on (group, order) and sort each partition: one
   shuffle, every partition holds a contiguous, sorted key range;
2. number the rows of a partition as they come: for unit weights the row
   counter in ``monotonically_increasing_id``, for other weights a running sum
   over Arrow batches;
3. the (partition, group) totals form a table bounded by partitions x groups;
   a window over it gives each partition's offset, which is joined back.

The numbered rows are staged as Parquet before they are used twice. This is
required, not a precaution: two plans of the same range exchange may cut the
key range differently (the bounds come from a sample), also when a lost task
is recomputed. Reading both from one staged table makes the partition ids
agree, and later readers see only the columns they need.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import shuffle_partitions
from tessera.sources.staging import stage

# Offsets tables above this many rows are joined with a shuffle, not broadcast.
OFFSET_BROADCAST_ROWS = 2_000_000


def _cols(xs: Sequence[str | Column]) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def numbered(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str | Column],
             weight_col: str | None = None, num_partitions: int | None = None) -> DataFrame:
    """Rows in (group, order) ranges with ``_rk_pid`` (their range),
    ``_rk_w`` (their weight) and ``_rk_cum`` (the weight before them in their
    range). One shuffle; must be staged before it is used more than once."""
    n = num_partitions or shuffle_partitions(df.sparkSession)
    keys = [*_cols(group_cols), *_cols(order_cols)]
    w = F.col(weight_col).cast("long") if weight_col else F.lit(1).cast("long")
    laid = df.withColumn("_rk_w", w).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    if weight_col is None:
        # partition number in the upper bits, row counter in the lower 33
        cum = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        return laid.withColumn("_rk_cum", cum).withColumn("_rk_pid", F.spark_partition_id())

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            own = b.column(b.schema.get_field_index("_rk_w")).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.cumsum(own) + total
            total = int(upto[-1]) if len(upto) else total
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(upto - own, pa.int64())],
                                             names=[*b.schema.names, "_rk_cum"])

    schema = T.StructType([*laid.schema.fields, T.StructField("_rk_cum", T.LongType())])
    return laid.mapInArrow(running, schema).withColumn("_rk_pid", F.spark_partition_id())


def cumulative_rank(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str | Column],
                    weight_col: str | None = None, lo_col: str = "rank_lo",
                    hi_col: str = "rank_hi", num_partitions: int | None = None,
                    group_bound: int | None = None) -> DataFrame:
    """Add ``lo_col`` = total weight of the rows before this one in its group
    (order given by ``order_cols``) and ``hi_col`` = lo + own weight.

    With no ``weight_col`` every row weighs 1, so ``lo_col`` is the 0-based
    row number within the group. ``order_cols`` must order each group totally
    (append a unique key) for the numbering to be deterministic.
    ``group_bound`` (an upper bound on the number of groups known to the
    caller, e.g. the number of columns) proves the offsets table small
    without counting it; with no groups the bound is 1.
    """
    group_cols = list(group_cols)
    n = num_partitions or shuffle_partitions(df.sparkSession)
    local = stage(numbered(df, group_cols, order_cols, weight_col, n), "ranked")
    stats = local.groupBy("_rk_pid", *group_cols).agg(F.sum("_rk_w").alias("_rk_tot"), F.min("_rk_cum").alias("_rk_first"))
    before = (Window.partitionBy(*group_cols).orderBy("_rk_pid")
              .rowsBetween(Window.unboundedPreceding, -1))
    offs = stats.select(
        F.col("_rk_pid").alias("_rk_opid"),
        *[F.col(g).alias(f"_rk_g{i}") for i, g in enumerate(group_cols)],
        (F.coalesce(F.sum("_rk_tot").over(before), F.lit(0)) - F.col("_rk_first")).cast("long").alias("_rk_off"))
    bound = 1 if not group_cols else group_bound
    if bound is not None and n * bound <= OFFSET_BROADCAST_ROWS:
        offs = F.broadcast(offs)  # at most partitions x groups rows
    elif offs.count() <= OFFSET_BROADCAST_ROWS:
        offs = F.broadcast(offs)
    cond = F.col("_rk_pid") == F.col("_rk_opid")
    for i, g in enumerate(group_cols):
        cond = cond & F.col(g).eqNullSafe(F.col(f"_rk_g{i}"))
    joined = local.join(offs, cond, "inner")
    keep = [c for c in df.columns]
    return joined.select(
        *keep,
        (F.col("_rk_off") + F.col("_rk_cum")).alias(lo_col),
        (F.col("_rk_off") + F.col("_rk_cum") + F.col("_rk_w")).alias(hi_col),
    )


def row_index(df: DataFrame, order_cols: Sequence[str | Column], group_cols: Sequence[str] = (),
              out_col: str = "row_idx", **kw) -> DataFrame:
    """0-based position of each row in ``order_cols`` order (within groups)."""
    r = cumulative_rank(df, group_cols, order_cols, lo_col=out_col, hi_col="_rk_hi_drop", **kw)
    return r.drop("_rk_hi_drop")


def long_numeric(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (),
                 drop_nulls: bool = True) -> DataFrame:
    """Unpivot numeric columns to (column, value) rows, in the map stage."""
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                      for c in cols])
    out = df.select(*keep, F.inline(items))
    return out.where(F.col("value").isNotNull()) if drop_nulls else out


#: Rank error of the sketch that brackets a quantile is at most one in this many values.
SKETCH_ACCURACY = 2000


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Exact quantiles (linear interpolation between order statistics, the
    R type-7 definition) of every column: (column, prob, value).

    One aggregate brackets each quantile with ``percentile_approx`` at twice
    the sketch's rank error to either side; a second scan counts the values
    below each bracket and keeps those inside (about 0.4% of a column), which
    are reduced to (value, count), ranked with :func:`cumulative_rank` and
    looked up. Columns too short for the sketch's bound are bracketed by their
    whole range. ``df`` is read three times, so stage it if it is costly.
    """
    spark = df.sparkSession
    cols, probs = list(cols), [float(p) for p in probs]
    grid = spark.createDataFrame([(c, p) for c in cols for p in probs], "column string, prob double")
    x = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    margin = 2.0 / SKETCH_ACCURACY
    ends = [min(1.0, max(0.0, p + m)) for p in probs for m in (-margin, margin)]
    row = x.agg(*[F.struct(F.count(c).alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi"),
                           F.percentile_approx(c, ends, SKETCH_ACCURACY).alias("ends")).alias(f"s{j}")
                  for j, c in enumerate(cols)]).first()  # a few numbers a column
    brackets = {}
    for j, c in enumerate(cols):
        s = row[f"s{j}"]
        for i, p in enumerate(probs):
            if s["n"]:
                short = s["n"] < 4 * SKETCH_ACCURACY
                brackets[c, p] = (s["n"], *((s["lo"], s["hi"]) if short else s["ends"][2 * i:2 * i + 2]))
    if not brackets:
        return grid.withColumn("value", F.lit(None).cast("double"))
    keys = list(brackets)
    below = x.agg(*[F.count_if(F.col(c) < F.lit(brackets[c, p][1])).alias(f"b{k}")
                    for k, (c, p) in enumerate(keys)]).first()
    cells = x.select(F.inline(F.filter(
        F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).alias("value"), F.lit(brackets[c, p][1]).alias("lo"),
                           F.lit(brackets[c, p][2]).alias("hi")) for k, (c, p) in enumerate(keys)]),
        lambda t: (t["value"] >= t["lo"]) & (t["value"] <= t["hi"])))).groupBy("key", "value") \
        .agg(F.count(F.lit(1)).alias("cnt"))
    ranked = cumulative_rank(cells, ["key"], ["value"], weight_col="cnt", group_bound=len(keys))
    need = []
    for k, (c, p) in enumerate(keys):
        h = (brackets[c, p][0] - 1) * p
        need += [(k, c, p, h - int(h), which, r - below[f"b{k}"]) for which, r in enumerate((int(h), -int(-h // 1)))]
    # two rows for each column and probability
    need = F.broadcast(spark.createDataFrame(
        need, "n_key int, column string, prob double, share double, which int, r long"))
    hits = ranked.join(need, (F.col("key") == F.col("n_key")) & (F.col("r") >= F.col("rank_lo"))
                       & (F.col("r") < F.col("rank_hi")))
    vals = hits.groupBy("column", "prob", "share").agg(
        F.max(F.when(F.col("which") == 0, F.col("value"))).alias("v0"),
        F.max(F.when(F.col("which") == 1, F.col("value"))).alias("v1"))
    found = vals.select("column", "prob", (F.col("v0") + F.col("share") * (F.col("v1") - F.col("v0"))).alias("value"))
    return grid.join(found, ["column", "prob"], "left")
