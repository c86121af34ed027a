"""Profiling and aggregation.

Results are long tables (column, stat, value) so that any number of columns
gives the same schema. Every statistic is one distributed aggregate with a
map-side partial combine; wide frames are unpivoted inside the map stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import exprs as X
from tessera.operators.ranking import exact_quantiles, long_numeric

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)

# Statistic names of the six-number summary and moment report.
SUMMARY_STATS = ["Min.", "1st Qu.", "Median", "Mean", "3rd Qu.", "Max.", "NA's",
                 "skewness", "kurtosis", "jarque-brera"]


def column_class(dt: T.DataType) -> str:
    """R-like class name of a Spark type."""
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(dt, NUMERIC_TYPES):
        return "numeric"
    if isinstance(dt, T.StringType):
        return "character"
    if isinstance(dt, T.BooleanType):
        return "logical"
    return dt.simpleString()


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


# ---------------------------------------------------------------- A1
def label_counts(df: DataFrame, label_col: str = "target") -> DataFrame:
    """A1: (level, n, share); the null label is a level; share is over all rows.

    The grouped counts are staged once; the total is one scalar read from
    them, so no window or group ever holds all levels in one task."""
    from tessera.sources.staging import stage
    g = stage(df.groupBy(F.col(label_col).cast("string").alias("level")).agg(
        F.count(F.lit(1)).alias("n")), "label-counts")
    total = g.agg(F.sum("n")).first()[0] or 0
    return g.select("level", "n", (F.col("n") / F.lit(float(total))).alias("share"))


# ---------------------------------------------------------------- A3, A13
def column_nulls(df: DataFrame, cols: Sequence[str] | None = None, wide_max: int = 200) -> DataFrame:
    """A3: (column, col_class, n_null, null_share) for every listed column.

    Up to ``wide_max`` columns: one aggregate with a null count per column.
    Wider tables: the null flags are unpivoted inside the map stage and
    counted per column with partial aggregation, still in one scan."""
    cols = list(cols) if cols is not None else df.columns
    classes = {f.name: column_class(f.dataType) for f in df.schema.fields}
    if len(cols) <= wide_max:
        agg = df.agg(F.count(F.lit(1)).alias("_n"),
                     *[F.count_if(F.col(c).isNull()).alias(f"_z{j}") for j, c in enumerate(cols)])
        items = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(classes[c]).alias("col_class"),
                                   F.col(f"_z{j}").alias("n_null")) for j, c in enumerate(cols)])
        out = agg.select("_n", F.inline(items))
    else:
        items = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(classes[c]).alias("col_class"),
                                   F.col(c).isNull().cast("long").alias("z")) for c in cols])
        out = (df.select(F.inline(items)).groupBy("column", "col_class")
               .agg(F.count(F.lit(1)).alias("_n"), F.sum("z").alias("n_null")))
    return out.select("column", "col_class", "n_null",
                      (F.col("n_null") / F.col("_n")).alias("null_share"))


def columns_with_nulls(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """The columns that contain at least one null."""
    return column_nulls(df, cols).where(F.col("n_null") > 0).select("column", "n_null")


# ---------------------------------------------------------------- A4, A15
def _long_levels(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level"))
                      for c in cols])
    return df.select(*keep, F.inline(items))


def level_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A4: (column, n_levels); null is not a level, the empty string is."""
    lv = _long_levels(df, cols).where(F.col("level").isNotNull()).distinct()
    got = lv.groupBy("column").agg(F.count(F.lit(1)).alias("n_levels"))
    grid = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return grid.join(got, "column", "left").select(
        "column", F.coalesce("n_levels", F.lit(0)).cast("long").alias("n_levels"))


def unseen_level_report(df: DataFrame, cols: Sequence[str], label_col: str = "target") -> DataFrame:
    """Levels seen in labelled rows against all levels, per column (zeros
    for a column without any level)."""
    lv = (_long_levels(df, cols, keep=[label_col]).where(F.col("level").isNotNull())
          .groupBy("column", "level")
          .agg(F.max(F.col(label_col).isNotNull().cast("int")).alias("in_train")))
    got = lv.groupBy("column").agg(F.sum("in_train").alias("tr"), F.count(F.lit(1)).alias("tot"))
    grid = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    zero = F.lit(0)
    return grid.join(got, "column", "left").select(
        "column", F.coalesce("tr", zero).cast("long").alias("levels_train"),
        F.coalesce("tot", zero).cast("long").alias("levels_total"),
        (F.coalesce("tot", zero) - F.coalesce("tr", zero)).cast("long").alias("levels_unseen"))


# ---------------------------------------------------------------- A2, A5-A8
def numeric_summary(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Min, quartiles, Mean, Max, null count, population skewness,
    plain (non-excess) kurtosis and the Jarque-Bera p-value, per column, as
    (column, stat, value)."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    long = long_numeric(df, cols, drop_nulls=False)
    mom = long.groupBy("column").agg(
        F.min("value").alias("mn"), F.max("value").alias("mx"), F.avg("value").alias("mean"),
        F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("nulls"),
        F.skewness("value").alias("skew"), (F.kurtosis("value") + F.lit(3.0)).alias("kurt"))
    jb = (F.col("n") / 6.0) * (F.pow("skew", 2) + F.pow(F.col("kurt") - 3.0, 2) / 4.0)
    mom = mom.withColumn("jb_p", F.exp(-jb / 2.0))
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    qw = q.groupBy("column").agg(
        F.max(F.when(F.col("prob") == 0.25, F.col("value"))).alias("q1"),
        F.max(F.when(F.col("prob") == 0.5, F.col("value"))).alias("med"),
        F.max(F.when(F.col("prob") == 0.75, F.col("value"))).alias("q3"))
    w = mom.join(qw, "column", "left")
    names = dict(zip(SUMMARY_STATS, ["mn", "q1", "med", "mean", "q3", "mx", "nulls",
                                     "skew", "kurt", "jb_p"]))
    items = F.array(*[F.struct(F.lit(s).alias("stat"), F.col(v).cast("double").alias("value"))
                      for s, v in names.items()])
    return w.select("column", F.inline(items))


def target_summary(df: DataFrame, label_col: str = "target") -> DataFrame:
    """A2: the numeric summary of a continuous label."""
    return numeric_summary(df, [label_col])


# ---------------------------------------------------------------- A9-A11
def add_row_shares(df: DataFrame, id_col: str = "ID", label_col: str = "target",
                   factor_cols: Sequence[str] | None = None, include_label: bool = False
                   ) -> DataFrame:
    """NAfreq, NAfacfreq, Below0freq per row.

    The denominator of NAfreq and Below0freq is the number of feature columns
    (all but id and label). ``include_label=True`` also counts a null label in
    the numerator, as the reference does (which leaks train/test membership).
    """
    feats = [c for c in df.columns if c not in (id_col, label_col)]
    k = len(feats)
    facs = list(factor_cols) if factor_cols is not None else string_columns(df, [id_col, label_col])
    nums = [c for c in numeric_columns(df, [id_col, label_col]) if c not in facs]
    counted = feats + ([label_col] if include_label else [])
    return (df.withColumn("NAfreq", X.row_null_share(counted, k))
              .withColumn("NAfacfreq", X.row_null_share(facs))
              .withColumn("Below0freq", X.row_below_zero_share(nums, k)))


# ---------------------------------------------------------------- A12
def histogram(df: DataFrame, col: str, width: float | None = None, bins: int | None = None,
              origin: float | None = None) -> DataFrame:
    """(bin, lo, hi, n) with fixed ``width`` or ``bins`` equal bins over
    the range; bin k covers [origin + k*width, origin + (k+1)*width)."""
    x = F.col(col).cast("double")
    if width is None:
        r = df.agg(F.min(x).alias("a"), F.max(x).alias("b")).first()
        if r["a"] is None:
            return df.sparkSession.createDataFrame([], "bin long, lo double, hi double, n long")
        width = (r["b"] - r["a"]) / float(bins or 15) or 1.0
        origin = r["a"] if origin is None else origin
    origin = 0.0 if origin is None else origin
    b = F.floor((x - F.lit(origin)) / F.lit(width)).cast("long")
    g = df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("bin", (F.lit(origin) + F.col("bin") * F.lit(width)).alias("lo"),
                    (F.lit(origin) + (F.col("bin") + 1) * F.lit(width)).alias("hi"), "n")


# ---------------------------------------------------------------- A14
def null_positions(df: DataFrame, cols: Sequence[str], id_col: str = "ID") -> DataFrame:
    """(ID, column) for every null cell of the listed columns."""
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).isNull().alias("is_null"))
                      for c in cols])
    return df.select(id_col, F.inline(items)).where("is_null").select(id_col, "column")
