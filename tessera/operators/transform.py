"""Numeric transforms.

Fits are single aggregates whose results are a few scalars per column
(min/max, a lambda), kept on the driver and inlined as literals; applying
them is a projection inside whole-stage codegen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import exprs as X

# Fixed grid of Yeo-Johnson lambdas searched by maximum likelihood: -2..2 by 0.1.
YJ_GRID = [round(-2.0 + 0.1 * i, 1) for i in range(41)]


def add_special_log(df: DataFrame, cols: Sequence[str], prefix: str = "Ts_") -> DataFrame:
    """``Ts_<c>``."""
    return df.select("*", *[X.special_log(c).alias(f"{prefix}{c}") for c in cols])


def add_log1p(df: DataFrame, cols: Sequence[str], prefix: str = "Tl_") -> DataFrame:
    """``Tl_<c>`` = log(1 + x)."""
    return df.select("*", *[X.log1p_guarded(c).alias(f"{prefix}{c}") for c in cols])


def yeo_johnson_profile(df: DataFrame, cols: Sequence[str], grid: Sequence[float] = YJ_GRID,
                        shift_min: bool = False) -> dict[str, list[tuple[float, float]]]:
    """Profile log-likelihood of the Yeo-Johnson lambda on a fixed grid:
    ll(l) = -n/2 log(var_pop(yj(x, l))) + (l - 1) sum(sign(x) log(1 + |x|)).

    One pass for all columns and lambdas: each task transforms its columns in
    Arrow batches and emits one row of moments for each (column, lambda), so
    cells are not multiplied by the grid. ``shift_min`` first shifts each
    column by its minimum (x - min)."""
    cols, grid = list(cols), [float(v) for v in grid]
    x = df.select(*[F.col(c).cast("double").alias(f"c{j}") for j, c in enumerate(cols)])
    if shift_min:
        mins = x.agg(*[F.min(c).alias(c) for c in x.columns]).first()
        x = x.select(*[(F.col(c) - F.lit(mins[c] or 0.0)).alias(c) for c in x.columns])

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, logs = np.zeros(len(cols), dtype=np.int64), np.zeros(len(cols))
        mean, m2 = np.zeros((len(cols), len(grid))), np.zeros((len(cols), len(grid)))
        for batch in batches:
            for j in range(len(cols)):
                v = batch.column(j).drop_null().to_numpy(zero_copy_only=False)
                if not len(v):
                    continue
                log, up = np.log1p(np.abs(v)), v >= 0
                logs[j] += (np.sign(v) * log).sum()
                for k, lam in enumerate(grid):
                    p = np.where(up, lam, 2.0 - lam)
                    y = np.where(p == 0, log, np.expm1(p * log) / np.where(p == 0, 1.0, p)) * np.where(up, 1.0, -1.0)
                    own, total = y.mean(), n[j] + len(v)
                    m2[j, k] += ((y - own) ** 2).sum() + (own - mean[j, k]) ** 2 * n[j] * len(v) / total
                    mean[j, k] += (own - mean[j, k]) * len(v) / total
                n[j] += len(v)
        j, k = (i.ravel() for i in np.indices(mean.shape))
        yield pa.RecordBatch.from_arrays(
            [pa.array(i) for i in (j.astype(np.int32), k.astype(np.int32), n[j], logs[j], mean[j, k], m2[j, k])],
            names=["j", "k", "n", "s", "mean", "m2"])

    parts = x.mapInArrow(moments, "j int, k int, n long, s double, mean double, m2 double").where("n > 0")
    rows = parts.groupBy("j", "k").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("m2").alias("m2"),
        F.sum(F.col("n") * F.col("mean")).alias("t"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("q")).collect()
    got = {(r["j"], r["k"]): r for r in rows}  # columns x grid
    out = {}
    for j, c in enumerate(cols):
        prof = []
        for k, lam in enumerate(grid):
            r = got.get((j, k))
            v = (r["m2"] + max(0.0, r["q"] - r["t"] * r["t"] / r["n"])) / r["n"] if r else 0.0
            good = v > 0 and math.isfinite(v)
            prof.append((lam, -0.5 * r["n"] * math.log(v) + (lam - 1.0) * r["s"] if good else float("-inf")))
        out[c] = prof
    return out


def fit_yeo_johnson(df: DataFrame, cols: Sequence[str], grid: Sequence[float] = YJ_GRID,
                    shift_min: bool = False, step: float | None = None) -> dict[str, float]:
    """T3 fit: lambda maximising the profile likelihood on the grid (first
    maximum on ties). With ``step`` a second pass searches the neighbourhood of
    each maximum (0.1 to either side) in steps of that size."""

    def best(profile: list[tuple[float, float]]) -> float:
        return max(profile, key=lambda t: (t[1], -t[0]))[0]

    found = {c: best(p) for c, p in yeo_johnson_profile(df, cols, grid, shift_min).items()}
    if step:
        around = round(0.1 / step)
        for c in cols:
            fine = [found[c] + i * step for i in range(-around, around + 1)]
            found[c] = best(yeo_johnson_profile(df, [c], fine, shift_min)[c])
    return found


def add_yeo_johnson(df: DataFrame, cols: Sequence[str], lambdas: dict[str, float] | None = None,
                    prefix: str = "Tyj_", fit_on: DataFrame | None = None, step: float | None = None) -> DataFrame:
    """``Tyj_<c>`` with lambdas fitted on ``fit_on`` (default ``df``), on
    the grid or, with ``step``, as finely as that."""
    lambdas = lambdas or fit_yeo_johnson(fit_on if fit_on is not None else df, cols, step=step)
    return df.select("*", *[X.yeo_johnson(c, lambdas[c]).alias(f"{prefix}{c}") for c in cols])


def fit_ranges(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float | None, float | None]]:
    r = df.agg(*[F.min(F.col(c).cast("double")).alias(f"a{i}") for i, c in enumerate(cols)],
               *[F.max(F.col(c).cast("double")).alias(f"b{i}") for i, c in enumerate(cols)]).first()
    return {c: (r[f"a{i}"], r[f"b{i}"]) for i, c in enumerate(cols)}


def range_scale(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None,
                ranges: dict | None = None) -> DataFrame:
    """T4: (x - min) / (max - min) in place; the range is fitted on
    ``fit_on`` (default: all rows of ``df``); a constant column becomes null."""
    ranges = ranges or fit_ranges(fit_on if fit_on is not None else df, cols)
    cs = set(cols)
    return df.select(*[X.min_max_scale(c, *ranges[c]).alias(c) if c in cs else F.col(c)
                       for c in df.columns])


def transform_diagnostics(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """T6 (re-aimed interactive picker): per column, skewness of the shifted
    raw values (x - min), of log(1 + x - min) and of Yeo-Johnson(x - min)
    with the fitted lambda; ``choice`` is the candidate with the smallest
    absolute skewness ('rescale', 'log(1+x)', 'YeoJohnson')."""
    spark = df.sparkSession
    lams = fit_yeo_johnson(df, cols, shift_min=True)
    mins = df.agg(*[F.min(F.col(c).cast("double")).alias(c) for c in cols]).first()
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double") - F.lit(mins[c] if mins[c] is not None else 0.0)
        aggs += [F.skewness(x).alias(f"r{i}"), F.skewness(F.log1p(x)).alias(f"l{i}"),
                 F.skewness(X.yeo_johnson(x, lams[c])).alias(f"y{i}")]
    r = df.agg(*aggs).first()
    rows = []
    for i, c in enumerate(cols):
        cand = [("rescale", r[f"r{i}"]), ("log(1+x)", r[f"l{i}"]), ("YeoJohnson", r[f"y{i}"])]
        valid = [(n, v) for n, v in cand if v is not None]
        choice = min(valid, key=lambda t: abs(t[1]))[0] if valid else "rescale"
        rows.append((c, float(lams[c]), r[f"r{i}"], r[f"l{i}"], r[f"y{i}"], choice))
    return spark.createDataFrame(rows, "column string, lambda double, skew_raw double, "
                                       "skew_log double, skew_yj double, choice string")
