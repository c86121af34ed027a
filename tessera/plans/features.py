"""Feature pipelines: the reference's scripts as one lazy Spark plan each.

    preprocess        typing, blank -> null, row shares           (P1, P3, P5, A9-A11)
    numeric_features  special log / log1p / Yeo-Johnson + scaling (T1-T5)
    factor_features   character items, letter counts, impact or
                      frequency coding gated by level counts      (E3, E6-E10, E14, P4)
    imputed datasets  join of both + one imputation per variant   (J1, I1-I4, E11)

Plans are cut only at fits (small driver-side results: level counts, ranges,
lambdas, modes) and never collect rows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import encode, impute, profile, select, transform, typing

ID, LABEL = "ID", "target"


def preprocess(df: DataFrame, coded: Sequence[str] = typing.CODED_AS_CATEGORY) -> DataFrame:
    """Integers to double (ID kept), '' to null, integer codes to
    categories, then NAfreq / NAfacfreq / Below0freq."""
    # codes become categories first, so their levels read '12', not '12.0'
    x = typing.codes_to_categorical(df, [c for c in coded if c in df.columns])
    x = typing.cast_integers_to_double(x, exclude=[ID, LABEL])
    x = typing.blanks_to_null(x)
    x = x.withColumn(LABEL, F.col(LABEL).cast("int"))
    return profile.add_row_shares(x, ID, LABEL)


def numeric_features(pre: DataFrame, special_log: Sequence[str] = (), log1p: Sequence[str] = (),
                     yeo_johnson: Sequence[str] = (), scale: bool = True) -> DataFrame:
    """T5: ID, target, numeric columns, row shares and the transformed
    columns, with everything but ID/target/shares min-max scaled."""
    nums = profile.numeric_columns(pre, [ID, LABEL])
    x = pre.select(ID, LABEL, *nums)
    x = transform.add_special_log(x, special_log)
    x = transform.add_log1p(x, log1p)
    if yeo_johnson:
        x = transform.add_yeo_johnson(x, list(yeo_johnson))
    if scale:
        freq = [c for c in x.columns if "freq" in c]
        cols = [c for c in x.columns if c not in (ID, LABEL, *freq)]
        x = transform.range_scale(x, cols)
    return x


def numeric_tables(pre: DataFrame, special_log: Sequence[str] = (), log1p: Sequence[str] = (),
                   yeo_johnson: Sequence[str] = (), rescale_only: Sequence[str] = ()) -> dict[str, DataFrame]:
    """T5: the three numeric tables of one plan: ``raw_trans`` (all scaled
    columns and transforms), ``trans`` (ID, target, the columns that are only
    rescaled, the row shares and the transforms) and ``raw`` (scaled columns
    without transforms)."""
    full = numeric_features(pre, special_log, log1p, yeo_johnson)
    made = [c for c in full.columns if re.match(r"T\w*_", c)]
    freq = [c for c in full.columns if "freq" in c]
    return {"raw_trans": full, "trans": full.select(ID, LABEL, *rescale_only, *freq, *made), "raw": full.drop(*made)}


def factor_features(pre: DataFrame, long_strings: Sequence[str] = ("v22",), version: int = 2,
                    impact_min_levels: int = 10, freq_min_levels: int = 25, buckets: int = 25,
                    impact_exclude: Sequence[str] = ("v22",), max_width: int = 256) -> DataFrame:
    """E14 gate applied to the categorical table. v1: impact coding of
    every column with more than 10 levels (originals dropped). v2: impact
    coding excluding ``impact_exclude``, numeric copies of the code columns,
    frequency coding of columns with at least 25 levels (25 buckets),
    originals of frequency-coded columns dropped. A long string of more than
    ``max_width`` characters raises: each is a column of the result."""
    facs = profile.string_columns(pre, [ID, LABEL])
    x = pre.select(ID, LABEL, *facs)
    x = encode.explode_chars(x, [c for c in long_strings if c in facs], max_width)
    cat = [c for c in x.columns if c not in (ID, LABEL) and not c.startswith("Len_")]
    x = encode.letter_counts(x, cat)
    levels = profile.level_counts(x, facs)
    levels = x.sparkSession.createDataFrame(levels.collect(), levels.schema)  # one row per column
    if version == 1:
        to_impact = encode.gate_by_levels(levels, min_levels=impact_min_levels)
        x = encode.impact_encode(x, to_impact, LABEL, row_key=ID)
        return x.drop(*to_impact)
    to_impact = encode.gate_by_levels(levels, min_levels=impact_min_levels, exclude=impact_exclude)
    x = encode.impact_encode(x, to_impact, LABEL, row_key=ID)
    coded = [c for c in typing.CODED_AS_CATEGORY if c in facs]
    x = typing.numeric_copies(x, coded)
    to_freq = encode.gate_by_levels(levels, min_levels=freq_min_levels, strict=False)
    if to_freq:
        x = encode.frequency_encode(x, to_freq, buckets=[buckets] * len(to_freq), drop_source=True, row_key=ID)
    return x


def model_table(pre: DataFrame, num: DataFrame | None = None, fac: DataFrame | None = None) -> DataFrame:
    """Numeric and categorical tables joined on ID (one label)."""
    num = num if num is not None else numeric_features(pre)
    fac = fac if fac is not None else factor_features(pre)
    return select.join_on_id(num, fac, ID, LABEL)


def retransform(df: DataFrame, special_log: Sequence[str] = (), log1p: Sequence[str] = (),
                yeo_johnson: Sequence[str] = (), scale: bool = True) -> DataFrame:
    """After imputation, re-derive ``Ts_/Tl_/Tyj_`` from the (now
    complete) source columns and min-max scale only the re-derived columns."""
    new = ([f"Ts_{c}" for c in special_log] + [f"Tl_{c}" for c in log1p]
           + [f"Tyj_{c}" for c in yeo_johnson])
    x = df.drop(*[c for c in new if c in df.columns])
    x = transform.add_special_log(x, special_log)
    x = transform.add_log1p(x, log1p)
    if yeo_johnson:
        x = transform.add_yeo_johnson(x, list(yeo_johnson))
    return transform.range_scale(x, new) if scale else x


def imputed(table: DataFrame, method: str, seed: int = 321) -> DataFrame:
    """Dataset variants: 'mode' (A1: numeric mode, strings ''), 'median'
    (B1), 'random' (B2), 'sentinel' (C: first-appearance codes, -999)."""
    nums = profile.numeric_columns(table, [ID, LABEL])
    strs = profile.string_columns(table, [ID, LABEL])
    if method == "mode":
        return impute.fill_constant(impute.fill_mode(table, nums), [], strs)
    if method == "median":
        return impute.fill_constant(impute.fill_median(table, nums), [], strs)
    if method == "random":
        return impute.fill_constant(impute.random_impute(table, nums, ID, seed), [], strs)
    if method == "sentinel":
        x = encode.label_encode(table, strs, order="first", id_col=ID, missing=-1)
        return impute.fill_constant(x, nums, [])
    raise ValueError(method)
