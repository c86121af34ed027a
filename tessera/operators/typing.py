"""Typing, projection, renaming and row filters.

All of these only shape a projection or a filter; Catalyst pushes the filters
and the column pruning into the Parquet scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import exprs as X
from tessera.operators.profile import NUMERIC_TYPES, string_columns

INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)

# Integer-coded columns that the reference treats as categories.
CODED_AS_CATEGORY = ["v38", "v62", "v72", "v129"]


def cast_integers_to_double(df: DataFrame, exclude: Sequence[str] = ("ID",)) -> DataFrame:
    """Every integer column but the excluded ones becomes double."""
    return df.select(*[F.col(f.name).cast("double").alias(f.name)
                       if isinstance(f.dataType, INTEGER_TYPES) and f.name not in exclude
                       else F.col(f.name) for f in df.schema.fields])


def codes_to_categorical(df: DataFrame, cols: Sequence[str] = CODED_AS_CATEGORY) -> DataFrame:
    """Integer codes become string categories (present columns only)."""
    cs = set(cols)
    return df.select(*[F.col(c).cast("string").alias(c) if c in cs else F.col(c) for c in df.columns])


def categorical_columns(df: DataFrame, extra: Sequence[str] = (), exclude: Sequence[str] = ()
                        ) -> list[str]:
    """P2 (column part): every string column plus ``extra`` names present."""
    s = string_columns(df, exclude)
    return s + [c for c in extra if c in df.columns and c not in s and c not in exclude]


def level_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P2 (level part): (column, level, code) with 1-based codes in sorted
    level order; null is not a level. Distributed ranking per column."""
    from tessera.operators.ranking import cumulative_rank
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level"))
                      for c in cols])
    lv = df.select(F.inline(items)).where(F.col("level").isNotNull()).distinct()
    r = cumulative_rank(lv, ["column"], ["level"], lo_col="_lo", hi_col="code", group_bound=len(cols))
    return r.select("column", "level", F.col("code").cast("long").alias("code"))


def numeric_copies(df: DataFrame, cols: Sequence[str], prefix: str = "Num_") -> DataFrame:
    """Keep a numeric copy ``Num_<c>`` before ``c`` becomes categorical."""
    return df.select("*", *[F.col(c).cast("double").alias(f"{prefix}{c}") for c in cols if c in df.columns])


def _map_strings(df: DataFrame, fn, cols: Sequence[str] | None) -> DataFrame:
    cs = set(cols) if cols is not None else set(string_columns(df))
    return df.select(*[fn(c).alias(c) if c in cs else F.col(c) for c in df.columns])


def blanks_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """P5: '' -> null in string columns."""
    return _map_strings(df, X.blank_to_null, cols)


def blanks_to_level(df: DataFrame, cols: Sequence[str] | None = None, level: str = X.EMPTY_LEVEL
                    ) -> DataFrame:
    """P6: '' -> a named level."""
    return _map_strings(df, lambda c: X.blank_to_level(c, level), cols)


def nulls_to_level(df: DataFrame, cols: Sequence[str] | None = None, level: str = X.EMPTY_LEVEL
                   ) -> DataFrame:
    """Null string -> a named level."""
    return _map_strings(df, lambda c: X.null_to_level(c, level), cols)


def drop_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop named columns (absent names are ignored)."""
    return df.drop(*[n for n in names if n in df.columns])


def match_columns(df: DataFrame, pattern: str, keep: Sequence[str] = ()) -> list[str]:
    rx = re.compile(pattern)
    return [c for c in df.columns if rx.search(c) and c not in keep]


def select_regex(df: DataFrame, pattern: str, keep: Sequence[str] = ()) -> DataFrame:
    """Keep ``keep`` plus the columns whose name matches ``pattern``."""
    return df.select(*[c for c in df.columns if c in keep or re.search(pattern, c)])


def drop_regex(df: DataFrame, pattern: str, keep: Sequence[str] = ()) -> DataFrame:
    """Drop the columns whose name matches ``pattern`` (except ``keep``)."""
    return df.drop(*match_columns(df, pattern, keep))


def names_intersect(a: Sequence[str], b: Iterable[str]) -> list[str]:
    """P10: names of ``a`` also in ``b`` (order of ``a``)."""
    bs = set(b)
    return [x for x in a if x in bs]


def names_setdiff(a: Sequence[str], b: Iterable[str]) -> list[str]:
    bs = set(b)
    return [x for x in a if x not in bs]


def names_union(*lists: Sequence[str]) -> list[str]:
    seen, out = set(), []
    for lst in lists:
        for x in lst:
            if x not in seen:
                seen.add(x)
                out.append(x)
    return out


def split_by_class(df: DataFrame, id_col: str = "ID", label_col: str = "target"
                   ) -> tuple[DataFrame, DataFrame]:
    """(id + numeric columns, id + label + string columns)."""
    nums = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)
            and f.name != id_col]
    strs = string_columns(df, [id_col, label_col])
    return df.select(id_col, *nums), df.select(id_col, label_col, *strs)


def prefix_rename(df: DataFrame, prefix: str, cols: Sequence[str] | None = None) -> DataFrame:
    """``prefix + name`` for the listed (default: all) columns."""
    cols = list(cols) if cols is not None else df.columns
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in cols})


def keep_rows(df: DataFrame, condition: Column | str) -> DataFrame:
    """Predicate filter (pushed down when it touches scan columns)."""
    return df.where(condition)


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows where every listed column is non-null."""
    return df.dropna(how="any", subset=list(cols))
