"""Pairwise association of mixed-type columns as a long table
(col_a, col_b, kind, n, stat).

Each task reduces its rows to partial sums over Arrow batches (masked Gram
matrices for numeric pairs, contingency counts for categorical pairs, counts
and sums per level for mixed pairs) and emits them once, so rows are never
multiplied by pairs and what is shuffled depends on columns and levels only.
Numeric values are shifted by the column mean first, so that the sums keep
their digits. Categorical pairs are gated by a level cap beforehand. The
matrix is returned in both orientations (a, b) and (b, a), without the
diagonal; a pair of columns that are never present together has n = 0 and a
null statistic.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.profile import level_counts
from tessera.sources.staging import stage

SCHEMA = "col_a string, col_b string, kind string, n long, stat double"


def _mirror(df: DataFrame) -> DataFrame:
    """Both orientations from each row in one pass (a union with a flipped
    copy would plan, and scan, the input twice)."""
    both = F.array(
        F.struct(F.col("col_a").alias("col_a"), F.col("col_b").alias("col_b"), "kind", "n", "stat"),
        F.struct(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "kind", "n", "stat"))
    return df.select(F.inline(both))


def _empty(spark) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def _means(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{j}") for j, c in enumerate(cols)]).first()
    return np.array([m if m is not None else 0.0 for m in row])


def _shifted(batch: pa.RecordBatch, means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Presence (0/1) and shifted values (0 where null) of the first columns."""
    cols = [batch.column(j) for j in range(len(means))]
    there = np.column_stack([~c.is_null().to_numpy(zero_copy_only=False) for c in cols])
    values = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in cols])
    return there.astype(np.float64), np.where(there, values - means, 0.0)


class _Codes:
    """Level codes of string columns, the same for all batches of a task."""

    def __init__(self, columns: int):
        self.levels: list[dict[str, int]] = [{} for _ in range(columns)]

    def of(self, j: int, column: pa.Array) -> np.ndarray:
        """Codes of a column, -1 for null."""
        own = column.dictionary_encode()
        known = self.levels[j]
        table = np.array([known.setdefault(x, len(known)) for x in own.dictionary.to_pylist()] + [-1], dtype=np.int64)
        return table[own.indices.fill_null(len(table) - 1).to_numpy(zero_copy_only=False)]

    def names(self, j: int) -> list[str]:
        return list(self.levels[j])


def _on_grid(found: DataFrame, pairs: Sequence[tuple[str, str]], kind: str) -> DataFrame:
    """Every pair, those without common rows with n = 0 and a null stat."""
    grid = found.sparkSession.createDataFrame(list(pairs), "col_a string, col_b string")
    return grid.join(found, ["col_a", "col_b"], "left").select(
        "col_a", "col_b", F.lit(kind).alias("kind"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), "stat")


# ---------------------------------------------------------------- C1
def pearson_pairs(df: DataFrame, cols: Sequence[str], mirror: bool = True) -> DataFrame:
    """Pearson correlation of every numeric pair over pairwise-complete
    rows; null for fewer than two rows or a constant side."""
    cols = list(cols)
    pairs = list(combinations(cols, 2))
    if not pairs:
        return _empty(df.sparkSession)
    x = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    means = _means(x, cols)
    a, b = np.triu_indices(len(cols), 1)

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q, xy = (np.zeros((len(cols), len(cols))) for _ in range(4))
        for batch in batches:
            there, value = _shifted(batch, means)
            n += there.T @ there
            s += value.T @ there          # sum of i where j is present
            q += (value * value).T @ there
            xy += value.T @ value
        sums = [n[a, b].astype(np.int64), s[a, b], s[b, a], q[a, b], q[b, a], xy[a, b]]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (a.astype(np.int32), b.astype(np.int32), *sums)],
                                         names=["a", "b", "n", "sx", "sy", "sxx", "syy", "sxy"])

    parts = x.mapInArrow(gram, "a int, b int, n long, sx double, sy double, sxx double, syy double, sxy double")
    g = parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    names = F.array(*map(F.lit, cols))
    found = g.where("n > 0").select(names[F.col("a")].alias("col_a"), names[F.col("b")].alias("col_b"), "n", F.when(
        (F.col("n") >= 2) & (vx > 0) & (vy > 0), cov / F.sqrt(vx * vy)).alias("stat"))
    out = _on_grid(found, pairs, "num-num")
    return _mirror(out) if mirror else out


def complete_gram(df: DataFrame, cols: Sequence[str], means: Sequence[float] | None = None) -> np.ndarray:
    """Gram matrix of (1, columns shifted by their means, or by ``means``) over
    the rows where all columns are present: (p + 1) x (p + 1) numbers, from one
    partial matrix a task. With an intercept the shift changes no residual."""
    cols = list(cols)
    x = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    means = _means(x, cols) if means is None else np.asarray(means, dtype=float)
    p = len(cols) + 1
    a, b = np.triu_indices(p)

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((p, p))
        for batch in batches:
            there, value = _shifted(batch, means)
            rows = np.column_stack([np.ones(len(value)), value])
            g += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(g[a, b])],
                                         names=["a", "b", "g"])

    out = np.zeros((p, p))
    for r in x.mapInArrow(gram, "a int, b int, g double").groupBy("a", "b").agg(F.sum("g").alias("g")).collect():
        out[r["a"], r["b"]] = out[r["b"], r["a"]] = r["g"]
    return out


# ---------------------------------------------------------------- C2, C3
def _contingency(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(col_a, col_b, la, lb, nij): counts of the level pairs that occur."""
    used = sorted({c for pair in pairs for c in pair})
    at = {c: j for j, c in enumerate(used)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, cells = _Codes(len(used)), [Counter() for _ in pairs]
        for batch in batches:
            own = [codes.of(j, batch.column(j)) for j in range(len(used))]
            for cell, (a, b) in zip(cells, pairs):
                x, y = own[at[a]], own[at[b]]
                both = (x >= 0) & (y >= 0)
                width = len(codes.levels[at[b]]) or 1
                both, n = np.unique(x[both] * width + y[both], return_counts=True)
                cell.update(dict(zip(zip((both // width).tolist(), (both % width).tolist()), n.tolist())))
        names = [codes.names(j) for j in range(len(used))]
        rows = [(a, b, names[at[a]][i], names[at[b]][j], n)
                for cell, (a, b) in zip(cells, pairs) for (i, j), n in cell.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)],
                                             names=["col_a", "col_b", "la", "lb", "nij"])

    return df.select(*[F.col(c).cast("string").alias(c) for c in used]).mapInArrow(
        count, "col_a string, col_b string, la string, lb string, nij long") \
        .groupBy("col_a", "col_b", "la", "lb").agg(F.sum("nij").alias("nij"))


def random_tables(rows: np.ndarray, cols: np.ndarray, replicates: int, rng: np.random.Generator) -> np.ndarray:
    """sum n_ij^2 / (n_i n_j) of ``replicates`` random tables with the given
    margins, cell by cell, each hypergeometric given those before it. For what
    is left of a table with 10^9 rows or more the draw is normal, with the
    hypergeometric mean and variance, cut to the possible counts."""
    left = np.repeat(np.asarray(cols, dtype=np.int64)[None, :], replicates, axis=0)
    out = np.zeros(replicates)
    for n_i in rows:
        need = np.full(replicates, n_i, dtype=np.int64)  # of this row, still to be placed
        rest = left.sum(axis=1)                          # places in this column and those after it
        for j in range(len(cols)):
            good = left[:, j].copy()
            rest = rest - good
            if int(rest[0] + good[0]) < 1_000_000_000:
                cell = rng.hypergeometric(good, rest, need)
            else:
                total = (good + rest).astype(float)
                mean = need * (good / total)
                var = mean * (rest / total) * ((total - need) / (total - 1))
                cell = np.rint(rng.normal(mean, np.sqrt(var))).astype(np.int64)
                cell = np.clip(cell, np.maximum(0, need - rest), np.minimum(need, good))
            out += cell.astype(float) ** 2 / (float(n_i) * float(cols[j]))
            left[:, j] -= cell
            need = need - cell
    return out


def simulated_p_values(df: DataFrame, cols: Sequence[str], level_cap: int = 100, replicates: int = 1000,
                       seed: int = 1, levels: DataFrame | None = None) -> DataFrame:
    """C2 with its simulated p-value: for every categorical pair within the
    level cap ``(col_a, col_b, n, v, least_expected, p_value)``, each pair once in
    the order of ``cols``; p = (1 + tables at least as far from independence as
    the observed one) / (1 + replicates) over random tables with the same
    margins. ``v`` and ``p_value`` are null if a side has fewer than two levels
    among the common rows; pairs without common rows are left out.

    The rows are reduced to a table of at most cap x cap counts a pair; the
    replicates are dealt over tasks in lots of 100, each with its own seed, so
    a lost task draws the same again."""
    spark = df.sparkSession
    schema = "col_a string, col_b string, n long, v double, least_expected double, p_value double"
    pairs = list(combinations(cols, 2))
    lv = levels if levels is not None else level_counts(df, cols)
    few = {r["column"] for r in lv.where(F.col("n_levels") <= level_cap).collect()}  # one row a column
    ok = [(a, b) for a, b in pairs if a in few and b in few]
    if not ok:
        return spark.createDataFrame([], schema)
    cells = stage(_contingency(df, ok), "p-cells")
    key = ["col_a", "col_b"]

    def margin(level: str, name: str) -> DataFrame:
        return cells.groupBy(*key, level).agg(F.sum("nij").alias("m")).groupBy(*key).agg(
            F.sort_array(F.collect_list("m")).alias(name))  # at most level_cap

    ni = cells.groupBy(*key, "la").agg(F.sum("nij").alias("ni"))
    nj = cells.groupBy(*key, "lb").agg(F.sum("nij").alias("nj"))
    told = cells.join(ni, [*key, "la"]).join(nj, [*key, "lb"]).groupBy(*key).agg(
        F.sum(F.col("nij") * F.col("nij") / (F.col("ni") * F.col("nj"))).alias("s"), F.sum("nij").alias("n"))
    told = stage(told.join(margin("la", "r"), key).join(margin("lb", "c"), key), "p-margins")
    lots = told.where((F.size("r") > 1) & (F.size("c") > 1)).withColumn(
        "lot", F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // 100) - 1))))

    def simulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                rng = np.random.default_rng([seed, r["lot"], *f"{r['col_a']}/{r['col_b']}".encode()])
                drawn = random_tables(r["r"], r["c"], min(100, replicates - 100 * r["lot"]), rng)
                out.append((r["col_a"], r["col_b"], int((drawn - 1 >= (r["s"] - 1) * (1 - 1e-9) - 1e-12).sum())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*key, "far"])

    far = lots.repartition(F.col("lot"), *map(F.col, key)).mapInArrow(simulate, "col_a string, col_b string, far long") \
        .groupBy(*key).agg(F.sum("far").alias("far"))
    least = F.array_min("r") * F.array_min("c") / F.col("n")
    k = F.least(F.size("r"), F.size("c"))
    return told.join(far, key, "left").select(
        *key, "n", F.when(k > 1, F.sqrt(F.greatest(F.col("s") - 1.0, F.lit(0.0)) / (k - 1))).alias("v"),
        least.alias("least_expected"), ((F.col("far") + 1) / F.lit(replicates + 1)).alias("p_value"))


def cramers_v_pairs(df: DataFrame, cols: Sequence[str], level_cap: int = 100,
                    mirror: bool = True, levels: DataFrame | None = None) -> DataFrame:
    """Cramer's V of every categorical pair over complete cases.

    V^2 = (sum n_ij^2 / (n_i n_j) - 1) / (min(r, c) - 1), no continuity
    correction; null when min(r, c) < 2 or when either column has more than
    ``level_cap`` levels (the pair is then not expanded at all).
    """
    spark = df.sparkSession
    pairs = list(combinations(cols, 2))
    if not pairs:
        return _empty(spark)
    lv = levels if levels is not None else level_counts(df, cols)
    nlev = {r["column"]: r["n_levels"] for r in lv.collect()}  # one row per column
    ok = [(a, b) for a, b in pairs if nlev.get(a, 0) <= level_cap and nlev.get(b, 0) <= level_cap]
    skipped = [(a, b) for a, b in pairs if (a, b) not in set(ok)]
    parts = []
    if ok:
        cells = _contingency(df, ok)
        # staged (bounded by pairs x cap^2 rows): the three uses below read it,
        # not the source
        cells = stage(cells, "assoc-cells")
        ni = cells.groupBy("col_a", "col_b", "la").agg(F.sum("nij").alias("ni"))
        nj = cells.groupBy("col_a", "col_b", "lb").agg(F.sum("nij").alias("nj"))
        terms = (cells.join(ni, ["col_a", "col_b", "la"]).join(nj, ["col_a", "col_b", "lb"])
                 .groupBy("col_a", "col_b").agg(
                     F.sum(F.col("nij") * F.col("nij") / (F.col("ni") * F.col("nj"))).alias("s"),
                     F.sum("nij").alias("n"),
                     F.countDistinct("la").alias("r"), F.countDistinct("lb").alias("c")))
        k = F.least("r", "c")
        v = F.when(k >= 2, F.sqrt(F.greatest(F.col("s") - 1.0, F.lit(0.0)) / (k - 1)))
        parts.append(_on_grid(terms.select("col_a", "col_b", "n", v.alias("stat")), ok, "fac-fac"))
    if skipped:
        parts.append(spark.createDataFrame([(a, b, "fac-fac", None, None) for a, b in skipped], SCHEMA))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _mirror(out) if mirror else out


# ---------------------------------------------------------------- C4
def anova_r2_pairs(df: DataFrame, num_cols: Sequence[str], fac_cols: Sequence[str],
                   level_cap: int = 100, mirror: bool = True,
                   levels: DataFrame | None = None) -> DataFrame:
    """C4: adjusted R^2 of the one-way linear fit num ~ factor over complete
    cases: 1 - (1 - SSB/SST) (n - 1) / (n - k), k = levels present.

    Per level only (n, sum, sum of squares) of the shifted values are
    aggregated, so a pair costs one small table of at most ``level_cap`` rows.
    """
    spark = df.sparkSession
    if not num_cols or not fac_cols:
        return _empty(spark)
    lv = levels if levels is not None else level_counts(df, fac_cols)
    nlev = {r["column"]: r["n_levels"] for r in lv.collect()}
    ok_fac = [f for f in fac_cols if nlev.get(f, 0) <= level_cap]
    parts = []
    if ok_fac:
        nums = list(num_cols)
        x = df.select(*[F.col(y).cast("double").alias(y) for y in nums],
                      *[F.col(f).cast("string").alias(f"lv_{f}") for f in ok_fac])
        means = _means(x, nums)

        def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes = _Codes(len(ok_fac))
            sums = [np.zeros((3, len(nums), 0)) for _ in ok_fac]  # count, sum and square sum by level
            for batch in batches:
                there, value = _shifted(batch, means)
                for j in range(len(ok_fac)):
                    own = codes.of(j, batch.column(len(nums) + j))
                    width, seen = len(codes.levels[j]), own >= 0
                    sums[j] = np.pad(sums[j], ((0, 0), (0, 0), (0, width - sums[j].shape[2])))
                    for k in range(len(nums)):
                        for t, w in enumerate((there[:, k], value[:, k], value[:, k] ** 2)):
                            sums[j][t, k] += np.bincount(own[seen], weights=w[seen], minlength=width)
            rows = [(y, f, level, int(sums[j][0, k, i]), *sums[j][1:, k, i].tolist())
                    for j, f in enumerate(ok_fac) for k, y in enumerate(nums) for i, level in enumerate(codes.names(j))
                    if sums[j][0, k, i]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)],
                                                 names=["col_a", "col_b", "lvl", "nl", "sl", "ql"])

        ss = x.mapInArrow(moments, "col_a string, col_b string, lvl string, nl long, sl double, ql double") \
            .groupBy("col_a", "col_b", "lvl").agg(*[F.sum(c).alias(c) for c in ("nl", "sl", "ql")]) \
            .groupBy("col_a", "col_b").agg(
                F.sum("nl").alias("n"), F.count(F.lit(1)).alias("k"),
                (F.sum(F.col("sl") * F.col("sl") / F.col("nl")) - F.sum("sl") * F.sum("sl") / F.sum("nl")).alias("ssb"),
                F.sum(F.col("ql") - F.col("sl") * F.col("sl") / F.col("nl")).alias("ssw"))
        sst = F.col("ssb") + F.col("ssw")
        r2 = F.col("ssb") / sst
        adj = (F.when(F.col("k") == 1, F.lit(0.0))
               .when((F.col("n") > F.col("k")) & (sst > 0),
                     F.lit(1.0) - (F.lit(1.0) - r2) * (F.col("n") - 1) / (F.col("n") - F.col("k"))))
        parts.append(_on_grid(ss.select("col_a", "col_b", "n", adj.alias("stat")),
                              [(y, f) for y in nums for f in ok_fac], "num-fac"))
    skipped = [(y, f, "num-fac", None, None) for y in num_cols for f in fac_cols if f not in ok_fac]
    if skipped:
        parts.append(spark.createDataFrame(skipped, SCHEMA))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _mirror(out) if mirror else out


# ---------------------------------------------------------------- C5, C6
def association_matrix(df: DataFrame, num_cols: Sequence[str], fac_cols: Sequence[str],
                       level_cap: int = 100, fill_unknown: float | None = None) -> DataFrame:
    """The stitched matrix of C1, C3 and C4 in long form. C6:
    ``fill_unknown=0.0`` turns unknown associations into 0."""
    levels = level_counts(df, fac_cols) if fac_cols else None
    if levels is not None:
        levels = df.sparkSession.createDataFrame(levels.collect(), levels.schema)
    out = (pearson_pairs(df, num_cols)
           .unionByName(cramers_v_pairs(df, fac_cols, level_cap, levels=levels))
           .unionByName(anova_r2_pairs(df, num_cols, fac_cols, level_cap, levels=levels)))
    if fill_unknown is not None:
        out = out.fillna({"stat": float(fill_unknown)})
    return out


def fill_unknown(assoc: DataFrame, value: float = 0.0) -> DataFrame:
    """Unknown association to a value (0 in the reference)."""
    return assoc.fillna({"stat": float(value)})
