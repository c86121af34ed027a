"""Chained-equation imputation, regression with noise, convergence
trace and backward stepwise predictor choice.

Each sweep visits the columns in order; per column a linear model is fitted on
the rows where that column was observed, using the current values of its
predictors: one distributed Gram matrix, solved by the sweep operator (columns
that are constant or a combination of others get no weight). With
``posterior=True`` the coefficients of the missing rows are drawn from their
posterior, so that several imputations differ by what the data leave open
about the model too.

* ``method='pmm'`` (predictive mean matching): a missing cell takes the
  observed value of one of its ``k`` nearest donors in predicted value. The
  search is exact and bounded: rows are dealt into ranges of predictions, and a
  missing row meets only the k observed rows before and the
  k after it, which provably contain its k nearest donors.
* ``method='norm'``: prediction plus Gaussian noise with the fit's residual
  standard deviation (hash-seeded Box-Muller, reproducible).

After every column the rows that miss it are staged as Parquet, cutting the lineage of the
iteration; all others stay where they are. The current table is the complete rows, which the imputations share, and each
other row as the latest visit left it. ``m`` imputations are averaged per cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.hashing import hashed_normal, mix, std_normal
from tessera.operators.assoc import complete_gram
from tessera.operators.impute import column_salt, random_impute, random_imputes
from tessera.session import shuffle_partitions
from tessera.sources.staging import stage

#: A range of predictions holds about so many rows at most; the map side sorts and packs so many at a time.
RANGE_ROWS, DEALT_ROWS = 262_144, 524_288


def sweep(A: np.ndarray, k: int) -> np.ndarray:
    """Sweep of a symmetric matrix on pivot ``k``; sweeping on it again gives
    the matrix back."""
    d = A[k, k]
    out = A - np.outer(A[:, k], A[k, :]) / d
    out[k, :] = A[k, :] / abs(d)
    out[:, k] = out[k, :]
    out[k, k] = -1.0 / d
    return out


def linear_fit(G: np.ndarray, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Least squares of the last column on the others, from the Gram matrix of
    all, the constant first: (coefficients, inverse of X'X, residual sum of
    squares, degrees of freedom). A column whose remaining variance is below
    ``tolerance`` of its own has coefficient and variance 0."""
    A, p, inside = G.copy(), len(G) - 1, []
    for j in range(p):
        if A[j, j] > tolerance * max(G[j, j], 1e-300):
            A = sweep(A, j)
            inside.append(j)
    beta, inverse = np.zeros(p), np.zeros((p, p))
    beta[inside] = A[inside, p]
    inverse[np.ix_(inside, inside)] = -A[np.ix_(inside, inside)]
    return beta, inverse, max(float(A[p, p]), 0.0), int(G[0, 0]) - len(inside)


def posterior_draw(beta: np.ndarray, inverse: np.ndarray, rss: float, freedom: int,
                   rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """Coefficients and residual standard deviation drawn from their posterior
    under a flat prior. Without a degree of freedom: the estimates, 0."""
    if freedom < 1:
        return beta, 0.0
    sigma = math.sqrt(rss / rng.chisquare(freedom))
    inside = np.flatnonzero(np.diag(inverse) > 0)
    out = beta.copy()
    if len(inside):
        own = inverse[np.ix_(inside, inside)]
        size = np.sqrt(np.diag(own))  # the factor of the correlations keeps its digits
        root = np.linalg.cholesky(own / np.outer(size, size) + 1e-12 * np.eye(len(inside)))
        out[inside] += sigma * size * (root @ rng.standard_normal(len(inside)))
    return out, sigma


def _fit_predict(cur: DataFrame, target: str, preds: Sequence[str], miss: str, means: dict[str, float],
                 rng: np.random.Generator | None) -> tuple[DataFrame, float]:
    """``cur`` with ``_pred``, and the residual's size. With ``rng`` the missing
    rows are predicted by drawn coefficients."""
    cols = [*preds, target]
    beta, inverse, rss, freedom = linear_fit(complete_gram(cur.where(~F.col(miss)), cols, [means[c] for c in cols]))
    n = freedom + int((np.diag(inverse) > 0).sum())
    sigma = math.sqrt(rss / n) if n else 0.0

    def value(b: np.ndarray):
        # the target was shifted too
        return sum((F.lit(float(w)) * (F.col(c) - F.lit(means[c])) for w, c in zip(b[1:], preds)),
                   F.lit(float(b[0] + means[target])))

    pred = value(beta)
    if rng is not None:
        drawn, sigma = posterior_draw(beta, inverse, rss, freedom, rng)
        pred = F.when(F.col(miss), value(drawn)).otherwise(pred)
    return cur.withColumn("_pred", pred), sigma


def visit_order(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns by their number of nulls, fewest first, then by name."""
    n = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{j}") for j, c in enumerate(cols)]).first()
    return [c for _, c in sorted(zip(n, cols))]


def _sort_keys(pred: pa.ChunkedArray, ids: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys for ``lexsort`` that order rows by (prediction, id), nulls first."""
    ids = ids.cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy()
    return ids, pred.fill_null(0.0).to_numpy(), pred.is_valid().to_numpy()


def _range_ends(cur: DataFrame, id_col: str, rows: int, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort keys of the rows at which a new range of (prediction, id) begins, from about 128 hashed rows
    a range; they decide which task sees a row, not what it finds."""
    unit = 1 << 30
    few = cur.where(F.pmod(F.xxhash64("_pred", id_col), F.lit(unit)) < int(unit * min(1.0, 128 * ranges / max(rows, 1))))
    keys = _sort_keys(*few.select("_pred", id_col).toArrow().columns)
    order = np.lexsort(keys)
    at = order[np.arange(1, ranges) * len(order) // ranges] if len(order) else order
    return tuple(key[at] for key in keys)


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def _unpacked(column: pa.ChunkedArray) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(v.as_buffer()).read_all() for v in column]).combine_chunks()


def _nearest(donors: pa.Table, missing: pa.Table, id_col: str, k: int) -> np.ndarray:
    """For each missing row the place of its drawn donor, -1 without one."""
    d, m = (_sort_keys(t["_pred"], t[id_col]) for t in (donors, missing))
    n = len(d[0])
    order = np.lexsort((np.repeat([1, 0], [n, len(m[0])]), *(np.concatenate(x) for x in zip(d, m))))
    is_donor = order < n
    place, row = order[is_donor], order[~is_donor] - n  # in order of (prediction, id); a missing row before its equals
    ids, pred, there = (key[place] for key in d)
    draw = missing["_draw"].fill_null(-1).to_numpy()
    out, step = np.full(len(row), -1), np.arange(-k, k)
    closeness = np.where(step < 0, -step, step + 1)
    before = np.cumsum(is_donor)[~is_donor]
    for at in range(0, len(row) if n else 0, 32768):
        own = row[at:at + 32768]
        cand = before[at:at + 32768, None] + step
        outside, cand = (cand < 0) | (cand >= n), cand.clip(0, n - 1)
        known = there[cand] & m[2][own, None]
        gap = np.where(known, np.abs(pred[cand] - m[1][own, None]), 0.0)
        near = np.lexsort((ids[cand], np.broadcast_to(closeness, cand.shape), gap, known, outside), axis=-1)
        pick = draw[own] % np.minimum((~outside).sum(axis=1), k)
        found = place[cand[np.arange(len(own)), near[np.arange(len(own)), pick]]]
        out[own] = np.where(draw[own] >= 0, found, -1)
    return out


def pmm_fill(cur: DataFrame, target: str, id_col: str, miss: str, k: int = 5, salt: int = 0, rows: int | None = None) -> DataFrame:
    """The rows of ``cur`` that miss ``target``, with ``_new``: the value drawn from
    the k nearest observed rows in ``_pred`` (null without any, or without an id).

    A missing row with b observed rows before it by (prediction, id) only needs the
    observed rows of ranks b-k .. b+k-1: in one dimension the k
    nearest points (distance ties broken by closeness in that order, then id)
    are always among the k predecessors and k successors, since every row
    further out is beaten by the k rows in between.

    Rows are dealt once, into ranges of (prediction, id). The map side sorts some hundred
    thousand rows at a time and sends each range its own rows and its last k observed rows before and
    first k after the range; the k nearest of all beyond an end are among these. Observed rows travel as (prediction,
    id, value), packed; missing ones whole, so that nothing is joined back. ``rows``: their number, if it is known."""
    rows = cur.count() if rows is None else rows
    ranges = max(1, -(-rows // RANGE_ROWS), min(shuffle_partitions(cur.sparkSession), -(-rows // (RANGE_ROWS // 4))))
    ends = _range_ends(cur, id_col, rows, ranges)
    sent = cur.where(F.col(miss).isNotNull()).withColumn("_pred", F.col("_pred").cast("double")) \
        .withColumn("_draw", F.pmod(mix(F.col(id_col), salt), F.lit(math.lcm(*range(1, k + 1)))).cast("int"))
    kept = [f for f in cur.schema.fields if f.name != "_pred"]

    def dealt(table: pa.Table) -> pa.RecordBatch:
        keys, n = _sort_keys(table["_pred"], table[id_col]), len(ends[0])
        order = np.lexsort((np.repeat([0, 1], [n, len(table)]), *(np.concatenate(x) for x in zip(ends, keys))))
        of = np.cumsum(order < n)[order >= n]
        order = order[order >= n] - n
        gone = table[miss].to_numpy()[order]
        donors = table.select(["_pred", id_col, target]).take(order[~gone])
        missing = table.take(order[gone])
        d, m = (np.searchsorted(x, np.arange(n + 2)) for x in (of[~gone], of[gone]))
        lo, hi = np.maximum(d[:-1] - k, 0), np.minimum(d[1:] + k, len(donors))
        return pa.RecordBatch.from_arrays([
            pa.array(np.arange(n + 1), pa.int32()), pa.array([_packed(donors.slice(a, b - a)) for a, b in zip(lo, hi)], pa.binary()),
            pa.array([_packed(missing.slice(a, b - a)) for a, b in zip(m[:-1], m[1:])], pa.binary())], names=["range", "donors", "missing"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= DEALT_ROWS:
                yield dealt(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield dealt(pa.Table.from_batches(held))

    def match(part: pa.Table) -> pa.Table:
        donors, missing = _unpacked(part["donors"]), _unpacked(part["missing"])
        at = _nearest(donors, missing, id_col, k)
        value = donors[target].cast(pa.float64()).combine_chunks().take(pa.array(at, mask=at < 0))
        return missing.select([f.name for f in kept]).append_column("_new", value)

    out = T.StructType([*kept, T.StructField("_new", T.DoubleType())])
    return sent.mapInArrow(deal, "range int, donors binary, missing binary").groupBy("range").applyInArrow(match, out)


def pmm_donors(cur: DataFrame, target: str, id_col: str, miss: str, k: int = 5, salt: int = 0) -> DataFrame:
    """(id, value) drawn for every missing row of ``target`` from its k
    nearest observed rows in ``_pred``."""
    own = cur.select(id_col, "_pred", target, miss)
    return pmm_fill(own, target, id_col, miss, k, salt).where(F.col("_new").isNotNull()).select(id_col, "_new")


def chained_impute(df: DataFrame, impute_cols: Sequence[str], all_cols: Sequence[str],
                   id_col: str = "ID", m: int = 3, maxit: int = 3, seed: int = 37,
                   method: str = "pmm", predictors: dict[str, Sequence[str]] | None = None,
                   k: int = 5, posterior: bool = False, order: str = "given",
                   spread: bool = False) -> tuple[DataFrame, DataFrame]:
    """I5/I6 + I7. Returns (df with ``impute_cols`` filled by the mean over
    ``m`` imputations, trace(imputation, sweep, visit, column, mean_abs_change)).

    ``posterior`` draws the coefficients for the missing rows; ``order``
    visits columns as ``given`` or fewest nulls first (``monotone``);
    ``spread`` adds ``sd_<column>``, the standard deviation of a filled cell
    between the imputations (null for observed cells and for m = 1)."""
    spark = df.sparkSession
    if order not in ("given", "monotone"):
        raise ValueError(order)
    if method not in ("pmm", "norm"):
        raise ValueError(method)
    impute_cols = list(impute_cols) if order == "given" else visit_order(df, impute_cols)
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{j}") for j, c in enumerate(all_cols)]).first()
    means = {c: float(v) if v is not None else 0.0 for c, v in zip(all_cols, means)}
    base = stage(df.select(id_col, *[F.col(c).cast("double").alias(c) for c in all_cols],
                           *[F.col(c).isNull().alias(f"_m_{c}") for c in impute_cols]), "chained")
    rows = base.count()

    def holds(cols: Sequence[str]):
        return reduce(or_, [F.col(f"_m_{c}") for c in cols], F.lit(False))

    whole = base.where(~holds(impute_cols))
    starts = stage(random_imputes(base, impute_cols, id_col, [seed * 100 + i for i in range(1, m + 1)], holds(impute_cols)), "chained-start")
    trace_rows = []
    results = []
    for i in range(1, m + 1):
        start, latest = starts.where(F.col("_draw") == i - 1).select(*base.columns), {}

        def unfinished() -> DataFrame:
            # rows with a missing cell, as the latest visit of one of their columns left them
            out, later = None, []
            for c in reversed(latest):
                own = latest[c].where(~holds(later)).select(*base.columns)
                out, later = own if out is None else out.unionByName(own), [*later, c]
            own = start.where(~holds(later))
            return own if out is None else out.unionByName(own)

        for sweep_no in range(1, maxit + 1):
            for visit, c in enumerate(impute_cols, 1):
                preds = list(predictors[c]) if predictors and c in predictors else \
                    [x for x in all_cols if x != c]
                miss = f"_m_{c}"
                salt = column_salt(seed * 1000 + i * 10 + sweep_no, c)
                rng = np.random.default_rng([salt, i, sweep_no]) if posterior else None
                fitted, sigma = _fit_predict(whole.unionByName(unfinished()), c, preds, miss, means, rng)
                if method == "pmm":
                    nxt = pmm_fill(fitted, c, id_col, miss, k, salt, rows)
                else:
                    noise = hashed_normal if posterior else std_normal
                    nxt = fitted.where(F.col(miss)).withColumn("_new", F.col("_pred") + F.lit(sigma) * noise(F.col(id_col), salt))
                # staged for each column: the next fit and trace read this table instead of running all
                # columns before again; the other rows stay where they are
                nxt = stage(nxt.withColumn("_old", F.col(c)).withColumn(c, F.col("_new")).select(*base.columns, "_old"), "chained")
                ch = nxt.agg(F.avg(F.abs(F.col(c) - F.col("_old"))).alias("d")).first()["d"]
                trace_rows.append((i, sweep_no, visit, c, float(ch) if ch is not None else None))
                latest.pop(c, None)
                latest[c] = nxt
        items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value"),
                                   F.col(f"_m_{c}").alias("was_null")) for c in impute_cols])
        results.append(unfinished().select(id_col, F.inline(items)).where("was_null").select(id_col, "column", "value"))
    u = results[0]
    for r in results[1:]:
        u = u.unionByName(r)
    wide = u.groupBy(id_col).pivot("column", impute_cols).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    wide = wide.select(id_col, *[F.col(f"{c}_mean").alias(f"_ci_{c}") for c in impute_cols],
                       *[F.col(f"{c}_sd").alias(f"sd_{c}") for c in impute_cols if spread])
    out = df.join(wide, id_col, "left").select(
        *[F.coalesce(F.col(c).cast("double"), F.col(f"_ci_{c}")).alias(c) if c in impute_cols else F.col(c)
          for c in df.columns], *[f"sd_{c}" for c in impute_cols if spread])
    trace = spark.createDataFrame(trace_rows, "imputation int, sweep int, visit int, column string, mean_abs_change double")
    return out, trace


def stepwise_predictors(df: DataFrame, targets: Sequence[str], all_cols: Sequence[str],
                        id_col: str = "ID", seed: int = 22,
                        predictors: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """I8: backward AIC elimination (AIC = n log(RSS/n) + 2 p) of each
    target's linear model after a random pre-fill. One distributed aggregate
    gives the Gram matrix of (1, columns); the search runs on that p x p
    matrix at the driver. Errors (singular systems) are reported per target
    instead of aborting. Output: (target_col, predictor_col, aic, status)."""
    spark = df.sparkSession
    cols = list(all_cols)
    filled = random_impute(df.select(id_col, *[F.col(c).cast("double").alias(c) for c in cols]),
                           list(targets), id_col, seed=seed)
    names = ["_one"] + cols
    G = complete_gram(filled, cols)
    n = G[0, 0]
    rows = []
    for t in targets:
        ti = names.index(t)
        cand = [names.index(p) for p in (predictors[t] if predictors and t in predictors
                                          else [c for c in cols if c != t])]

        def aic(sel):
            idx = [0] + sel
            A = G[np.ix_(idx, idx)]
            bvec = G[idx, ti]
            beta = np.linalg.solve(A, bvec)
            rss = max(G[ti, ti] - beta @ bvec, 1e-300)
            return n * math.log(rss / n) + 2 * len(idx)
        try:
            cur = list(cand)
            best = aic(cur)
            while cur:
                trials = [(aic([x for x in cur if x != d]), d) for d in cur]
                val, d = min(trials)
                if val < best:
                    best, cur = val, [x for x in cur if x != d]
                else:
                    break
            status = "ok"
            kept = [names[x] for x in cur]
        except np.linalg.LinAlgError as e:
            kept, best, status = [], float("nan"), f"error: {e}"
        rows += [(t, p, float(best), status) for p in kept] or [(t, None, float(best), status)]
    return spark.createDataFrame(rows, "target_col string, predictor_col string, aic double, status string")


# ---------------------------------------------------------------- elimination by the sweep operator
def stepwise_trace(df: DataFrame, targets: Sequence[str], candidates: Sequence[str], id_col: str = "ID", seed: int = 22,
                   tolerance: float = 1e-9) -> DataFrame:
    """I8 over all columns: backward AIC elimination of each target's linear
    model, after a random pre-fill, from one distributed Gram matrix of all columns
    (centred by sweeping the constant). A column is swept in; one whose remaining variance is
    below ``tolerance`` of its own is set aside, as constant or as a combination of
    those before it. Then the column whose removal lowers the AIC most is swept out
    again, until none does: what a removal costs is read off the matrix, without a new fit.

    Output, one row a target and column: (target_col, column, step: the removal's
    number, null for kept columns and those set aside, status: kept, dropped, constant or collinear, coefficient
    of kept columns, aic after the step, or of the final model)."""
    spark = df.sparkSession
    cols = list(dict.fromkeys([*targets, *candidates]))
    filled = random_impute(df.select(id_col, *[F.col(c).cast("double").alias(c) for c in cols]), cols, id_col, seed=seed)
    G = complete_gram(filled, cols)
    n = G[0, 0]
    centred = sweep(G, 0)[1:, 1:]
    rows = []
    for t in targets:
        place = {c: j for j, c in enumerate(cols)}
        A, ti, inside = centred.copy(), place[t], []
        for c in candidates:
            j = place[c]
            if c == t:
                continue
            scale = G[j + 1, j + 1]
            if centred[j, j] <= tolerance * max(scale, 1e-300):
                rows.append((t, c, None, "constant", None, None))
            elif A[j, j] <= tolerance * centred[j, j]:
                rows.append((t, c, None, "collinear", None, None))
            else:
                A = sweep(A, j)
                inside.append(c)

        def aic(rss: float, p: int) -> float:
            return float(n * math.log(max(rss, 1e-300) / n) + 2 * (p + 1))

        now, step = aic(A[ti, ti], len(inside)), 0
        while inside:
            # A[j, t]^2 / -A[j, j] is what the residuals grow by without column j
            least, c = min((A[ti, ti] - A[place[c], ti] ** 2 / A[place[c], place[c]], c) for c in inside)
            if aic(least, len(inside) - 1) >= now:
                break
            A, step = sweep(A, place[c]), step + 1
            inside.remove(c)
            now = aic(A[ti, ti], len(inside))
            rows.append((t, c, step, "dropped", None, now))
        rows += [(t, c, None, "kept", float(A[place[c], ti]), now) for c in inside]
    return spark.createDataFrame(rows, "target_col string, column string, step int, status string, coefficient double, aic double")
