"""Categorical encoders.

Fitting an encoder is one grouped aggregate with a map-side combine (a hot
level costs one partial row per task, not a third of the data in one task).
Applying it is ``lookup_join``: the model is broadcast only after its row count
is checked against a bound; above the bound it is joined with a salted
shuffle join, so a hot level is spread over ``salt`` tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.functions.hashing import mix
from tessera.operators.ranking import cumulative_rank

# A lookup model is broadcast only within both bounds.
BROADCAST_MAX_ROWS = 1_000_000
BROADCAST_MAX_BYTES = 64 << 20
SALT_BUCKETS = 32


# ---------------------------------------------------------------- J3
def lookup_join(df: DataFrame, model: DataFrame, key: str | Column, model_key: str,
                value_cols: Sequence[str], defaults: dict | None = None,
                row_key: str | Column | None = None, null_safe: bool = False,
                broadcast_max_rows: int = BROADCAST_MAX_ROWS, salt: int = SALT_BUCKETS,
                model_rows: int | None = None) -> DataFrame:
    """Left-join ``model`` (one row per distinct ``model_key``) on ``key`` and
    fill missing values from ``defaults``.

    ``row_key`` (a unique row id) spreads rows over salt buckets when the
    model is too large to broadcast: more rows than ``broadcast_max_rows`` or,
    by its key lengths, more than ``BROADCAST_MAX_BYTES``.
    """
    key_col = F.col(key) if isinstance(key, str) else key
    defaults = defaults or {}
    n_model = model_rows if model_rows is not None else model.count()
    small = n_model <= broadcast_max_rows
    if small:
        chars = model.agg(F.sum(F.octet_length(F.col(model_key).cast("string")))).first()[0] or 0
        small = chars + n_model * (24 + 16 * len(value_cols)) <= BROADCAST_MAX_BYTES
    mk = "_lk_key"
    m = model.select(F.col(model_key).alias(mk), *value_cols)
    left = df.withColumn("_lk_k", key_col)
    if small or salt <= 1:
        cond = (F.col("_lk_k").eqNullSafe(F.col(mk)) if null_safe else F.col("_lk_k") == F.col(mk))
        j = left.join(F.broadcast(m) if small else m, cond, "left")
    else:
        rk = F.col(row_key) if isinstance(row_key, str) else row_key
        if rk is None:
            rk = F.xxhash64(*[F.col(c) for c in df.columns])
        left = left.withColumn("_lk_s", F.pmod(mix(F.abs(rk) if row_key is None else rk, 17), F.lit(salt)))
        m = m.withColumn("_lk_s", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        kc = F.col("_lk_k").eqNullSafe(F.col(mk)) if null_safe else F.col("_lk_k") == F.col(mk)
        j = left.join(m.withColumnRenamed("_lk_s", "_lk_s2"),
                      kc & (F.col("_lk_s") == F.col("_lk_s2")), "left").drop("_lk_s", "_lk_s2")
    out_cols = [F.col(c) for c in df.columns]
    for v in value_cols:
        d = defaults.get(v)
        out_cols.append(F.coalesce(F.col(v), F.lit(d)).alias(v) if d is not None else F.col(v))
    return j.select(*out_cols)


# ---------------------------------------------------------------- E1, E2
def fit_impact_many(df: DataFrame, cols: Sequence[str], label_col: str = "target"
                    ) -> tuple[DataFrame, dict[str, float], dict[str, int]]:
    """E1 for several columns in one pass: the labelled rows are unpivoted to
    (column, level, y) inside the map stage and counted per (column, level)
    with a map-side combine.

    Returns (model(column, level, value) staged as a small Parquet table,
    {column: na_value}, {column: number of levels}). Per level:
    (n1 + p) / (n + 1), p = global positive rate. The value shared by null
    and unseen levels counts every labelled row once more plus the real null
    rows: (n1_all + n1_null + p) / (n_all + n_null + 1).
    """
    from tessera.sources.staging import stage
    lab = df.where(F.col(label_col).isNotNull())
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level"))
                      for c in cols])
    per = (lab.select(F.col(label_col).cast("double").alias("_y"), F.inline(items))
           .groupBy("column", "level").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("n1")))
    per = stage(per, "impact-counts")  # bounded by the number of distinct levels
    tot = {r["column"]: r for r in per.groupBy("column").agg(
        F.sum("n").alias("n"), F.sum("n1").alias("n1"),
        F.sum(F.when(F.col("level").isNull(), F.col("n"))).alias("nn"),
        F.sum(F.when(F.col("level").isNull(), F.col("n1"))).alias("nn1"),
        F.count("level").alias("levels")).collect()}  # one row per column
    na, nlev, pvals = {}, {}, {}
    for c in cols:
        t = tot.get(c)
        n = float(t["n"] or 0) if t else 0.0
        n1 = float(t["n1"] or 0) if t else 0.0
        p = n1 / n if n else 0.0
        nn = float(t["nn"] or 0) if t else 0.0
        nn1 = float(t["nn1"] or 0) if t else 0.0
        na[c] = (n1 + nn1 + p) / (n + nn + 1.0)
        nlev[c] = int(t["levels"]) if t else 0
        pvals[c] = p
    pmap = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(pvals[c]))])
    model = per.where(F.col("level").isNotNull()).select(
        "column", "level", ((F.col("n1") + pmap[F.col("column")]) / (F.col("n") + F.lit(1.0))).alias("value"))
    return model, na, nlev


def fit_impact(df: DataFrame, col: str, label_col: str = "target") -> tuple[DataFrame, float]:
    """E1 for one column: (model(level, value), na_value)."""
    model, na, _ = fit_impact_many(df, [col], label_col)
    return model.select("level", "value"), na[col]


def apply_impact(df: DataFrame, model: DataFrame, na_value: float, col: str,
                 out_col: str | None = None, row_key: str | None = None, **kw) -> DataFrame:
    """Level -> value; null and unseen levels -> na_value."""
    out_col = out_col or f"Imp_{col}"
    m = model.select("level", F.col("value").alias(out_col))
    return lookup_join(df, m, F.col(col).cast("string"), "level", [out_col],
                       defaults={out_col: na_value}, row_key=row_key, **kw)


def impact_encode(df: DataFrame, cols: Sequence[str], label_col: str = "target",
                  prefix: str = "Imp_", drop_source: bool = False, row_key: str | None = None,
                  **kw) -> DataFrame:
    """``Imp_<c>`` for every listed column (one fit pass for all columns,
    then one size-checked lookup join per column; in-sample as in the
    reference, see ``impact_encode_out_of_fold`` for the leak-free form)."""
    cols = list(cols)
    if not cols:
        return df
    model, na, nlev = fit_impact_many(df, cols, label_col)
    out = df
    for c in cols:
        m = model.where(F.col("column") == c).select("level", "value")
        out = apply_impact(out, m, na[c], c, f"{prefix}{c}", row_key=row_key, model_rows=nlev[c], **kw)
    return out.drop(*cols) if drop_source else out


def impact_encode_out_of_fold(df: DataFrame, col: str, fold_col: str, label_col: str = "target",
                              out_col: str | None = None, rep_col: str | None = None,
                              row_key: str | None = None, **kw) -> DataFrame:
    """Q11 option: impact coding where a labelled row's value comes from the
    model fitted on the other folds (its own fold's counts subtracted from
    the totals); unlabelled rows get the full-data model. With ``rep_col``
    every repeat (or bag member) is handled in the same pass.

    One grouped count per (rep, fold, level) feeds everything; the per-fold
    priors and NA values form a table of reps x folds rows; the per-level
    model is applied with the size-checked lookup join.
    """
    from tessera.sources.staging import stage
    out_col = out_col or f"Imp_{col}"
    src_cols = df.columns
    if rep_col is None:  # one repeat: a constant key keeps every join an equi-join
        rep_col = "_rep0"
        df = df.withColumn(rep_col, F.lit(0))
    reps = [rep_col]
    y = F.col(label_col).cast("double")
    lab = df.where(F.col(label_col).isNotNull())
    per = lab.groupBy(*reps, F.col(fold_col).alias("_f"), F.col(col).cast("string").alias("_lv")).agg(
        F.count(F.lit(1)).alias("nf"), F.sum(y).alias("n1f"))
    per = stage(per, "oof-counts")  # bounded by reps x folds x levels
    isnull = F.col("_lv").isNull()
    lev = per.groupBy(*reps, "_lv").agg(F.sum("nf").alias("n"), F.sum("n1f").alias("n1"))
    ft = per.groupBy(*reps, "_f").agg(
        F.sum("nf").alias("Nf"), F.sum("n1f").alias("N1f"),
        F.coalesce(F.sum(F.when(isnull, F.col("nf"))), F.lit(0)).alias("NNf"),
        F.coalesce(F.sum(F.when(isnull, F.col("n1f"))), F.lit(0.0)).alias("NN1f"))
    tot = per.groupBy(*reps).agg(
        F.sum("nf").alias("N"), F.sum("n1f").alias("N1"),
        F.coalesce(F.sum(F.when(isnull, F.col("nf"))), F.lit(0)).alias("NN"),
        F.coalesce(F.sum(F.when(isnull, F.col("n1f"))), F.lit(0.0)).alias("NN1"))
    n_o, n1_o = F.col("N") - F.col("Nf"), F.col("N1") - F.col("N1f")
    p_o = n1_o / n_o
    po = ft.join(tot, reps)  # reps x folds rows
    po = po.select(*reps, "_f", p_o.alias("_p_o"),
                   ((n1_o + (F.col("NN1") - F.col("NN1f")) + p_o)
                    / (n_o + (F.col("NN") - F.col("NNf")) + 1.0)).alias("_na_o"))
    full = tot.select(*reps, (F.col("N1") / F.col("N")).alias("_p"),
                      ((F.col("N1") + F.col("NN1") + F.col("N1") / F.col("N"))
                       / (F.col("N") + F.col("NN") + 1.0)).alias("_na"))
    oofv = (per.where(~isnull).join(lev, [*reps, "_lv"]).join(po, [*reps, "_f"])
            .select(F.struct(*[F.col(r) for r in reps], F.col("_f"), F.col("_lv")).alias("_k"),
                    F.when(F.col("n") - F.col("nf") > 0,
                           (F.col("n1") - F.col("n1f") + F.col("_p_o")) / (F.col("n") - F.col("nf") + 1.0))
                    .otherwise(F.col("_na_o")).alias("_v_oof")))
    fullv = lev.where(F.col("_lv").isNotNull()).join(full, reps).select(
        F.struct(*[F.col(r) for r in reps], F.col("_lv")).alias("_k"),
        ((F.col("n1") + F.col("_p")) / (F.col("n") + 1.0)).alias("_v_full"))
    # per-(rep, fold) and per-rep tables: broadcast after checking their size
    # (reps x folds rows for a fold column; a fold column with many values
    # falls back to a shuffle join)
    po = po.withColumnRenamed("_f", fold_col)
    small = po.count() <= BROADCAST_MAX_ROWS
    x = df.join(F.broadcast(po) if small else po, [*reps, fold_col], "left")
    x = x.join(F.broadcast(full) if small else full, reps, "left")
    lvl = F.col(col).cast("string")
    x = lookup_join(x, oofv, F.struct(*[F.col(r) for r in reps], F.col(fold_col), lvl), "_k", ["_v_oof"],
                    row_key=row_key, **kw)
    x = lookup_join(x, fullv, F.struct(*[F.col(r) for r in reps], lvl), "_k", ["_v_full"],
                    row_key=row_key, **kw)
    v = F.when(F.col(label_col).isNotNull(), F.coalesce("_v_oof", "_na_o")) \
        .otherwise(F.coalesce("_v_full", "_na"))
    return x.select(*[F.col(c) for c in src_cols], v.alias(out_col))


# ---------------------------------------------------------------- E4
def one_hot_levels(df: DataFrame, col: str, max_levels: int) -> list[str]:
    """Sorted level list of a column; null becomes the level 'nan'. Fails
    loudly above ``max_levels`` (the output width is data dependent)."""
    lv = (df.select(F.coalesce(F.col(col).cast("string"), F.lit("nan")).alias("l"))
          .distinct().limit(max_levels + 1).collect())
    if len(lv) > max_levels:
        raise ValueError(f"{col}: more than {max_levels} levels; refusing to one-hot encode")
    return sorted(r["l"] for r in lv)


def one_hot(df: DataFrame, col: str, levels: Sequence[str] | None = None,
            drop_source: bool = True, max_levels: int | None = None) -> tuple[DataFrame, list[str]]:
    """``<col>_<level>`` 0/1 columns; levels fitted on one frame can be
    reused on another (unseen levels give all zeros). To fit them, the caller
    says how many columns the result may get (``max_levels``)."""
    if levels is None and max_levels is None:
        raise TypeError("one_hot needs either levels or max_levels")
    levels = list(levels) if levels is not None else one_hot_levels(df, col, max_levels)
    s = F.coalesce(F.col(col).cast("string"), F.lit("nan"))
    out = df.select("*", *[F.when(s == F.lit(v), 1).otherwise(0).alias(f"{col}_{v}") for v in levels])
    return (out.drop(col) if drop_source else out), levels


# ---------------------------------------------------------------- E5
def fit_nb_impact_many(train: DataFrame, cols: Sequence[str], label_col: str = "target",
                       alpha: float = 1.0) -> tuple[DataFrame, dict[str, float], dict[str, int]]:
    """E5 for several columns in one pass: Bernoulli naive Bayes on the
    one-hot levels of each column in closed form (null is the level 'nan').

    theta_jy = (N_jy + a) / (N_y + 2a); score_y = log prior_y
    + sum_j log(1 - theta_jy) + [log theta_ly - log(1 - theta_ly)];
    value = posterior of class 1. An unseen level keeps only the first two
    terms. Returns (model(column, level, value), {column: unseen value},
    {column: number of levels})."""
    import math

    from tessera.sources.staging import stage
    lab = train.where(F.col(label_col).isNotNull())
    y = F.col(label_col).cast("int")
    items = F.array(*[F.struct(F.lit(c).alias("column"),
                               F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias("level")) for c in cols])
    per = (lab.select(y.alias("_y"), F.inline(items)).groupBy("column", "level")
           .agg(F.sum(F.when(F.col("_y") == 0, 1).otherwise(0)).alias("n0"),
                F.sum(F.when(F.col("_y") == 1, 1).otherwise(0)).alias("n1")))
    per = stage(per, "nb-counts")  # bounded by the number of distinct levels
    cls = {r["column"]: r for r in per.groupBy("column").agg(
        F.sum("n0").alias("c0"), F.sum("n1").alias("c1"), F.count(F.lit(1)).alias("levels")).collect()}
    a = float(alpha)
    c0 = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(float(cls[c]["c0"])))])
    c1 = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(float(cls[c]["c1"])))])
    th = per.select("column", "level",
                    ((F.col("n0") + a) / (c0[F.col("column")] + 2 * a)).alias("t0"),
                    ((F.col("n1") + a) / (c1[F.col("column")] + 2 * a)).alias("t1"))
    sums = {r["column"]: r for r in th.groupBy("column").agg(
        F.sum(F.log1p(-F.col("t0"))).alias("s0"), F.sum(F.log1p(-F.col("t1"))).alias("s1")).collect()}
    base0, base1, unseen = {}, {}, {}
    for c in cols:
        k0, k1 = float(cls[c]["c0"]), float(cls[c]["c1"])
        base0[c] = math.log(k0 / (k0 + k1)) + sums[c]["s0"]
        base1[c] = math.log(k1 / (k0 + k1)) + sums[c]["s1"]
        unseen[c] = 1.0 / (1.0 + math.exp(base0[c] - base1[c]))
    b0 = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(base0[c]))])
    b1 = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(base1[c]))])
    d = ((b0[F.col("column")] + F.ln("t0") - F.log1p(-F.col("t0")))
         - (b1[F.col("column")] + F.ln("t1") - F.log1p(-F.col("t1"))))
    model = th.select("column", "level", (F.lit(1.0) / (F.lit(1.0) + F.exp(d))).alias("value"))
    return model, unseen, {c: int(cls[c]["levels"]) for c in cols}


def fit_nb_impact(train: DataFrame, col: str, label_col: str = "target",
                  alpha: float = 1.0) -> tuple[DataFrame, float]:
    """E5 for one column: (model(level, value), unseen value)."""
    model, unseen, _ = fit_nb_impact_many(train, [col], label_col, alpha)
    return model.select("level", "value"), unseen[col]


def nb_impact_encode(train: DataFrame, cols: Sequence[str], label_col: str = "target",
                     apply_to: DataFrame | None = None, prefix: str = "Imp_", **kw) -> DataFrame:
    """E5 over several columns: fitted on ``train``'s labelled rows in one
    pass, applied to ``apply_to`` (default ``train``)."""
    cols = list(cols)
    out = apply_to if apply_to is not None else train
    if not cols:
        return out
    model, unseen, sizes = fit_nb_impact_many(train, cols, label_col)
    for c in cols:
        m = model.where(F.col("column") == c).select("level", F.col("value").alias(f"{prefix}{c}"))
        out = lookup_join(out, m, F.coalesce(F.col(c).cast("string"), F.lit("nan")), "level",
                          [f"{prefix}{c}"], defaults={f"{prefix}{c}": unseen[c]}, model_rows=sizes[c], **kw)
    return out


# ---------------------------------------------------------------- E6, E7
def frequency_encode(df: DataFrame, cols: Sequence[str], buckets: Sequence[int | None] | None = None,
                     rfreq_prefix: str = "Rfreq_", ffreq_prefix: str = "Ffreq_",
                     drop_source: bool = False, **kw) -> DataFrame:
    """``Rfreq_<c>`` = level count / all rows (null rows get the null share).
    E7: ``Ffreq_<c>`` = that share cut into B equal-width right-closed bins
    over its range, labelled ``F_<c>_<k>``; B defaults to the number of
    distinct shares (the null share counts, even when it is zero). Bins are
    computed on the integer counts, so edges are exact.

    One pass counts (column, level) for all columns with a map-side combine;
    the small count table is staged and each column is joined back with a
    size-checked lookup join."""
    from tessera.sources.staging import stage
    cols = list(cols)
    if not cols:
        return df
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level"))
                      for c in cols])
    cnt = df.select(F.inline(items)).groupBy("column", "level").agg(F.count(F.lit(1)).alias("cnt"))
    cnt = stage(cnt, "level-counts")
    stats = {r["column"]: r for r in cnt.groupBy("column").agg(
        F.sum("cnt").alias("N"), F.min("cnt").alias("cmin"), F.max("cnt").alias("cmax"),
        F.countDistinct("cnt").alias("nd"), F.count(F.lit(1)).alias("rows"),
        F.max(F.when(F.col("level").isNull(), 1).otherwise(0)).alias("has_null")).collect()}
    out = df
    for i, c in enumerate(cols):
        st = stats[c]
        N, cmin, cmax = int(st["N"]), int(st["cmin"]), int(st["cmax"])
        b = buckets[i] if buckets is not None and i < len(buckets) and buckets[i] else None
        if b is None:
            b = int(st["nd"]) + (0 if st["has_null"] else 1)
        b = max(int(b), 1)
        if cmax == cmin:
            k = F.lit((b + 1) // 2)
        else:
            num = (F.col("cnt") - F.lit(cmin)) * F.lit(b)
            k = F.greatest(F.lit(1), F.least(F.lit(b), F.ceil(num / F.lit(cmax - cmin)))).cast("int")
        model = cnt.where(F.col("column") == c).select(
            "level", (F.col("cnt") / F.lit(float(N))).alias(f"{rfreq_prefix}{c}"),
            F.concat(F.lit(f"F_{c}_"), k.cast("string")).alias(f"{ffreq_prefix}{c}"))
        out = lookup_join(out, model, F.col(c).cast("string"), "level",
                          [f"{rfreq_prefix}{c}", f"{ffreq_prefix}{c}"], null_safe=True,
                          model_rows=int(st["rows"]), **kw)
    return out.drop(*cols) if drop_source else out


# ---------------------------------------------------------------- E8, E9
def add_lengths(df: DataFrame, cols: Sequence[str], prefix: str = "Len_") -> DataFrame:
    """``Len_<c>``, null counting as 0."""
    return df.select("*", *[X.str_len(c).alias(f"{prefix}{c}") for c in cols])


def explode_chars(df: DataFrame, cols: Sequence[str], max_width: int,
                  with_length: bool = True) -> DataFrame:
    """``Len_<c>`` and ``It_<c>_1..L`` (L = longest value), null or past
    the end giving ''. One aggregate finds L; fails loudly above
    ``max_width``, the columns that the caller allows for each source."""
    if not cols:
        return df
    ml = df.agg(*[F.max(F.length(F.col(c))).alias(c) for c in cols]).first()
    extra = []
    for c in cols:
        L = int(ml[c] or 0)
        if L > max_width:
            raise ValueError(f"{c}: longest value has {L} characters (> {max_width})")
        if with_length:
            extra.append(X.str_len(c).alias(f"Len_{c}"))
        extra += [X.char_at(c, i).alias(f"It_{c}_{i}") for i in range(1, L + 1)]
    return df.select("*", *extra)


# ---------------------------------------------------------------- E10
def letter_counts(df: DataFrame, cols: Sequence[str] | None = None, prefix: str = "Nr_") -> DataFrame:
    """``Nr_A .. Nr_Z``: in how many listed columns the cell equals the
    letter. Default: every string column."""
    if cols is None:
        from tessera.operators.profile import string_columns
        cols = string_columns(df)
    return df.select("*", *[X.letter_count(cols, L).alias(f"{prefix}{L}") for L in X.LETTERS])


# ---------------------------------------------------------------- E11-E13
def fit_label_codes_many(df: DataFrame, cols: Sequence[str], order: str = "first", id_col: str = "ID",
                         start: int = 0) -> tuple[DataFrame, dict[str, int]]:
    """Level tables of several columns in one pass: (column, level, code)
    with codes by first appearance in ``id_col`` order (E11, ``order='first'``)
    or sorted level order (E13, ``order='alpha'``), numbered per column by the
    distributed ranking helper. Also returns the number of levels per column."""
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level"))
                      for c in cols])
    long = df.select(id_col, F.inline(items)).where(F.col("level").isNotNull())
    if order == "first":
        lv = long.groupBy("column", "level").agg(F.min(id_col).alias("_first"))
        ranked = cumulative_rank(lv, ["column"], ["_first", "level"], group_bound=len(cols))
    elif order == "alpha":
        lv = long.select("column", "level").distinct()
        ranked = cumulative_rank(lv, ["column"], ["level"], group_bound=len(cols))
    else:
        raise ValueError(order)
    codes = ranked.select("column", "level", (F.col("rank_lo") + F.lit(start)).cast("long").alias("code"))
    sizes = {r["column"]: r["n"] for r in codes.groupBy("column").agg(
        F.count(F.lit(1)).alias("n")).collect()}  # one row per column
    return codes, sizes


def fit_label_codes(df: DataFrame, col: str, order: str = "first", id_col: str = "ID",
                    start: int = 0) -> DataFrame:
    """Level table (level, code) of one column (see fit_label_codes_many)."""
    codes, _ = fit_label_codes_many(df, [col], order, id_col, start)
    return codes.select("level", "code")


def label_encode(df: DataFrame, cols: Sequence[str], order: str = "first", id_col: str = "ID",
                 fit_on: DataFrame | None = None, missing: int | None = -1, start: int = 0,
                 **kw) -> DataFrame:
    """Replace each listed column by its integer code. Codes are
    fitted on ``fit_on`` (default ``df``) for all columns in one pass; null
    and unseen levels get ``missing`` (-1 for E11/E12; ``None`` keeps null
    for E13)."""
    cols = list(cols)
    if not cols:
        return df
    src = fit_on if fit_on is not None else df
    codes, sizes = fit_label_codes_many(src, cols, order, id_col, start)
    out = df
    for c in cols:
        m = codes.where(F.col("column") == c).select("level", F.col("code").alias("_code"))
        out = lookup_join(out, m, F.col(c).cast("string"), "level", ["_code"],
                          defaults={"_code": missing} if missing is not None else None,
                          model_rows=sizes.get(c, 0), **kw)
        out = out.withColumn(c, F.col("_code")).drop("_code")
    return out


# ---------------------------------------------------------------- E14
def gate_by_levels(levels: DataFrame, min_levels: int | None = None, max_levels: int | None = None,
                   strict: bool = True, exclude: Sequence[str] = ()) -> list[str]:
    """Columns whose level count passes the gate (driver list of names,
    one row per column)."""
    out = []
    for r in levels.collect():
        n = r["n_levels"]
        if r["column"] in exclude:
            continue
        if min_levels is not None and (n <= min_levels if strict else n < min_levels):
            continue
        if max_levels is not None and n > max_levels:
            continue
        out.append(r["column"])
    return sorted(out)
