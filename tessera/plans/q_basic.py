"""Queries for sources (S), projection/typing (P) and row joins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import exprs as X
from tessera.operators import profile, select, typing
from tessera.plans.registry import R, query, rounded, with_claims
from tessera.session import ensure_checkpoint_dir
from tessera.sources import io
from tessera.sources.tables import CLAIMS_STRING, claims_view

ALL = "ID, target, v1, v23, v38, v50, v3, v71, v22, v66"


@query("s1_claims_scan", with_claims(f"SELECT {ALL} FROM claims"))
def s1_claims_scan(spark, d):
    """Scan with an explicit column set (the claims view)."""
    return claims_view(spark, d)


@query("s3_csv_roundtrip", with_claims(
    "SELECT ID, target, v1, v23, CAST(v38 AS VARCHAR) AS v38, v50, v3, v71, v22, v66 FROM claims"))
def s3_csv_roundtrip(spark, d):
    """S3 + S1 + S2: write the view as headed CSV (quoting on) into the session's
    checkpoint folder and read it back with an explicit schema. The null
    token is \\N: the reference's NA token collides with real levels (v22
    holds the two-letter level 'NA'), which a round trip would turn into nulls."""
    df = claims_view(spark, d)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    io.write_csv(df, path, null_value="\\N")
    # The integer-coded v38 is read as a string category
    schema = io.with_type_override(df.schema, {"v38": T.StringType()})
    return io.read_csv(spark, path, schema=schema, null_value="\\N")


@query("s4_submission", with_claims(
    f"SELECT ID, {R('CASE WHEN v1 IS NULL THEN 0.5 ELSE v1 / (v1 + 100000.0) END')} AS PredictedProb "
    "FROM claims WHERE target IS NULL"))
def s4_submission(spark, d):
    """ID and PredictedProb of the unlabelled rows for a score column."""
    df = claims_view(spark, d).withColumn(
        "score", F.when(F.col("v1").isNull(), F.lit(0.5)).otherwise(F.col("v1") / (F.col("v1") + 100000.0)))
    return rounded(io.submission(df, "score"))


@query("s5_union_train_test", with_claims(f"SELECT {ALL} FROM claims"))
def s5_union_train_test(spark, d):
    """Labelled and unlabelled parts (label column dropped from the
    latter) stacked by name with a null label."""
    train, test = io.split_labelled(claims_view(spark, d))
    return io.union_train_test(train, test.drop("target")).select(*ALL.split(", "))


@query("s6_labelled_rows", with_claims(f"SELECT {ALL} FROM claims WHERE target IS NOT NULL"))
def s6_labelled_rows(spark, d):
    """The labelled part."""
    return io.split_labelled(claims_view(spark, d))[0]


@query("p1_cast_double", with_claims(
    "SELECT ID, CAST(target AS DOUBLE) AS target, v1, v23, CAST(v38 AS DOUBLE) AS v38, v50, "
    "v3, v71, v22, v66 FROM claims"))
def p1_cast_double(spark, d):
    """Every integer column but ID becomes double."""
    return typing.cast_integers_to_double(claims_view(spark, d), exclude=["ID"])


_LVL_COLS = ["v3", "v71", "v22", "v66", "v38"]
_LVL_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS level FROM claims WHERE {c} IS NOT NULL"
    for c in _LVL_COLS)


@query("p2_level_table", with_claims(
    "SELECT \"column\", level, CAST(row_number() OVER (PARTITION BY \"column\" ORDER BY level) AS BIGINT) "
    "AS code FROM (SELECT DISTINCT \"column\", level FROM lv) t", f"lv AS ({_LVL_SQL})"))
def p2_level_table(spark, d):
    """P2 + P3: categorical level tables (sorted levels, 1-based codes) of the
    string columns and the integer-coded v38."""
    df = typing.codes_to_categorical(claims_view(spark, d), ["v38"])
    return typing.level_table(df, typing.categorical_columns(df, extra=["v38"], exclude=["ID"]))


@query("p5_blank_to_null", with_claims(
    "SELECT ID, nullif(v3, '') AS v3, nullif(v71, '') AS v71, nullif(v22, '') AS v22, "
    "nullif(v66, '') AS v66 FROM claims"))
def p5_blank_to_null(spark, d):
    """P5: '' becomes null in every string column."""
    return typing.blanks_to_null(claims_view(spark, d).select("ID", *CLAIMS_STRING))


@query("p6_blank_to_level", with_claims(
    "SELECT ID, " + ", ".join(f"CASE WHEN {c} = '' THEN 'EMPTY' ELSE {c} END AS {c}"
                              for c in CLAIMS_STRING) + " FROM claims"))
def p6_blank_to_level(spark, d):
    """P6: '' becomes the level EMPTY."""
    return typing.blanks_to_level(claims_view(spark, d).select("ID", *CLAIMS_STRING))


@query("p7_null_to_level", with_claims(
    "SELECT ID, " + ", ".join(f"coalesce({c}, 'EMPTY') AS {c}" for c in CLAIMS_STRING)
    + " FROM claims"))
def p7_null_to_level(spark, d):
    """Null strings become the level EMPTY."""
    return typing.nulls_to_level(claims_view(spark, d).select("ID", *CLAIMS_STRING))


@query("p9_regex_select_rename", with_claims(
    "SELECT ID, v22 AS Imp_v22, v23 AS Imp_v23 FROM claims"))
def p9_regex_select_rename(spark, d):
    """P8 + P9 + P10 + P12: drop named columns, keep the columns matching a
    regex, rename with a prefix."""
    df = typing.drop_columns(claims_view(spark, d), ["v1", "v3"])
    df = typing.select_regex(df, r"^v2\d$", keep=["ID"])
    keep = typing.names_setdiff(df.columns, ["ID"])
    return typing.prefix_rename(df, "Imp_", keep)


_SHARE_SQL = (
    "(CAST((v1 IS NULL) AS INT) + CAST((v23 IS NULL) AS INT) + CAST((v38 IS NULL) AS INT) "
    "+ CAST((v50 IS NULL) AS INT) + CAST((v3 IS NULL) AS INT) + CAST((v71 IS NULL) AS INT) "
    "+ CAST((v22 IS NULL) AS INT) + CAST((v66 IS NULL) AS INT)) / 8.0")
_FAC_SHARE_SQL = ("(CAST((v3 IS NULL) AS INT) + CAST((v71 IS NULL) AS INT) "
                  "+ CAST((v22 IS NULL) AS INT) + CAST((v66 IS NULL) AS INT)) / 4.0")
_BELOW_SQL = ("(coalesce(CAST(v1 < 0 AS INT), 0) + coalesce(CAST(v23 < 0 AS INT), 0) "
              "+ coalesce(CAST(v38 < 0 AS INT), 0) + coalesce(CAST(v50 < 0 AS INT), 0)) / 8.0")
ROW_SHARES_CTE = (f"shares AS (SELECT ID, target, {_SHARE_SQL} AS NAfreq, {_FAC_SHARE_SQL} AS NAfacfreq, "
                  f"{_BELOW_SQL} AS Below0freq FROM claims)")


def _row_shares(spark, d):
    return profile.add_row_shares(claims_view(spark, d), factor_cols=CLAIMS_STRING)


@query("a9_row_shares", with_claims(
    f"SELECT ID, {R('NAfreq')} AS NAfreq, {R('NAfacfreq')} AS NAfacfreq, "
    f"{R('Below0freq')} AS Below0freq FROM shares", ROW_SHARES_CTE))
def a9_row_shares(spark, d):
    """Per-row null share, categorical null share, negative share."""
    return rounded(_row_shares(spark, d).select("ID", "NAfreq", "NAfacfreq", "Below0freq"))


@query("p13_nafreq_filter", with_claims(
    f"SELECT ID, {R('NAfreq')} AS NAfreq FROM shares WHERE NAfreq <= 0.125", ROW_SHARES_CTE))
def p13_nafreq_filter(spark, d):
    """Keep rows with at most 1 of 8 feature cells missing."""
    return rounded(typing.keep_rows(_row_shares(spark, d), F.col("NAfreq") <= 0.125)
                   .select("ID", "NAfreq"))


@query("p14_complete_cases", with_claims(
    f"SELECT {ALL} FROM claims WHERE v1 IS NOT NULL AND v23 IS NOT NULL"))
def p14_complete_cases(spark, d):
    """Rows where v1 and v23 are both present."""
    return typing.complete_cases(claims_view(spark, d), ["v1", "v23"])


@query("j1_join_numeric_factor", with_claims(
    "SELECT n.ID, n.target, n.v1, n.v23, n.v50, f.v38, f.v3, f.v71, f.v22, f.v66 "
    "FROM (SELECT ID, target, v1, v23, v50 FROM claims) n "
    "JOIN (SELECT ID, target, CAST(v38 AS VARCHAR) AS v38, v3, v71, v22, v66 FROM claims) f "
    "ON n.ID = f.ID"))
def j1_join_numeric_factor(spark, d):
    """P11 + P3 + J1: split into numeric and categorical tables, re-join on
    ID with one copy of the label."""
    df = typing.codes_to_categorical(claims_view(spark, d), ["v38"])
    num, fac = typing.split_by_class(df)
    return select.join_on_id(num, fac)


@query("j2_bind_columns", with_claims(
    f"SELECT a.ID, a.v1, {R('b.Ts_v23')} AS Ts_v23 FROM (SELECT ID, v1 FROM claims) a JOIN "
    "(SELECT ID, CASE WHEN v23 IS NULL THEN NULL WHEN v23 > 0 THEN ln(v23) "
    "WHEN v23 = 0 THEN CAST('-inf' AS DOUBLE) ELSE -40.0 END AS Ts_v23 FROM claims) b ON a.ID = b.ID"))
def j2_bind_columns(spark, d):
    """Column bind of two frames of the same rows (matched on ID)."""
    c = claims_view(spark, d)
    a = c.select("ID", "v1")
    b = c.select("ID", X.special_log("v23").alias("Ts_v23"))
    return rounded(select.bind_columns(a, b, "ID"))


@query("j10_first_rows", with_claims(f"SELECT {ALL} FROM claims ORDER BY ID LIMIT 1000"))
def j10_first_rows(spark, d):
    """J10 (+ J4): the first 1,000 rows in ID order."""
    return select.first_n(claims_view(spark, d), 1000)
