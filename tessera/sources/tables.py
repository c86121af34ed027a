"""Reading the driver tables and deriving the ``claims`` view.

The driver tables contain no nulls, no blanks and no unlabelled rows, which
are exactly what the toolkit is about, so ``claims_view`` derives a table with
the reference's column roles (``ID``, ``target``, numeric and categorical
``v<k>`` columns) from ``orders`` joined to ``customer``. Every order row is
kept; some cells are set to null or blank by arithmetic on the key so that the
same view can be reproduced by SQL (``CLAIMS_SQL``). The operators applied to
the view never rely on how it was made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Session setting: number of partitions the derived views are dealt into by
#: their row key. Unset (the default), the reader's splits are left as they are;
#: it serves a few small files on many cores, where one split would hold all rows.
VIEW_PARTITIONS = "tessera.view.partitions"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal ``df`` by ``key`` into the number of partitions that the session
    setting ``VIEW_PARTITIONS`` names; unchanged when it is unset."""
    n = df.sparkSession.conf.get(VIEW_PARTITIONS, None)
    return df.repartition(int(n), key) if n else df


def _letter(code) -> F.Column:
    return F.chr((F.lit(65) + code).cast("long"))


def claims_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: ID, target (null = unlabelled), v1, v23, v38, v50,
    v3, v71, v22, v66 (see FIXTURES.md section 2)."""
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    j = o.join(c, o["o_custkey"] == c["c_custkey"], "inner")
    k = F.col("o_orderkey")
    ck = F.col("o_custkey")
    null = F.lit(None)
    out = j.select(
        k.alias("ID"),
        F.when(F.pmod(k, F.lit(5)) == 4, null.cast("int"))
         .when(F.col("o_orderstatus") == "F", F.lit(1)).otherwise(F.lit(0)).alias("target"),
        F.when(F.pmod(k, F.lit(7)) == 3, null.cast("double"))
         .otherwise(F.col("o_totalprice")).alias("v1"),
        F.when(F.pmod(k, F.lit(11)) == 5, null.cast("double"))
         .otherwise(F.col("c_acctbal")).alias("v23"),
        F.when(F.pmod(k, F.lit(13)) == 6, null.cast("int"))
         .otherwise(F.pmod(k * 31, F.lit(12)).cast("int")).alias("v38"),
        (F.pmod(k * 17, F.lit(101)).cast("double") - F.lit(50.0)).alias("v50"),
        F.col("c_mktsegment").alias("v3"),
        F.when(F.pmod(k, F.lit(17)) == 2, null.cast("string"))
         .when(F.pmod(k, F.lit(19)) == 4, F.lit(""))
         .otherwise(F.col("o_orderpriority")).alias("v71"),
        F.when(F.pmod(k, F.lit(23)) == 8, null.cast("string")).otherwise(F.concat(
            _letter(F.pmod(ck, F.lit(26)).cast("int")),
            _letter(F.pmod(F.floor(ck / F.lit(26)).cast("long"), F.lit(26)).cast("int")),
            F.when(F.pmod(ck, F.lit(3)) == 0, F.lit(""))
             .otherwise(_letter(F.pmod(ck * 7, F.lit(26)).cast("int"))))).alias("v22"),
        _letter(F.pmod(k * 3, F.lit(7)).cast("int")).alias("v66"),
    )
    return spread(out, "ID")


# The same view as SQL text (runs unchanged in Spark SQL and DuckDB).
CLAIMS_SQL = """
SELECT o.o_orderkey AS ID,
       CASE WHEN mod(o.o_orderkey, 5) = 4 THEN NULL
            WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS target,
       CASE WHEN mod(o.o_orderkey, 7) = 3 THEN NULL ELSE o.o_totalprice END AS v1,
       CASE WHEN mod(o.o_orderkey, 11) = 5 THEN NULL ELSE c.c_acctbal END AS v23,
       CASE WHEN mod(o.o_orderkey, 13) = 6 THEN NULL
            ELSE CAST(mod(o.o_orderkey * 31, 12) AS INT) END AS v38,
       CAST(mod(o.o_orderkey * 17, 101) AS DOUBLE) - 50.0 AS v50,
       c.c_mktsegment AS v3,
       CASE WHEN mod(o.o_orderkey, 17) = 2 THEN NULL
            WHEN mod(o.o_orderkey, 19) = 4 THEN ''
            ELSE o.o_orderpriority END AS v71,
       CASE WHEN mod(o.o_orderkey, 23) = 8 THEN NULL ELSE concat(
            chr(65 + CAST(mod(o.o_custkey, 26) AS INT)),
            chr(65 + CAST(mod(CAST(floor(o.o_custkey / 26) AS BIGINT), 26) AS INT)),
            CASE WHEN mod(o.o_custkey, 3) = 0 THEN ''
                 ELSE chr(65 + CAST(mod(o.o_custkey * 7, 26) AS INT)) END) END AS v22,
       chr(65 + CAST(mod(o.o_orderkey * 3, 7) AS INT)) AS v66
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
"""

# Column roles of the claims view.
CLAIMS_ID = "ID"
CLAIMS_LABEL = "target"
CLAIMS_NUMERIC = ["v1", "v23", "v50"]
CLAIMS_CODED = ["v38"]                 # integer codes used as categories
CLAIMS_STRING = ["v3", "v71", "v22", "v66"]


def lineitem_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second, larger mixed-type table for the scale runs of profiling and
    association: every lineitem row, numeric measures and string flags."""
    li = read_table(spark, sf_dir, "lineitem")
    return spread(li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus",
    ), "l_orderkey")


LINEITEM_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINEITEM_STRING = ["l_returnflag", "l_linestatus"]
