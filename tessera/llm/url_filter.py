"""URL allow/block rules by a sort-merge range join.

A rule is ``(host, path, verdict)``; it fits a url whose host is the rule's
host or a subdomain of it and whose path starts with the rule's path. Written
label by label from the right, and each label in hex with a closing ``.``, a
host becomes a canonical key under which "host or subdomain" is "has this
prefix", that is one key interval; the intervals of several rules are nested
or disjoint. Rules (interval starts) and urls are laid out in one global key
order and swept once: the last rule start at or before a url carries the stack
of rules that were open there, and the open ones around the url are those of
the stack whose interval still holds its key. A second sweep does the same
for paths below each host that is still open.

The sweep is a range shuffle plus a running window inside each range; the
stack that is open at the start of a range comes from a table with one row per
range. No row is compared with all rules, nothing is broadcast but that table,
and a hot host is split over ranges because the order ends with the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import shuffle_partitions
from tessera.sources.staging import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the
    end, A-Z in lower case; empty for null or without ``://``."""
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; may be empty."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    return F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))


def _labels(host: Column) -> Column:
    """Closed hex labels from the right; none for an empty host, so that a
    rule with an empty host spans every url."""
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.reverse(F.split(host, "[.]")), lambda x: F.concat(F.hex(x), F.lit("."))))


def host_key(host: Column) -> Column:
    return F.array_join(_labels(host), "")


def _open_rules(rules: DataFrame, prefixes: Column) -> DataFrame:
    """For each rule ``(key, rule)`` the stack of all rules whose key is a
    prefix of its key, outermost first. ``prefixes`` lists the candidates."""
    own = rules.select("key", F.explode(F.array_distinct(prefixes)).alias("_prefix"))
    outer = rules.select(F.col("key").alias("_prefix"), "rule")
    found = own.join(outer, "_prefix").groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct(F.length("_prefix").alias("n"),
                                             F.col("_prefix").alias("key"), "rule"))).alias("stack"))
    return found


def prefix_sweep(points: DataFrame, rules: DataFrame, prefixes: Column) -> DataFrame:
    """Sweep ``points (key, row)`` against ``rules (key, rule, ...)``: each
    point gets ``open``, the rules whose key is a prefix of its key, outermost
    first (empty when there is none). Rule keys must be distinct."""
    spark = points.sparkSession
    n = shuffle_partitions(spark)
    starts = _open_rules(rules, prefixes)
    events = starts.select("key", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("tie"), "stack",
                           F.lit(None).cast(points.schema["row"].dataType).alias("row")) \
        .unionByName(points.select("key", F.lit(1).alias("kind"), F.xxhash64("row").alias("tie"),
                                   F.lit(None).cast(starts.schema["stack"].dataType).alias("stack"), "row"))
    # written once: the range of a row must stay the same for both uses below
    laid = stage(events.repartitionByRange(n, "key", "kind", "tie")
                 .withColumn("range", F.spark_partition_id()), "url-sweep")
    last = laid.where("kind = 0").groupBy("range").agg(F.max_by("stack", "key").alias("stack"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = spark.range(n).select(F.col("id").cast("int").alias("range")).join(last, "range", "left") \
        .select("range", F.last("stack", ignorenulls=True).over(earlier).alias("carried"))
    run = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    # one row per range, so the broadcast is bounded by the number of partitions
    return laid.join(F.broadcast(carried), "range") \
        .withColumn("_top", F.coalesce(F.last("stack", ignorenulls=True).over(run), "carried")) \
        .where("kind = 1") \
        .select("key", "row", F.filter(F.coalesce("_top", F.array().cast(starts.schema["stack"].dataType)),
                                       lambda s: F.col("key").startswith(s["key"])).alias("open"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """``(id_col, host, path, rule, verdict)`` for every row of ``pages``.

    ``rules`` holds ``host, path, verdict`` strings; rules with a null part
    are ignored, of two rules with one host and path ``block`` (the greater
    verdict) wins. The longest fitting rule (host plus path) decides; of two
    equally long ones the longer host. Without a fitting rule ``rule`` is null
    and the verdict is ``default``. A null url or one without ``://`` has empty
    host and path. Ids may be null or repeated: every row of ``pages`` gives
    one row. Other columns of ``pages`` are not read.
    """
    r = rules.where("host is not null and path is not null and verdict is not null") \
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rows = pages.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"),
                        url_path(F.col(url_col)).alias("path")) \
        .groupBy("id", "host", "path").agg(F.count(F.lit(1)).alias("n"))
    # sweep 1: the rule hosts that are open around the url's host
    hosts = r.select("host").distinct().select(host_key(F.col("host")).alias("key"),
                                               F.lit(True).alias("rule"), _labels(F.col("host")).alias("labels"))
    host_prefixes = F.transform(F.sequence(F.lit(0), F.size("labels")),
                                lambda i: F.array_join(F.slice(F.col("labels"), F.lit(1), i), ""))
    points = rows.select(host_key(F.col("host")).alias("key"), F.struct("id", "host", "path", "n").alias("row"))
    open_hosts = prefix_sweep(points, hosts, host_prefixes)
    # sweep 2: below each open host, the rule paths open around the url's path;
    # no rule key starts with "-"
    below = open_hosts.select("row", F.explode_outer("open").alias("at")).select(
        F.concat(F.coalesce(F.col("at.key"), F.lit("-")), F.lit("/"), F.hex("row.path")).alias("key"), "row")
    paths = r.select(
        F.concat(host_key(F.col("host")), F.lit("/"), F.hex("path")).alias("key"),
        F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("host_n"),
                 F.concat("host", "path").alias("rule"), "verdict").alias("rule"),
        host_key(F.col("host")).alias("hk"), F.hex("path").alias("hp"))
    path_prefixes = F.transform(
        F.sequence(F.lit(0), F.length("hp"), F.lit(2)),
        lambda i: F.concat(F.col("hk"), F.lit("/"), F.substring(F.col("hp"), F.lit(1), i)))
    found = prefix_sweep(below, paths, path_prefixes)
    best = found.select("row", F.when(F.size("open") > 0, F.element_at("open", -1)["rule"]).alias("best")) \
        .groupBy("row").agg(F.max("best").alias("best"))
    return best.select(
        F.col("row.id").alias(id_col), F.col("row.host").alias("host"), F.col("row.path").alias("path"),
        F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("row.n"))).alias("_copy")).drop("_copy")
