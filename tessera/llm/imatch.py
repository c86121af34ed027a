"""I-Match fingerprints with randomised lexicon subsets.

Terms are runs of letters and digits in lower case. The document frequency of
every term is counted over the whole corpus; terms whose inverse document
frequency lies in a band form the lexicon. A fingerprint has one part for each
of several random subsets of the lexicon: the hash of the text's distinct
terms in that subset, in sorted order. The subsets get smaller by halves, so
an edit changes the parts of large subsets first and likeness falls gradually.
A subset is what a draw of random numbers for the terms leaves below its share;
several subsets of one draw are nested and cost little more than the first.

The upper end of the band bounds the lexicon whatever the corpus: of terms in
at least one of ``rarest`` documents there are at most ``rarest`` times the
mean number of distinct terms. So it is broadcast (behind a count), and texts
move once, to stand beside the next document's; terms are listed, looked up
and gathered again inside the partition that holds the text.

Only DataFrame functions are used.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import shuffle_partitions
from tessera.sources.staging import stage

NOT_TERM = r"[^\p{L}\p{N}]+"
#: For each draw, the shares of the lexicon in its nested subsets (falling); a part of the fingerprint each.
SUBSETS = [(1 / 2 ** (1 + k // 2),) for k in range(16)]
EMPTY = "-"
#: What Spark's xxhash64 gives for no terms: its seed.
NO_TERMS = 42
#: Bytes of text in a part of the table, about.
PART_BYTES = 64 << 20


def terms(text: Column) -> Column:
    """Distinct 64-bit term hashes; the empty term at the ends of a text
    counts as a term and, being common, falls out of the band."""
    return F.array_distinct(F.transform(F.split(F.lower(text), NOT_TERM), lambda t: F.xxhash64(t)))


def lexicon(term_lists: DataFrame, documents: int, commonest: float = 10, rarest: float = 1000) -> DataFrame:
    """The terms (column ``term``) that are in at most one of ``commonest``
    and at least one of ``rarest`` of all ``documents``. ``term_lists`` has a
    row ``terms`` for each document. With fewer than ``rarest`` documents every
    term that isn't too common is in the band."""
    counts = term_lists.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return counts.where((F.col("df") * commonest <= documents) & (F.col("df") * rarest >= documents)).select("term")


def parts(held: Column, subsets: Sequence[Sequence[float]] = SUBSETS) -> Column:
    """The parts of a fingerprint: sixteen hex digits for each lexicon subset
    that holds some of the terms, ``-`` for the others. ``held`` must be a
    plain column."""

    def below(terms: Column, draw: Column, limit: Column) -> Column:
        return F.filter(terms, lambda t: F.pmod(F.xxhash64(t, draw), F.lit(1 << 32)) < limit)

    limits = [[F.lit(int(share * (1 << 32))) for share in shares] for shares in subsets]
    own = F.array(*[F.struct(F.lit(k).alias("draw"), F.array(*own).alias("limits"), below(held, F.lit(k), own[0]).alias("own"))
                    for k, own in enumerate(limits)])
    hashes = F.flatten(F.transform(own, lambda d: F.transform(
        d["limits"], lambda limit: F.xxhash64(below(d["own"], d["draw"], limit)))))
    return F.transform(hashes, lambda h: F.when(h == NO_TERMS, F.lit(EMPTY)).otherwise(
        F.lower(F.lpad(F.hex(h), 16, "0"))))


def fingerprint(part_list: Column, held: Column, all_hash: Column) -> Column:
    """The parts as text; a text without any lexicon term gets ``x`` and the
    hash of all its terms, so that only equal term sets agree."""
    return F.when(F.size(held) > 0, F.array_join(part_list, ".")).otherwise(
        F.concat(F.lit("x"), F.lower(F.lpad(F.hex(all_hash), 16, "0"))))


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1, of two fingerprints: the share of equal parts among the
    subsets that hold terms of either; without any such, whether they are equal."""
    x, y = F.split(a, "[.]"), F.split(b, "[.]")
    both = F.arrays_zip(x.alias("x"), y.alias("y"))
    some = F.size(F.filter(both, lambda p: (p["x"] != EMPTY) | (p["y"] != EMPTY)))
    same = F.size(F.filter(both, lambda p: (p["x"] == p["y"]) & (p["x"] != EMPTY)))
    return F.when(a == b, F.lit(1.0)).when(a.startswith("x") | b.startswith("x") | (some == 0), F.lit(0.0)) \
        .otherwise(same / some)


def _cuts_below(cuts: list[int], value: Column) -> Column:
    """How many of the sorted ``cuts`` are at most ``value``: first among every
    w-th cut, then among the w - 1 after it (w their square root)."""
    if not cuts:
        return F.lit(0)
    w = max(1, math.isqrt(len(cuts)))
    blocks = [cuts[k:k + w] for k in range(0, len(cuts), w)]
    firsts = F.array(*[F.lit(b[0]) for b in blocks])
    inner = F.array(*[F.array(*map(F.lit, b)) for b in blocks])
    return F.aggregate(F.array(F.size(F.filter(firsts, lambda c: c <= value))), F.lit(0), lambda _, k: F.when(
        k == 0, F.lit(0)).otherwise((k - 1) * w + F.size(F.filter(F.get(inner, k - 1), lambda c: c <= value))))


def deal_in_order(rows: DataFrame, order_col: str, parts_wanted: int) -> DataFrame:
    """Rows dealt into ``_part``, about ``parts_wanted`` ranges of ``order_col``
    of about equal size (null in one of its own). The rows with the greatest value of a range are
    also sent to the range after it in descending order (from the lowest back
    to the highest) with ``_copy`` true, so that there each row finds the next
    one in descending order."""
    n = parts_wanted
    ids = rows.select(order_col)
    cuts = ids.agg(F.percentile_approx(order_col, [k / n for k in range(1, n)], 10 * n).alias("cuts")).first()["cuts"]
    cuts = sorted(set(cuts or []))  # fewer than n
    part = F.when(F.col(order_col).isNull(), F.lit(-1)).otherwise(_cuts_below(cuts, F.col(order_col)))
    tops = {r["part"]: r["top"] for r in  # one row a range
            ids.select(order_col, part.alias("part")).groupBy("part").agg(F.max(order_col).alias("top")).collect()}
    ring = sorted(tops)
    heads = rows.sparkSession.createDataFrame([(tops[p], ring[(k + 1) % len(ring)]) for k, p in enumerate(ring)],
                                              f"_top {rows.schema[order_col].dataType.simpleString()}, _before int")
    own = F.struct(part.alias("part"), F.lit(False).alias("copy"))
    copy = F.struct(F.col("_before").alias("part"), F.lit(True).alias("copy"))
    return rows.join(F.broadcast(heads), F.col(order_col).eqNullSafe(F.col("_top")), "left") \
        .withColumn("_at", F.explode(F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, copy)))) \
        .select(*rows.columns, F.col("_at.part").alias("_part"), F.col("_at.copy").alias("_copy"))


#: Lexicons up to this number of terms (8 bytes each) are broadcast; larger ones are joined by a shuffle.
BROADCAST_TERMS = 2_000_000
#: Stands in every list of terms and in the lexicon, so that no text is lost in the join.
MARK = 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", commonest: float = 10,
                 rarest: float = 1000, subsets: Sequence[Sequence[float]] = SUBSETS) -> DataFrame:
    """For every row of ``docs`` its fingerprint and that of its edited text:
    the last third of its characters replaced by the first ones of the next
    document in descending id order (after the last: the first).

    Returns ``id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``. A null text counts as empty. Equal texts have
    equal fingerprints; texts without lexicon terms are alike only if their
    term sets are equal. Rows with one id are ordered by text, descending;
    null ids come last. Other columns are not read. Ids are numbers. More and
    smaller ``subsets`` (by draw, falling) grade the likeness more finely; texts
    that share some terms are then a little alike.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = base.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).first()
    found = lexicon(base.select(terms(F.col("text")).alias("terms")), size["rows"], commonest, rarest)
    wanted = max(2 * shuffle_partitions(docs.sparkSession), -(-(size["bytes"] or 0) // PART_BYTES))
    found = stage(found.union(found.sparkSession.range(1).select(F.lit(MARK).cast("long"))).distinct(), "lexicon")
    lookup = F.broadcast(found) if found.count() <= BROADCAST_TERMS else found

    order = Window.partitionBy("_part").orderBy("_copy", F.desc_nulls_last("id"), F.desc_nulls_last("text"))
    rows = deal_in_order(base, "id", wanted).withColumn("_n", F.row_number().over(order)) \
        .withColumn("next_text", F.coalesce(F.lead("text").over(order), F.lit("")))
    third = F.floor(F.length("text") / 3).cast("int")
    rows = rows.select(
        "_part", "_n", "_copy", "id", F.length("text").cast("long").alias("n_chars"),
        terms(F.col("text")).alias("own"),
        F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - third),
                 F.substring(F.col("next_text"), F.lit(1), third)).alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited"), 256)).withColumn("edited", terms(F.col("edited")))
    carried = ["_copy", "id", "n_chars", "edited_sha256", "own_hash", "edited_hash"]
    listed = rows.withColumn("own_hash", F.xxhash64(F.sort_array("own"))) \
        .withColumn("edited_hash", F.xxhash64(F.sort_array("edited"))) \
        .select("_part", "_n", *carried, F.explode(F.concat(
            F.array(F.struct(F.lit(MARK).cast("long").alias("term"), F.lit(True).alias("own"))),
            F.transform("own", lambda t: F.struct(t.alias("term"), F.lit(True).alias("own"))),
            F.transform("edited", lambda t: F.struct(t.alias("term"), F.lit(False).alias("own"))))).alias("t")) \
        .select("_part", "_n", *carried, "t.term", "t.own")
    real = F.col("term") != MARK
    gathered = listed.join(lookup, "term").groupBy("_part", "_n").agg(
        *[F.first(c).alias(c) for c in carried],
        F.sort_array(F.collect_list(F.when(real & F.col("own"), F.col("term")))).alias("own"),
        F.sort_array(F.collect_list(F.when(real & ~F.col("own"), F.col("term")))).alias("edited"))
    printed = gathered.withColumn("own_parts", parts(F.col("own"), subsets)).withColumn("edited_parts", parts(F.col("edited"), subsets)) \
        .withColumn("fingerprint", fingerprint(F.col("own_parts"), F.col("own"), F.col("own_hash"))) \
        .withColumn("edited_fingerprint", fingerprint(F.col("edited_parts"), F.col("edited"), F.col("edited_hash")))
    following = F.lead("fingerprint").over(Window.partitionBy("_part").orderBy("_n"))
    done = printed.withColumn("next_fingerprint", following).where("not _copy")
    return done.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
