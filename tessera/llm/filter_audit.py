"""How quality filters interact: what each removes in every order of applying them.

A document is reduced to the set of filters it fails. Documents are counted by
part and set (a mask cell); what an order of the filters does to a cell depends
on its set alone, so each cell folds over the array of all orders and gives one
weighted struct for each order and step. The arrays of a part's cells (at most
2^5) are added element by element.

Only DataFrame functions are used, and no text is shuffled: the copy filter
moves a digest of each text.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD_GAP = r"[ \t-\r]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS = "ABCDE"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def failed_alone(text: Column, least_words: int = 200, distinct_percent: int = 50, capital_percent: int = 3) -> Column:
    """The filters of A to D that a text (not null) fails by itself, as text
    in alphabetical order. A: under ``least_words`` words. B: distinct words
    under ``distinct_percent`` of the words. C: more than ``capital_percent`` of
    the characters are A-Z. D: holds one of ``#$%&*|``. An empty text fails A only."""
    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return F.concat(
        F.when(F.size(words) < least_words, "A").otherwise(""),
        F.when(100 * F.size(F.array_distinct(words)) < distinct_percent * F.size(words), "B").otherwise(""),
        F.when(100 * capitals > capital_percent * F.length(text), "C").otherwise(""),
        F.when(text.rlike("[#$%&*|]"), "D").otherwise(""))


def mask_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               part_col: str = "lang") -> DataFrame:
    """Documents counted by part and failed filters: (part, fails, n, good, toxic).

    E, the copy filter, is failed by a document whose text stands in a row
    with a smaller id. A null text is empty and a null part the empty string.
    Rows that repeat an id and a text are each counted, and fail E together
    or not at all. A null id is neither smaller nor greater than any, so such
    rows don't fail E and make no other row fail it, and have no label. Of several labels of an id the
    greatest quality and toxicity hold.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.unhex(F.sha2(text, 256)).alias("digest"), failed_alone(text).alias("fails"))
    # null ids are dealt by their text; ``known`` keeps them apart from the labelled ids
    rows = rows.withColumn("known", F.col("id").isNotNull()).withColumn("key", F.coalesce("id", F.xxhash64("digest")))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("key")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")).withColumn("known", F.lit(True))
    marked = rows.join(marks, ["key", "known"], "left").withColumns(
        {c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    kind = ["digest", "fails", "part", "good", "toxic"]
    by_id = marked.groupBy("key", "known", *kind).agg(F.count(F.lit(1)).alias("n"))
    by_kind = by_id.groupBy(*kind).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(~F.col("known"), F.col("n"))), F.lit(0)).alias("n_unknown"),
        F.min(F.when(F.col("known"), F.struct("key", "n"))).alias("least"))
    # one row a text, part and label by now: a window over a text's rows is short
    first = F.min("least.key").over(Window.partitionBy("digest"))
    originals = F.col("n_unknown") + F.when(F.col("least.key") == F.col("first"), F.col("least.n")).otherwise(0)
    split = by_kind.withColumn("first", first).withColumn("originals", originals).select(
        "part", "good", "toxic", F.inline(F.array(
            F.struct(F.col("fails"), F.col("originals").alias("n")),
            F.struct(F.concat("fails", F.lit("E")).alias("fails"), (F.col("n") - F.col("originals")).alias("n")))))
    return split.where("n > 0").groupBy("part", "fails").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def fold_orders(fails: Column, n: Column, good: Column, toxic: Column, orders: Sequence[str]) -> Column:
    """One struct for each order and step, in that order: what the step's
    filter does to ``n`` documents that fail ``fails``."""
    zero = F.lit(0).cast("long")
    none = F.array().cast("array<struct<filter_order:string,step:int,letter:string,"
                          + ",".join(f"{c}:bigint" for c in COUNTS) + ">>")

    def walk(order: Column) -> Column:
        def step(seen: Column, i: Column) -> Column:
            letter = F.substring(order, i, F.lit(1))
            hit, gone = F.contains(fails, letter), seen["gone"]
            here = hit & ~gone

            def count(when: Column, what: Column = n) -> Column:
                return F.when(when, what).otherwise(zero)

            done = F.struct(
                order.alias("filter_order"), i.alias("step"), letter.alias("letter"),
                count(~gone & ~hit).alias("kept"), count(here).alias("removed"), count(hit & gone).alias("redundant"),
                count(fails == letter).alias("unique_fails"), count(here, good).alias("good_lost"),
                count(here, toxic).alias("toxic_lost"))
            return F.struct((gone | hit).alias("gone"), F.concat(seen["steps"], F.array(done)).alias("steps"))

        start = F.struct(F.lit(False).alias("gone"), none.alias("steps"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(len(orders[0]))), start, step, lambda seen: seen["steps"])

    return F.flatten(F.transform(F.array(*map(F.lit, orders)), walk))


def _added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(
        *[x[c].alias(c) for c in ("filter_order", "step", "letter")], *[(x[c] + y[c]).alias(c) for c in COUNTS]))


def interactions(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """For each part, order of the filters and step: (part, filter_order,
    step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley); zeros are included. ``cells`` comes from ``mask_cells``. No part, no rows."""
    orders = ["".join(p) for p in permutations(letters)]
    folded = cells.select("part", fold_orders(*map(F.col, ("fails", "n", "good", "toxic")), orders).alias("steps"))
    merged = folded.groupBy("part").agg(F.collect_list("steps").alias("cells")).select(  # at most 2^5 cells
        "part", F.aggregate(F.slice("cells", 2, 1 << len(letters)), F.element_at("cells", 1), _added).alias("steps"))

    def total(letter: str) -> Column:
        own = F.filter("steps", lambda s: s["letter"] == letter)
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, s: a + s["removed"])

    by_letter = F.map_from_arrays(F.array(*map(F.lit, letters)), F.array(*map(total, letters)))
    return merged.select("part", by_letter.alias("totals"), F.inline("steps")).select(
        "part", "filter_order", "step", *COUNTS, F.element_at("totals", F.col("letter")).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """The five filters over whole ``docs``: ``interactions`` of their ``mask_cells``."""
    return interactions(mask_cells(docs, labels, **columns))
