"""Periodic runs of words: stretches that repeat a block of words four times or more.

A run has a smallest period q; periods fall into octaves [P, 2P), P a power of
two. A document is exploded into overlapping tiles for its octaves: tiles of an
octave are 16P words long and overlap by 8P, more than any 4q, so that what a
run shares with a tile holds four periods in at least one tile, and what two
neighbouring tiles see of it overlaps by more than a period. The octaves up
to ``BASE`` share the tiles of the largest, longer ones have tiles of their own.

A tile is solved alone. Every stretch of four periods holds a boundary (a
multiple of P) near its start, where the next 2P words come again q words
later; hashes of 2P words name these (boundary, q). The Z-function of the words from
the boundary then gives the exact stretch to the right, and whether q is itself a
multiple of a smaller period; the words before it give the stretch to the left.

Fragments are shuffled by document and period and stitched where they overlap
by a period; only runs of the whole document count. Texts of documents without
a fragment stay where they are: their results need no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.staging import stage

WORD_GAP = r"[ \t-\r]+"
#: The octaves up to this P share their tiles.
BASE = 512
#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
_U = np.uint64


def z_values(x: list, limit: int) -> list[int]:
    """z[i], i < ``limit``: how many leading elements of x[i:] equal those of x."""
    n = len(x)
    z = [n] + [0] * (min(limit, n) - 1)
    left = right = 0
    for i in range(1, len(z)):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of joined windows from the hashes of their halves."""
    x = a * _U(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def fragments(words: np.ndarray, low: int, high: int) -> list[tuple[int, int, int]]:
    """The stretches (period, start, end) of a tile of 64-bit word numbers that
    have a smallest period in the octaves ``low`` to ``high``, hold it four times
    and can't be extended inside the tile."""
    n, found, listed = len(words), [], None
    h, p = words.view(np.uint64), 1  # h: hashes of windows of p words, then of 2p
    while p <= high and LEAST_PERIODS * p <= n:
        h = _pair(h[:-p], h[p:])
        if p >= low and len(h) > p:
            marks = (len(h) - 1) // p  # boundaries 0, p, 2p, ... with a window q words later
            later = h[p:(marks + 1) * p]
            hits = np.flatnonzero(later == np.repeat(h[:marks * p:p], p)[:len(later)])
            if len(hits):
                listed = listed or words.tolist()
                found += _at_boundaries(listed, p, (hits // p * p).tolist(), (hits % p + p).tolist())
        p *= 2
    return found


def _at_boundaries(x: list, p: int, boundaries: list[int], periods: list[int]) -> list[tuple[int, int, int]]:
    found, ends = [], {}  # ends: the end of the last stretch seen of each period
    z, at = [], -1
    small, small_end = 0, -1  # a period below p, and where its stretch around the last boundary ends
    for b, q in zip(boundaries, periods):
        if b + q <= ends.get(q, -1) or (small and q % small == 0 and b + q <= small_end):
            continue
        if b != at:
            at, z = b, z_values(x[b:], 2 * p)
            short = next((d for d in range(1, p) if d + z[d] >= 3 * p), 0)
            if short:
                small, small_end = short, b + short + z[short]
                if q % small == 0:
                    continue
        k = 0
        while b > k and x[b - 1 - k] == x[b + q - 1 - k]:
            k += 1
        start, end = b - k, b + q + z[q]
        ends[q] = end
        if end - start >= LEAST_PERIODS * q and not (small and q % small == 0 and b + q <= small_end):
            found.append((q, start, end))
    return found


def _solve(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    for tiles, offsets, lows, highs in batches:
        yield pd.Series([
            [{"period": q, "start": int(at) + s, "end": int(at) + e} for q, s, e in fragments(np.asarray(t, dtype=np.int64), lo, hi)]
            for t, at, lo, hi in zip(tiles, offsets, lows, highs)])


solve = F.pandas_udf(_solve, T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("period", "start", "end")])))


def split_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def tile_plan(n: Column, base: int = BASE) -> Column:
    """For a document of ``n`` words its tiles as (number, offset, width, low,
    high): those of the octaves up to ``base``, then those of each longer octave
    that fits in four times. Tile 0 is always there."""
    octave = F.greatest(F.lit(0), F.floor(F.log2(n / (LEAST_PERIODS * base))))  # of the longest possible period
    one = F.lit(1).cast("long")

    def tiles(k: Column) -> Column:
        p = F.lit(base).cast("long") * F.pow(F.lit(2), k).cast("long")
        last = F.greatest(F.lit(0).cast("long"), F.ceil((n - 16 * p) / (8 * p)))
        return F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: F.struct(
            (i + F.when(k == 0, 0).otherwise(1)).alias("number"), (i * 8 * p).alias("offset"), (16 * p).alias("width"),
            F.when(k == 0, one).otherwise(p).alias("low"), p.alias("high")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.coalesce(octave, F.lit(0)).cast("int")), tiles))


def stitch(found: DataFrame) -> DataFrame:
    """Runs (key, start, length, period) from fragments (key, period, start,
    end): those of a key and period that overlap by a period are one stretch, and
    of stretches at one place the smallest period counts. Repeated rows don't matter."""
    by_period = Window.partitionBy("key", "period").orderBy("start", "end")
    before = F.max("end").over(by_period.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before - F.col("start") >= F.col("period"), 0).otherwise(1)
    parts = found.distinct().withColumn("fresh", fresh).withColumn("part", F.sum("fresh").over(by_period))
    whole = parts.groupBy("key", "period", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    length = F.col("end") - F.col("start")
    return whole.where((length >= LEAST_WORDS) & (length >= LEAST_PERIODS * F.col("period"))) \
        .groupBy("key", "start", "end").agg(F.min("period").alias("period")) \
        .select("key", "start", length.alias("length"), "period")


def greatest(runs: Column) -> Column:
    """Of runs ordered by start and period the first with the greatest
    length / period, compared in whole numbers."""
    return F.aggregate(F.slice(runs, F.lit(2), F.size(runs)), F.element_at(runs, 1), lambda a, r: F.when(
        r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a))


def kept_words(words: Column, runs: Column) -> Column:
    """The words outside all runs or among the first ``period`` of every run
    that holds them. ``runs`` is ordered by start."""
    drops = F.array_sort(F.transform(runs, lambda r: F.struct(
        (r["start"] + r["period"]).alias("start"), (r["start"] + r["length"]).alias("end"))))
    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,size:bigint>>").alias("gaps"))
    total = F.size(words).cast("long")

    def gap(seen: Column, upto: Column) -> Column:
        own = F.struct(seen["at"].alias("start"), (upto - seen["at"]).alias("size"))
        return F.when(upto > seen["at"], F.concat(seen["gaps"], F.array(own))).otherwise(seen["gaps"])

    gaps = F.aggregate(drops, first, lambda seen, d: F.struct(
        F.greatest(seen["at"], d["end"]).alias("at"), gap(seen, d["start"]).alias("gaps")), lambda seen: gap(seen, total))
    return F.flatten(F.transform(gaps, lambda g: F.slice(words, (g["start"] + 1).cast("int"), g["size"].cast("int"))))


def periodic_runs(docs: DataFrame, words: Column, id_col: str = "doc_id") -> DataFrame:
    """All runs of every row's ``words`` (an array of strings, null as empty).

    Returns ``id_col``, ``words`` (only where there is a run), ``plain_sha256``
    (digest of all words joined by a space) and ``runs``: (start, length,
    period) by start, then period, empty without runs. A run is a stretch of
    words with smallest period q, of at least ``LEAST_WORDS`` words and
    ``LEAST_PERIODS`` periods, that no neighbouring word extends. Rows that
    repeat an id and words give the same result each; null ids are allowed;
    other columns are not read. A long document is solved tile by tile; only its
    list of runs is gathered.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(words, F.array().cast("array<string>")).alias("w"))
    joined = F.array_join("w", " ")
    n = F.size("w").cast("long")
    rows = rows.select("id", joined.alias("plain"), n.alias("n"), F.transform("w", lambda w: F.xxhash64(w)).alias("numbers"))
    rows = rows.withColumn("key", F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), "plain"))))
    tiles = F.transform(tile_plan(F.col("n")), lambda t: F.struct(
        t["number"].alias("number"), t["offset"].alias("offset"), t["low"].alias("low"), t["high"].alias("high"),
        F.slice("numbers", (t["offset"] + 1).cast("int"), t["width"].cast("int")).alias("numbers"),
        F.when(t["number"] == 0, F.struct("id", "n", "plain")).alias("own")))
    tiles = rows.select("key", F.size(tile_plan(F.col("n"))).alias("tiles"), F.inline(tiles))
    found = tiles.withColumn("found", solve("numbers", "offset", "low", "high"))
    # the only pass over the texts; a text goes on if its document has fragments or further tiles
    solved = stage(found.select(
        "key", "number", "found", "own.id", F.sha2("own.plain", 256).alias("plain_sha256"),
        F.when((F.size("found") > 0) | (F.col("tiles") > 1), F.col("own.plain")).alias("plain")), "solved-tiles")
    runs = stitch(solved.select("key", F.inline("found"))).groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    first = solved.where("number = 0")
    none = F.array().cast("array<struct<start:bigint,length:bigint,period:bigint>>")
    done = first.where("plain is null").select(F.col("id").alias(id_col), F.lit(None).cast("array<string>").alias("words"),
                                               "plain_sha256", none.alias("runs"))
    some = first.where("plain is not null").join(runs, "key", "left").select(
        F.col("id").alias(id_col), F.when(F.col("runs").isNotNull(), split_words(F.col("plain"))).alias("words"),
        "plain_sha256", F.coalesce("runs", none).alias("runs"))
    return done.unionByName(some)


def repeated_tail(words: Column, doc_id: Column) -> Column:
    """Words of the documents with h % 10 = 0, h the CRC-32 of the decimal id,
    with a periodic end: g = h / 10; from word a = g % n on, the p =
    1 + (n - a) / (3 + g % 8) words at a come again and again. Others, and those
    with a null id, are unchanged."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    n, g = F.size(words).cast("long"), F.floor(h / 10)
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + g % 8))
    tail = F.transform(F.sequence(F.lit(0).cast("long"), n - a - 1), lambda i: F.element_at(words, (a + i % p + 1).cast("int")))
    return F.when((h % 10 == 0) & (n > 0), F.concat(F.slice(words, F.lit(1), a.cast("int")), tail)).otherwise(words)
