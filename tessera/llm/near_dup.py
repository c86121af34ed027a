"""Near-duplicate documents by an inverted join of MinHash signatures.

1. Every text becomes its set of word shingles, and the set a signature of
   ``K`` coordinates. Texts with equal sets form a class at once; one
   representative a class goes on.
2. Representatives are posted under their (coordinate, value) pairs. Two sets
   that are alike enough share at least ``T`` of ``K`` pairs (but for a chance
   of about 1e-7 at the threshold), so they meet already in the ``K - T + 1``
   rarest pairs of each: only this prefix is posted, the long lists (of a
   passage that many documents share) are skipped.
3. In each list the representative with the most collisions overall is the
   hub. Each member counts its collisions with the hubs of its lists, is
   compared with the best one if enough coordinates agree, and the links found
   are merged to components: this settles most lists, large ones too.
4. Lists that still hold several components are compared in full, in blocks:
   first by signatures (collisions at least ``T``, sizes that allow the
   likeness; a pair counts in the first list that it shares), then, only for
   the members with such a pair, on their full shingle sets. What leaves a
   block is at most one row a member, never the pairs.

Links are always decided on full sets: 100 * intersection >= percent * union.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import shingles
from tessera.llm.components import components
from tessera.sources.staging import stage

SKETCH = "struct<n:bigint,key:binary,sig:array<int>>"
_SKETCH = pa.struct([("n", pa.int64()), ("key", pa.binary()), ("sig", pa.list_(pa.int32()))])
#: Ids up to this number (8 bytes each) are broadcast to fetch texts; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def sketched(text: Column, coordinates: int, size: int) -> Column:
    """Size, key and signature of each text's shingle set; null for texts
    without words."""
    multipliers = shingles.coordinates(coordinates)

    @F.arrow_udf(SKETCH)
    def sketch(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            s = shingles.shingle_set(t.as_py(), size)
            out.append({"n": len(s), "key": shingles.set_key(s), "sig": shingles.signature(s, multipliers)}
                       if len(s) else None)
        return pa.array(out, type=_SKETCH)

    return sketch(text)


def _agreement(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def _sizes_allow(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _forest(linked: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links, the first member of each member's
    component."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(sets: list[np.ndarray], allowed: np.ndarray, percent: int) -> np.ndarray:
    """Which allowed pairs of a block are alike enough, on the full sets."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    m = len(sets)
    rows, cols = np.nonzero(np.triu(allowed | allowed.T, 1))
    out = np.zeros((m, m), dtype=bool)
    if len(rows) <= 4 * m:
        for a, b in zip(rows, cols):
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            out[a, b] = out[b, a] = 100 * both >= percent * (n[a] + n[b] - both)
        return out
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), n)
    shared = np.bincount(column, minlength=len(values))[column] > 1  # others are in no intersection
    number = np.cumsum(np.bincount(column[shared], minlength=len(values)) > 0) - 1
    column, owner = number[column[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((m, m), dtype=np.float32)  # counts below 2**24 are exact
    for first in range(0, int(column.max(initial=-1)) + 1, 1024):
        a, b = np.searchsorted(column, [first, first + 1024])
        part = np.zeros((m, 1024), dtype=np.float32)
        part[owner[a:b], column[a:b] - first] = 1
        both += part @ part.T
    both = both.astype(np.int64)
    out = (allowed | allowed.T) & ((100 + percent) * both >= percent * (n[:, None] + n[None, :]))
    np.fill_diagonal(out, False)
    return out


def _fetch(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of the documents in ``ids (rid)``."""
    ids = stage(ids.distinct(), "ids")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return stage(docs.join(ids, docs["id"] == ids["rid"], "left_semi").select(F.col("id").alias("rid"), "text"), "texts")


def _confirmed(units: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """Edges ``(u, v)`` between members of a unit that links on full sets
    connect. ``units``: (unit, rid, comp, side); members of side 0 are compared
    with those of side 1, those of side 2 with each other, and none with one
    of its own component. Several units share a group; a unit is bounded by
    the caller, so a group is."""
    groups = max(1, math.ceil(units.count() / 1024))
    rows = units.join(texts, "rid").withColumn("g", F.pmod(F.xxhash64("unit"), F.lit(groups)))

    def confirm(pdf: pd.DataFrame) -> pd.DataFrame:
        sets, out = {}, []
        for _, own in pdf.groupby("unit", sort=False):
            rid, comp, side = own["rid"].to_numpy(), own["comp"].to_numpy(), own["side"].to_numpy()
            for r, t in zip(own.index, own["text"]):
                key = (own.at[r, "rid"], t)
                if key not in sets:
                    sets[key] = shingles.shingle_set(t, size)
            mine = [sets[key] for key in zip(rid, own["text"])]
            allowed = (comp[:, None] != comp[None, :]) & ((side[:, None] != side[None, :]) | (side == 2)[:, None])
            label = _forest(_links(mine, allowed, percent))
            out += [(rid[k], rid[x]) for k, x in enumerate(label) if k != x]
        return pd.DataFrame(out, columns=["u", "v"])

    kind = texts.schema["rid"].dataType.simpleString()
    return rows.groupBy("g").applyInPandas(confirm, f"u {kind}, v {kind}")


def _postings(reps: DataFrame, coordinates: int, agree: int) -> DataFrame:
    """The rarest pairs of each signature in ``reps (rid, n, sig)``, without
    pairs that nobody shares: (pair, c, rid, h, weight, mask). An id with
    several texts has several signatures, told apart by ``h``; bit c of
    ``mask`` is set if coordinate c of that signature is posted."""
    pairs = reps.select("rid", "sig").distinct() \
        .select("rid", F.xxhash64("sig").alias("h"), F.posexplode("sig").alias("c", "v")) \
        .select("rid", "h", "c", F.shiftleft(F.col("c").cast("long"), 32).bitwiseOR(
            F.col("v").cast("long").bitwiseAND(F.lit((1 << 32) - 1))).alias("pair"))
    often = pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    own = Window.partitionBy("rid", "h")
    posted = pairs.join(often, "pair").withColumn("nth", F.row_number().over(own.orderBy("f", "pair"))) \
        .withColumn("common", F.count(F.lit(1)).over(own)).withColumn("weight", F.sum("f").over(own)) \
        .where(F.col("nth") <= (coordinates - agree + 1) - (coordinates - F.col("common"))) \
        .withColumn("mask", F.bit_or(F.expr("shiftleft(1L, c)")).over(own))
    return posted.select("pair", "c", "rid", "h", "weight", "mask")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85,
                    size: int = shingles.SIZE, coordinates: int = 24, agree: int = 10,
                    block: int = 1024) -> DataFrame:
    """``(id_col, n_shingles, component_id, kept)`` for every row of ``docs``.

    Documents whose shingle sets have at least ``percent`` in common (100 *
    intersection over union) are linked; ``component_id`` is the least id
    reachable over links, ``kept`` tells whether it is the row's own. A null,
    empty or wordless text has size 0 and stands alone. Rows with the same id
    are one document: their links are pooled. Rows with a null id are never
    linked, have a null component and are kept. Other columns are not read.

    ``agree`` of ``coordinates`` must be so low that a pair at the threshold
    agrees in fewer with negligible probability: 10 of 24 leaves 1.5e-7 at 85%.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    sketches = stage(docs.select("id", sketched(F.col("text"), coordinates, size).alias("s")).select("id", "s.*"),
                     "sketches")
    sets = sketches.where("n > 0 and id is not null")
    # written, so that the join below is one of two plain tables and Spark can
    # split the rows of a class that holds a large share of the documents
    classes = stage(sets.groupBy("key").agg(F.min("id").alias("rid")), "classes")
    member = sketches.join(classes, "key", "left")  # rows without words match nothing
    member = stage(member.select("id", F.coalesce("n", F.lit(0).cast("long")).alias("n"),
                                 F.when(F.col("id").isNotNull(), F.coalesce("rid", "id")).alias("rid"),
                                 F.when(F.col("id") == F.col("rid"), F.col("sig")).alias("sig")), "members")
    reps = member.where("sig is not null").select("rid", "n", "sig").distinct()

    posted = stage(_postings(reps, coordinates, agree), "postings")

    # the best hub of each member
    hubs = posted.groupBy("pair").agg(F.min(F.struct((-F.col("weight")).alias("w"), "rid")).alias("hub"),
                                      F.count(F.lit(1)).alias("size")).where("size > 1")
    met = posted.join(hubs, "pair").where("rid <> hub.rid").groupBy("rid", "hub").agg(F.count(F.lit(1)).alias("k"))
    best = met.groupBy("rid").agg(F.min(F.struct((-F.col("k")).alias("k"), "hub")).alias("b")) \
        .select("rid", F.col("b.hub.rid").alias("hub"))
    left = reps.select("rid", F.col("n").alias("n1"), F.col("sig").alias("s1"))
    right = reps.select(F.col("rid").alias("hub"), F.col("n").alias("n2"), F.col("sig").alias("s2"))
    star = stage(best.join(left, "rid").join(right, "hub")
                 .where(_sizes_allow(F.col("n1"), F.col("n2"), percent))
                 .where(_agreement(F.col("s1"), F.col("s2")) >= agree).select("hub", "rid"), "stars")
    chunks = star.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / 256).alias("chunks"))
    rays = star.join(chunks, "hub").withColumn("chunk", F.pmod(F.xxhash64("rid"), F.col("chunks"))) \
        .withColumn("unit", F.xxhash64("hub", "chunk"))
    side = F.lit(0).alias("side")
    units = stage(rays.select("unit", "rid", F.col("rid").alias("comp"), F.lit(1).alias("side"))
                  .union(rays.select("unit", F.col("hub").alias("rid"), F.col("hub").alias("comp"), side).distinct()),
                  "units")
    links = _confirmed(units, _fetch(docs, units.select("rid")), percent, size)
    pooled = member.where("id is not null").groupBy("id").agg(F.min("rid").alias("u"), F.max("rid").alias("v"))
    links = stage(links.union(pooled.where("u <> v").select("u", "v")), "links")
    parts = components(links)

    # lists that still hold several components, in blocks: first by signatures
    comp = posted.join(parts.withColumnRenamed("node", "rid"), "rid", "left") \
        .withColumn("comp", F.coalesce("component", "rid"))
    mixed = comp.groupBy("pair").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("a"),
                                     F.max("comp").alias("b")).where("a <> b").select("pair", "size")
    mixed = comp.join(mixed, "pair").join(reps.withColumn("h", F.xxhash64("sig")), ["rid", "h"]) \
        .withColumn("blocks", F.ceil(F.col("size") / block)) \
        .withColumn("own", F.pmod(F.xxhash64("rid"), F.col("blocks"))) \
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))) \
        .withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other")) \
        .withColumn("side", F.when(F.col("p") == F.col("q"), 2).when(F.col("own") == F.col("p"), 0).otherwise(1)) \
        .withColumn("unit", F.xxhash64("pair", "p", "q"))
    mixed = stage(mixed.select("unit", "c", "rid", "comp", "n", "sig", "mask", "side"), "mixed")
    groups = max(1, math.ceil(mixed.count() / 4096))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        keep = []
        for _, own in pdf.groupby("unit", sort=False):
            sig = np.stack(own["sig"].to_numpy())
            c = int(own["c"].iloc[0])
            bits = (own["mask"].to_numpy()[:, None] >> np.arange(coordinates)[None, :]) & 1 == 1
            n, comp, side = (own[x].to_numpy() for x in ("n", "comp", "side"))
            found = np.zeros(len(own), dtype=bool)
            for a in range(0, len(own), 128):
                z = slice(a, a + 128)
                equal = sig[z, None, :] == sig[None, :, :]
                ok = (comp[z, None] != comp[None, :]) & ((side[z, None] != side[None, :]) | (side == 2)[None, :])
                ok &= np.minimum(n[z, None], n[None, :]) * 100 >= np.maximum(n[z, None], n[None, :]) * percent
                ok &= equal.sum(axis=2) >= agree
                ok &= ~(equal[:, :, :c] & bits[z, None, :c] & bits[None, :, :c]).any(axis=2)
                found[z] |= ok.any(axis=1)
            keep.append(own.loc[found, ["unit", "rid", "comp", "side"]])
        return pd.concat(keep)

    near = stage(mixed.withColumn("g", F.pmod(F.xxhash64("unit"), F.lit(groups))).groupBy("g").applyInPandas(
        meet, f"unit long, rid {kind}, comp {kind}, side int"), "near")
    if not near.isEmpty():
        more = _confirmed(near, _fetch(docs, near.select("rid")), percent, size)
        parts = components(links.union(more))
    return member.join(parts.withColumnRenamed("node", "rid"), "rid", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.coalesce("component", "rid").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "rid"), F.lit(True)).alias("kept"))
