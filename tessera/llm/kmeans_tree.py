"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is grown by Spark: its top is fitted on a bounded sample of unit vectors,
then every leaf that holds too many rows of the table gets a subtree fitted on a
bounded sample of its own rows, all such leaves at once, until leaves are small
or the tree has as many as may be broadcast. Every row is indexed:
it goes down to the leaf with the nearest centres. A query visits leaves best
bin first: a priority queue holds the branches not yet taken by the cosine of
their centres. How many leaves are visited is calibrated: for a bounded sample
of queries the true neighbours are found by brute force over all rows, and the
visits are widened until the wanted share of them lies in visited leaves.

Rows with equal vectors are indexed once, with their ``k + 1`` smallest ids
(no query needs more), so a vector that a third of the rows share costs no more
than another. Leaves and their queries are cut into blocks of bounded size.
"""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import shuffle_partitions
from tessera.sources.staging import stage

#: Leaves that a subtree may have.
MOST_BELOW = 512


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _centres(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means; empty clusters are left out."""
    chosen = [int(rng.integers(len(x)))]
    far = 1 - x @ x[chosen[0]]
    for _ in range(k - 1):
        if far.max() <= 1e-12:
            break
        chosen.append(int(far.argmax()))
        far = np.minimum(far, 1 - x @ x[chosen[-1]])
    c = x[chosen]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        held = np.bincount(own, minlength=len(c)) > 0
        c = _unit(np.where(held[:, None], sums, c))
    own = (x @ c.T).argmax(axis=1)
    held = np.unique(own)
    return c[held], np.searchsorted(held, own)


class Tree:
    """Nodes as (centres, children); a child below zero is leaf ``-1 - child``."""

    def __init__(self, x: np.ndarray, branches: int = 8, leaf_size: int = 64, seed: int = 11):
        self.nodes: list[tuple[np.ndarray, list[int]]] = []
        self.leaves = 0
        rng = np.random.default_rng(seed)
        self.root = self._grow(x, branches, leaf_size, rng)

    def _grow(self, x, branches, leaf_size, rng) -> int:
        if len(x) > leaf_size:
            c, own = _centres(x, branches, rng)
            if len(c) > 1:
                children = [self._grow(x[own == j], branches, leaf_size, rng) for j in range(len(c))]
                self.nodes.append((c, children))
                return len(self.nodes) - 1
        self.leaves += 1
        return -self.leaves

    def graft(self, subtrees: dict[int, Tree]) -> None:
        """Put a subtree in the place of each of some leaves. Its first leaf
        keeps the number, the others get new ones."""
        place = {-1 - child: (n, k) for n, (_, children) in enumerate(self.nodes) for k, child in enumerate(children) if child < 0}
        for leaf, sub in sorted(subtrees.items()):
            if sub.root < 0:
                continue
            offset, more = len(self.nodes), self.leaves - 1

            def moved(child: int) -> int:
                return child + offset if child >= 0 else -1 - (leaf if child == -1 else more - 1 - child)

            self.nodes += [(c, [moved(child) for child in children]) for c, children in sub.nodes]
            self.leaves += sub.leaves - 1
            if leaf in place:
                n, k = place[leaf]
                self.nodes[n][1][k] = sub.root + offset
            else:
                self.root = sub.root + offset

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector, by the nearest centre at each level."""
        out = np.zeros(len(x), dtype=np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
                continue
            c, children = self.nodes[node]
            own = (x[rows] @ c.T).argmax(axis=1)
            todo += [(child, rows[own == j]) for j, child in enumerate(children) if (own == j).any()]
        return out

    def visits(self, q: np.ndarray):
        """Leaves in best-bin-first order for one unit vector."""
        queue = [(-2.0, 0, self.root)]
        pushed = 0
        while queue:
            node = heapq.heappop(queue)[2]
            if node < 0:
                yield -1 - node
                continue
            c, children = self.nodes[node]
            for score, child in zip(c @ q, children):
                pushed += 1
                heapq.heappush(queue, (-float(score), pushed, child))


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))


#: More than two ways to compute one cosine of unit vectors differ.
MARGIN = 1e-9


def _nearest(q: np.ndarray, x: np.ndarray, least_id: np.ndarray, k: int):
    """For each query (index, row of x, cosine) of the ``k`` nearest rows,
    ties to the smaller id. Candidates are cut by a fast product, but for its
    rounding; their cosines are computed in one fixed order."""
    fast = _unit(q) @ _unit(x).T
    m = max(0, len(x) - k)
    cut = np.partition(fast, m, axis=1)[:, m] - MARGIN
    norm = np.sqrt((x * x).sum(axis=1))
    for i in range(len(q)):
        rows = np.flatnonzero(fast[i] >= cut[i])
        score = (x[rows] * q[i]).sum(axis=1) / (norm[rows] * np.sqrt((q[i] * q[i]).sum()))
        for j in np.lexsort((least_id[rows], -score))[:k]:
            yield i, int(rows[j]), float(score[j])


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not zero."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    norm = F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    return F.coalesce(fine & (norm > 0) & (norm < float("inf")), F.lit(False))


def search(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5,
           sample: int = 16384, calibration: int = 200, recall: float = 0.95, block: int = 2048, leaf_rows: int = 256,
           most_leaves: int = 65536) -> DataFrame:
    """The ``k`` nearest other rows of each query row by cosine, in double
    precision: ``query_id, rank`` (int, from 1), ``vec_id, score``; nearest
    first, ties to the smaller id. With fewer candidates, all of them.

    ``is_query`` is a condition on ``id_col``. Rows without an id and vectors
    that aren't ``usable`` take no part; vectors of different lengths are never
    compared (one tree for each length; lengths of at most ``leaf_rows`` vectors
    are a single leaf each, all in one job). Equal ids are one
    candidate, by its best score. ``sample`` rows fit the top of the tree, and again as many
    the subtree of each leaf of more than ``leaf_rows`` rows, up to ``most_leaves``
    leaves (beyond it leaves grow); ``calibration`` queries set
    the number of visited leaves so that ``recall`` of their true neighbours is
    found; all are drawn by hashes of ids and vectors. Other columns are not read.
    """
    spark = rows.sparkSession
    own = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), is_query.alias("asks")) \
        .where(F.col("id").isNotNull() & usable(F.col("v"))).select(
            "id", F.transform("v", lambda x: x.cast("double")).alias("v"), F.coalesce("asks", F.lit(False)).alias("asks"),
            F.size("v").alias("dim"), F.xxhash64("v").alias("h1"), F.hash("v").alias("h2"))
    kind = rows.schema[id_col].dataType.simpleString()
    # equal vectors once, with their k + 1 smallest ids: the row limit is applied before the shuffle
    least = Window.partitionBy("h1", "h2").orderBy("id")
    reps = stage(own.select("h1", "h2", "id", "v", "dim").dropDuplicates(["h1", "h2", "id"])
                 .withColumn("nth", F.row_number().over(least)).where(F.col("nth") <= k + 1)
                 .groupBy("h1", "h2").agg(F.first("v").alias("v"), F.first("dim").alias("dim"), F.sort_array(F.collect_list("id")).alias("ids")),
                 "vectors")
    queries = own.where("asks").select("id", "h1", "h2", "v", "dim")
    asked = stage(queries.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.first("dim").alias("dim"), F.min("id").alias("id")), "queries")
    counts = reps.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    large = {r["dim"]: r["n"] for r in counts.where(F.col("n") > leaf_rows).collect()}
    few = ~F.col("dim").isin(list(large)) if large else F.lit(True)
    leaf = F.col("dim").cast("long")
    found = [_compared(reps.where(few).withColumn("leaf", leaf), asked.where(few).select("h1", "h2", leaf.alias("leaf"), F.lit(0).alias("nth")),
                       asked, queries, k, block, kind)]
    for dim, total in sorted(large.items()):
        mine, asking = reps.where(F.col("dim") == dim), asked.where(F.col("dim") == dim)
        tree, sizes = grown(mine, total, sample, leaf_rows, most_leaves)
        leaves = indexed(mine, tree)
        width = _calibrated(leaves, _drawn(asking, asking.count(), calibration), tree, k, recall)
        found.append(_compared(leaves, _routed(asking, tree, sizes, width, k), asked, queries, k, block, kind))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def _drawn(rows: DataFrame, total: int, wanted: int) -> DataFrame:
    """About ``wanted`` of ``total`` rows, by a hash of the id."""
    share = min(1.0, wanted / max(1, total))
    return rows.where(F.pmod(F.xxhash64(F.lit("draw"), "id"), F.lit(1 << 30)) < int(share * (1 << 30)))


def _leaf_of(rows: DataFrame, tree: Tree, columns: list[str]) -> DataFrame:
    """``columns`` of ``rows`` and the leaf of each row's vector."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def index(batches):
        for pdf in batches:
            out = pdf[columns].copy()
            out["leaf"] = shared.value.leaf_of(_unit(_matrix(pdf["v"])))
            yield out

    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    return rows.mapInPandas(index, f"{kept}, leaf long")


def indexed(rows: DataFrame, tree: Tree) -> DataFrame:
    return stage(_leaf_of(rows, tree, ["h1", "h2", "v", "ids"]), "leaves")


def grown(reps: DataFrame, total: int, sample: int, leaf_rows: int, most_leaves: int) -> tuple[Tree, dict[int, tuple[int, int]]]:
    """A tree whose leaves hold at most about ``leaf_rows`` of the ``total``
    rows (as far as centres can tell them apart), and the vectors and ids in each leaf."""
    drawn = _drawn(reps.withColumn("id", F.col("h1")), total, sample).orderBy("h1", "h2").select("v").collect()
    drawn = drawn or reps.orderBy("h1", "h2").select("v").limit(1).collect()
    tree = Tree(_unit(np.array([r["v"] for r in drawn])), leaf_size=max(16, leaf_rows * len(drawn) // (2 * max(1, total))))
    stuck: set[int] = set()
    while True:
        told = _leaf_of(reps.withColumn("m", F.size("ids")), tree, ["m"]).groupBy("leaf").agg(  # at most ``most_leaves`` leaves
            F.count(F.lit(1)).alias("n"), F.sum("m").alias("m")).collect()
        sizes = {r["leaf"]: (r["n"], r["m"]) for r in told}
        full = sorted(((n, leaf) for leaf, (n, _) in sizes.items() if n > leaf_rows and leaf not in stuck), reverse=True)
        room = (most_leaves - tree.leaves) // MOST_BELOW
        if not full or room < 1:
            return tree, sizes
        full = full[:room]  # the largest first
        share = reps.sparkSession.createDataFrame([(leaf, n, min(1.0, sample / n)) for n, leaf in full], "leaf long, n long, share double")
        picked = _leaf_of(reps, tree, ["h1", "h2", "v"]).join(F.broadcast(share), "leaf").where(
            F.pmod(F.xxhash64(F.lit("leaf"), "h1", "h2"), F.lit(1 << 30)) < F.col("share") * (1 << 30))

        def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(["h1", "h2"])
            size = max(8, leaf_rows * len(part) // (2 * int(part["n"].iloc[0])), -(-2 * len(part) // MOST_BELOW))
            sub = Tree(_unit(_matrix(part["v"])), leaf_size=size)
            return pd.DataFrame({"leaf": [key[0]], "tree": [pickle.dumps(sub)]})

        subtrees = {r["leaf"]: pickle.loads(r["tree"]) for r in picked.groupBy("leaf").applyInPandas(fit, "leaf long, tree binary").collect()}
        tree.graft(subtrees)
        stuck |= {leaf for _, leaf in full if leaf not in subtrees or subtrees[leaf].root < 0}


def _routed(asked: DataFrame, tree: Tree, sizes: dict[int, tuple[int, int]], width: int, k: int) -> DataFrame:
    """(h1, h2, leaf, nth): the leaves that each query visits, in order."""
    spark = asked.sparkSession
    shared = spark.sparkContext.broadcast((tree, sizes))

    def route(batches):
        for pdf in batches:
            tree, sizes = shared.value
            for h1, h2, q in zip(pdf["h1"], pdf["h2"], _unit(_matrix(pdf["v"]))):
                out, ids = [], 0
                for seen, leaf in enumerate(tree.visits(q)):
                    if seen >= width and ids > k:
                        break
                    if leaf in sizes:
                        ids += sizes[leaf][1]
                        out.append(leaf)
                yield pd.DataFrame({"h1": h1, "h2": h2, "leaf": out, "nth": range(len(out))})

    # only keys leave the tree walk; vectors are joined to the visits by Spark
    dealt = asked.select("h1", "h2", "v").repartition(shuffle_partitions(spark), "h1")
    return stage(dealt.mapInPandas(route, "h1 long, h2 int, leaf long, nth int"), "routed")


#: Leaves of a query that are compared first; the others give only what reaches the best found there.
FIRST_VISITS = 4


def _hits(leaves: DataFrame, routed: DataFrame, asked: DataFrame, k: int, block: int, kind: str) -> DataFrame:
    """(h1, h2, score, ids): the ``k + 1`` best vectors of each leaf that a query
    visits, if they reach the query's ``floor``."""
    load = routed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / block).alias("q_blocks"))
    cut = leaves.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / block).alias("r_blocks")).join(load, "leaf")  # one row a leaf

    def dealt(side: DataFrame, own_blocks: str, own_key: str, other_blocks: str, other_key: str) -> DataFrame:
        return side.join(cut, "leaf").withColumn(own_key, F.pmod(F.xxhash64("h1", "h2"), F.col(own_blocks))) \
            .withColumn(other_key, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other_blocks) - 1))) \
            .drop("q_blocks", "r_blocks")

    wanted = routed.select("h1", "h2", "leaf", "floor").join(asked.select("h1", "h2", "v"), ["h1", "h2"])
    left = dealt(wanted, "q_blocks", "qb", "r_blocks", "rb").groupBy("leaf", "qb", "rb")
    right = dealt(leaves.select("h1", "h2", "v", "ids", "leaf"), "r_blocks", "rb", "q_blocks", "qb").groupBy("leaf", "qb", "rb")

    def compare(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(x):
            least_id = np.array([ids[0] for ids in x["ids"]])
            h1, h2, floor, ids = (c.to_numpy() for c in (q["h1"], q["h2"], q["floor"], x["ids"]))
            out = [(h1[i], h2[i], s, list(ids[j])) for i, j, s in _nearest(_matrix(q["v"]), _matrix(x["v"]), least_id, k + 1) if s >= floor[i]]
        return pd.DataFrame(out, columns=["h1", "h2", "score", "ids"])

    return left.cogroup(right).applyInPandas(compare, f"h1 long, h2 int, score double, ids array<{kind}>")


def _compared(leaves: DataFrame, routed: DataFrame, asked: DataFrame, queries: DataFrame, k: int, block: int, kind: str) -> DataFrame:
    """The ``k`` best of the vectors in the leaves that each query visits."""
    least = F.lit(-2.0)
    hits = stage(_hits(leaves, routed.where(F.col("nth") < FIRST_VISITS).withColumn("floor", least), asked, k, block, kind), "first-hits")
    place = F.row_number().over(Window.partitionBy("h1", "h2").orderBy(F.desc("score")))
    floors = hits.select("h1", "h2", "score", place.alias("place")).where(F.col("place") == k + 1).select("h1", "h2", F.col("score").alias("floor"))
    rest = routed.where(F.col("nth") >= FIRST_VISITS).join(floors, ["h1", "h2"], "left").withColumn("floor", F.coalesce("floor", least))
    hits = hits.unionByName(_hits(leaves, rest, asked, k, block, kind))
    best = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), F.col("ids")[0])
    hits = hits.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1) \
        .select("h1", "h2", "score", F.explode("ids").alias("vec_id"))
    pairs = queries.select(F.col("id").alias("query_id"), "h1", "h2").distinct().join(hits, ["h1", "h2"]) \
        .where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _calibrated(leaves: DataFrame, drawn: DataFrame, tree: Tree, k: int, recall: float) -> int:
    """The least number of visits that finds the wanted share of the true
    other neighbours (brute force over all rows) of the drawn queries."""
    probes = drawn.orderBy("h1", "h2").collect()  # bounded by the caller
    if not probes:
        return 1
    matrix, keys = np.array([r["v"] for r in probes]), [(r["h1"], r["h2"]) for r in probes]

    def truth(batches):
        for pdf in batches:
            if len(pdf):
                least_id = np.array([ids[0] for ids in pdf["ids"]])
                leaf = pdf["leaf"].to_numpy()
                own = list(zip(pdf["h1"], pdf["h2"]))
                out = [(i, s, least_id[j], leaf[j]) for i, j, s in _nearest(matrix, _matrix(pdf["v"]), least_id, k + 1)
                       if own[j] != keys[i]]
                yield pd.DataFrame(out, columns=["probe", "score", "id", "leaf"])

    kind = leaves.schema["ids"].dataType.elementType.simpleString()
    nearest = leaves.mapInPandas(truth, f"probe int, score double, id {kind}, leaf long")
    order = Window.partitionBy("probe").orderBy(F.desc("score"), "id")
    held = nearest.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k) \
        .select("probe", "leaf").collect()  # at most k rows a probe
    wanted: dict[int, list[int]] = {}
    for r in held:
        wanted.setdefault(r["probe"], []).append(r["leaf"])
    ranks = []
    for probe, theirs in wanted.items():
        missing = set(theirs)
        for n, leaf in enumerate(tree.visits(_unit(matrix[probe:probe + 1])[0])):
            if leaf in missing:
                ranks += [n] * theirs.count(leaf)
                missing.discard(leaf)
                if not missing:
                    break
    ranks.sort()
    return ranks[max(0, math.ceil(recall * len(ranks)) - 1)] + 1 if ranks else 1
