import itertools
import random
from collections import defaultdict

from pyspark.sql import functions as F

from tessera.llm import packing


def padding(histogram, bounds):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in histogram.items())


def test_bounds_are_optimal():
    rng = random.Random(1)
    for _ in range(60):
        h = {rng.randint(1, 40): rng.randint(1, 50) for _ in range(rng.randint(1, 9))}
        for k in (1, 2, 3, 4):
            got = packing.best_bounds(h, k)
            top = max(h)
            best = min(padding(h, (*c, top)) for r in range(min(k, len(h)))
                       for c in itertools.combinations([n for n in h if n < top], r))
            assert got[-1] == top and len(got) <= k and padding(h, got) == best
    assert packing.best_bounds({}, 3) == []


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, 5, "z") for i, t in texts], "doc_id long, text string, n int, bucket_len string")


def test_every_token_once_within_budget(spark):
    rng = random.Random(2)
    texts = [(i, "w " * rng.randint(0, 40)) for i in range(200)] + [(5, "a b c")] * 300 + [
        (None, "x y"), (1000, None), (1001, ""), (1002, "\t \n"), (1003, "q " * 1234)]
    out = packing.pack(rows_of(spark, texts), packing.word_count(F.col("text")), max_len=25, buckets=4,
                       budget=100, shard_rows=40)
    got = out.collect()
    want = defaultdict(int)
    for i, t in texts:
        want[i] += len((t or "").split())
    have = defaultdict(int)
    batches = defaultdict(list)
    for r in got:
        have[r.doc_id] += r.n_tokens
        if r.n_tokens:
            assert r.padding == r.bucket_len - r.n_tokens >= 0 and r.n_tokens <= 25
            batches[r.bucket_len, r.shard, r.batch].append(r)
        else:
            assert r.bucket_len is None and r.batch is None
    assert have == want
    short = defaultdict(int)
    for (bound, shard, _), rows in batches.items():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        assert len(rows) * bound <= 100
        short[bound, shard] += len(rows) < 100 // bound
    assert max(short.values()) <= 1  # only the last batch of a shard isn't full
    pieces = sorted((r.piece, r.start, r.n_tokens) for r in got if r.doc_id == 1003)
    assert [p[:2] for p in pieces] == [(k, 25 * k) for k in range(50)] and pieces[-1][2] == 9
    histogram = defaultdict(int)
    for r in got:
        if r.n_tokens:
            histogram[r.n_tokens] += 1
    assert sorted({r.bucket_len for r in got if r.n_tokens}) == packing.best_bounds(histogram, 4)


def test_result_does_not_depend_on_partitions_and_empty_table(spark):
    d = rows_of(spark, [(i, "w " * (i % 17)) for i in range(100)])
    a = packing.pack(d, packing.word_count(F.col("text")), budget=64, shard_rows=9)
    b = packing.pack(d.repartition(7), packing.word_count(F.col("text")), budget=64, shard_rows=9)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert packing.pack(rows_of(spark, []), packing.word_count(F.col("text"))).count() == 0
