import hashlib
import random
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from tessera.llm import periodic, queries


def brute_runs(w):
    """All runs, by every period and every start."""
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i + q - s
            if length >= max(6, 4 * q):
                out.setdefault((s, length), q)
    return sorted((s, length, q) for (s, length), q in out.items())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text):
    w = [x for x in periodic_split(text or "")]
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for s, length, q in runs:
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def periodic_split(text):
    word = ""
    for c in text + " ":
        if c in " \t\n\v\f\r":
            if word:
                yield word
            word = ""
        else:
            word += c


def sample_words(rng, n):
    out = []
    while len(out) < n:
        kind = rng.random()
        if kind < 0.4:
            out += [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 12))]
        elif kind < 0.8:
            block = [rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 16, 17, 31]))]
            m = rng.randrange(2, 9) * len(block) + rng.randrange(len(block))
            out += [block[i % len(block)] for i in range(m)]
        else:
            out += [rng.choice("ab")] * rng.randrange(1, 30)
    return out[:n]


@pytest.mark.parametrize("n", [0, 1, 5, 6, 7, 30, 100, 300])
def test_one_tile_finds_every_run(n):
    rng = random.Random(n)
    for _ in range(40):
        w = sample_words(rng, n)
        numbers = np.array([ord(x) * 7919 for x in w], dtype=np.int64)
        got = {}
        for q, s, e in periodic.fragments(numbers, 1, 512):
            if e - s >= 6:
                got[(s, e - s)] = min(q, got.get((s, e - s), q))
        assert sorted((s, length, q) for (s, length), q in got.items()) == brute_runs(w)


def test_equal_words_give_few_fragments():
    numbers = np.full(8192, 5, dtype=np.int64)
    assert periodic.fragments(numbers, 1, 512) == [(1, 0, 8192)]
    assert periodic.fragments(numbers, 1024, 1024) == []


def test_small_tiles_are_stitched(spark, monkeypatch):
    rng = random.Random(11)
    texts = [sample_words(rng, n) for n in (20, 80, 150, 333, 500, 700)]
    texts += [["x"] * 400, (list("ab") * 300)[:511], [str(i % 37) for i in range(600)], [str(i) for i in range(300)]]
    monkeypatch.setattr(periodic.tile_plan, "__defaults__", (2,))
    docs = spark.createDataFrame([(i, w, "k", 1) for i, w in enumerate(texts)], "doc_id long, w array<string>, key string, n int")
    out = periodic.periodic_runs(docs, F.col("w"))
    got = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in out.collect()}
    assert got == {i: brute_runs(w) for i, w in enumerate(texts)}


def read(spark, monkeypatch, rows):
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "doc_id long, text string, key string, words string, n int")
    monkeypatch.setattr(queries, "read_table", lambda *_: docs)
    return queries.op13_periodic(spark, "")


def test_query_matches_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:25]
    rows = [(i, rng.choice([" ", "\n\t"]).join(sample_words(rng, rng.choice([1, 3, 40, 200])))) for i in range(30)]
    rows += [(i, " ".join(str(rng.randrange(1000)) for _ in range(rng.choice([1, 7, 50, 400])))) for i in ids]
    rows += [(None, "a " * 50), (None, None), (5, None), (5, ""), (6, " \t "), (ids[0], None), (1, "z" * 50000 + " é" * 20)]
    rows += [(9, " ".join(["one two three"] * 9))] * 20
    rows += [(777, " ".join(str(i % 2500) for i in range(11000)))]
    out = read(spark, monkeypatch, rows)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([expected(*r) for r in rows], key=str)


def test_empty_table(spark, monkeypatch):
    assert read(spark, monkeypatch, []).collect() == []


def test_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in rows if len(r["text"]) < 8000]
    got = {r["doc_id"]: tuple(r) for r in queries.op13_periodic(spark, sf).collect()}
    assert len(got) == len(rows)
    for r in short[::3]:
        assert got[r["doc_id"]] == expected(*r)
