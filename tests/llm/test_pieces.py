import hashlib
import itertools
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tessera.llm import nbest, pieces, queries

MODEL = pieces.read_model(queries.PIECES)


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(MODEL)


@pytest.fixture(scope="module")
def library():
    """The library's own unigram segmentation over the same pieces and scores:
    the model type in the file's training part set from 2 to 1."""
    at = MODEL.rindex(b"\x12\x06tok_v0\x18\x02") + 9
    sp = sentencepiece.SentencePieceProcessor()
    sp.LoadFromSerializedProto(MODEL[:at] + b"\x01" + MODEL[at + 1:])
    return sp


def texts(rng, count, alphabet, most):
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, most))) for _ in range(count)]


def paths(v, text):
    """All paths of a short text by recursion: (score, ids)."""
    s = v.normal(text)

    def walk(k):
        if k == len(s):
            yield 0.0, []
        for end in range(k + 1, len(s) + 1):
            p = s[k:end]
            if p in v.score:
                yield from ((x + v.score[p], [v.id[p], *y]) for x, y in walk(end))
            elif end == k + 1:
                yield from ((x + v.unknown, v.char_ids(p) + y) for x, y in walk(end))

    return sorted(walk(0), key=lambda p: -p[0])


def test_best_path_against_the_library(vocabulary, library):
    """Never worse than the library's path, and the same path where the scores
    are equal, so ties go the library's way. In a few words (`tone`) the
    library's fast encoder returns less than its own N-best search does."""
    rng = random.Random(1)
    words = ["the", "running", "über", "çtre", "ciónes", "Straße", "x", "a.b", "don't", "12,50", "日本", "hello", "tone"]
    cases = texts(rng, 400, "abetnio ", 30) + [" ".join(rng.choices(words, k=rng.randint(1, 8))) for _ in range(300)]
    count, segment = pieces.Counts(vocabulary), nbest.Segmenter(vocabulary, 3)
    same = checked = 0
    for t in cases:
        if "  " in t or t != t.strip():
            continue  # unknown-like scores of runs of spaces exceed the library's single floats
        want = library.encode(t)
        mine = np.frombuffer(segment.text(t)[0][1], dtype=np.int32).tolist()
        score = sum(map(library.get_score, mine))
        assert (score, score) == (segment.text(t)[0][0], count.text(t)[1]) and count.text(t)[0] == len(mine)
        assert score >= sum(map(library.get_score, want)), t
        if score == sum(map(library.get_score, want)):
            assert mine == want, t
            same += 1
        checked += 1
        if 0 < len(t) <= 12 and score > -1e6:  # single floats again
            listed = library.nbest_encode(t, nbest_size=3, out_type=int)
            assert [sum(map(library.get_score, x)) for x in listed] == [x for x, _ in segment.text(t)], t
    assert checked > 300 and same > 0.7 * checked


def test_unknown_characters_fall_back_to_bytes(vocabulary, library):
    for t in ["a\x02b", "\U0001F9FFq", "\n", "𐎠"]:
        ids = np.frombuffer(nbest.Segmenter(vocabulary, 2).text(t)[0][1], dtype=np.int32).tolist()
        assert ids == library.encode(t) and vocabulary.sp.decode(ids) == t
        assert pieces.Counts(vocabulary).text(t)[0] == len(ids)


@pytest.mark.parametrize("n", [1, 2, 5, 40])
def test_n_best_matches_enumeration(vocabulary, n):
    rng = random.Random(n)
    segment = nbest.Segmenter(vocabulary, n)
    count = pieces.Counts(vocabulary)
    for t in [*texts(rng, 120, "aen t.\n", 9), "", "a", "ab ab", "   ", "ab  é"]:
        every, got = paths(vocabulary, t), segment.text(t)
        assert [s for s, _ in got] == [s for s, _ in every[:n]], t
        known = {tuple(ids): s for s, ids in every}
        assert len({raw for _, raw in got}) == len(got)
        assert all(known[tuple(np.frombuffer(raw, dtype=np.int32).tolist())] == s for s, raw in got)
        assert count.text(t) == (len(got[0][1]) // 4, got[0][0])


def test_combined_sums():
    rng = random.Random(3)
    for _ in range(50):
        lists = [sorted((rng.randint(-9, 0) for _ in range(rng.randint(1, 4))), reverse=True) for _ in range(rng.randint(0, 4))]
        every = sorted((sum(x) for x in itertools.product(*lists)), reverse=True)
        assert [s for s, _ in nbest.combined(lists, 6)] == every[:6]


def test_columns(spark, vocabulary):
    rows = [(0, None), (1, ""), (2, "Hello  wörld\n 日本 \x00"), (3, "ab cd " * 20_000), (4, " x"), (4, " x"), (None, "q" * 50_000)]
    docs = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, n long, score double")
    got = docs.select("doc_id", "text", nbest.encoded(spark, F.col("text"), MODEL, 3).alias("p"),
                      pieces.token_counts(spark, F.col("text"), MODEL).alias("c")).collect()
    assert len(got) == len(rows)
    for r in got:
        best = r.p[0]
        assert (r.c.n, r.c.score) == (best.n_pieces, best.score) and best.n_pieces == len(best.ids)
        assert all(p.decoded and p.ids_sha256 == hashlib.sha256(np.array(p.ids, dtype=np.int32).tobytes()).hexdigest()
                   for p in r.p)
        assert [p.score for p in r.p] == sorted((p.score for p in r.p), reverse=True)
        assert vocabulary.sp.decode(best.ids) == (r.text or "") if best.ids else not r.text
    ids = docs.select(nbest.decoded(spark, nbest.encoded(spark, F.col("text"), MODEL, 1)[0]["ids"], MODEL).alias("t"))
    assert [r.t for r in ids.collect()] == [t or "" for _, t in rows]
    assert docs.limit(0).select(pieces.token_counts(spark, F.col("text"), MODEL)).collect() == []


def test_queries(spark, sf):
    counts = {r.doc_id: (r.n_tokens, r.score) for r in queries.op5_token_counts(spark, sf).collect()}
    best = [r for r in queries.op4_nbest(spark, sf).collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert len(counts) == docs and {r.doc_id: (r.n_pieces, r.score) for r in best if r.rank == 1} == counts
    assert all(r.decoded for r in best)
