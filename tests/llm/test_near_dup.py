import random
import re

import numpy as np
import pytest

from tessera.llm import near_dup, shingles
from tessera.llm.components import components


def words(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def shingled(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingled(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            same = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if rows[i][0] is None or rows[j][0] is None:
                continue
            if same or (a and b and 100 * len(a & b) >= 85 * len(a | b)):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), None, True) if d is None else
                   (d, len(sets[i]), least[find(i)], least[find(i)] == d) for i, (d, _) in enumerate(rows)), key=str)


def run(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, 1, "x", []) for i, t in rows],
                                 "doc_id long, text string, n int, rid string, sig array<int>")
    return sorted(map(tuple, near_dup.near_duplicates(docs, **options).collect()), key=str)


def mutated(rng, base, edits):
    w = list(base)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(rng):
    vocabulary = [f"w{i}" for i in range(3000)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows = []
    for _ in range(12):
        base = some(rng.randint(6, 200))
        rows += [mutated(rng, base, rng.randint(0, 6)) for _ in range(rng.randint(1, 6))]
    base = some(120)
    rows += [mutated(rng, base, rng.randint(0, 5)) for _ in range(60)]  # one large group of near copies
    chain = some(300)
    for k in range(25):  # a chain: neighbours are linked, ends are not
        chain = chain[2:] + some(2)
        rows.append(" ".join(chain))
    passage = some(60)
    rows += [" ".join(some(rng.randint(0, 60)) + passage + some(rng.randint(0, 60))) for _ in range(40)]
    rows += ["a b", "A  b\n", "a b c", "ß É", "ß é", "one", "", None, " \t ", "x " * 30_000, "x " * 29_999 + "y"]
    rows += [rows[0]] * 30
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [2048, 16])
def test_matches_brute_force(spark, block):
    rng = random.Random(block)
    rows = corpus(rng) + [(None, "a b"), (None, "q"), (3, "one"), (3, "one")]
    assert run(spark, rows, block=block) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_shingle_sets_match_words():
    rng = random.Random(8)
    for _ in range(300):
        a, b = ("".join(rng.choice("aB \t\né一") for _ in range(rng.randint(0, 40))) for _ in range(2))
        x, y = shingles.shingle_set(a), shingles.shingle_set(b)
        assert len(x) == len(shingled(a)) and len(np.intersect1d(x, y)) == len(shingled(a) & shingled(b))
    long = shingles.word_hashes("a" * 300 + " " + "a" * 256 + "b" + "a" * 43)
    assert len(set(long.tolist())) == 2


def test_block_links_match_pairwise():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, size=50).astype(np.uint64)) for _ in range(40)]
    every = np.ones((40, 40), dtype=bool)
    dense = near_dup._links(sets, every, 60)
    for i in range(40):
        for j in range(40):
            both = len(np.intersect1d(sets[i], sets[j]))
            assert dense[i, j] == (i != j and 100 * both >= 60 * (len(sets[i]) + len(sets[j]) - both))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (102, 102), (200, 150), (200, 160), (None, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    want = {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 150, 150: 150, 160: 150}
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_masks_name_the_posted_coordinates(spark):
    rng = random.Random(2)
    sigs = [[rng.randrange(3) if c % 3 else rng.randrange(9) for c in range(24)] for _ in range(30)]
    once = [(i % 25, 9, s) for i, s in enumerate(sigs)]  # ids 0 to 4 have two signatures
    kind = "rid long, n long, sig array<int>"
    want = sorted(map(tuple, near_dup._postings(spark.createDataFrame(once, kind), 24, 10).collect()))
    assert sorted(map(tuple, near_dup._postings(spark.createDataFrame(once * 3, kind), 24, 10).collect())) == want
    masks, bits = {}, {}
    for _, c, rid, h, _, mask in want:
        masks.setdefault((rid, h), set()).add(mask)
        bits[rid, h] = bits.get((rid, h), 0) | 1 << c
    assert len(masks) == 30 and masks == {k: {v} for k, v in bits.items()}


def test_repeated_rows_and_ids_match_brute_force(spark):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = [" ".join(rng.choices(vocabulary, k=8) + passage + rng.choices(vocabulary, k=8)) for _ in range(30)]
    texts += [mutated(rng, t.split(), 1) for t in texts]
    rows = [(i % 50, t) for i, t in enumerate(texts)] * 2
    assert run(spark, rows) == brute(rows) and run(spark, rows, block=16) == brute(rows)
