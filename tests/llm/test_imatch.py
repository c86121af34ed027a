import hashlib
import random
import re
import struct
from collections import Counter

import xxhash

from tessera.llm import imatch, queries


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def xx(data, seed=42):
    return signed(xxhash.xxh64_intdigest(data, seed=seed & (1 << 64) - 1))


def chain(values, pack="<q"):
    seed = 42
    for v in values:
        seed = xx(struct.pack(pack, v), seed)
    return seed


def term_set(text):
    return {xx(w.encode()) for w in re.split(r"[^a-zà-ÿ0-9]+", text.lower())}


def brute(rows, commonest, rarest, subsets=imatch.SUBSETS):
    rows = [(i, t or "") for i, t in rows]
    df = Counter(t for _, x in rows for t in term_set(x))
    n = len(rows)
    band = {t for t, c in df.items() if c * commonest <= n <= c * rarest}

    def printed(text):
        all_terms = sorted(term_set(text))
        held = [t for t in all_terms if t in band]
        if not held:
            return "x%016x" % (chain(all_terms) % (1 << 64))
        out = []
        for k, shares in enumerate(subsets):
            for share in shares:
                own = [t for t in held if xx(struct.pack("<i", k), chain([t])) % (1 << 32) < int(share * (1 << 32))]
                out.append("%016x" % (chain(own) % (1 << 64)) if own else "-")
        return ".".join(out)

    def alike(a, b):
        if a == b:
            return 1.0
        if "x" in (a[0], b[0]):
            return 0.0
        both = [(x, y) for x, y in zip(a.split("."), b.split(".")) if (x, y) != ("-", "-")]
        return sum(x == y for x, y in both) / len(both) if both else 0.0

    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()), reverse=True)
    out = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        third = len(t) // 3
        edited = t[:len(t) - third] + after[:third]
        a, b, c = printed(t), printed(edited), printed(after)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, alike(a, b), alike(a, c)))
    return sorted(out, key=str)


def run(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_chars int, own string")
    return sorted(map(tuple, imatch.fingerprints(docs, **options).collect()), key=str)


def test_matches_brute_force(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(120)]
    text = lambda: " ".join(words[min(119, int(rng.expovariate(0.03)))] for _ in range(rng.randint(0, 60)))
    rows = [(rng.randrange(10**6), text()) for _ in range(150)]
    rows += [(5, None), (6, ""), (7, " . "), (8, "zzz yyy"), (None, text()), (None, text()), (9, "é😀 " * 5000)]
    rows += [rows[0]] * 40 + [(rows[1][0], text())]
    assert run(spark, rows, commonest=4, rarest=20) == brute(rows, 4, 20)
    fine = dict(subsets=queries.IMATCH_SUBSETS)
    assert run(spark, rows, commonest=4, rarest=20, **fine) == brute(rows, 4, 20, **fine)


def test_one_row_and_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, "abc def")]) == brute([(1, "abc def")], 10, 1000)


def test_likeness_falls_with_edits(spark):
    rng = random.Random(2)
    words = [f"v{k}" for k in range(400)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(300))) for i in range(40)]
    w = rows[39][1].split()
    w[7] = "other"
    rows.append((40, " ".join(w)))  # next in descending order: its near copy 39
    got = {r[0]: r for r in run(spark, rows, commonest=1.2, rarest=100)}
    assert got[40][6] > 0.5 > got[40][5] > got[20][6] == 0.0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string")
    plan = imatch.fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert plan.count("Exchange hashpartitioning") == 1  # the texts move once


def test_a_replaced_third_is_told_from_another_text(spark, sf):
    got = [r for r in queries.op3_imatch(spark, sf).collect() if r["n_chars"] >= 300]
    edited, other = [r["near_edited"] for r in got], [r["near_next"] for r in got]
    wins = sum((a > b) + (a == b) / 2 for a in edited for b in other) / (len(got) ** 2)
    assert wins >= 0.95


def test_cut_lookup_counts_cuts(spark):
    values = [(v,) for v in range(-1, 60)]
    df = spark.createDataFrame(values, "v long")
    for cuts in ([], [5], [1, 4], [0, 3, 9, 10, 11, 40, 41], list(range(3, 53, 2))):
        got = df.select("v", imatch._cuts_below(cuts, df["v"]).alias("k")).collect()
        assert all(r["k"] == sum(c <= r["v"] for c in cuts) for r in got)
