import random
import re
from itertools import permutations

from tessera.llm import filter_audit

WORD = re.compile("[^ \t-\r]+")
SCHEMA = "doc_id long, text string, lang string, n int, good int, fails string"


def brute(rows, labels):
    marks = {}
    for i, q, t in labels:
        if i is not None:
            a, b = marks.get(i, (False, False))
            marks[i] = (a or q == 1, b or t == 1)
    docs = []
    for i, text, lang in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
                 "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
                 "E": i is not None and any(j is not None and j < i and (other or "") == text for j, other, _ in rows)}
        docs.append((lang or "", {k for k, v in fails.items() if v}, *marks.get(i, (False, False))))
    out = []
    for part in {d[0] for d in docs}:
        mine, found, shapley = [d for d in docs if d[0] == part], [], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = list(range(len(mine)))
            for step, f in enumerate(order, 1):
                fail = [k for k, d in enumerate(mine) if f in d[1]]
                gone = [k for k in left if f in mine[k][1]]
                left = [k for k in left if f not in mine[k][1]]
                shapley[f] += len(gone)
                found.append((part, order, step, len(left), len(gone), len(fail) - len(gone),
                              sum(mine[k][1] == {f} for k in fail), sum(mine[k][2] for k in gone),
                              sum(mine[k][3] for k in gone)))
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in found]
    return sorted(out)


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)
    marks = spark.createDataFrame([(*x, "t") for x in labels], "doc_id long, quality int, toxic int, text string")
    out = filter_audit.audit(docs, marks)
    assert out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
                           "good_lost", "toxic_lost", "shapley"]
    return sorted(map(tuple, out.collect()))


def test_matches_brute_force(spark):
    rng = random.Random(5)
    bases = ["", None, "a b  c\td", "x" * 30000, "AB " * 150, "w " * 250]
    for _ in range(25):
        n = rng.choice([3, 120, 220, 400])
        words = [rng.choice(["tone", "Tone", "é", "die", "ÄÖ", "of"]) + str(rng.randrange(rng.choice([5, 900])))
                 for _ in range(n)]
        bases.append(rng.choice([" ", "\n", "\v "]).join(words) + rng.choice(["", " $", "|", " A" * 40]))
    rows = [(rng.choice([None, *range(60)]), rng.choice(bases), rng.choice(["en", "de", None, ""])) for _ in range(150)]
    rows += [(7, bases[7], "en")] * 3 + [(200 + k, bases[8], "fr") for k in range(40)]
    labels = [(rng.choice([None, *range(80)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(90)]
    labels += [(210, 1, 0), (210, 1, 0), (200, 1, 1)]
    assert audited(spark, rows, labels) == brute(rows, labels)


def test_empty_tables(spark):
    assert audited(spark, [], []) == []
    rows = [(1, None, None)]
    assert audited(spark, rows, []) == brute(rows, [])


def test_copies_of_one_id_stay_together(spark):
    cells = filter_audit.mask_cells(
        spark.createDataFrame([(2, "t", "en")] * 5 + [(3, "t", "en"), (None, "t", "en")], "doc_id long, text string, lang string"),
        spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r["fails"]: r["n"] for r in cells.collect()} == {"A": 6, "AE": 1}


def test_native_and_no_text_is_shuffled(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = filter_audit.audit(docs, labels)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
    for line in plan.splitlines():
        assert "Exchange" not in line or "text#" not in line
