import hashlib
import random
import re

import pytest

from tessera.llm import pii, queries


def luhn(d):
    x = [int(c) for c in d][::-1]
    return (sum(x[::2]) + sum(sum(divmod(2 * v, 10)) for v in x[1::2])) % 10 == 0


def brute(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    return (
        [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        + [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
           if all(int(p) <= 255 for p in m[0].split("."))]
        + [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
           if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
        + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
           if 9 <= len(digits(m)) <= 15])


def base(text):
    return [s[:3] for s in pii.find(text) if s[3]]


def test_base_spans_match_brute_force():
    rng = random.Random(5)
    parts = ["a", "b.c", "@", "@@", ".", "..", "1", "22", "255", "256", "0001", "1.2.3.4", "4532015112830366", "+", "+1",
             " ", "-", "(", ")", "x@y.z", "é", "😀", "4111 1111-1111 1111", "%", "_", "+49 (30) 123456", "\n", "一"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert base(t) == brute(t), t


@pytest.mark.parametrize("char", ["1", "1.", "1 ", "@", "a@", "a", " ", "+1", "+", "one ", "[", "a.", "at ", "а"])
def test_long_runs_are_linear(char):
    t = char * 100_000
    found = pii.find(t)
    assert len(found) <= 100_000 and [s for s in found if s[0] == "card"] == []


DISGUISED = [
    ("email", "john@exаmple.com"), ("email", "john [at] example [dot] com"), ("email", "ｊohn＠example．com"),
    ("email", "john dot doe at example dot co dot uk"), ("email", "j​ohn@exa​mple.com"),
    ("email", "john@example(dot)com"), ("phone", "plus one five five five one two three four five six"),
    ("phone", "+１ (５２３) 555-1055"), ("ip", "one nine two dot one six eight dot one dot one"), ("ip", "１０.0.0.7"),
    ("card", "four one one one one one one one one one one one one one one one"), ("card", "4532 ０151 1283 ٠٣٦٦"),
]


@pytest.mark.parametrize("kind,hidden", DISGUISED)
def test_disguises_map_back_to_the_source(kind, hidden):
    text = f"Vorher é😀 {hidden} , nachher"
    assert [(k, text[a:b], own) for k, a, b, own in pii.find(text)] == [(kind, hidden, False)]
    assert pii.redact(text) == f"Vorher é😀 [{kind.upper()}] , nachher"


MIXED = [
    ("card", "4111 1111 1111 111 one"), ("phone", "+1 five 5 five 0 one 2 three 4 five"), ("card", "four 111 1111 1111 1111"),
    ("card", "4111-1111-1111-111-one"), ("phone", "+five 5 5 0 1 2 3 4 5 6"), ("phone", "+ſix 1 2 3 4 5 6 7 8 9"),
    ("ip", "192 dot 168 dot 1 dot one"),
]


@pytest.mark.parametrize("kind,hidden", MIXED)
@pytest.mark.parametrize("around", [" {} , after", "({}).", "«{}»", " {} , far away — a dash", " {} , far away the point"])
def test_mixed_runs_are_found_whatever_else_the_text_holds(kind, hidden, around):
    text = "before" + around.format(hidden)
    assert [(k, text[a:b], own) for k, a, b, own in pii.find(text)] == [(kind, hidden, False)]


def test_gate_lets_every_rewritten_run_through():
    rng = random.Random(9)
    parts = ["one", "Five", "fünf", "uno", "4", "11", "dot", "plus", "+", "x", "(", ")", ".", "ſix", "a@b.cd"]
    changed = 0
    for _ in range(6000):
        t = "".join(rng.choice(parts) + rng.choice([" ", " ", "-", ", ", ""]) for _ in range(rng.randint(1, 12)))
        if pii._spelled(t):
            changed += 1
            new = pii._rewritten(t)
            assert new is not None and len(new.text) == len(new.lo) == len(new.hi), t
    assert changed > 300


LONG = [
    ("email", "a [dot] b [dot] c [dot] d [dot] e [at] example [dot] com"),
    ("email", " [dot] ".join(["name"] * 40) + " [at] example [dot] com"),
    ("email", "a dot b dot c dot d dot e dot f at example dot com"), ("email", "x" * 200 + " [dot] y [at] example [dot] com"),
    ("phone", "plus one - five - five - five - one - two - three - four - five"),
    ("card", "four - 111 , 1111 - 1111 - 111 - one"),
]


@pytest.mark.parametrize("kind,hidden", LONG)
def test_long_disguises_are_found_whole(kind, hidden):
    text = f"(before: {hidden}) after"
    assert [(k, text[a:b], own) for k, a, b, own in pii.find(text)] == [(kind, hidden, False)]


@pytest.mark.parametrize("part", ["a [dot] ", "a dot ", "a [at] b.c ", "a at b.c ", "a [dot] b [at] ", "@b.c "])
def test_long_addresses_are_linear(part):
    assert len(pii.find(part * 30_000 + "a [at] b [dot] com")) <= 60_001


@pytest.mark.parametrize("clean", [
    "He looked at the dot on the map, at one point. We met at example.com", "one two three", "Это просто текст о жизни",
    "un deux trois quatre cinq six sept huit neuf", "(at) the [dot]", "m² and ½ of 3.5.2", "", "in 1999 and 2001-2003"])
def test_clean_text_is_left_alone(clean):
    assert pii.find(clean) == [] and pii.redact(clean) == clean


def test_overlapping_kinds_give_one_mark():
    assert pii.redact("x +4532015112830366@a.b y") == "x [EMAIL] y"
    assert pii.find(None) == [] and pii.redact(None) is None


def test_query_against_brute_force(spark, tmp_path):
    texts = [None, "", "a@b.cd 1.2.3.4 +1 (523) 555-1055", "x " * 60_000 + "q@r.st", "j [at] b [dot] com, a@b.cd"] * 2
    rows = [(i // 2, t, "n", "m") for i, t in enumerate(texts)] + [(None, "a@b.cd", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, spans string, n_ip string") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op2_pii(spark, str(tmp_path)).collect()
    want = []
    for i, t, *_ in rows:
        b = brute(t)
        own = ",".join(f"{k}:{s}:{e}" for k, s, e in b)
        counts = [sum(k == x for x, *_ in b) for k in ("email", "ip", "card", "phone")]
        want.append((i, *counts, hashlib.sha256(own.encode()).hexdigest(),
                     ",".join(f"{k}:{s}:{e}" for k, s, e, _ in pii.find(t))))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/e/documents.parquet")
    assert queries.op2_pii(spark, f"{tmp_path}/e").collect() == []
