import hashlib
import random

import pytest

from tessera.llm import chat_format, queries
from tessera.llm.chat_format import INSTRUCT, Template

CONTROLS = [*INSTRUCT.controls(), "\\", "\\\\", "[INST", "/s>", "<", "[", "]", "\n", "é", "word ", "$1"]
SCHEMA = "conv_id long, turn long, role string, text string, formatted string, loss int, id int, before string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def frame(spark, rows):
    return spark.createDataFrame([(*r, "f", 1, 2, "b") for r in rows], SCHEMA)


def by_conversation(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append((r[1], r[2] or "", r[3] or ""))
    return {c: sorted(x, key=lambda t: (t[0] is not None, t[0] or 0, t[1])) for c, x in groups.items()}


def brute_order(roles):
    state = "start"
    for i, role in enumerate(roles, 1):
        state = INSTRUCT.order[state].get(role)
        if state is None:
            return i
    return None if state in INSTRUCT.final else len(roles) + 1


def sample(rng):
    rows = []
    for c in [*range(25), None]:
        for t in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.2 else ("user", "assistant")[t % 2]
            role = rng.choice(["system", None, "tool[END]\\", role]) if rng.random() < 0.1 else role
            text = None if rng.random() < 0.05 else "".join(rng.choice(CONTROLS) for _ in range(rng.randrange(0, 12)))
            rows.append((c, None if rng.random() < 0.03 else t, role, text))
    rows += [(40, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(300)]  # spread over several ranges
    rows += [(41, 0, "system", "only")] + [(42, 0, "user", "x" * 50000), (42, 1, "assistant", "[/INST]" * 5000)]
    rows += [(43, 0, "user", "same")] * 3
    return rows


def test_text_alone_gives_the_turns_back(spark):
    rows = sample(random.Random(1))
    read = chat_format.reader(INSTRUCT)
    out = chat_format.format_turns(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    got = sorted(((r["conv_id"], r["turn"], *read(r["formatted"])[0]) for r in out), key=str)
    assert got == sorted(((c, t, role or "", text or "") for c, t, role, text in rows), key=str)
    for r in out:
        (role, text), = read(r["formatted"])
        assert [chat_format.unescaped(r["formatted"][s["start"]:s["end"]]) for s in r["loss"]] == \
            ([text] if role == "assistant" else [])
    # a whole conversation reads as its turns
    joined = "".join(r["formatted"] for r in sorted((r for r in out if r["conv_id"] == 40), key=lambda r: r["turn"]))
    assert read(joined) == [(("user", "assistant")[t % 2], f"turn {t}") for t in range(300)]


def test_query_matches_brute_force(spark, monkeypatch):
    rows = sample(random.Random(2))
    monkeypatch.setattr(queries, "read_table", lambda *_: frame(spark, rows))
    out = {r["conv_id"]: r for r in queries.op12_chat_format(spark, "").collect()}
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    want = by_conversation(rows)
    assert set(out) == set(want)
    for c, turns in want.items():
        if len({t for t, _, _ in turns}) < len(turns) and c != 43:
            turns = None  # ties are checked below
        if turns:
            learned = "".join(text for _, role, text in turns if role == "assistant")
            assert out[c]["turns_sha256"] == sha("".join(f"{role}\n{text}\n" for _, role, text in turns))
            assert (out[c]["loss_chars"], out[c]["loss_sha256"]) == (len(learned), sha(learned))
        bad = brute_order([role for _, role, _ in want[c]])
        assert (out[c]["n_turns"], out[c]["first_bad"], out[c]["valid"]) == (len(want[c]), bad, bad is None)
    formatted = chat_format.format_turns(frame(spark, rows)).collect()
    assert sum(r["formatted_chars"] for r in out.values()) == sum(len(r["formatted"]) for r in formatted)


def test_equal_turns_follow_role_and_text(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "z")]
    r, = chat_format.digests(chat_format.format_turns(frame(spark, rows))).collect()
    assert r["turns_sha256"] == sha("assistant\nz\nuser\na\nuser\nb\n")


def test_empty_table(spark, monkeypatch):
    assert chat_format.turn_order(frame(spark, [])).collect() == []
    monkeypatch.setattr(queries, "read_table", lambda *_: frame(spark, []))
    r, = queries.op12_chat_format(spark, "").collect()
    assert (r["conv_id"], r["n_turns"], r["valid"], r["loss_chars"]) == (-1, 2, True, 21)


@pytest.mark.parametrize("change", [
    {"other": ("[ROLE]", "[/RO[LE]", "[END]")}, {"roles": {"a": ("<a>", "", True)}}, {"roles": {"a": ("<\\>", "</a>", True)}},
    {"roles": {"a": ("<a>", "</a>", True), "b": ("<a>", "</b>", False)}}, {"final": ("nowhere",)},
    {"order": {"start": {"user": "lost"}}}])
def test_templates_that_cannot_be_read_raise(change):
    with pytest.raises(ValueError):
        Template(**({"roles": INSTRUCT.roles, "other": INSTRUCT.other, "order": INSTRUCT.order, "final": INSTRUCT.final} | change))


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = {r["conv_id"]: r for r in queries.op12_chat_format(spark, sf).collect()}
    want = by_conversation(rows)
    assert set(out) == {-1, *want}
    for c, turns in want.items():
        assert out[c]["turns_sha256"] == sha("".join(f"{role}\n{text}\n" for _, role, text in turns))
