"""Conversations as training text with a loss mask.

A declarative template names, for each role, the control strings around a turn
and whether its text is learned, and the order that turns may take as a
finite-state machine over roles. What the machine emits for a turn (marker,
escaped text, marker, each with its loss flag) depends on the role alone, so turns
are written where they lie. Only the machine's state needs the order: rows are
sorted by ranges of (conversation, turn), each range reduces what it holds of a
conversation to a map from the state before to the state after, and the maps of a
conversation, one a range, are composed. A conversation of any length is spread
over ranges.

Control strings inside texts are escaped by a backslash, backslashes too, so
the reader gets every turn back from the text alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import shuffle_partitions

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """``roles``: role to (marker before, marker after, whether its text is
    learned). Other roles are written as ``other``: marker before the name,
    between name and text, and after; they are not learned. ``order``: state to
    {role: next state}; a turn that has no entry is out of order, and so is the
    end of a conversation in a state that isn't in ``final``. The machine starts
    in the first state. A control string must not begin inside another one or at
    its own later characters, so none can arise where pieces meet."""
    roles: dict[str, tuple[str, str, bool]]
    other: tuple[str, str, str]
    order: dict[str, dict[str, str]]
    final: tuple[str, ...]

    def controls(self) -> list[str]:
        """All control strings, the longest first."""
        found = {c for before, after, _ in self.roles.values() for c in (before, after)} | set(self.other)
        return sorted(found, key=lambda c: (-len(c), c))

    def __post_init__(self) -> None:
        found = self.controls()
        befores = [b for b, _, _ in self.roles.values()] + [self.other[0]]
        if len(set(befores)) < len(befores):
            raise ValueError("each role needs a marker of its own")
        for c in found:
            if not c or ESCAPE in c or any(c[0] in other[1:] for other in found):
                raise ValueError(f"control string {c!r} could be read into another one or an escape")
        states = set(self.order)
        if not set(self.final) <= states or any(s not in states for moves in self.order.values() for s in moves.values()):
            raise ValueError("order and final name a state that order doesn't hold")


# Instruction markers and the end of an answer.
INSTRUCT = Template(
    roles={"system": ("[SYS]", "[/SYS]", False), "user": ("[INST]", "[/INST]", False), "assistant": ("<s>", "</s>", True)},
    other=("[ROLE]", "[/ROLE]", "[END]"),
    order={"start": {"system": "opened", "user": "asked"}, "opened": {"user": "asked"},
           "asked": {"assistant": "answered"}, "answered": {"user": "asked"}},
    final=("asked", "answered"))


# ---------------------------------------------------------------- writing
def escaped(text: Column, template: Template) -> Column:
    """``text`` with a backslash before every control string and backslash."""
    some = "|".join(re.escape(c).replace("/", "\\/") for c in [ESCAPE, *template.controls()])
    return F.regexp_replace(text, f"({some})", r"\\$1")


def format_turns(turns: DataFrame, template: Template = INSTRUCT, id_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Each row of ``turns`` as ``formatted`` text with ``loss``, the spans
    (start, end; code points, end exclusive) to learn from: the escaped text
    of a learned role, without its markers. Returns (id_col, turn_col, role,
    formatted, loss). A null role or text counts as empty; rows that repeat are
    each written; other columns are not read. No rows move."""
    role = F.coalesce(F.col(role_col), F.lit(""))
    body = escaped(F.coalesce(F.col(text_col), F.lit("")), template)
    start, name_end, end = map(F.lit, template.other)
    before, after, learned = F.concat(start, escaped(role, template), name_end), end, F.lit(False)
    for name, (b, a, loss) in template.roles.items():
        own = role == name
        before, after = F.when(own, F.lit(b)).otherwise(before), F.when(own, F.lit(a)).otherwise(after)
        learned = F.when(own, F.lit(loss)).otherwise(learned)
    span = F.struct(F.length("before").cast("long").alias("start"), (F.length("before") + F.length("body")).cast("long").alias("end"))
    return turns.select(F.col(id_col), F.col(turn_col), role.alias("role"), before.alias("before"), body.alias("body"),
                        after.alias("after"), learned.alias("learned")).select(
        id_col, turn_col, "role", F.concat("before", "body", "after").alias("formatted"),
        F.when(F.col("learned"), F.array(span)).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("loss"))


# ---------------------------------------------------------------- turn order
def _same(a, b) -> bool:
    return a == b or (pd.isna(a) and pd.isna(b))


def _maps(template: Template, id_type: str):
    """A function over the sorted rows of a range that gives, for each
    conversation in it, where the machine ends from each state before, and
    after how many turns it fails (0: it doesn't)."""
    states = list(template.order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, after, bad, n, seq = None, None, None, 0, 0
        for batch in batches:
            out = []
            for conv, role, part in zip(batch["id"], batch["role"], batch["part"]):
                if after is None or not _same(conv, current):
                    if after is not None:
                        out.append((current, part, seq, n, after, bad))
                        seq += 1
                    current, after, bad, n = conv, list(range(len(states))), [0] * len(states), 0
                n += 1
                for k, s in enumerate(after):
                    if s >= 0:
                        to = template.order[states[s]].get(role)
                        after[k], bad[k] = (-1, n) if to is None else (states.index(to), 0)
                last = part
            if out:
                yield pd.DataFrame(out, columns=["id", "part", "seq", "n", "after", "bad"])
        if after is not None:
            yield pd.DataFrame([(current, last, seq, n, after, bad)], columns=["id", "part", "seq", "n", "after", "bad"])

    return run, f"id {id_type}, part int, seq long, n long, after array<int>, bad array<long>"


def turn_order(turns: DataFrame, template: Template = INSTRUCT, id_col: str = "conv_id", turn_col: str = "turn",
               role_col: str = "role") -> DataFrame:
    """For each conversation whether its turns are in the template's order:
    (id_col, n_turns, valid, first_bad: the first turn out of order, from 1;
    one past the last if only the end is wrong, else null). Null turns come
    first, equal turns in order of their role; a null id is a conversation."""
    rows = turns.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"))
    order = ["id", "turn", "role"]
    ranges = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order) \
        .select("id", "role", F.spark_partition_id().alias("part"))
    run, schema = _maps(template, rows.schema["id"].dataType.simpleString())
    maps = ranges.mapInPandas(run, schema)
    # one row a range and conversation
    pieces = maps.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("part", "n", "after", "bad"))).alias("maps"))
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(0).alias("state"), zero.alias("n"), zero.alias("bad"))

    def compose(seen: Column, m: Column) -> Column:
        known = seen["state"] >= 0
        at = F.greatest(seen["state"], F.lit(0)) + 1
        to, bad = F.element_at(m["after"], at), F.element_at(m["bad"], at)
        return F.struct(F.when(known, to).otherwise(seen["state"]).alias("state"), (seen["n"] + m["n"]).alias("n"),
                        F.when(known & (to < 0), seen["n"] + bad).otherwise(seen["bad"]).alias("bad"))

    done = pieces.select("id", F.aggregate("maps", start, compose).alias("end"))
    states = list(template.order)
    first_bad = F.when(F.col("end.state") < 0, F.col("end.bad")) \
        .when(~F.col("end.state").isin([states.index(s) for s in template.final]), F.col("end.n") + 1)
    return done.select(F.col("id").alias(id_col), F.col("end.n").alias("n_turns"), first_bad.isNull().alias("valid"),
                       first_bad.alias("first_bad"))


# ---------------------------------------------------------------- reading
def reader(template: Template):
    """A function from formatted text to its turns (role, text) in order."""
    token = re.compile(r"\\(.)|(" + "|".join(map(re.escape, template.controls())) + ")", re.DOTALL)
    opens = {before: (name, after) for name, (before, after, _) in template.roles.items()}
    start, name_end, end = template.other

    def read(text: str) -> list[tuple[str, str]]:
        turns, at, role, closing, piece = [], 0, None, None, []
        for m in token.finditer(text):
            piece.append(text[at:m.start()])
            at = m.end()
            if m[1] is not None:
                piece.append(m[1])
                continue
            inside = "".join(piece)
            piece = []
            if closing is None:
                if inside or (m[2] != start and m[2] not in opens):
                    raise ValueError("text outside of turns")
                role, closing = (None, name_end) if m[2] == start else opens[m[2]]
            elif m[2] != closing:
                raise ValueError(f"{m[2]} inside a turn")
            elif closing == name_end and role is None:
                role, closing = inside, end
            else:
                turns.append((role, inside))
                role = closing = None
        if closing is not None or at < len(text):
            raise ValueError("a turn without an end")
        return turns

    return read


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def _digests(template: Template):
    read = reader(template)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        seen, current, n, chars, size = False, None, 0, 0, 0
        turns = loss = None
        for batch in batches:
            out = []
            for conv, text, spans in zip(batch["id"], batch["formatted"], batch["loss"]):
                if not seen or not _same(conv, current):
                    if seen:
                        out.append((current, n, turns.hexdigest(), chars, loss.hexdigest(), size))
                    seen, current, n, chars, size = True, conv, 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                for role, said in read(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                for s in spans:
                    learned = unescaped(text[s["start"]:s["end"]])
                    loss.update(learned.encode())
                    chars += len(learned)
                size += len(text)
            if out:
                yield pd.DataFrame(out, columns=names)
        if seen:
            yield pd.DataFrame([(current, n, turns.hexdigest(), chars, loss.hexdigest(), size)], columns=names)

    return run


def digests(formatted: DataFrame, template: Template = INSTRUCT, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """What a reader gets back from ``format_turns``, a row a conversation:
    (id_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars),
    by turn, then role, then formatted text. A digest runs over a conversation
    in order, so its rows pass one task, as a stream that keeps none of them."""
    id_type = formatted.schema[id_col].dataType.simpleString()
    order = [F.col(id_col), F.col(turn_col), F.col("role"), F.col("formatted")]
    rows = formatted.repartition(shuffle_partitions(formatted.sparkSession), id_col).sortWithinPartitions(*order) \
        .select(F.col(id_col).alias("id"), "formatted", "loss")
    return rows.mapInPandas(_digests(template), f"id {id_type}, n_turns long, turns_sha256 string, loss_chars long, "
                                                "loss_sha256 string, formatted_chars long").withColumnRenamed("id", id_col)
