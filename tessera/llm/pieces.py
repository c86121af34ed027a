"""The piece lattice of a SentencePiece vocabulary, and token counts on it.

A path through the lattice of a normalised text is a sequence of vocabulary
pieces; its score is the sum of the pieces' scores as the model file gives
them. A character that is no piece by itself is also an edge, with the unknown
score (ten below the least piece score); it counts as its UTF-8 bytes where the
model falls back to bytes. Scores are added exactly (as doubles), also where a
text is so long that the library's single floats would round.

No edge crosses a place between two characters that stand side by side in no
piece, so the lattice falls apart there: words are segmented one by one, and
each distinct word once for as long as the worker remembers it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Words that a worker remembers before it forgets them all.
MOST_WORDS = 500_000


class Vocabulary:
    """Pieces, scores and the match automaton of a model file's bytes."""

    def __init__(self, model: bytes):
        self.sp = sp = sentencepiece.SentencePieceProcessor()
        sp.LoadFromSerializedProto(model)
        plain = [k for k in range(sp.get_piece_size())
                 if not (sp.is_unknown(k) or sp.is_control(k) or sp.is_unused(k) or sp.is_byte(k))]
        self.score = {sp.id_to_piece(k): sp.get_score(k) for k in plain}
        self.id = {sp.id_to_piece(k): k for k in plain}
        self.unknown = min(self.score.values()) - UNKNOWN_PENALTY
        self.unknown_id = sp.unk_id()
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.by_byte = all(sp.is_byte(k) for k in self.bytes)
        self.pairs = {pair for p in self.score for pair in zip(p, p[1:])}
        self.chars = {p for p in self.score if len(p) == 1}
        self.matches = ahocorasick.Automaton()
        self.piece_ids = list(self.id.values())
        self.lengths, self.scores = [len(p) for p in self.score], list(self.score.values())
        for k, p in enumerate(self.score):
            self.matches.add_word(p, k)
        self.matches.make_automaton()
        # words start at a run of spaces, unless some piece goes on over one
        joined = any(p.lstrip(SPACE).find(SPACE) >= 0 for p in self.score)
        self.words = re.compile(".+" if joined else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", re.DOTALL)

    def normal(self, text: str | None) -> str:
        return self.sp.normalize(text) if text else ""

    def cut(self, word: str) -> list[str]:
        """Parts between which no piece reaches."""
        if self.pairs.issuperset(zip(word, word[1:])):
            return [word]
        at = [0, *(k for k, pair in enumerate(zip(word, word[1:]), 1) if pair not in self.pairs), len(word)]
        return [word[a:b] for a, b in zip(at, at[1:])]

    def char_ids(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")] if self.by_byte else [self.unknown_id]

    def edges(self, part: str) -> list[tuple[int, int, float]]:
        """Edges (end, start, score) by end, for one end the longest first: of
        equally good paths the tokenizer keeps the one whose last piece starts
        first, which it meets first."""
        lengths, scores = self.lengths, self.scores
        out = [(last + 1, last + 1 - lengths[k], scores[k]) for last, k in self.matches.iter(part)]
        if not self.chars.issuperset(part):
            out += [(k + 1, k, self.unknown) for k, c in enumerate(part) if c not in self.chars]
            out.sort(key=lambda e: e[:2])
        return out


@dataclass
class Counts:
    """Remembers the best score and the number of pieces of words."""
    vocabulary: Vocabulary

    def __post_init__(self):
        self.known: dict[str, tuple[int, float]] = {}

    def _count(self, part: str) -> tuple[int, float]:
        v = self.vocabulary
        best, pieces = [-float("inf")] * (len(part) + 1), [0] * (len(part) + 1)
        best[0] = 0.0
        for end, start, score in v.edges(part):
            if best[start] + score > best[end]:
                best[end] = best[start] + score
                pieces[end] = pieces[start] + 1
                if score == v.unknown and end - start == 1 and part[start] not in v.chars:
                    pieces[end] += len(v.char_ids(part[start])) - 1
        return pieces[-1], best[-1]

    def _word(self, word: str) -> tuple[int, float]:
        counted = [self._count(p) for p in self.vocabulary.cut(word)]
        out = sum(n for n, _ in counted), sum(s for _, s in counted)
        if len(word) <= 64:
            self.known[word] = out
        return out

    def text(self, text: str | None) -> tuple[int, float]:
        """Pieces and score of the best path of a text; 0 for null or empty."""
        if len(self.known) > MOST_WORDS:
            self.known.clear()
        n, score, known = 0, 0.0, self.known
        for word in self.vocabulary.words.findall(self.vocabulary.normal(text)):
            c, s = known.get(word) or self._word(word)
            n += c
            score += s
        return n, score


_WORKER: dict[tuple, object] = {}


def remembered(kind: type, model: bytes, *args):
    """This worker's ``kind`` for a model; only the last one is kept."""
    key = (kind, hash(model), args)
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = kind(Vocabulary(model), *args)
    return _WORKER[key]


def read_model(path: str) -> bytes:
    """A vocabulary file, read on the driver; it is of fixed size and goes to
    the tasks by broadcast."""
    with open(path, "rb") as f:
        return f.read()


def token_counts(spark: SparkSession, text: Column, model: bytes) -> Column:
    """``struct<n:bigint,score:double>`` for a text column: number of pieces
    and score of the best segmentation; zeros for null and empty texts."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<n:bigint,score:double>")
    def count(texts: pa.Array) -> pa.Array:
        own = remembered(Counts, shared.value)
        done = [own.text(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([n for n, _ in done], pa.int64()),
                                           pa.array([s for _, s in done], pa.float64())], ["n", "score"])

    return count(text)
