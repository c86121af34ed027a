"""N-best SentencePiece segmentation of whole texts, and decoding.

Per word, a forward Viterbi pass gives the best score of every prefix. Those
scores are an exact estimate of what a path from the end back to some position
can still gain, so A* from the end of the word yields its paths in order of
score, each step on a path that is among the best.

A text's best paths combine those of its words. A path of rank N or better
differs from the best in fewer than N words, and these can be taken from the
N - 1 words that lose least by their second-best path; what a word loses
follows from the two best scores of its prefixes without a search. So A* runs on a few
words a text, and a heap combines their lists.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tessera.llm.pieces import MOST_WORDS, Vocabulary, remembered

_NONE = -float("inf")
PATHS = "array<struct<score:double,n_pieces:bigint,ids_sha256:string,ids:array<int>,decoded:boolean>>"
_PATHS = pa.list_(pa.struct([("score", pa.float64()), ("n_pieces", pa.int64()), ("ids_sha256", pa.string()),
                             ("ids", pa.list_(pa.int32())), ("decoded", pa.bool_())]))


class Segmenter:
    """N-best paths of texts; remembers words."""

    def __init__(self, vocabulary: Vocabulary, n: int):
        self.vocabulary, self.n = vocabulary, n
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.score: list[float] = []   # best score, loss of the second-best path and best ids of each word
        self.loss: list[float] = []
        self.ids: list[bytes] = []
        self.parts: dict[str, tuple[float, float, bytes]] = {}
        self.lists: dict[str, list[tuple[float, bytes, bool]]] = {}

    def _ids(self, part: str, cuts: list[int]) -> bytes:
        v = self.vocabulary
        out = array("i")
        for a, b in zip(cuts, cuts[1:]):
            k = v.id.get(part[a:b])
            out.extend([k] if k is not None else v.char_ids(part[a:b]))
        return out.tobytes()

    @staticmethod
    def _forward(edges: list, n: int) -> list[float]:
        """Best score of each prefix."""
        best = [_NONE] * (n + 1)
        best[0] = 0.0
        for end, start, score in edges:
            if best[start] + score > best[end]:
                best[end] = best[start] + score
        return best

    def _measure(self, part: str) -> tuple[float, float, bytes]:
        """Best score, loss of the second-best path, best ids: a forward pass
        that keeps the two best scores of every prefix."""
        v, n = self.vocabulary, len(part)
        lengths, scores = v.lengths, v.scores
        best, second, back = [_NONE] * (n + 1), [_NONE] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        if v.chars.issuperset(part):
            edges = v.matches.iter(part)
        else:  # a character without a piece is an edge of its own, by -1
            edges = sorted([*v.matches.iter(part), *((k, -1) for k, c in enumerate(part) if c not in v.chars)],
                           key=lambda e: (e[0], -lengths[e[1]] if e[1] >= 0 else -1))
        for last, k in edges:
            end = last + 1
            start, score = (end - lengths[k], scores[k]) if k >= 0 else (last, v.unknown)
            through = best[start] + score
            if through > best[end]:
                other = second[start] + score
                second[end] = other if other > best[end] else best[end]
                best[end], back[end] = through, k
            elif through > second[end]:
                second[end] = through
        ids, end = [], n
        while end:
            k = back[end]
            if k >= 0:
                ids.append(v.piece_ids[k])
                end -= lengths[k]
            else:
                ids.extend(reversed(v.char_ids(part[end - 1])))
                end -= 1
        ids.reverse()
        return best[n], best[n] - second[n], array("i", ids).tobytes()

    def _learn(self, word: str) -> int:
        # the same word comes with many marks behind it, which no piece joins to it
        known, score, loss, ids = self.parts, 0.0, -_NONE, b""
        pairs, end, marks = self.vocabulary.pairs, len(word), []
        while end > 1 and (word[end - 2], word[end - 1]) not in pairs:
            end -= 1
            marks.append(word[end])
        for p in (word[:end], *reversed(marks)):
            if p not in known:
                known[p] = self._measure(p)
            s, x, k = known[p]
            score, loss, ids = score + s, x if x < loss else loss, ids + k
        self.at[word] = at = len(self.score)
        self.score.append(score)
        self.loss.append(loss)
        self.ids.append(ids)
        return at

    def _search(self, part: str) -> list[tuple[float, bytes]]:
        """The ``n`` best paths of a part by backward A*."""
        best = self._forward(edges := self.vocabulary.edges(part), len(part))
        arriving: list[list] = [[] for _ in best]
        for end, start, score in edges:
            arriving[end].append((start, score))
        out, pushed = [], 0
        queue = [(-best[-1], 0, 0.0, len(part), (len(part), None))]
        while queue and len(out) < self.n:
            _, _, gained, end, path = heapq.heappop(queue)
            if not end:
                cuts = []
                while path:
                    cuts.append(path[0])
                    path = path[1]
                out.append((gained, self._ids(part, cuts)))
                continue
            # the longest edge is pushed last and, of equals, popped first: the tokenizer's own choice
            for a, s in reversed(arriving[end]):
                pushed += 1
                heapq.heappush(queue, (-(gained + s + best[a]), -pushed, gained + s, a, (a, path)))
        return out

    def best(self, word: str) -> list[tuple[float, bytes, bool]]:
        """The ``n`` best paths of a word: score, ids, and whether they decode
        to the same text as the best."""
        if word not in self.lists:
            parts = [self._search(p) for p in self.vocabulary.cut(word)]
            paths = [(s, b"".join(parts[k][r][1] for k, r in enumerate(ranks)))
                     for s, ranks in combined([[s for s, _ in p] for p in parts], self.n)]
            said = [self.decode(raw) for _, raw in paths]
            self.lists[word] = [(s, raw, x == said[0]) for (s, raw), x in zip(paths, said)]
        return self.lists[word]

    def decode(self, raw: bytes) -> str:
        return self.vocabulary.sp.decode(np.frombuffer(raw, dtype=np.int32).tolist()) if raw else ""

    def text(self, text: str | None) -> list[tuple[float, bytes]]:
        """The ``n`` best paths of a text (fewer if there are fewer), best
        first; one empty path for null and empty texts."""
        return [path[:2] for path in self.paths(text)]

    def paths(self, text: str | None) -> list[tuple[float, bytes, bool]]:
        """``text``, each path with whether it decodes to what the best does."""
        if len(self.at) > MOST_WORDS:
            self._forget()
        words = self.vocabulary.words.findall(self.vocabulary.normal(text))
        if not words:
            return [(0.0, b"", True)]
        known = self.at
        rows = list(map(known.get, words))
        if None in rows:
            rows = [known[w] if w in known else self._learn(w) for w in words]
        score, ids, losses = self.score, self.ids, self.loss
        parts = [ids[k] for k in rows]
        total = sum(map(score.__getitem__, rows))
        # the words that lose least by another path
        lost, open_ = list(map(losses.__getitem__, rows)), []
        for x in sorted(lost)[:self.n - 1]:
            open_.append(lost.index(x, open_[-1] + 1 if open_ and lost[open_[-1]] == x else 0))
        open_.sort()
        lists = [self.best(words[k]) for k in open_]
        fixed = total - sum(score[rows[k]] for k in open_)
        out = []
        for gained, ranks in combined([[x[0] for x in own] for own in lists], self.n):
            for k, own, r in zip(open_, lists, ranks):
                parts[k] = own[r][1]
            out.append((fixed + gained, b"".join(parts), all(own[r][2] for own, r in zip(lists, ranks))))
        return out


def combined(lists: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The ``n`` best sums of one score from each descending list, with the
    chosen ranks."""
    first = (0,) * len(lists)
    queue = [(-sum(x[0] for x in lists), first)]
    seen, out = {first}, []
    while queue and len(out) < n:
        score, ranks = heapq.heappop(queue)
        out.append((-score, ranks))
        for k, r in enumerate(ranks):
            new = (*ranks[:k], r + 1, *ranks[k + 1:])
            if r + 1 < len(lists[k]) and new not in seen:
                seen.add(new)
                heapq.heappush(queue, (score + lists[k][r] - lists[k][r + 1], new))
    return out


def encoded(spark: SparkSession, text: Column, model: bytes, n: int = 4, with_ids: bool = True) -> Column:
    """``PATHS`` of a text column: the ``n`` best segmentations of each whole
    text, best first; for null and empty texts one path without pieces.

    ``ids_sha256`` is the digest of the ids as little-endian 32-bit integers;
    ``ids`` are left out (null) unless ``with_ids``; ``decoded`` tells whether
    decoding gives the text back (a null text counts as empty). Rows that repeat
    get the same paths each, an empty table none; a text is segmented word by
    word, so its length costs no more than its ids."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(PATHS)
    def paths(texts: pa.Array) -> pa.Array:
        own = remembered(Segmenter, shared.value, n)
        out = []
        for t in texts:
            said, rows = t.as_py() or "", []
            found = own.paths(said)
            back = own.decode(found[0][1]) == said
            for score, raw, same in found:
                rows.append({"score": score, "n_pieces": len(raw) // 4, "ids_sha256": hashlib.sha256(raw).hexdigest(),
                             "ids": np.frombuffer(raw, dtype=np.int32) if with_ids else None,
                             "decoded": back if same else own.decode(raw) == said})
            out.append(rows)
        return pa.array(out, type=_PATHS)

    return paths(text)


def decoded(spark: SparkSession, ids: Column, model: bytes) -> Column:
    """The text of a column of id lists; null stays null."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def text(lists: pa.Array) -> pa.Array:
        sp = remembered(Segmenter, shared.value, 1).vocabulary.sp
        return pa.array([None if x is None else sp.decode(x) if x else "" for x in lists.to_pylist()], pa.string())

    return text(ids)
