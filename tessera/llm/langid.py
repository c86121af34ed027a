"""Language identification with spans for mixed-language text.

Fit: from a bounded sample of labelled documents, Spark counts the character
trigrams of each language's words and the scripts of its letters. The model is
a table of at most ``grams_per_lang`` trigrams for each language.

Predict, per text: words are runs of letters; the script range of a word
narrows its candidate languages to those written in that script; each word
gets one score per language (smoothed log-probability of its trigrams); a
Viterbi pass over the words with a penalty for each change of language labels
spans. The document's language is the one that holds the most letters.

The Viterbi pass is vectorised: texts are cut into blocks of words, all
blocks of a batch advance together once for each language they may start in,
and the blocks of a text are then joined in order. This is exact, and a very
long text costs no more a word than a short one.
"""

from __future__ import annotations

import bisect
import re
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNDETERMINED = "und"
WORD = re.compile(r"[^\W\d_]+")
#: Predicted struct: language, share of the letters it holds, spans (code points, end exclusive).
RESULT = "struct<lang:string,score:double,spans:array<struct<start:int,end:int,lang:string>>>"

# Unicode ranges of scripts (first, last, name), ascending.
SCRIPTS = [
    (0x0041, 0x024F, "Latin"), (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"),
    (0x0531, 0x058F, "Armenian"), (0x0591, 0x05F4, "Hebrew"), (0x0600, 0x06FF, "Arabic"),
    (0x0750, 0x077F, "Arabic"), (0x0900, 0x097F, "Devanagari"), (0x0980, 0x09FF, "Bengali"),
    (0x0A00, 0x0A7F, "Gurmukhi"), (0x0A80, 0x0AFF, "Gujarati"), (0x0B80, 0x0BFF, "Tamil"),
    (0x0C00, 0x0C7F, "Telugu"), (0x0C80, 0x0CFF, "Kannada"), (0x0D00, 0x0D7F, "Malayalam"),
    (0x0E00, 0x0E7F, "Thai"), (0x0E80, 0x0EFF, "Lao"), (0x1000, 0x109F, "Myanmar"),
    (0x10A0, 0x10FF, "Georgian"), (0x1100, 0x11FF, "Hangul"), (0x1200, 0x137F, "Ethiopic"),
    (0x1780, 0x17FF, "Khmer"), (0x1E00, 0x1EFF, "Latin"), (0x1F00, 0x1FFF, "Greek"),
    (0x3040, 0x309F, "Kana"), (0x30A0, 0x30FF, "Kana"), (0x3400, 0x4DBF, "Han"),
    (0x4E00, 0x9FFF, "Han"), (0xAC00, 0xD7AF, "Hangul"),
]
_FIRST = [a for a, _, _ in SCRIPTS]


def script_of(char: str) -> str:
    k = bisect.bisect_right(_FIRST, ord(char)) - 1
    return SCRIPTS[k][2] if k >= 0 and ord(char) <= SCRIPTS[k][1] else "Other"


@dataclass
class Model:
    langs: list[str]
    grams: dict[str, int]           # trigram -> row of ``scores``
    scores: np.ndarray              # log-probabilities; the last row is that of an unknown trigram
    scripts: dict[str, np.ndarray]  # script -> 0 for its languages, a large loss for the others
    switch: float
    key: str = ""


def held_out(doc_id: Column) -> Column:
    """Rows the model never learns from: crc32 of the id as text is 2 mod 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        docs_per_lang: int = 1500, grams_per_lang: int = 30000, alpha: float = 0.2, switch: float = 12.0,
        least_script_share: float = 0.01) -> Model:
    """Learn from the rows where ``learn`` holds and text and language are not
    null. The sample is the ``docs_per_lang`` documents of each language whose
    ids come first in hash order (their whole texts), so it is bounded
    whatever the size of the corpus; the number of languages is taken to be a
    few hundred at most."""
    known = docs.where(learn).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    order = Window.partitionBy("lang").orderBy("h", "id")
    ids = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("h"))
    # a hash share of each language that holds some four samples, so that no
    # task ranks a whole language; one row a language is broadcast
    sizes = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    ids = ids.join(F.broadcast(sizes), "lang") \
        .where(F.pmod("h", F.lit(1 << 30)) * F.col("n") < F.lit(float(4 * docs_per_lang << 30))) \
        .withColumn("k", F.row_number().over(order)).where(F.col("k") <= docs_per_lang).select("id")
    # at most docs_per_lang ids a language
    sample = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")) \
        .join(F.broadcast(ids.distinct()), "id", "left_semi")
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
                          .alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    marked = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    grams = words.select("lang", "n", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("word")), lambda i: F.substring(marked, i, F.lit(3)))).alias("gram")) \
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = grams.withColumn("k", F.row_number().over(top)).where(F.col("k") <= grams_per_lang).collect()
    langs = sorted({r["lang"] for r in rows})
    index = {g: k for k, g in enumerate(sorted({r["gram"] for r in rows}))}
    counts = np.zeros((len(index) + 1, len(langs)))
    at = {x: k for k, x in enumerate(langs)}
    letters: dict[str, np.ndarray] = {}
    for r in rows:
        counts[index[r["gram"]], at[r["lang"]]] = r["n"]
        name = script_of(r["gram"].strip()[:1] or " ")
        letters.setdefault(name, np.zeros(len(langs)))[at[r["lang"]]] += r["n"]
    total = counts.sum(axis=0)
    scores = np.log((counts + alpha) / (total + alpha * len(counts)))
    scripts = {s: np.where(n >= least_script_share * total, 0.0, -1e3) for s, n in letters.items()}
    scripts = {s: n for s, n in scripts.items() if (n == 0).any()}
    return Model(langs, index, scores.astype(np.float32), scripts, switch, key=uuid.uuid4().hex)


@dataclass
class _Words:
    """Scores of the words seen so far by this worker, up to a bound."""
    model: Model
    most: int = 150_000
    at: dict[str, int] = field(default_factory=dict)
    scores: np.ndarray = None
    letters: np.ndarray = None

    def __post_init__(self):
        self.scores = np.zeros((1, len(self.model.langs)), dtype=np.float32)
        self.letters = np.zeros(1, dtype=np.int64)
        self.known = np.zeros(1, dtype=bool)

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self.at) > self.most:
            self.at = {}
            self.__post_init__()
        got = [self.at.get(w, -1) for w in words]
        if -1 in got:
            new = list(dict.fromkeys(w for w, k in zip(words, got) if k < 0))
            self._add(new)
            got = [self.at[w] for w in words]
        return np.array(got, dtype=np.int64)

    def _add(self, words: list[str]) -> None:
        m, unknown = self.model, len(self.model.grams)
        flat, starts = [], []
        for w in words:
            starts.append(len(flat))
            t = f" {w.lower()} "
            flat += [m.grams.get(t[i:i + 3], unknown) for i in range(len(t) - 2)]
        scores = np.add.reduceat(m.scores[flat], starts, axis=0)
        letters = np.array([len(w) if w.isalpha() else sum(map(str.isalpha, w)) for w in words])
        known = np.ones(len(words), dtype=bool)
        for k, w in enumerate(words):
            narrow = m.scripts.get(script_of(next(filter(str.isalpha, w), w[0])))
            if narrow is None:  # a script of no language says nothing
                scores[k], known[k] = 0, False
            else:
                scores[k] += narrow
        base = len(self.scores)
        self.at.update((w, base + k) for k, w in enumerate(words))
        self.scores = np.concatenate([self.scores, scores])
        self.letters = np.concatenate([self.letters, letters])
        self.known = np.concatenate([self.known, known])


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float, block: int = 64) -> np.ndarray:
    """Best language of each word. ``scores`` (words x languages) of several
    texts one after the other; ``first[t]:first[t+1]`` are the words of text
    t. Of equally good paths: the language without a change, else the first."""
    n, k = scores.shape
    sizes = np.diff(first)
    blocks = -(-sizes // block)
    text = np.repeat(np.arange(len(sizes)), blocks)
    nth = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = first[text] + nth * block
    size = np.minimum(first[text + 1] - begin, block)
    m = len(begin)
    eye = np.where(np.eye(k, dtype=bool), 0.0, -np.inf)
    # v[b, s, l]: best score from the word before block b in language s to its last word in l
    v = np.broadcast_to(eye, (m, k, k)).copy()
    moved = np.zeros((block, m, k, k), dtype=bool)
    source = np.zeros((block, m, k), dtype=np.int16)
    for t in range(int(size.max(initial=0))):
        live = size > t
        e = scores[np.where(live, begin + t, 0)] * live[:, None]
        top = v.argmax(axis=2)
        best = np.take_along_axis(v, top[:, :, None], axis=2) - switch
        change = (best > v) & live[:, None, None]
        moved[t], source[t] = change, top
        v = np.where(change, best, v) + e[:, None, :]
    # join the blocks of each text: the best score of each language before a
    # block, and for each language at its end the one that it was entered in
    enter = np.zeros((m, k))
    came = np.zeros((m, k), dtype=np.int16)
    end = np.zeros(m, dtype=np.int64)
    start = np.cumsum(blocks) - blocks
    for j in range(int(blocks.max(initial=0))):
        own = start[blocks > j] + j
        through = enter[own][:, :, None] + v[own]
        came[own] = through.argmax(axis=1)
        out = through.max(axis=1)
        last = nth[own] + 1 == blocks[text[own]]
        end[own[last]] = out[last].argmax(axis=1)
        enter[own[~last] + 1] = out[~last]
    for j in range(int(blocks.max(initial=0)) - 1, 0, -1):
        own = start[blocks > j] + j
        end[own - 1] = came[own, end[own]]
    entered = came[np.arange(m), end]
    path = np.zeros(n, dtype=np.int64)
    state, rows = end.copy(), np.arange(m)
    for t in range(int(size.max(initial=0)) - 1, -1, -1):
        live = size > t
        path[(begin + t)[live]] = state[live]
        state = np.where(live & moved[t][rows, entered, state], source[t][rows, entered], state)
    return path


def _label(texts: list[str | None], words: _Words) -> list[tuple[str, float, list]]:
    m = words.model
    if not m.langs:
        return [(UNDETERMINED, 0.0, [])] * len(texts)
    found = [WORD.findall(t) if t else [] for t in texts]
    first = np.concatenate([[0], np.cumsum([len(x) for x in found])])
    at = words.rows([w for x in found for w in x])
    letters, known = words.letters[at], words.known[at]
    k = len(m.langs)
    path = viterbi(words.scores[at].astype(np.float64), first, m.switch)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    held = np.zeros((len(texts), k))
    np.add.at(held, (text, path), letters * known)
    every = np.bincount(text, weights=letters, minlength=len(texts))
    changes = np.zeros(len(texts), dtype=np.int64)
    if len(at) > 1:
        np.add.at(changes, text[1:], (path[1:] != path[:-1]) & (text[1:] == text[:-1]))
    out = []
    for i, t in enumerate(texts):
        if not every[i]:
            out.append((UNDETERMINED, 0.0, []))
            continue
        best = int(held[i].argmax())
        own = path[first[i]:first[i + 1]]
        if changes[i]:
            begins = [x.start() for x in WORD.finditer(t)]
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1), len(own)]
            edges = [0, *(begins[c] for c in cuts[1:-1]), len(t)]
            spans = [(edges[j], edges[j + 1], m.langs[own[cuts[j]]]) for j in range(len(cuts) - 1)]
        else:
            spans = [(0, len(t), m.langs[own[0]])]
        out.append((m.langs[best], float(held[i][best] / every[i]), spans))
    return out


_WORKER: dict[str, _Words] = {}


def _batches(texts: pa.Array, chars: int):
    """Consecutive texts of about so many characters; only these are unpacked."""
    part, size = [], 0
    for t in texts:
        part.append(t.as_py())
        size += len(part[-1] or "") + 1
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def predictor(spark, model: Model, batch_chars: int = 1_000_000):
    """Column function text -> RESULT. Null text and text without letters are
    ``und`` with score 0 and no spans; a text whose letters belong to scripts
    of no learned language gets the first language and score 0; without any
    learned language everything is ``und``. The model is bounded (see ``fit``),
    so it is broadcast."""
    shared = spark.sparkContext.broadcast(model)
    chars = max(10_000, batch_chars * 16 // max(16, len(model.langs) ** 2))

    @F.arrow_udf(RESULT)
    def predict(text: pa.Array) -> pa.Array:
        own = _WORKER.get(shared.value.key)
        if own is None:
            _WORKER.clear()
            own = _WORKER[shared.value.key] = _Words(shared.value)
        rows = [r for part in _batches(text, chars) for r in _label(part, own)]
        return pa.array([{"lang": a, "score": b, "spans": [{"start": s, "end": e, "lang": x} for s, e, x in c]}
                         for a, b, c in rows],
                        type=pa.struct([("lang", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct(
                            [("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))]))

    return predict


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """The RESULT column for ``docs[text_col]``; use it with ``withColumn`` or
    ``select``, all other columns pass through untouched."""
    return predictor(docs.sparkSession, model)(F.col(text_col))
