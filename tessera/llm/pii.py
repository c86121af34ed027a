"""Personal data with offset-preserving deobfuscation.

Four kinds are found in the text as it stands (the base spans). Transducers
then rewrite disguised text: look-alike and wide characters to ASCII,
invisible characters to nothing, spelled digits to digits, disguised ``at``
and ``dot`` to ``@`` and ``.``. Every character of the rewritten text keeps the
range of source characters it came from, through all transducers. The same
detectors run on the rewritten text, and what they find only there is mapped
back to the source and added; base spans always stay.

Only texts that a transducer can change are rewritten. All scans are linear in
the text, also for long runs of digits, blanks or ``@``.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Code point offsets, end exclusive; ``base`` is false for spans that only show when rewritten.
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"

Span = tuple[int, int]

# The characters and forms of the four kinds.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _emails(text: str) -> list[Span]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = done + len(text[done:at].rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if begin < at else None
        done = at + 1
        if domain:
            out.append((begin, domain.end()))
            done = domain.end()
        at = text.find("@", done)
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _small(number: str) -> bool:
    n = number.lstrip("0")
    return len(n) < 3 or len(n) == 3 and n <= "255"


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def detect(text: str) -> dict[str, list[Span]]:
    """Leftmost non-overlapping spans of each kind; a match that fails its
    test (ip parts at most 255; card 13 to 19 digits passing Luhn; phone 9 to
    15 digits) is dropped and not tried again in another length."""
    out = {
        "email": _emails(text),
        "ip": [m.span() for m in IP.finditer(text) if all(map(_small, m[0].split(".")))],
        "card": [m.span() for m in CARD.finditer(text)
                 if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and _luhn(d)],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15],
    }
    return out


# Letters of other scripts that look like the ASCII letter below them.
ALIKE = str.maketrans(
    "аеіјорсухһԁԛԝѕАВЕНІЈКМОРЅТХΑΒΕΖΗΙΚΜΝΟΡΤΧοιν",
    "aeijopcyxhdqwsABEHIJKMOPSTXABEZHIKMNOPTXoiv")
INVISIBLE = "­​‌‍⁠﻿"


def _folds() -> dict[int, str]:
    """One ASCII character for each look-alike: the fixed pairs; by rule, every
    decimal digit and every compatibility form of one ASCII character; dashes
    and blanks."""
    out = {k: chr(v) for k, v in ALIKE.items()}
    for cp in (*range(0x0250, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800)):
        c = chr(cp)
        digit = unicodedata.decimal(c, None)
        plain = str(digit) if digit is not None else unicodedata.normalize("NFKC", c)
        if len(plain) == 1 and "!" <= plain <= "~" and unicodedata.category(c) != "No":
            out[cp] = plain
    out |= dict.fromkeys([*range(0x2010, 0x2016), 0x2212], "-")
    out |= dict.fromkeys([0x00A0, *range(0x2000, 0x200B), 0x202F, 0x3000], " ")
    return out


FOLDS = _folds()
ODD = frozenset(map(chr, FOLDS)) | frozenset(INVISIBLE)
HIDDEN = re.compile(f"[{INVISIBLE}]+")

# Spelled digits 0 to 9, the sign and the point in four languages.
DIGITS = [
    "zero one two three four five six seven eight nine",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
]
SPELLED = {w: str(k) for line in DIGITS for k, w in enumerate(line.split())}
PLUS = "plus|más|mas"
DOT = "dot|punkt|punto|point"
_DIGIT = "|".join(sorted(SPELLED, key=len, reverse=True))
_BETWEEN = "[ ,-]{1,3}"
#: At least four digits and points in a row.
RUN = re.compile(rf"(?<!\w)(?:(?:{PLUS}|\+)[ ,-]?)?(?<!\w)(?:{_DIGIT}|[0-9]+)"
                 rf"(?:{_BETWEEN}(?:{_DIGIT}|{DOT}|[0-9]+)){{3,}}(?!\w)", re.IGNORECASE)
ITEM = re.compile(rf"(?P<plus>{PLUS}|\+)|(?P<dot>{DOT})|(?P<word>{_DIGIT})|(?P<digit>[0-9])", re.IGNORECASE)
#: Letters that match s and i when case is ignored, but don't become them in lower case.
CASELESS = str.maketrans("ſıİ", "sii")
#: Digit and dot words by their first letter, which a search tries faster.
_WORD = "|".join(f"{c}(?:{'|'.join(w[1:] for w in (*SPELLED, *DOT.split('|')) if w[0] == c)})"
                 for c in sorted({w[0] for w in (*SPELLED, *DOT.split("|"))}))
#: Two neighbours of a run, one of them in words: every run that is rewritten holds such a pair.
ANY_SPELLED = re.compile(rf"\b(?:{_WORD}){_BETWEEN}(?:{_WORD}|[0-9])|[0-9]{_BETWEEN}(?:{_WORD})", re.IGNORECASE)

_LABEL = "[A-Za-z0-9-]+"
_OPEN, _CLOSE = r"[ \t]{0,2}[\[({<][ \t]{0,2}", r"[ \t]{0,2}[\])}>][ \t]{0,2}"
BRACKETED_DOT = rf"{_OPEN}(?:{DOT}|\.){_CLOSE}"
ANY_DOT = rf"(?:\.|{BRACKETED_DOT}|[ \t]{{1,2}}(?:{DOT})[ \t]{{1,2}})"
AT = re.compile(rf"(?P<sure>{_OPEN}(?:at|arroba|@){_CLOSE}|@)|(?P<word>[ \t]{{1,2}}(?:at|arroba)[ \t]{{1,2}})",
                re.IGNORECASE)
AFTER = re.compile(rf"{_LABEL}(?:{ANY_DOT}{_LABEL})+", re.IGNORECASE)
DOTS = re.compile(ANY_DOT, re.IGNORECASE)
HIDDEN_DOT = re.compile(rf"(?:{BRACKETED_DOT}|[ \t]{{1,2}}(?:{DOT})[ \t]{{1,2}})\Z", re.IGNORECASE)
#: No disguised point is longer.
LONGEST_DOT = 2 * 5 + max(map(len, DOT.split("|")))
#: Without one of these no at/dot disguise is complete.
BRACKETED = re.compile(rf"[\[({{<][ \t]{{0,2}}(?:at|arroba|@|{DOT}|\.)[ \t]{{0,2}}[\])}}>]", re.IGNORECASE)
DOT_WORDS = frozenset(DOT.split("|"))
# Last labels for which an address in bare words is believed.
TOP_LEVEL = frozenset("""com org net edu gov mil int info biz name io co me tv cc app dev ai us uk ca au nz ie de at ch
fr be lu nl es pt it mx ar cl br pl se no dk fi ru ua cn jp in eu example test""".split())


class _Source:
    """A rewritten text; character k came from source[lo[k]:hi[k]]."""

    def __init__(self, text: str):
        self.text, self.lo = text, np.arange(len(text))
        self.hi = self.lo + 1

    def rewrite(self, edits: list[tuple[int, int, list[tuple[str, int, int]]]]) -> None:
        """Replace ``[a, b)`` by characters, each with the range that it came
        from; edits are in order and don't overlap."""
        text, lo, hi, done = [], [], [], 0
        for a, b, new in edits:
            text.append(self.text[done:a])
            lo.append(self.lo[done:a])
            hi.append(self.hi[done:a])
            for c, x, y in new:
                text.append(c)
                lo.append(self.lo[x:x + 1])
                hi.append(self.hi[y - 1:y])
            done = b
        self.text = "".join([*text, self.text[done:]])
        self.lo = np.concatenate([*lo, self.lo[done:]])
        self.hi = np.concatenate([*hi, self.hi[done:]])


def _spelled(text: str) -> list:
    """Digits for runs of spelled digits; the blanks between them go."""
    edits = []
    for run in RUN.finditer(text):
        if not any(m["word"] for m in ITEM.finditer(text, *run.span())):
            continue
        new, at = [], run.start()
        for m in ITEM.finditer(text, *run.span()):
            c = "+" if m["plus"] else "." if m["dot"] else SPELLED.get(m[0].translate(CASELESS).lower(), m[0])
            new.append((c, m.start(), m.end()))
            at = m.end()
        edits.append((run.start(), at, new))
    return edits


def _local_start(text: str, low: int, end: int) -> int:
    """Where the labels and points, disguised or not, begin that end at
    ``end``, not before ``low``; ``end`` if there are none."""
    start, at = end, end
    while True:
        label = at
        while label > low and text[label - 1] in LOCAL:
            label -= 1
        if label == at:
            return start
        start = label
        dot = HIDDEN_DOT.search(text, max(low, start - LONGEST_DOT), start)
        if not dot:
            return start
        at = dot.start()


def _disguised(text: str) -> list:
    """``@`` and ``.`` for disguised ones between what can be the two sides of
    an address. A bare word ``at`` counts only where a point of the domain is
    disguised too and the domain ends as domains do, so that prose is left
    alone."""
    edits, done = [], 0
    for at in AT.finditer(text):
        if at.start() < done:
            continue
        after = AFTER.match(text, at.end())
        start = _local_start(text, done, at.start()) if after else at.start()
        if start == at.start():
            continue
        dots = list(DOTS.finditer(text, *after.span()))
        if at["word"] and (all(d[0] == "." for d in dots)
                           or after[0][dots[-1].end() - after.start():].lower() not in TOP_LEVEL):
            continue
        left = [d for d in DOTS.finditer(text, start, at.start()) if d[0] != "."]
        parts = [*((d, ".") for d in left), (at, "@"), *((d, ".") for d in dots if d[0] != ".")]
        edits += [(m.start(), m.end(), [(c, m.start(), m.end())]) for m, c in parts if m[0] != c]
        done = after.end()
    return edits


def _rewritten(text: str) -> _Source | None:
    """None if no transducer changes the text."""
    odd = not text.isascii() and not ODD.isdisjoint(text)
    if not odd:
        words = text.lower().replace(",", " ").replace("-", " ").split()
        if DOT_WORDS.isdisjoint(words) and not BRACKETED.search(text) and not ANY_SPELLED.search(text):
            return None
    plain = text.translate(FOLDS) if odd else text
    out = _Source(plain)
    if odd:
        out.rewrite([(m.start(), m.end(), []) for m in HIDDEN.finditer(out.text)])
    out.rewrite(_spelled(out.text))
    out.rewrite(_disguised(out.text))
    return out if out.text != text else None


def find(text: str | None) -> list[tuple[str, int, int, bool]]:
    """Spans ``(kind, start, end, base)`` ordered by kind as in ``KINDS``, then
    start. Null and empty texts have none. An added span is one whose source
    reads differently than its rewritten form, and that isn't inside a base
    span of its kind."""
    if not text:
        return []
    base = detect(text)
    spans = {k: [(a, b, True) for a, b in base[k]] for k in KINDS}
    new = _rewritten(text)
    if new:
        for kind, found in detect(new.text).items():
            for a, b in found:
                x, y = int(new.lo[a]), int(new.hi[b - 1])
                if text[x:y] != new.text[a:b] and not any(s <= x and y <= e for s, e in base[kind]):
                    spans[kind].append((x, y, False))
    return [(k, a, b, own) for k in KINDS for a, b, own in sorted(spans[k])]


def redact(text: str | None) -> str | None:
    """Each span, added ones too, replaced by its kind in brackets;
    overlapping spans become one mark of the kind that starts first."""
    out, done = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b, _ in find(text)):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]]) if out else text


_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                                 ("base", pa.bool_())]))


def find_spans(text: Column) -> Column:
    """``SPANS`` of a text column, over the whole of each text."""

    @F.arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in find(t.as_py())]
                         for t in texts], type=_SPAN_TYPE)

    return spans(text)


def redacted(text: Column) -> Column:
    """The text column with personal data replaced; null stays null."""

    @F.arrow_udf("string")
    def replace(texts: pa.Array) -> pa.Array:
        return pa.array([redact(t.as_py()) for t in texts], type=pa.string())

    return replace(text)
