"""Word shingles of a text as sets of 64-bit hashes, and MinHash signatures.

Words are what lies between spaces and the control characters 9 to 13, with
A-Z in lower case. The set of a text holds its distinct runs of ``size``
words; a text with fewer words has its whole word sequence as one shingle, a
text without words has none. Everything is computed with numpy on the UTF-8
bytes; hashes depend on nothing but the words.
"""

from __future__ import annotations

import hashlib

import numpy as np

SIZE = 5
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd; powers of it weigh the bytes of a word
_POWERS = np.array([pow(_BASE, k, 1 << 64) for k in range(256)], dtype=_U)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit moves every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    inside = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    first, last = edge[::2], edge[1::2]
    if not len(first):
        return np.zeros(0, dtype=_U)
    size = last - first
    at = np.flatnonzero(inside)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
    # bytes beyond 256 of a word wrap to the first powers, told apart by a factor for each turn
    turn = (nth >> 8).astype(_U) * _U(2) + _U(1)
    terms = (raw[at].astype(_U) + _U(1)) * _POWERS[nth & 255] * turn
    sums = np.add.reduceat(terms, np.cumsum(size) - size)
    return _mix(sums ^ (size.astype(_U) << _U(40)))


def shingle_set(text: str | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    w = word_hashes(text) if text else np.zeros(0, dtype=_U)
    n = min(size, len(w))
    if not n:
        return w
    x = np.full(len(w) - n + 1, n, dtype=_U)
    for k in range(n):
        x += w[k:len(w) - n + 1 + k] * _POWERS[k + 1]
    x = _mix(x)
    return np.unique(x)


def coordinates(count: int, seed: int = 7) -> np.ndarray:
    """Odd 32-bit multipliers, one for each signature coordinate."""
    return np.random.default_rng(seed).integers(1 << 32, size=count, dtype=np.uint32) | np.uint32(1)


def signature(hashes: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """For each coordinate the least value of a set (not empty) under that
    coordinate's hash, as signed 32-bit integers."""
    x = (hashes >> _U(32)).astype(np.uint32)
    out = np.full(len(multipliers), np.iinfo(np.uint32).max, dtype=np.uint32)
    for a in range(0, len(x), 4096):
        np.minimum(out, (x[None, a:a + 4096] * multipliers[:, None]).min(axis=1), out=out)
    return out.view(np.int32)


def set_key(hashes: np.ndarray) -> bytes:
    """128-bit digest of a set: equal sets have equal keys."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
