"""Vectorised text work for Python workers: code points, words, shingles and hashes as numpy arrays."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np

CHUNK = 400_000  # characters worked on at once; a longer text is a chunk of its own
M1, M2, GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def word_chars() -> np.ndarray:
    """True at each code point that is a letter, mark or number."""
    return np.fromiter((unicodedata.category(chr(i))[0] in "LMN" for i in range(0x110000)), bool, 0x110000)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x += GOLD
    x ^= x >> np.uint64(30)
    x *= M1
    x ^= x >> np.uint64(27)
    x *= M2
    x ^= x >> np.uint64(31)
    return x


@functools.lru_cache(2)
def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, 0x100000001B3, np.uint64))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def chunks(texts: list, size: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about ``size`` characters together, with the number of the first. Null counts as empty."""
    start, held, n = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t or "")
        n += len(held[-1])
        if n >= size:
            yield start, held
            start, held, n = i + 1, [], 0
    if held:
        yield start, held


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (run of letters, marks and numbers, in lower case) and the number of its text."""
    joined = "\n".join(t.lower() for t in texts)
    cp = code_points(joined)
    ends_at = np.cumsum(np.fromiter((len(t.lower()) + 1 for t in texts), np.int64, len(texts)))
    inside = word_chars()[cp]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    length = end - start
    total = int(length.sum())
    first = np.cumsum(length) - length
    offset = np.arange(total) - np.repeat(first, length)
    with np.errstate(over="ignore"):
        value = (cp[inside].astype(np.uint64) + np.uint64(1)) * _powers(1 << max(6, int(length.max()).bit_length()))[offset]
        h = mix(np.add.reduceat(value, first))
    return h, np.searchsorted(ends_at, start, side="right")


def grams(h: np.ndarray, doc: np.ndarray, j: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every j consecutive words, at most k, of a text, and its text: that of a text of j words by shingles()."""
    n = len(h)
    if n < j:
        return h[:0], doc[:0]
    s = np.zeros(n - j + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            s = mix(s * np.uint64(31) + (h[i : n - j + 1 + i] if i < j else np.uint64(0)))
    full = doc[: n - j + 1] == doc[j - 1 :]
    return s[full], doc[: n - j + 1][full]


def shingles(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k consecutive words of a text, and its text. A shorter text has one shingle of all its words."""
    n = len(h)
    if not n:
        return h, doc
    s = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            part = np.zeros(n, np.uint64)
            if j < n:
                same = doc[: n - j] == doc[j:]
                part[: n - j] = np.where(same, h[j:], np.uint64(0))
            s = mix(s * np.uint64(31) + part)
    full = np.zeros(n, bool)
    if n >= k:
        full[: n - k + 1] = doc[: n - k + 1] == doc[k - 1 :]
    begins = np.concatenate(([True], doc[1:] != doc[:-1]))
    keep = full | begins
    return s[keep], doc[keep]
