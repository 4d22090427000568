"""Words and hashed word shingles of whole texts, used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: Texts, and characters of all, whose words are looked at together.
TEXTS, CHARS = 64, 400_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """Maximal runs of anything but space and the characters 9 to 13; lower changes A-Z only.

    bytes.split() and bytes.lower() have exactly these rules, and no byte of a longer UTF-8 sequence is touched.
    """
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    return (raw.lower() if lower else raw).split()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values in which every bit depends on all others."""
    x = (x ^ (x >> _HALF)) * _MIX
    x = (x ^ (x >> _HALF)) * _MIX
    return x ^ (x >> _HALF)


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def run_hashes(hashed: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all runs of `size` words, from the hashes of the words; fewer words count as one run, none as no run."""
    n = len(hashed)
    if not n:
        return np.empty(0, np.uint64)
    width = min(size, n)
    acc = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        acc = (acc ^ hashed[i:n - width + 1 + i]) * _ODD
        acc ^= acc >> _HALF
    return mix(acc)


def shingle_hashes(tokens: list[bytes], size: int) -> np.ndarray:
    """64-bit hashes of all runs of `size` words, repeats included; fewer words count as one run, none as no run."""
    return run_hashes(word_hashes(tokens), size)


def parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Bounds of texts in a row that are looked at together: up to TEXTS of them and about CHARS characters."""
    lo = chars = 0
    for i, t in enumerate(texts):
        if i > lo and (i - lo >= TEXTS or chars + len(t or "") > CHARS):
            yield lo, i
            lo, chars = i, 0
        chars += len(t or "")
    if lo < len(texts):
        yield lo, len(texts)


def shingle_set(text: str | None, size: int, lower: bool = False) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(words(text, lower), size))


def shingle_sets(paragraphs: list[list[bytes]], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each of many lists of words, hashed together."""
    counts = [len(p) for p in paragraphs]
    total = sum(counts)
    if total < size:
        return [np.unique(shingle_hashes(p, size)) for p in paragraphs]
    # Runs over the end of a list are computed too and left out.
    every = shingle_hashes([w for p in paragraphs for w in p], size)
    out, at = [], 0
    for words_, n in zip(paragraphs, counts):
        if n < size:
            out.append(np.unique(shingle_hashes(words_, size)))
        else:
            out.append(_distinct(every[at:at + n - size + 1]))
        at += n
    return out


def run_sets(hashed: np.ndarray, edges: list[tuple[int, int]], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of stretches (first, end) of one list of words, from the hashes of its words."""
    every = run_hashes(hashed, size)
    return [_distinct(every[lo:hi - size + 1] if hi - lo >= size else run_hashes(hashed[lo:hi], size)) for lo, hi in edges]


def _distinct(values: np.ndarray) -> np.ndarray:
    own = values.copy()
    own.sort()
    keep = np.empty(len(own), bool)
    keep[:1] = True
    np.not_equal(own[1:], own[:-1], out=keep[1:])
    return own[keep]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
