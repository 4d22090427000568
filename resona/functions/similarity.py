"""Sequence similarity of two texts: the matched share of both, as used for near duplicates."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocab

_SHORT = 200


def needed_matches(total: int, ratio: float = vocab.NEAR_DUP_RATIO) -> int:
    """The least number of matched characters whose ratio 2*m/total reaches the limit."""
    m = int(ratio * total / 2)
    while m > 0 and 2.0 * (m - 1) / total >= ratio:
        m -= 1
    while 2.0 * m / total < ratio:
        m += 1
    return m


@lru_cache(maxsize=256)
def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


@lru_cache(maxsize=2048)
def _counts(text: str) -> Counter:
    return Counter(text)


def may_share(a: str, b: str, need: int) -> bool:
    """Whether the longest common subsequence has `need` characters; no matching can match more.

    Bit-parallel over a, one step per character of b; stops once the rest of b is too short.
    """
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for done, ch in enumerate(b, 1):
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
        if done % 64 == 0 and len(a) - v.bit_count() + len(b) - done < need:
            return False
    return len(a) - v.bit_count() >= need


def _longest_block(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Longest common block, the earliest in a and then in b, from one row of run lengths at a time."""
    best, end_a, end_b = 0, 0, 0
    runs = np.zeros(len(b) + 1, dtype=np.int32)
    for i, ch in enumerate(a):
        runs[1:] = np.where(b == ch, runs[:-1] + 1, 0)
        top = int(runs.max())
        if top > best:
            best, end_a, end_b = top, i + 1, int(runs.argmax())
    return end_a - best, end_b - best, best


#: Base of the hashes of stretches of text, and the characters of a part from which on its longest block is searched by them.
_BASE, _LARGE = 0x9E3779B97F4A7C15, 256


@lru_cache(maxsize=256)
def _prefixes(text: str) -> np.ndarray:
    """Hashes of all beginnings of a text, times the base once a character, so that one subtraction gives that of any stretch."""
    out = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((_codes(text).astype(np.uint64) + np.uint64(1)) * _powers(len(text))[::-1], out=out[1:])
    return out


def _powers(n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), by wrapping products."""
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _stretches(text: str, lo: int, hi: int, n: int) -> np.ndarray:
    """Hashes of the stretches of n characters that start at lo to hi - n, equal for equal stretches of any texts."""
    sums = _prefixes(text)
    # A stretch at i carries the powers len - i - n to len - i - 1; it is raised to those of a stretch at the start of the longest text.
    return (sums[lo + n:hi + 1] - sums[lo:hi + 1 - n]) * _powers(hi + 1 - n)[lo:]


def _longest_by_hash(a: str, b: str, part: tuple[int, int, int, int]) -> tuple[int, int, int] | None:
    """_longest_block of a part (first, end, first, end) of two texts, by bisection over its size; None if hashes misled it."""
    a0, a1, b0, b1 = part
    # Texts of unlike lengths carry unlike powers.
    lift = _powers(abs(len(a) - len(b)) + 1)[-1]
    lift_a, lift_b = (np.uint64(1), lift) if len(a) > len(b) else (lift, np.uint64(1))
    low, high = 0, min(a1 - a0, b1 - b0)

    def common(n: int) -> np.ndarray:
        return np.isin(_stretches(a, a0, a1, n) * lift_a, _stretches(b, b0, b1, n) * lift_b)

    while low < high:
        n = min((low + high + 1) // 2, max(16, 2 * low))
        if common(n).any():
            low = n
        else:
            high = n - 1
    if not low:
        return 0, 0, 0
    i = int(common(low).argmax())
    j = int((_stretches(b, b0, b1, low) * lift_b == (_stretches(a, a0, a1, low) * lift_a)[i]).argmax())
    return (i, j, low) if a[a0 + i:a0 + i + low] == b[b0 + j:b0 + j + low] else None


def reaches(later: str, head: str, ratio: float = vocab.NEAR_DUP_RATIO) -> bool:
    """Whether the matching-block ratio of (later, head) is at least `ratio`; not symmetric."""
    need = needed_matches(len(later) + len(head), ratio)
    if later == head:
        return True
    if min(len(later), len(head)) < need or (_counts(later) & _counts(head)).total() < need:
        return False
    if not may_share(later, head, need):
        return False
    if max(len(later), len(head)) <= _SHORT:
        return SequenceMatcher(None, later, head, autojunk=False).ratio() >= ratio
    a, b = _codes(later), _codes(head)
    matched, open_parts, rest = 0, [(0, len(a), 0, len(b))], min(len(a), len(b))
    while open_parts and matched + rest >= need:
        part = a0, a1, b0, b1 = open_parts.pop(max(range(len(open_parts)), key=lambda k: open_parts[k][1] - open_parts[k][0]))
        rest -= min(a1 - a0, b1 - b0)
        found = _longest_by_hash(later, head, part) if min(a1 - a0, b1 - b0) >= _LARGE else None
        i, j, n = found or _longest_block(a[a0:a1], b[b0:b1])
        if n == 0:
            continue
        matched += n
        if matched >= need:
            return True
        for p in ((a0, a0 + i, b0, b0 + j), (a0 + i + n, a1, b0 + j + n, b1)):
            if p[0] < p[1] and p[2] < p[3]:
                open_parts.append(p)
                rest += min(p[1] - p[0], p[3] - p[2])
    return False


def _near(later: pd.Series, head: pd.Series) -> pd.Series:
    return pd.Series([reaches(a, b) for a, b in zip(later, head)], dtype="bool")


def is_near(later: str, head: str) -> Column:
    """The check of candidate pairs, in Arrow batches."""
    return F.pandas_udf(_near, T.BooleanType())(later, head)
