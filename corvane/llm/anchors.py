"""Content-defined anchors: what two equal windows of two texts have in common.

A text is a row of units (bytes or words), each a 64-bit hash. Of all k-grams in a window, the one
of the smallest hash is the window's anchor; equal windows have equal anchors at equal places.
Consecutive windows mostly share their anchor, so a text has few runs of windows with one anchor
each. Two equal windows anywhere in the corpus lie in runs of equal anchors: comparing runs that
share an anchor finds every repetition, exactly.

Ranges are hashed by sums of unit hashes times powers of an odd number, modulo 2^64.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from corvane.llm.common import splitmix

_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
#: Units taken at once; longer texts go in overlapping pieces.
CHUNK = 1 << 20
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, for at least n places."""
    have = max(_POWERS, default=0)
    if have < n:
        _POWERS.clear()
        have = max(n, 1 << 16)
        one = np.ones(1, np.uint64)
        _POWERS[have] = tuple(np.concatenate([one, np.cumprod(np.full(have, p, np.uint64))]) for p in (_P, _P_INVERSE))
    return _POWERS[have]


class Ranges:
    """Hashes of any range of units in constant time."""

    def __init__(self, units: np.ndarray):
        up, self.down = _powers(len(units))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(units * up[: len(units)])])

    def hash(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[begin]) * self.down[begin]


@dataclass
class Runs:
    """Runs of windows with one anchor: first and last window start, the anchor's hash and place."""

    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    place: np.ndarray  # of the anchor, in the text


def runs(units: np.ndarray, sizes: np.ndarray, window: int, k: int, seed: int) -> Runs:
    """Runs of the texts that ``units`` holds one after another; ``sizes`` has each text's units."""
    ends = np.cumsum(sizes)
    parts = []
    lo = 0
    while lo < len(sizes):
        base = int(ends[lo] - sizes[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
        if sizes[lo:hi].max() >= window:
            if hi == lo + 1 and sizes[lo] > CHUNK:
                for at in range(0, int(sizes[lo]) - window + 1, CHUNK - window + 1):
                    piece = units[base + at : min(base + at + CHUNK, int(ends[lo]))]
                    found = _runs(piece, np.array([len(piece)]), window, k, seed)
                    parts.append((found[0] + lo, found[1] + at, found[2] + at, found[3], found[4] + at))
            else:
                found = _runs(units[base : int(ends[hi - 1])], sizes[lo:hi], window, k, seed)
                parts.append((found[0] + lo, *found[1:]))
        lo = hi
    if not parts:
        e = np.empty(0, np.int64)
        return Runs(e, e, e, e.view(np.uint64), e)
    return Runs(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _runs(units: np.ndarray, sizes: np.ndarray, window: int, k: int, seed: int) -> tuple[np.ndarray, ...]:
    n = len(units)
    if n < window:
        e = np.empty(0, np.int64)
        return e, e, e, e.view(np.uint64), e
    ranges = Ranges(units)
    at = np.arange(n - k + 1)
    gram = splitmix((ranges.sums[k:] - ranges.sums[: n - k + 1]) * ranges.down[: n - k + 1] + np.uint64(seed))
    bits = np.uint64(max(n, CHUNK).bit_length())  # the same for all texts, or equal windows could rank grams differently
    low = (gram >> bits << bits) | at.astype(np.uint64)  # the place breaks ties: leftmost first
    span, have = window - k + 1, 1  # k-grams in a window
    while 2 * have <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < span:
        low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
    place = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)  # of each window start's anchor
    doc = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
    if not len(starts):
        e = np.empty(0, np.int64)
        return e, e, e, e.view(np.uint64), e
    place = place[starts]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[starts[1:]] != doc[starts[:-1]])]))
    first, last = starts[new], starts[np.append(new[1:], len(starts)) - 1]
    place = place[new]
    own = doc[first]
    begin = (np.cumsum(sizes) - sizes)[own]
    return own, first - begin, last - begin, splitmix(gram[place] ^ np.uint64(0x5DEECE66D)), place - begin


def bytes_units(data: bytes | np.ndarray) -> np.ndarray:
    """A unit per byte."""
    a = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
    return _BYTES[a]


_BYTES = splitmix(np.arange(256, dtype=np.uint64) + np.uint64(0xB10C))


def word_units(words: list[bytes]) -> np.ndarray:
    """A unit per word."""
    joined = np.frombuffer(b"".join(words), np.uint8)
    n = np.fromiter(map(len, words), np.int64, len(words))
    return splitmix(Ranges(_BYTES[joined]).hash(np.cumsum(n) - n, np.cumsum(n)) + n.astype(np.uint64)) if len(words) else np.empty(0, np.uint64)
