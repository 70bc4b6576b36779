"""Vectorised words and hashes of many texts at once.

Words are the maximal runs of bytes other than the six ASCII white-space characters. A word's hash is a polynomial over
random values of its bytes, taken modulo 2**64 as a difference of prefix sums, so a block of text costs a few passes of
NumPy whatever the number of its words.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 20
_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = 0x9E3779B97F4A7C15
_R_INVERSE = pow(_R, -1, 2**64)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads values over the whole range, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, r in enumerate((_R, _R_INVERSE)):
            step = np.full(n, r, np.uint64)
            step[0] = 1
            _powers[i] = np.multiply.accumulate(step)
    return _powers


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a buffer of bytes."""
    white = np.ones(len(data) + 2, bool)
    white[1:-1] = _WHITE[data]
    edge = np.flatnonzero(white[1:] != white[:-1])
    return edge[0::2], edge[1::2]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans of a buffer; spans are in order and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        block = data[base : int(ends[j - 1])]
        power, inverse = _power(len(block) + 1)
        prefix = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(_VALUE[block] * power[: len(block)], out=prefix[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((prefix[e] - prefix[s]) * inverse[s])
        i = j
    return out


def words_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts joined by line breaks: the bytes, starts and ends of the words, the text of each, and its hash."""
    data = np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n", np.uint8)
    starts, ends = spans(data)
    sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
    doc = np.searchsorted(np.cumsum(sizes), starts, "right")
    return data, starts, ends, doc, hashes(data, starts, ends)


def windows(ids: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words, and the positions of those that lie within one text."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out = out * np.uint64(_R) + ids[j : m + j]
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return mix(out[at]), at
