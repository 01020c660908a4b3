"""Vectorised word hashing on the UTF-8 buffers of Arrow string columns.

A word is a run of bytes outside 0x20 and 0x09-0x0D, with A-Z lower-cased.  Its identity is a
64-bit polynomial hash, mixed with the length.
"""

from __future__ import annotations

import numpy as np

from framelens.llm.common import ranges

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_PIECE = 1 << 19
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0..n of the base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) <= n:
        inverse = np.uint64(pow(_BASE, -1, 1 << 64))
        made = []
        for x in (np.uint64(_BASE), inverse):
            steps = np.full(n + 2, x, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _powers[:] = made
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _cuts(data: np.ndarray, at: np.ndarray, space: np.ndarray) -> list[int]:
    """Piece limits within data[at[0]:at[-1]], none of them inside a word."""
    end, cuts = int(at[-1]), [int(at[0])]
    while end - cuts[-1] > _PIECE:
        x = cuts[-1] + _PIECE
        doc = int(at[np.searchsorted(at, x)])
        while x < doc:
            step = space[data[x : min(x + 65536, doc)]]
            if step.any():
                x += int(step.argmax())
                break
            x = min(x + 65536, doc)
        if x >= end:
            break
        cuts.append(x)
    return [*cuts, end]


def tokenize(data: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word, and the first word of each document (one more at the end)."""
    hashes, starts, ends = [], [], []
    cuts = _cuts(data, at, space)
    for a, b in zip(cuts, cuts[1:]):
        if a == b:
            continue
        x = LOWER[data[a:b]]
        n, word = b - a, ~space[x]
        opens = np.zeros(n + 1, bool)
        inner = at[(at >= a) & (at <= b)] - a
        opens[inner] = True
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1] | opens[1:n]
        last[:-1] &= ~word[1:] | opens[1:n]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        h = (total[e] - total[s]) * down[s]
        hashes.append(mix(h + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        starts.append(s + a)
        ends.append(e + a)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    s = join(starts, np.int64)
    return join(hashes, np.uint64), s, join(ends, np.int64), np.searchsorted(s, at)


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's k-word shingles, and each document's first shingle.

    A document of fewer words has one shingle, its whole sequence; one of no words has none.
    """
    n = np.diff(first)
    m = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    at = np.concatenate([[0], np.cumsum(m)])
    out = np.zeros(int(at[-1]), np.uint64)
    step = np.uint64(0xC2B2AE3D27D4EB4F)
    if len(words) >= k:
        rolled = np.zeros(len(words) - k + 1, np.uint64)
        for j in range(k):
            rolled = (rolled + words[j : len(words) - k + 1 + j]) * step
        full = n >= k
        out[ranges(at[:-1][full], m[full])] = mix(rolled[ranges(first[:-1][full], m[full])])
    for d in np.flatnonzero((n > 0) & (n < k)):
        h = np.uint64(0)
        for w in words[first[d] : first[d + 1]]:
            h = np.uint64((int(h) + int(w)) * int(step) & 0xFFFFFFFFFFFFFFFF)
        out[at[d]] = mix(np.array([h], np.uint64) ^ np.uint64(n[d]))[0]
    return out, at
