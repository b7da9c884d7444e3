"""Word shingles of whole texts as 64-bit hashes."""

from __future__ import annotations

import functools

import numpy as np

from helpdeck.llm.common import mix64

_U = np.uint64
_BASE = 0x9E6C63D0876A9A47
#: A-Z as a-z, every other byte as itself; then a fixed random number for each byte.
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)[_LOW]
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse (modulo 2**64)."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        p = np.ones(1, _U)
        while len(p) < n:
            p = np.concatenate((p, p * _U(pow(base, len(p), 1 << 64))))
        out.append(p[:n])
    return out[0], out[1]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (maximal runs without separators, A-Z as a-z) and where each text's begin."""
    if not len(data):
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    inside = ~_BLANK[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    border = offsets[1:-1]
    border = border[(border > 0) & (border < len(data))]  # words do not run over texts
    start[border] = inside[border]
    end[border - 1] = inside[border - 1]
    a, b = np.flatnonzero(start), np.flatnonzero(end) + 1
    up, down = _powers(1 << (len(data) + 1).bit_length())
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * up[:len(data)], out=total[1:])
    h = (total[b] - total[a]) * down[a] + (b - a).astype(_U)
    return mix64(h), np.searchsorted(a, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = 5) -> list[np.ndarray]:
    """Per text its sorted distinct shingles of ``words`` words; with fewer words the whole sequence as one; none without words."""
    h, at = word_hashes(data, offsets)
    n = len(h) - words + 1
    if n > 0:
        s = np.zeros(n, _U)
        for k in range(words):
            s = s * _U(0xC2B2AE3D27D4EB4F) + h[k:k + n]
        s = mix64(s)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(s[a:b - words + 1]))
        elif b > a:
            one = _U(b - a)
            with np.errstate(over="ignore"):
                for w in h[a:b]:
                    one = one * _U(0x9FB21C651E98DF25) + w
            out.append(mix64(np.array([one], _U)))
        else:
            out.append(np.zeros(0, _U))
    return out
