"""Hashed word shingles of whole texts, in numpy.

A word is a run of bytes other than space and tab to carriage return, after A-Z became a-z.
Texts stay UTF-8 bytes throughout: no separator occurs inside a character."""

from __future__ import annotations

import numpy as np

WIDTH = 5
_PIECE = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _STEP = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, _PIECE + 2), _powers(_BASE_INV, _PIECE + 2)


def _hashed(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, dtype=np.uint8)
    n = len(b)
    gap = np.ones(n + 2, dtype=bool)
    gap[1:-1] = _SPACE[b]
    starts = np.flatnonzero(gap[:-2] & ~gap[1:-1])
    ends = np.flatnonzero(~gap[1:-1] & gap[2:]) + 1
    up, down = (_UP, _DOWN) if n < len(_UP) else (_powers(_BASE, n + 1), _powers(_BASE_INV, n + 1))
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[b] * up[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, in order; the text is worked through about 1 MiB at a time."""
    text = text.translate(_LOWER)
    if len(text) <= _PIECE:
        return _hashed(text)
    parts, at = [], 0
    while at < len(text):
        end = min(at + _PIECE, len(text))
        if end < len(text):
            cut = max(text.rfind(c, at, end) for c in b" \t\n\v\f\r")
            while cut < at and end < len(text):  # one word longer than a piece
                end = min(end + _PIECE, len(text))
                cut = max(text.rfind(c, at, end) for c in b" \t\n\v\f\r")
            end = cut + 1 if cut >= at else end
        parts.append(_hashed(text[at:end]))
        at = end
    return np.concatenate(parts)


def shingle_set(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words; of all words, where there are fewer."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    w = word_hashes(text)
    n = len(w)
    if not n:
        return w
    k = min(width, n)
    h = np.full(n - k + 1, k, dtype=np.uint64)
    for j in range(k):
        h = h * _STEP + w[j : n - k + 1 + j]
    return np.unique(mix(h))
