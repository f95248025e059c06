"""SetSketch registers of word-shingle sets, after Ertl (2021), in numpy.

Every shingle is the seed of a Poisson process of points: exponential gaps at rate ``m``, each point dealt to one of
``m`` registers. A register keeps the smallest point it sees, which is exponential with the set's size as its rate, so
equal registers tell overlap; minima of a union are minima of the minima, so sketches merge. The minimum is kept on an
exponentially spaced scale ``floor(1 - log_b(x / a))`` truncated to 16 bits. Points beyond the largest minimum change
nothing, so points are made in rising order and stop there: a text of n shingles needs about ``m ln m`` points and not
``n m``.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

M = 160
BANDS = 32
ROWS = 5
BASE = 1.001
RATE = 20.0
TOP = 65535

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mix(z: np.ndarray) -> np.ndarray:
    """The public splitmix64 finalizer."""
    z = (z ^ (z >> np.uint64(30))) * _MIX1
    z = (z ^ (z >> np.uint64(27))) * _MIX2
    return z ^ (z >> np.uint64(31))


@lru_cache(maxsize=None)
def _odd(count: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, count + 1, dtype=np.uint64) * _GOLD + np.uint64(seed)) | np.uint64(1)


PIECE = 1 << 20
_BREAK = np.zeros(256, bool)
_BREAK[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B]  # A-Z as a-z
_STEP = 0x5851F42D4C957F2D


def _powers(n: int, step: int) -> np.ndarray:
    out = np.full(n, step, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    return _powers(PIECE + 1, _STEP), _powers(PIECE + 1, pow(_STEP, -1, 1 << 64))


def _piece_words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of consecutive texts, and where each word starts. cuts: where texts end.

    A word's hash is a polynomial in its letters, read off one running sum over the whole piece, then mixed.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    power, back = _tables() if n <= PIECE else (_powers(n + 1, _STEP), _powers(n + 1, pow(_STEP, -1, 1 << 64)))
    inside = ~_BREAK[data]
    edge = np.zeros(n + 1, bool)
    edge[0] = edge[n] = True
    edge[cuts] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    after = np.zeros(n + 1, bool)
    after[:n] = inside
    start = np.flatnonzero(after & (~before | edge))
    end = np.flatnonzero(before & (~after | edge))
    with np.errstate(over="ignore"):
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTER[data] * power[:n], out=run[1:])
        return mix((run[end] - run[start]) * back[start]), start


def _words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and text numbers of consecutive texts of any length, in pieces of bounded size cut between words."""
    if len(data) <= PIECE:
        h, at = _piece_words(data, ends)
        return h, np.searchsorted(ends, at, side="right")
    hashes, texts, low = [], [], 0
    while low < len(data):
        high = min(low + PIECE, len(data))
        while high < len(data) and not _BREAK[data[high]]:
            # cut at the last break of the piece; a single word that fills it makes the piece longer
            gap = np.flatnonzero(_BREAK[data[low + 1 : high]])
            if len(gap):
                high = low + 1 + int(gap[-1])
                break
            high = min(high + PIECE, len(data))
        own = ends[(ends > low) & (ends < high)] - low
        h, at = _piece_words(data[low:high], own)
        hashes.append(h)
        texts.append(np.searchsorted(ends, at + low, side="right"))
        low = high
    return np.concatenate(hashes), np.concatenate(texts)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles.

    Words are runs of anything but ASCII white space, with A-Z in lower case. A text with fewer words has its whole
    sequence as its one shingle; null texts and texts without words have none.
    """
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    h, text = _words(data, at[1:] - at[0])
    first = np.searchsorted(text, np.arange(len(texts) + 1))
    out = []
    with np.errstate(over="ignore"):
        c = _odd(k, 1_000_003)
        if len(h) >= k:
            last = len(h) - k + 1
            mixed = h[:last] * c[0]
            for i in range(1, k):
                mixed += h[i : last + i] * c[i]
            mixed = mix(mixed)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            n = b - a
            if n >= k:
                out.append(_distinct(mixed[a : b - k + 1]))
            elif n:
                out.append(mix((h[a:b] * _odd(n, 17 * n)).sum(keepdims=True, dtype=np.uint64) + np.uint64(n)))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sets share, both sorted and distinct."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0


def fingerprint(shingle: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit sums over the set; with its size they name equal sets."""
    with np.errstate(over="ignore"):
        a = shingle.sum(dtype=np.uint64)
        b = mix(shingle ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _points(sets: list[np.ndarray], reach: np.ndarray, m: int) -> np.ndarray:
    size = np.array([len(s) for s in sets])
    state = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets), dtype=np.int64), size)
    at = np.zeros(len(state))
    limit = reach[doc]
    least = np.full(len(sets) * m, np.inf)
    with np.errstate(over="ignore"):
        while len(state):
            state = state + _GOLD
            z = mix(state)
            at = at - np.log(((z >> np.uint64(32)).astype(np.float64) + 0.5) * 2.0**-32) / m
            near = at < limit
            if not near.all():
                state, doc, at, limit, z = state[near], doc[near], at[near], limit[near], z[near]
            reg = ((z & np.uint64(0xFFFFFFFF)) * np.uint64(m)) >> np.uint64(32)
            np.minimum.at(least, doc * m + reg.astype(np.int64), at)
    return least.reshape(len(sets), m)


def sketch(sets: list[np.ndarray], m: int = M) -> np.ndarray:
    """Registers, one row of ``m`` 16-bit values for each non-empty set."""
    if not sets:
        return np.empty((0, m), np.uint16)
    least = np.full((len(sets), m), np.inf)
    todo, spread = np.arange(len(sets)), np.log(m) + 4.0
    while len(todo):
        reach = spread / np.array([len(sets[i]) for i in todo])
        found = _points([sets[i] for i in todo], reach, m)
        done = np.isfinite(found).all(axis=1)
        least[todo[done]] = found[done]
        todo, spread = todo[~done], spread * 1.7
    return np.clip(np.floor(1.0 - np.log(least / RATE) / np.log(BASE)), 0, TOP).astype(np.uint16)


def band_keys(registers: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One signed 64-bit key for each band of register values; the band's number is part of the key."""
    with np.errstate(over="ignore"):
        part = registers[:, : bands * rows].reshape(len(registers), bands, rows).astype(np.uint64) + np.uint64(1)
        return mix((part * _odd(rows, 5)).sum(axis=2, dtype=np.uint64) + _odd(bands, 99)).view(np.int64)


@lru_cache(maxsize=None)
def _grid(steps: int = 201) -> np.ndarray:
    return np.linspace(0.0, 1.0, steps)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1.0) / BASE) / np.log(BASE)


def likely_jaccard(more: np.ndarray, less: np.ndarray, same: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs from the numbers of registers that are larger, smaller and equal.

    The joint estimator of the paper with known set sizes: with u and v the sizes' shares, a register of the first set
    is larger with probability p(u - v J), smaller with p(v - u J), equal otherwise. The maximum is taken over a fixed
    grid up to the largest similarity that the sizes allow.
    """
    u = (n_a / (n_a + n_b))[:, None]
    v = 1.0 - u
    j = _grid()[None, :] * np.minimum(u, v) / np.maximum(u, v)
    up, down = _p(np.maximum(u - v * j, 0.0)), _p(np.maximum(v - u * j, 0.0))
    tiny = 1e-12
    value = more[:, None] * np.log(up + tiny) + less[:, None] * np.log(down + tiny) + same[:, None] * np.log(np.maximum(1.0 - up - down, 0.0) + tiny)
    return j[np.arange(len(j)), value.argmax(axis=1)]
