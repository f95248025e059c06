"""Content-defined chunking: where a rolling hash over the bytes says so.

The hash of a position is the sum of a table value for each byte before it, each shifted by its distance, and only its
low bits are tested. So it depends on as many bytes as bits are tested, and a whole buffer's hashes are a few shifted
additions in numpy (windows double each time). Where a chunk has just begun, the window is still short: those few
positions are looked at one by one.

Fixed by the format: the table, the sizes and masks that follow from the average, and that a byte which ends a chunk
belongs to the next one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

DEFAULT_AVERAGE = 1 << 20
_SEED = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def gear_table() -> np.ndarray:
    """256 values of the public splitmix64 sequence from a fixed seed."""
    with np.errstate(over="ignore"):
        z = np.uint64(_SEED) + np.arange(1, 257, dtype=np.uint64) * np.uint64(_SEED)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


@dataclass(frozen=True)
class Sizes:
    """Least, normal and largest size of a chunk, and how many low bits are tested before and after the normal size."""

    least: int
    normal: int
    most: int
    strict_bits: int
    loose_bits: int

    @classmethod
    def of(cls, average: int = 0) -> Sizes:
        average = average if average > 0 else DEFAULT_AVERAGE
        bits = max(2, average.bit_length() - 1)
        return cls(max(1, average // 4), average, 4 * average, bits + 1, bits - 1)


#: Positions that are hashed at a time, so that the running sums stay in the processor's cache.
_BLOCK = 1 << 16


def candidates(data: np.ndarray, size: Sizes) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the strict, and where the loose, test holds over a full window; both in rising order."""
    kind = np.uint32 if size.strict_bits <= 32 else np.uint64
    table = gear_table().astype(kind)
    strict, loose = kind((1 << size.strict_bits) - 1), kind((1 << size.loose_bits) - 1)
    width = 1
    while width < size.strict_bits:
        width *= 2  # bytes further back than the tested bits are shifted out of them
    hits, strict_hits = [], []
    for low in range(0, len(data), _BLOCK):
        begin = max(0, low - width)
        h = table[data[begin : low + _BLOCK]]
        reach = 1
        while reach < width and reach < len(h):
            h[reach:] += h[:-reach] << kind(reach)
            reach *= 2
        h = h[low - begin :]
        at = np.flatnonzero((h & loose) == 0)
        hits.append(at + low)
        strict_hits.append(at[(h[at] & strict) == 0] + low)
    none = np.empty(0, np.int64)
    return np.concatenate([none, *strict_hits]), np.concatenate([none, *hits])


def cuts(data: np.ndarray, average: int = 0, final: bool = True) -> list[int]:
    """Ends of the chunks of a buffer. Without ``final``, only those that bytes to come can't change."""
    size = Sizes.of(average)
    n, start, ends = len(data), 0, []
    if n > size.least:
        at_strict, at_loose = candidates(data, size)
        strict, loose = (1 << size.strict_bits) - 1, (1 << size.loose_bits) - 1
        table = gear_table()
    while start < n:
        left = n - start
        if not final and left < size.most:
            break
        if left <= size.least:
            ends.append(n)
            break
        stop = start + min(left, size.most)
        normal = start + min(size.normal, left)
        first = start + size.least
        full = min(first + size.strict_bits - 1, stop)  # from here on the window is full
        end, short = 0, 0
        for i in range(first, full):
            short = ((short << 1) + int(table[data[i]])) & 0xFFFFFFFFFFFFFFFF
            if not short & (strict if i < normal else loose):
                end = i
                break
        if not end and full < normal:
            i = int(np.searchsorted(at_strict, full))
            if i < len(at_strict) and at_strict[i] < normal:
                end = int(at_strict[i])
        if not end:
            i = int(np.searchsorted(at_loose, max(full, normal)))
            if i < len(at_loose) and at_loose[i] < stop:
                end = int(at_loose[i])
        start = end or stop
        ends.append(start)
    return ends


def split(pieces: Iterator[bytes], average: int = 0, buffer: int = 0) -> Iterator[bytes]:
    """Chunks of a stream of bytes; memory is one buffer, at least twice the largest chunk, however long the stream."""
    size = Sizes.of(average)
    want = max(buffer, 2 * size.most, 1 << 22)
    held = bytearray()
    for piece in pieces:
        held += piece
        if len(held) >= want:
            done = 0
            for end in cuts(np.frombuffer(bytes(held), np.uint8), average, final=False):
                yield bytes(held[done:end])
                done = end
            del held[:done]
    done = 0
    for end in cuts(np.frombuffer(bytes(held), np.uint8), average):
        yield bytes(held[done:end])
        done = end


def split_bytes(data: bytes, average: int = 0) -> list[bytes]:
    done, out = 0, []
    for end in cuts(np.frombuffer(data, np.uint8), average):
        out.append(data[done:end])
        done = end
    return out
