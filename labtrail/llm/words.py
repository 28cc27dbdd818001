"""Words of a block of texts as numpy arrays, and hashes of them.

A word is a maximal run of bytes other than space and 0x09-0x0D. Hashes are functions of the bytes alone,
so every task of a cluster gives a word the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Texts are handled in blocks of about so many bytes, to bound a task's memory; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(sizes: list[int], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


class Words:
    """``buf``: the joined bytes; ``start``/``end``: byte range of each word; ``first``: index of each text's first word, then the count."""

    def __init__(self, texts: list[bytes]):
        joined = b" ".join([b"", *texts, b"", b" " * 8])
        self.joined = joined
        self.buf = np.frombuffer(joined, np.uint8)
        blank = BLANK[self.buf]
        self.start = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        self.end = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        at = np.cumsum([1, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.start, at).astype(np.int64)

    def hashes(self, seed: int) -> np.ndarray:
        """A 64-bit name of each word, eight bytes at a time."""
        lanes = np.ndarray((len(self.buf) - 7,), "<u8", self.joined, strides=(1,))
        size = self.end - self.start
        h = mix(size.astype(np.uint64) + np.uint64(seed))
        live, at, left = np.arange(len(size)), self.start, size
        while len(live):
            h[live] = mix(h[live] ^ (lanes[at] & _KEEP[np.minimum(left, 8)])) + np.uint64(0x9E3779B97F4A7C15)
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
        return h


BASE = 0xD6E8FEB86659FD93 & ~7 | 3
_INVERSE = pow(BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, _INVERSE)):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


class Spans:
    """Fingerprints of any range of a sequence of 64-bit names in constant time."""

    def __init__(self, names: np.ndarray):
        up, self.down = powers(len(names) + 1)
        self.total = np.zeros(len(names) + 1, np.uint64)
        np.cumsum(names * up[:-1], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64))


#: Primes of XXH64, fixed values.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def xxh64(joined: bytes, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of many byte ranges at once; ``joined`` goes on for at least 8 bytes after the last."""
    eight = np.ndarray((len(joined) - 7,), "<u8", joined, strides=(1,))
    four = np.ndarray((len(joined) - 3,), "<u4", joined, strides=(1,))
    one = np.frombuffer(joined, np.uint8)
    s, size = np.uint64(seed), (end - start).astype(np.uint64)
    with np.errstate(over="ignore"):
        h, at = np.full(len(start), s + _P5), start.copy()
        wide = np.flatnonzero(size >= 32)
        lanes = [np.full(len(wide), x) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
        live = np.arange(len(wide))
        while len(live):
            for k, lane in enumerate(lanes):
                lane[live] = _turn(lane[live] + eight[at[wide[live]] + 8 * k] * _P2, 31) * _P1
            at[wide[live]] += 32
            live = live[at[wide[live]] + 32 <= end[wide[live]]]
        if len(wide):
            h[wide] = _turn(lanes[0], 1) + _turn(lanes[1], 7) + _turn(lanes[2], 12) + _turn(lanes[3], 18)
            for lane in lanes:
                h[wide] = (h[wide] ^ _turn(lane * _P2, 31) * _P1) * _P1 + _P4
        h += size
        live = np.flatnonzero(at + 8 <= end)
        while len(live):
            h[live] = _turn(h[live] ^ _turn(eight[at[live]] * _P2, 31) * _P1, 27) * _P1 + _P4
            at[live] += 8
            live = live[at[live] + 8 <= end[live]]
        live = np.flatnonzero(at + 4 <= end)
        h[live] = _turn(h[live] ^ four[at[live]].astype(np.uint64) * _P1, 23) * _P2 + _P3
        at[live] += 4
        live = np.flatnonzero(at < end)
        while len(live):
            h[live] = _turn(h[live] ^ one[at[live]].astype(np.uint64) * _P5, 11) * _P1
            at[live] += 1
            live = live[at[live] < end[live]]
        h = (h ^ h >> np.uint64(33)) * _P2
        h = (h ^ h >> np.uint64(29)) * _P3
        return h ^ h >> np.uint64(32)
