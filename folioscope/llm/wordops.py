"""Vectorised tokens: word boundaries, 64-bit word hashes and rolling k-gram hashes in numpy.

A chunk of texts is one byte array with a separator between texts.  Words never cross it, as
the separator is outside every word class used here.  Hashes only pick candidates or stand for a
word in counts; where a result must be exact, the bytes themselves are compared.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C17)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_GRAM = np.uint64(0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(inside) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(inside)] = True
    return table


#: Words between ASCII whitespace; words of ASCII letters, digits and all that is not ASCII.
SPACED = byte_class(b for b in range(256) if not (b == 32 or 9 <= b <= 13))
ALNUM = byte_class(b for b in range(256) if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 20), base, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if len(have) <= 1 << 22:
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@dataclass
class Words:
    """data: lower-cased bytes; starts, ends: of words; doc: the text of each word; first: of each text, its first word (one more entry at the end)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        if not len(self):
            return np.zeros(0, dtype=np.uint64)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[self.data] * powers(_BASE, n), out=sums[1:])
        back = powers(_INVERSE, n)
        h = (sums[self.ends] - sums[self.starts]) * back[self.starts]
        return mix(h + (self.ends - self.starts).astype(np.uint64) * _GRAM)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, start: int, stop: int) -> bytes:
        """Words start to stop-1, lower-cased, joined by one space."""
        raw = self.data
        return b" ".join(raw[s:e].tobytes() for s, e in zip(self.starts[start:stop], self.ends[start:stop], strict=True))


def tokenize(texts: list[bytes], word_bytes: np.ndarray) -> Words:
    data = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(sizes + 1, out=offsets[1:])
    inside = word_bytes[data].view(np.int8)
    edge = np.diff(inside, prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(data, starts, ends, doc, first, offsets)


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Blank-separated words, case kept, of neighbouring texts in one buffer without separators: they end at blanks and at the texts' ends."""
    inside = SPACED[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    heads = offsets[:-1][np.diff(offsets) > 0]
    opens[heads] = inside[heads]
    closes[heads[1:] - 1] = inside[heads[1:] - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    first = np.searchsorted(starts, offsets)
    return Words(data, starts, ends, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first, offsets)


def blank_cut(data: np.ndarray, size: int):
    """A long text in pieces of about ``size`` bytes that end at blanks."""
    at = 0
    while at < len(data):
        stop = at + size
        while stop < len(data) and not len(blank := np.flatnonzero(~SPACED[data[stop : stop + size]])):
            stop += size
        stop = stop + int(blank[0]) if stop < len(data) else len(data)
        yield data[at:stop]
        at = stop


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes from place a are those from place b, eight at a time."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    same, rest, step = np.ones(len(a), dtype=bool), np.flatnonzero(size > 0), 0
    while len(rest):
        left = np.minimum(size[rest] - step, 8)
        differ = ((eight[a[rest] + step] ^ eight[b[rest] + step]) << ((8 - left) * 8).astype(np.uint64)) != 0
        same[rest[differ]] = False
        step += 8
        rest = rest[~differ & (size[rest] > step)]
    return same


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position; shorter than the input by k - 1."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _GRAM
        out += hashes[j : j + n]
    return mix(out)


def window_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours; shorter than the input by w - 1."""
    n = len(values) - w + 1
    if n <= 0:
        return values[:0]
    out = values[:n].copy()
    for j in range(1, w):
        np.minimum(out, values[j : j + n], out=out)
    return out


class HashSet:
    """Membership of many 64-bit values in a fixed set: a bitmap on the low bits, then a sorted search."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(np.asarray(values, dtype=np.uint64))
        bits = max(16, int(np.ceil(np.log2(max(len(self.values), 1) * 16))))
        self.mask = np.uint64((1 << bits) - 1)
        self.maybe = np.zeros(1 << bits, dtype=bool)
        self.maybe[(self.values & self.mask).astype(np.int64)] = True

    def find(self, x: np.ndarray) -> np.ndarray:
        """Positions in x of members."""
        if not len(self.values) or not len(x):
            return np.zeros(0, dtype=np.int64)
        at = np.flatnonzero(self.maybe[(x & self.mask).astype(np.int64)])
        v = x[at]
        spot = np.minimum(np.searchsorted(self.values, v), len(self.values) - 1)
        return at[self.values[spot] == v]
