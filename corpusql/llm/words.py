"""Vectorised hashing of words and word shingles in numpy.

A word's hash depends on its bytes alone, so every executor and every batch gives the same one. Texts
are hashed in segments of about SEGMENT bytes cut at word ends; memory doesn't grow with a text."""

from __future__ import annotations

import numpy as np

SEGMENT = 1 << 20
_LOWER = {c: c + 32 for c in range(65, 91)}
_SPACE = {c: 32 for c in range(9, 14)}
#: Lower-cases A-Z and turns each of \x09-\x0D into a space; words are what stands between spaces.
BY_SPACE = bytes((_LOWER | _SPACE).get(c, c) for c in range(256))
#: Lower-cases A-Z and turns all of ASCII but letters and digits into spaces.
BY_LETTER = bytes(_LOWER.get(c, c if chr(c).isalnum() or c > 127 else 32) for c in range(256))

_rng = np.random.default_rng(20_240_601)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[32] = 0
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, 2 * SEGMENT)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _segment(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    b = np.frombuffer(blob, np.uint8)
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = b != 32
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * up[: len(b)], out=total[1:])
    return starts, mix((total[ends] - total[starts]) * down[starts])


def _words(texts: list[str | None], table: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Hashes and first bytes of all words of all texts, the first byte of each text and the end, the texts joined by line feeds."""
    blobs = [(t or "").encode("utf-8", "replace") for t in texts]
    at = np.zeros(len(blobs) + 1, np.int64)
    at[1:] = np.cumsum([len(x) + 1 for x in blobs])
    raw = b"\n".join(blobs)
    whole = raw.translate(table)
    starts, hashes, lo = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while lo < len(whole):
        hi = whole.find(b" ", lo + SEGMENT)
        hi = len(whole) if hi < 0 else hi
        s, h = _segment(whole[lo:hi])
        starts.append(s + lo)
        hashes.append(h)
        lo = hi
    return np.concatenate(hashes), np.concatenate(starts), at, raw


def word_hashes(texts: list[str | None], table: bytes = BY_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of all texts, offsets): text i has hashes[offsets[i]:offsets[i + 1]]."""
    hashes, starts, at, _ = _words(texts, table)
    return hashes, np.searchsorted(starts, at)


def line_hashes(texts: list[str | None], table: bytes = BY_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Those of word_hashes, then the first word of each line that has one (and the end), and the text each such line is of."""
    hashes, starts, at, raw = _words(texts, table)
    breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
    line = np.searchsorted(breaks, starts)
    first = np.flatnonzero(np.diff(line, prepend=-1))
    offsets = np.searchsorted(starts, at)
    return hashes, offsets, np.append(first, len(hashes)), np.searchsorted(offsets, first, "right") - 1


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of every n consecutive words, in order."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += words[k : len(words) - n + 1 + k]
    return mix(out)


def shingles(words: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets): the sorted distinct hashes of n-word shingles of each unit words[at[i]:at[i + 1]].

    Of a unit of fewer words the whole sequence is one, of none there are none."""
    size = np.diff(at)
    full = np.flatnonzero(size >= n)
    count = size[full] - n + 1
    unit = np.repeat(full, count)
    place = np.arange(len(unit)) - np.repeat(np.cumsum(count) - count, count) + at[unit]
    values, units = [grams(words, n)[place] if len(unit) else np.zeros(0, np.uint64)], [unit]
    for k in range(1, n):
        short = np.flatnonzero(size == k)
        if len(short):
            out = np.zeros(len(short), np.uint64)
            for i in range(k):
                out *= np.uint64(0xD6E8FEB86659FD93)
                out += words[at[short] + i]
            values.append(mix(out) ^ np.uint64(k))
            units.append(short)
    v, u = np.concatenate(values), np.concatenate(units)
    order = np.argsort(v)
    order = order[np.argsort(u[order].astype(np.uint16 if len(size) <= 65_536 else np.int64), kind="stable")]
    v, u = v[order], u[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (u[1:] != u[:-1])
    return v[keep], np.concatenate([[0], np.cumsum(np.bincount(u[keep], minlength=len(size)))]).astype(np.int64)


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    values, at = shingles(*word_hashes(texts), n)
    return [values[at[i] : at[i + 1]] for i in range(len(texts))]


def sequence_hashes(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A signed 64-bit hash of each sequence values[at[i]:at[i + 1]]: equal sequences have the same, empty ones 0."""
    size = np.diff(at)
    full = size > 0
    out = np.zeros(len(size), np.int64)
    if full.any():
        odd = (2 * (np.arange(len(values)) - np.repeat(at[:-1], size)) + 1).astype(np.uint64)
        total = np.add.reduceat(mix(values + odd) * odd, at[:-1][full])
        out[full] = mix(total + size[full].astype(np.uint64)).view(np.int64)
    return out


def slices(words: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of words[first[i]:end[i]] for each i; the same words have the same wherever they stand."""
    up, down = _power(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words) * up[: len(words)], out=total[1:])
    return mix((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64))


def parts(values: np.ndarray, at: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values and offsets of some units (their numbers, ascending)."""
    size = at[some + 1] - at[some]
    ends = np.cumsum(size)
    return values[np.arange(int(size.sum())) + np.repeat(at[some] - (ends - size), size)], np.concatenate([[0], ends]).astype(np.int64)


class MinHash:
    """Minima of ``total`` permutations, x -> a x + c over 32-bit hashes, and keys of bands of the first of them."""

    def __init__(self, bands: int, rows: int, seed: int = 7, total: int = 0):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, total = bands, rows, total or bands * rows
        self.a = rng.integers(0, 2**31, total, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.c = rng.integers(0, 2**32, total, dtype=np.uint32)

    def minima(self, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A row for each set values[at[i]:at[i + 1]]; none may be empty. Sets go through in groups that fit a core's cache."""
        n = len(at) - 1
        out = np.empty((n, len(self.a)), np.uint32)
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + 32_768, "right")) - 1)
            x = (values[at[lo] : at[hi]] >> np.uint64(32)).astype(np.uint32)
            starts = at[lo:hi] - at[lo]
            t = np.empty_like(x)
            for k in range(len(self.a)):
                np.multiply(x, self.a[k], out=t)
                np.add(t, self.c[k], out=t)
                out[lo:hi, k] = np.minimum.reduceat(t, starts)
            lo = hi
        return out

    def keys(self, minima: np.ndarray) -> np.ndarray:
        """The band keys, signed 64-bit: a row for each set, a column for each band."""
        m = minima[:, : self.bands * self.rows].reshape(len(minima), self.bands, self.rows).astype(np.uint64)
        key = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64), m.shape[:2]).copy()
        for r in range(self.rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + m[:, :, r])
        return key.view(np.int64)


def pack_low_bits(minima: np.ndarray, bits: int = 4) -> np.ndarray:
    """The low ``bits`` bits of each minimum, packed into signed 64-bit words: a row for each set."""
    per = 64 // bits
    low = (minima & np.uint32((1 << bits) - 1)).astype(np.uint64).reshape(len(minima), minima.shape[1] // per, per)
    shift = (np.arange(per, dtype=np.uint64) * np.uint64(bits))[None, None, :]
    return np.bitwise_or.reduce(low << shift, axis=2).view(np.int64)
