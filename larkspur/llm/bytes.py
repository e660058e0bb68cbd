"""Vectorised hashing of UTF-8 text: word boundaries, polynomial hashes of byte ranges, shingles."""

from __future__ import annotations

import hashlib

import numpy as np

#: Words of more bytes are hashed by BLAKE2: sums of powers modulo 2 ** 64 tell short ranges apart, but not long made-up ones.
LONG_WORD = 256
#: Odd, so that its powers can be inverted modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_INVERSE = pow(BASE, -1, 1 << 64)

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grown(a: np.ndarray, base: int, n: int) -> np.ndarray:
    """Powers of base up to n, by doubling."""
    while len(a) < n:
        a = np.concatenate([a, a * np.uint64(pow(base, len(a), 1 << 64))])
    return a


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        _powers = _grown(_powers, BASE, n)
        _inverses = _grown(_inverses, _INVERSE, n)
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A-Z to a-z; other bytes stay.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not ASCII white space."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_WHITE[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; equal ranges have equal hashes wherever they stand."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def combine(hashes: list[np.ndarray]) -> np.ndarray:
    """One hash of several in order."""
    out = np.zeros(len(hashes[0]), np.uint64)
    for h in hashes:
        out = mix(out * np.uint64(0xFF51AFD7ED558CCD) + h)
    return out


def shingles(text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of text in order, A-Z lower-cased, and the bytes in their words.

    With fewer words than size, the whole sequence is one shingle; without words there is none.
    """
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(LOWER), np.uint8)
    starts, ends = words(data)
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = range_hashes(data, starts, ends)
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    k = min(size, n)
    m = n - k + 1
    long = combine([h[i : i + m] for i in range(k)]) if k == size else mix(combine([h[i : i + 1] for i in range(k)]) + np.uint64(k))
    sums = np.concatenate([[0], np.cumsum(ends - starts)])
    return long, sums[k:] - sums[:m]
