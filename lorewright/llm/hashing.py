"""Hashes of the words of a text, many at a time, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_U = np.uint64
_RNG = np.random.default_rng(20240607)
#: A random number for each byte, and an odd base with its inverse modulo 2**64.
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers = {BASE: np.ones(1, np.uint64), INVERSE: np.ones(1, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers[base]
    while len(have) < n:
        step = _U(pow(base, len(have), 2**64))
        have = np.concatenate([have, have * step])
    _powers[base] = have if len(have) <= 1 << 22 else have[: 1 << 22].copy()
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def word_spans(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words among bytes."""
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~SPACE[b]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def prefix(b: np.ndarray) -> np.ndarray:
    """Running sums from which a rolling hash of any range of bytes follows; one longer than b.

    The rolling hash is linear in the bytes: it proposes places that may be alike and never decides that they are.
    """
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(BYTE[b] * powers(BASE, len(b)), out=out[1:])
    return out


_KEY = [_U(int(x)) for x in _RNG.integers(1, 2**63, 3, dtype=np.uint64)]
_LOW = np.array([0] + [2 ** (8 * k) - 1 for k in range(1, 9)], np.uint64)
#: Ranges of more bytes are hashed one by one.
LONG = 256


def span_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each range, eight at a time, mixed after each eight so that no sum can cancel."""
    size = ends - starts
    h = mix(size.astype(np.uint64) ^ _KEY[0])
    padded = np.zeros(len(b) + 8, np.uint8)
    padded[: len(b)] = b
    eight = np.ndarray((len(b) + 1,), "<u8", padded, strides=(1,))
    live, at = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(live):
        left = size[live] - at
        part = eight[starts[live] + at] & _LOW[np.minimum(left, 8)]
        h[live] = mix((h[live] ^ mix(part + _KEY[1])) + _KEY[2])
        live, at = live[left > 8], at + 8
    for k in np.flatnonzero(size > LONG):
        h[k] = xxhash.xxh3_64_intdigest(b[starts[k] : ends[k]].tobytes(), seed=77)
    return h


def word_hashes(b: np.ndarray) -> np.ndarray:
    return span_hashes(b, *word_spans(b))


_K = [_U(int(x) | 1) for x in _RNG.integers(1, 2**63, 8, dtype=np.uint64)]


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """The sorted set of hashed runs of `width` words; fewer words are one run; none: empty."""
    n = len(words)
    if n == 0:
        return words
    size = min(n, width)
    s = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        s = s + words[k : n - size + 1 + k] * _K[k]
    return np.unique(mix(s))
