"""Hashes of words and byte strings of many texts at once, from prefix polynomials modulo 2**64.

With A(i) = sum over j < i of (byte j + 1) * B**j, the hash of bytes i..k is (A(k) - A(i)) * B**-i, which
depends on the bytes alone. B is odd, hence has an inverse. Results go through a finaliser that mixes the bits.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASE = 0x9E3779B97F4A7C15
SEED = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(1)
def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        powers = np.full(n, base, np.uint64)
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i for i < n at least."""
    return _tables(1 << max(21, (n - 1).bit_length()))


def prefixes(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def region_prefixes(data: np.ndarray, offsets: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """As ``prefixes``, but powers count from the start of each region data[offsets[i] : offsets[i + 1]]."""
    out = np.zeros(len(data) + 1, np.uint64)
    longest = int(np.diff(offsets).max(initial=1))
    for a in range(0, len(data), step):
        at = np.arange(a, min(a + step, len(data)))
        at -= offsets[np.searchsorted(offsets, at, side="right") - 1]
        out[a + 1 : a + 1 + len(at)] = (data[a : a + step].astype(np.uint64) + np.uint64(1)) * powers(longest + 1)[0][at]
    return np.cumsum(out, out=out)


def finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * SEED
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def spans(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of bytes start..end, also told apart by their length."""
    inverse = powers(len(prefix))[1]
    return finish((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64) * SEED)


def runs(kind: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of equal non-zero ``kind``; runs also end at ``breaks``."""
    edge = np.empty(len(kind) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[breaks] = True
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    real = kind[start] != 0
    return start[real], end[real]


def words(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and the first word of each text (and the end).

    ``classes`` gives each byte's kind; 0 parts words, and so does a change of kind.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    start, end = runs(classes[data], offsets)
    return spans(prefixes(data), start, end), np.searchsorted(start, offsets)


def combine(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive values, for each place where n are left."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        out = out * np.uint64(BASE) + hashes[k : k + len(out)]
    return finish(out)


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def space_classes() -> np.ndarray:
    """1 for bytes of words, 0 for the six white-space bytes."""
    table = np.ones(256, np.uint8)
    table[[*range(9, 14), 32]] = 0
    return table
