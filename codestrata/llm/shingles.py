"""Word shingle sets as 64-bit hashes, in numpy."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import chain

import numpy as np
import xxhash

#: Words of one shingle, and the similarity in hundredths from which two sets link.
WORDS, LEAST = 5, 75

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingles_of(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of whole texts in order, one text after the other, and where each begins and the last ends.

    A text of fewer words is one shingle, none if it has no word.
    """
    listed = [(text or "").encode("utf-8", "replace").lower().split() for text in texts]
    ends = np.cumsum([0, *map(len, listed)])
    n = np.diff(ends)
    h = mix(np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, chain.from_iterable(listed))), ">u8").astype(np.uint64))
    total = np.full(len(h), WORDS, np.uint64)
    for i in range(WORDS):
        total[: max(len(h) - i, 0)] += h[i:] * _ODD[i]
    keep = np.ones(len(h), bool)
    keep[(ends[1:][n >= WORDS, None] - np.arange(1, WORDS)).ravel()] = False  # these windows reach into the next text
    for d in np.flatnonzero((n > 0) & (n < WORDS)):
        a, k = ends[d], int(n[d])
        total[a] = (h[a : a + k] * _ODD[:k]).sum(dtype=np.uint64) + np.uint64(k)
        keep[a + 1 : a + k] = False
    return mix(total[keep]), np.cumsum([0, *np.where(n < WORDS, n > 0, n - WORDS + 1)])


def sets_of(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and where each begins and the last ends."""
    h, ends = shingles_of(texts)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        h[a:b].sort()
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    first[ends[:-1][np.diff(ends) > 0]] = True
    return h[first], np.concatenate([[0], np.cumsum(first)])[ends]


def signatures(s: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal sets have equal signatures; unequal ones differ but for a chance of 2**-64. No set may be empty."""
    lanes = np.add.reduceat(mix(s ^ np.uint64(0x5851F42D4C957F2D)), ends[:-1]) if len(s) else np.empty(0, np.uint64)
    return mix(lanes + np.diff(ends).astype(np.uint64)).view(np.int64)


def least_common(n: int) -> int:
    """Shared elements that a set of ``n`` needs at least to link with any other."""
    return -(-LEAST * n // 100)


def parity_bits(s: np.ndarray, ends: np.ndarray, longs: int = 8) -> np.ndarray:
    """A row per set, one parity bit per bucket; two sets differ in at least as many elements as their parities differ in bits."""
    n, buckets = len(ends) - 1, 64 * longs
    place = mix(s ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(64 - buckets.bit_length() + 1)
    place = place.astype(np.int64) + np.repeat(np.arange(n) * buckets, np.diff(ends))
    odd = (np.bincount(place, minlength=n * buckets) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(n, longs)


def min_bands(s: np.ndarray, ends: np.ndarray, bands: int) -> np.ndarray:
    """A row of keys per set that two sets share with the square of their similarity, each from two minima under own scramblings.

    No set may be empty.
    """
    scramblings = mix(np.arange(1, 2 * bands + 1, dtype=np.uint64))
    low = np.empty((len(ends) - 1, 2 * bands), np.uint64)
    if len(s):
        for i, scrambling in enumerate(scramblings):
            low[:, i] = np.minimum.reduceat(mix(s ^ scrambling), ends[:-1])
    return mix(low[:, ::2] * _ODD[2] + low[:, 1::2] + np.arange(bands, dtype=np.uint64)).view(np.int64)
