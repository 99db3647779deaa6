"""Words and shingles of many texts at once, as 64-bit hashes in numpy.

The texts of a batch are laid end to end as UTF-8.  A word's hash is a
polynomial over its bytes, taken from running sums, so there is no Python work
for each word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

U64 = np.uint64
#: Odd multiplier of the polynomial and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Texts are worked on in groups of about so many bytes; a longer text is a group of its own.
GROUP_BYTES = 2_000_000

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Separators of the two word rules become a space; A to Z become lower case.
BLANK_SPLIT = bytes(32 if b in b"\t\n\x0b\x0c\r" else LOWER[b] for b in range(256))
ALNUM_SPLIT = bytes(LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown by doubling and kept."""
    have = _powers.get(str(base), np.ones(1, U64))
    while len(have) < n:
        have = np.concatenate([have, have * U64(pow(base, len(have), 1 << 64))])
    if len(have) <= 8 * GROUP_BYTES:  # larger tables, of very long texts, aren't kept
        _powers[str(base)] = have
    return have[:n]


def groups(sizes: Sequence[int], limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def _parts(joined: bytes) -> Iterator[tuple[int, int]]:
    """Ranges of about GROUP_BYTES that begin and end with a blank and share it, so no word is cut."""
    at, last = 0, len(joined) - 1
    while at < last:
        to = joined.find(b" ", min(at + GROUP_BYTES, last))
        yield at, to + 1
        at = to


def word_places(texts: Sequence[bytes], table: bytes) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The translated bytes of all texts, start and end of each word there, its hash, and the first word of each text and the end."""
    joined = b" ".join([b"", *texts, b""]).translate(table)  # a blank before, between and after
    starts, ends, hashes = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, U64)]
    for lo, hi in _parts(joined):
        raw = np.frombuffer(joined, np.uint8, hi - lo, lo)
        inside = raw != 32
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        start, end = edge[0::2], edge[1::2]
        sums = np.empty(len(raw) + 1, U64)
        sums[0] = 0
        np.cumsum(raw.astype(U64) * _power(BASE, len(raw)), out=sums[1:])
        hashes.append(mix((sums[end] - sums[start]) * _power(INVERSE, len(raw))[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93)))
        starts.append(start + lo)
        ends.append(end + lo)
    start, end = np.concatenate(starts), np.concatenate(ends)
    begins = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return joined, start, end, np.concatenate(hashes), np.searchsorted(start, begins)


def word_hashes(texts: Sequence[bytes], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the end): text i has words first[i] to first[i+1]."""
    return word_places(texts, table)[3:]


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; the order of the words counts."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    out = np.full(n, k, U64)
    for j in range(k):
        out = out * U64(BASE) + hashes[j : j + n]
    return mix(out)
