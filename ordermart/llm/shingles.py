"""Word shingles as 64-bit hashes, and their MinHash signatures."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np

#: An odd number, and its inverse modulo 2^64, for hashes of byte runs.
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 2**64)
#: Letters that are hashed at once.
LONGEST = 2**20
#: Shingles whose hashes under all permutations are held at once.
AT_ONCE = 2048


@cache
def powers(base: int, bits: int) -> np.ndarray:
    """base^i modulo 2^64 for i below 2^bits."""
    if bits == 0:
        return np.ones(1, dtype=np.uint64)
    half = powers(base, bits - 1)
    return np.concatenate([half, half * np.uint64(pow(base, len(half), 2**64))])


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread over all 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_text(text: str) -> str:
    """Lower-case words with one space between them."""
    return " ".join(text.lower().split())


def pieces(plain: str) -> Iterator[str]:
    """A text with single spaces, cut at spaces into parts of bounded length (but for
    longer words)."""
    at = 0
    while len(plain) - at > LONGEST:
        cut = plain.rfind(" ", at, at + LONGEST)
        cut = cut if cut > at else plain.find(" ", at)
        if cut < 0:
            break
        yield plain[at:cut]
        at = cut + 1
    yield plain[at:]


def word_hashes(plain: str) -> np.ndarray:
    """A hash of each word of a text with single spaces."""
    return np.concatenate([hashes_of_piece(p) for p in pieces(plain)])


def hashes_of_piece(plain: str) -> np.ndarray:
    """Differences of running sums over the bytes."""
    data = np.frombuffer(plain.encode() + b" ", dtype=np.uint8).astype(np.uint64)
    bits = max(1, int(len(data) - 1).bit_length())
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data + np.uint64(1)) * powers(BASE, bits)[: len(data)], out=sums[1:])
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    runs = (sums[ends] - sums[starts]) * powers(UNBASE, bits)[starts]
    return mixed(runs + (ends - starts).astype(np.uint64))


def shingle_set(plain: str, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of `size` words; a shorter text is one
    shingle, one without words has none."""
    if not plain:
        return np.zeros(0, dtype=np.uint64)
    words = word_hashes(plain)
    size = min(size, len(words))
    runs = np.zeros(len(words) - size + 1, dtype=np.uint64)
    for j in range(size):
        runs = runs * np.uint64(0xD6E8FEB86659FD93) + words[j : len(words) - size + 1 + j]
    return np.unique(mixed(runs))


@dataclass(frozen=True)
class Bands:
    """Rows in a band and number of bands."""

    rows: int
    count: int

    @classmethod
    def choose(cls, similarity: float, recall: float, hashes: int = 320) -> Bands:
        """As many rows as allowed by the number of hashes, for few strangers, with as
        many bands as find so large a share of pairs of just this similarity."""
        for rows in range(hashes, 0, -1):
            miss = 1 - similarity**rows
            count = math.ceil(math.log(1 - recall) / math.log(miss)) if miss < 1 else hashes + 1
            if rows * count <= hashes:
                return cls(rows, count)
        raise ValueError(f"{hashes} hashes can't reach that recall")


@cache
def permutations(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    factor = rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return factor[:, None], rng.integers(0, 2**32, n, dtype=np.uint32)[:, None]


def band_hashes(shingles: np.ndarray, bands: Bands) -> np.ndarray:
    """One 64-bit hash for each band, different between bands."""
    factor, shift = permutations(bands.rows * bands.count)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factor), 2**32 - 1, dtype=np.uint32)
    for at in range(0, len(low), AT_ONCE):
        part = low[None, at : at + AT_ONCE]
        for j in range(0, len(factor), 64):
            np.minimum(
                least[j : j + 64],
                (factor[j : j + 64] * part + shift[j : j + 64]).min(axis=1),
                out=least[j : j + 64],
            )
    rows = least.reshape(bands.count, bands.rows).astype(np.uint64)
    found = np.arange(1, bands.count + 1, dtype=np.uint64)
    for j in range(bands.rows):
        found = mixed(found * np.uint64(BASE) + rows[:, j])
    return found
