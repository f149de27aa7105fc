"""Word shingles of whole texts as sorted sets of 64-bit hashes, and minwise values of such sets."""

from __future__ import annotations

import re

import numpy as np
import xxhash

UPPER_TO_LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """Hashes of words; forgets all once it holds ``limit`` of them, so its memory is bounded."""

    def __init__(self, limit: int = 300_000):
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_HASHES = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct shingles of a text, sorted; with fewer words than ``size`` the whole sequence is one; no words, none."""
    words = WORD.findall((text or "").translate(UPPER_TO_LOWER))
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    out = np.full(len(h) - width + 1, width, np.uint64) * _MIX
    for k in range(width):
        out = _mixed(out * np.uint64(3) + h[k : len(h) - width + 1 + k])
    return np.unique(out)


def set_digest(shingles: np.ndarray) -> bytes:
    """16 bytes that two sets share only if they are equal."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def minwise(shingles: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """One 32-bit minwise value a seed: the top half of the least product of a shingle and the seed made odd.

    Shingles are mixed hashes already, so a product with an odd number of its own orders them anew for each seed.
    """
    out, odd = np.full(len(seeds), np.uint64(2**64 - 1), np.uint64), seeds | np.uint64(1)
    for k in range(0, len(shingles), 2048):  # long texts in pieces, so that the table stays in cache
        np.minimum(out, (shingles[k : k + 2048, None] * odd).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)
