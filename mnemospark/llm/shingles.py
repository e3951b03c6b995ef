"""Word shingles and MinHash values of one text, as numpy arrays.

Used inside Arrow batches only; everything between rows is done by Spark.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Columns of a long text that are hashed at once; bounds memory, not the text.
CHUNK = 8192

_word_hash = xxhash.xxh3_64_intdigest


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection, so equal only for equal input)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def words(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space; only A-Z are lower-cased."""
    return text.lower().split() if text else []


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_word_hash, tokens), np.uint64, len(tokens))


def shingle_hashes(tokens: list[bytes], width: int) -> np.ndarray:
    """Hashes of all shingles in text order; fewer words than ``width``: one shingle."""
    if not tokens:
        return np.empty(0, np.uint64)
    hashed = word_hashes(tokens)
    span = min(width, len(tokens))
    count = len(tokens) - span + 1
    total = np.full(count, span, np.uint64)
    for k in range(span):
        total = mix(total + hashed[k : k + count])
    return total


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text; empty without words."""
    return np.unique(shingle_hashes(words(text), width))


class MinHash:
    """``count`` hash functions x -> a*x + b over 32-bit values, and their minima."""

    def __init__(self, count: int, seed: int):
        draw = np.random.default_rng(seed)
        self.factors = (draw.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.offsets = draw.integers(0, 1 << 32, count, dtype=np.uint32)[:, None]

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
        best = np.full(len(self.factors), 0xFFFFFFFF, np.uint32)
        for start in range(0, len(x), CHUNK):
            values = x[None, start : start + CHUNK] * self.factors
            values += self.offsets
            np.minimum(best, values.min(axis=1), out=best)
        return best


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """64-bit keys of each band of ``rows`` values, for signatures one below the other.

    The band number is in the key.
    """
    bands = signatures.reshape(len(signatures), -1, rows)
    key = np.broadcast_to(np.arange(bands.shape[1], dtype=np.uint64), bands.shape[:2])
    for k in range(rows):
        key = mix(key * np.uint64(0x100000001B3) + bands[:, :, k].astype(np.uint64))
    return key
