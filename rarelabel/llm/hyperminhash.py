"""HyperMinHash sketches of shingle sets: kernels for one text at a time.

A register holds the smallest of one hash function's values over the set, as
its leading-zero count (6 bits) and the 10 bits after the leading one.  Each
register has a hash function of its own, so short texts leave none empty.
"""

from __future__ import annotations

import numpy as np
import xxhash

from .repeats import _mixed, _rolling, unit_hashes

BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
MANTISSA_BITS = 10
_CHUNK = 2_048
_random = np.random.Generator(np.random.PCG64(20_240_501))
_FUNCTIONS = _random.integers(0, 1 << 64, REGISTERS, np.uint64) | np.uint64(1)
_FOLD = _random.integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)
_BAND = _random.integers(0, 1 << 64, BANDS, np.uint64)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words, A-Z lower-cased.

    A text with fewer words is one shingle; a text without words has none.
    """
    units = text.encode().lower().split() if text else []  # bytes: changes and cuts at ASCII only
    if not units:
        return np.zeros(0, np.uint64)
    return np.unique(_rolling(unit_hashes(units), min(words, len(units))))


def set_id(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def registers(shingles: np.ndarray) -> np.ndarray:
    """uint16 registers of a set that is not empty."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), _CHUNK):
        np.minimum(least, np.multiply.outer(_FUNCTIONS, shingles[at : at + _CHUNK]).min(axis=1), out=least)
    # a double's exponent is 63 less the leading zeros; its mantissa starts after the leading one
    bits = np.maximum(least, np.uint64(1)).astype(np.float64).view(np.int64) >> (52 - MANTISSA_BITS)
    return np.minimum(bits - (1023 << MANTISSA_BITS), 0xFFFF).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    folded = (regs.reshape(BANDS, ROWS).astype(np.uint64) + np.uint64(1)) * _FOLD
    return _mixed(_mixed(folded.sum(axis=1, dtype=np.uint64) + _BAND)).view(np.int64)


def estimated_jaccard(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """From counts of equal registers and set sizes, less the share that differs but collides."""
    by_chance = 0.169919487159739 * 2.0**-MANTISSA_BITS * 4.0 * n * m / (n + m) ** 2
    return (equal / REGISTERS - by_chance) / (1.0 - by_chance)
