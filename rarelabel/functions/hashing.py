"""Row hashing: the one source of randomness in this package.

A draw is a function of (row key, seed), never of partition layout, so a lost
executor, a retry or a different cluster size gives the same answer.  The hash
is the first 60 bits of an MD5, because other SQL engines can state it too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60
HASH_SPACE = 1 << HASH_BITS


def as_columns(key: str | Sequence[str]) -> list[str]:
    """Normalise a row key given as one name or as several."""
    return [key] if isinstance(key, str) else list(key)


def uniform_hash(*parts: Column | str, seed: int) -> Column:
    """Uniform integer in [0, 2**60) from the text of ``parts`` and the seed.

    Parts should be integers or strings; engines print doubles differently.
    """
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat_ws(":", *[c.cast("string") for c in cols], F.lit(str(seed)))
    hashed = F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("bigint")
    # never null; saying so spares joins on it a null filter that hashes again
    return F.coalesce(hashed, F.lit(0).cast("bigint"))


def below(fraction: float) -> int:
    """Hash threshold so that ``hash < below(f)`` keeps a share ``f`` of rows."""
    if not 0.0 <= fraction <= 1.0:
        raise ValueError(f"fraction {fraction} is outside [0, 1]")
    return int(fraction * HASH_SPACE)


def hash_bucket(hashed: Column, bits: int) -> Column:
    """Top ``bits`` bits of a hash: a bucket number that keeps hash order."""
    return F.shiftright(hashed, HASH_BITS - bits)
