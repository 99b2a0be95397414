"""Deterministic seeds and draws, from keys of text parts."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, functions as F

#: The modulus of seeds and the separator between key parts.
MODULUS, SEPARATOR = 2**32 - 1, "\x1f"


def stable_seed(base: int, *parts) -> int:
    """A seed from a base and the first eight bytes of a digest of the parts."""
    digest = hashlib.sha256(SEPARATOR.join(map(str, parts)).encode()).digest()
    return (base + int.from_bytes(digest[:8], "big")) % MODULUS


def generator(base: int, *parts) -> np.random.Generator:
    return np.random.default_rng(stable_seed(base, *parts))


def stable_seed_column(base: int, *parts: Column) -> Column:
    """``stable_seed`` as an expression."""
    digest = F.substring(F.sha2(F.concat_ws(SEPARATOR, *parts), 256), 1, 16)
    return ((F.conv(digest, 16, 10).cast("decimal(20,0)") + F.lit(base)) % F.lit(MODULUS)).cast("long")


def uniform(*parts: Column) -> Column:
    """A draw between 0 and 1 from a hash of the parts, the same in every engine that has md5."""
    prefix = F.conv(F.substring(F.md5(F.concat(*parts)), 1, 8), 16, 10).cast("long")
    return (prefix + F.lit(0.5)) / F.lit(float(2**32))
