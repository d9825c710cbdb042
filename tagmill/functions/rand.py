"""Randomness as a pure function of (seed, purpose, key).

Results do not depend on partitioning, retries or row order, and any SQL engine with
md5 can repeat them.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DEFAULT_SEED = 42
_RANGE = float(1 << 52)


def uniform(purpose: str, *keys: Column | str, seed: int = DEFAULT_SEED) -> Column:
    """Uniform double in [0, 1) with 52 random bits."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(purpose),
                               *[c.cast("string") for c in cols]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(_RANGE)


def pick(u: Column, n: Column | int) -> Column:
    """Integer in [0, n) taken from a uniform."""
    return F.floor(u * n).cast("int")
