"""Token-sort similarity on column pairs."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F, types as T

# Executors receive the helpers below by value and need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def token_sort(text: Column) -> Column:
    """Blank-separated tokens in name order."""
    words = F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 0)
    return F.array_join(F.array_sort(words), " ")


def _common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by Hyyro's bit-vector recurrence (2004)."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """100 (1 - insertions and deletions / total length), per Arrow batch."""
    def one(x: str, y: str) -> float:
        total = len(x) + len(y)
        return 100.0 * (1 - (total - 2 * _common_length(x, y)) / total) if total else 100.0
    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")
