"""Edit similarities with no built-in form, as Arrow-batched functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def indel(a: str, b: str) -> float:
    """2 * LCS / (len + len) of two strings, 1 for two empty ones: bit-parallel longest common subsequence."""
    if not a or not b:
        return float(a == b)
    full, where = (1 << len(a)) - 1, {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    s = full
    for c in b:
        u = s & where.get(c, 0)
        s = (s + u | s - u) & full
    return 2 * (len(a) - s.bit_count()) / (len(a) + len(b))


def token_set(a: str, b: str) -> float:
    """The best indel ratio among the shared tokens and the shared ones with each side's others."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 1.0
    sides = [f"{both} {left}".strip(), f"{both} {right}".strip()]
    return max(indel(*sides), indel(both, sides[0]) if both else 0.0, indel(both, sides[1]) if both else 0.0)


@F.pandas_udf(DoubleType())
def edit_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """F07; null where either side is."""
    return pd.Series([None if x is None or y is None else indel(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """F08; null where either side is."""
    return pd.Series([None if x is None or y is None else token_set(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
