"""Similarity of names by their sets of words."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit of a number for each letter of ``a``."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for ch in b:
        hit = row & where.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


@lru_cache(1 << 18)  # the same names meet the same roles in many plays
def token_set_ratio(a: str | None, b: str | None) -> float:
    """0 to 100. Words shared by both count once; 100 if one side has no word of its own left; 0 if a side is empty."""
    x, y = set((a or "").split()), set((b or "").split())
    if not x or not y:
        return 0.0
    both, own_x, own_y = x & y, x - y, y - x
    if both and (not own_x or not own_y):
        return 100.0
    shared = len(" ".join(sorted(both)))
    sx, sy = " ".join(sorted(own_x)), " ".join(sorted(own_y))
    gap = 1 if shared else 0
    lx, ly = shared + gap + len(sx), shared + gap + len(sy)
    scores = [100 * (1 - (len(sx) + len(sy) - 2 * lcs(sx, sy)) / (lx + ly))]
    if shared:
        scores += [100 * (1 - (gap + len(s)) / (shared + length)) for s, length in ((sx, lx), (sy, ly))]
    return max(scores)


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x, y) for x, y in zip(a, b)])
