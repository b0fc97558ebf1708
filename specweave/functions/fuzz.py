"""Similarity of word sets, by longest common subsequences."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of ``a`` a row at a time."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & where.get(y, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


@lru_cache(maxsize=1 << 16)
def token_set_ratio(left: str, right: str) -> float:
    """0 to 100: how far the words of one text are those of the other, order and repeats aside."""
    a, b = set(left.split()), set(right.split())
    if not a or not b:
        return 0.0
    both, only_a, only_b = (" ".join(sorted(s)) for s in (a & b, a - b, b - a))
    if both and not (only_a and only_b):
        return 100.0
    s, gap = len(both), 1 if both else 0
    sizes = s + gap + len(only_a), s + gap + len(only_b)
    apart = len(only_a) + len(only_b) - 2 * common_length(only_a, only_b)
    best = 100.0 * (1 - apart / sum(sizes))
    if both:
        best = max(best, *(100.0 * (1 - (n - s) / (s + n)) for n in sizes))
    return best


@F.arrow_udf(T.DoubleType())
def _ratio(left: pa.Array, right: pa.Array) -> pa.Array:
    return pa.array([None if a is None or b is None else token_set_ratio(a, b) for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True)], pa.float64())


def similarity(left: Column, right: Column) -> Column:
    return _ratio(left, right)
