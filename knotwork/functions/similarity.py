"""The normalised Indel similarity of strings: 200 * LCS / (|a| + |b|)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows (Hyyrö)."""
    if len(a) < len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & where.get(c, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """0 to 100; two empty strings are alike."""
    return 200 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


@pandas_udf(LongType())
def lcs(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Column function: the longest common subsequence's length."""
    for a, b in pairs:
        yield pd.Series([common_length(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")
