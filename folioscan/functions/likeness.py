"""Likeness of two texts. Spark has no longest common subsequence, so these are Arrow functions over few pairs."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit of a whole number for each letter of ``a``."""
    places: dict[str, int] = {}
    for k, letter in enumerate(a):
        places[letter] = places.get(letter, 0) | 1 << k
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for letter in b:
        met = row & places.get(letter, 0)
        row = (row + met | row - met) & full
    return len(a) - row.bit_count()


@F.pandas_udf(DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness of two texts' sorted words, 0 to 100: twice the common subsequence over both lengths. Null where one is."""

    def one(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        x, y = (" ".join(sorted(t.split())) for t in (x, y))
        return 200.0 * common_length(x, y) / (len(x) + len(y)) if x or y else 100.0

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks of two texts, 0 to 1. Null where one is."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")
