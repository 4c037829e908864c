"""A bounded, repeatable sample of rows for fitting; no other result may rest on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEPS = 1 << 40


def hash_step(key: str) -> Column:
    """Place of a row, by its key, in the order that samples are taken in."""
    return F.pmod(F.xxhash64(F.col(key)), F.lit(_STEPS))


def hash_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows of ``df`` (all of fewer), those whose key hashes lowest; found by a filter, without a shuffle."""
    count = df.count()
    if count <= rows:
        return df
    return df.where(hash_step(key) < int(_STEPS * rows / count))
