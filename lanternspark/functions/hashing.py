"""Wrap-around 64-bit hashes of tokens, as Arrow UDFs: Spark's own arithmetic raises on overflow."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Offset and prime of the 64-bit hash; finaliser of the mixer; salts of the bucket tables.
FNV_OFFSET = 14695981039346656037
FNV_PRIME = 1099511628211
MIX_STEP = 0x9E3779B97F4A7C15
MIX_A = 0xBF58476D1CE4E5B9
MIX_B = 0x94D049BB133111EB
NGRAM_SALT = 0xC4A7
BIGRAM_SALT = 0xB16A
MASK = (1 << 64) - 1


def fnv1a64(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h = ((h ^ b) * FNV_PRIME) & MASK
    return h


def mix64(x: int) -> int:
    x = (x + MIX_STEP) & MASK
    x = ((x ^ (x >> 30)) * MIX_A) & MASK
    x = ((x ^ (x >> 27)) * MIX_B) & MASK
    return x ^ (x >> 31)


def bucket(data: bytes, salt: int, buckets: int) -> int:
    return mix64(fnv1a64(data) ^ salt) % buckets


def ngram_buckets(token: str, buckets: int) -> list[int]:
    """Buckets of the byte 3- and 4-grams of the token between ^ and $."""
    raw = b"^" + token.encode("utf-8", "surrogatepass") + b"$"
    return [bucket(raw[i : i + n], NGRAM_SALT, buckets) for n in (3, 4) for i in range(len(raw) - n + 1)]


class HashTable(dict):
    """token -> unsigned hash; emptied when it grows over ``limit``."""

    def __init__(self, limit: int = 1 << 20):
        super().__init__()
        self.limit = limit

    def __missing__(self, token: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[token] = fnv1a64(token.encode("utf-8", "surrogatepass"))
        return h


def hash_column(token: Column) -> Column:
    """The signed 64-bit form of the token's hash; null for null."""

    @F.pandas_udf("bigint")
    def run(s: pd.Series) -> pd.Series:
        table = HashTable()
        return pd.Series([None if t is None else int(np.uint64(table[t]).astype(np.int64)) for t in s], dtype="Int64")

    return run(token)


def mix_column(token: Column, salt: int, buckets: int) -> Column:
    """The bucket of a token under a salt."""

    @F.pandas_udf("int")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else bucket(t.encode("utf-8", "surrogatepass"), salt, buckets) for t in s], dtype="Int32")

    return run(token)
