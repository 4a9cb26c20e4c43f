"""Embedders: objects that turn a batch of texts into vectors, and how a DataFrame is embedded by one."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternspark.functions.hashing import BIGRAM_SALT, HashTable, bucket, ngram_buckets
from lanternspark.session import spread

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_TOKEN = re.compile("[0-9a-z\x80-\U0010ffff]+")


def simple_tokens(text: str | None) -> list[str]:
    """The same tokens as ``functions.text.tokens``, for code that runs in Python."""
    found = _TOKEN.findall((text or "").translate(_LOWER))
    return [t[:-1] if t.endswith("s") and not t.endswith("ss") and len(t.encode("utf-8", "surrogatepass")) > 4 else t for t in found]


class Embedder(Protocol):
    """What a user's own embedder has: a size, a name, and vectors (n, dim) of n texts."""

    dim: int
    id: str

    def embed(self, texts: list[str | None]) -> np.ndarray: ...


def unit_rows(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return (rows / np.where(size > 0, size, 1)).astype(np.float32)


class HashingEmbedder:
    """Every token adds 1 or -1 at the place its hash gives; rows at length 1."""

    id = "hashing-v1"

    def __init__(self, dim: int = 512):
        if dim <= 0:
            raise ValueError("dim must be over 0")
        self.dim, self.table = dim, HashTable()

    def embed(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        found = [simple_tokens(t) for t in texts]
        h = np.array([self.table[t] for ts in found for t in ts], np.uint64)
        row = np.repeat(np.arange(len(texts)), [len(ts) for ts in found])
        sign = np.where((h >> np.uint64(32)) & np.uint64(1), 1.0, -1.0)
        np.add.at(out, (row, (h % np.uint64(self.dim)).astype(np.int64)), sign)
        return unit_rows(out)


class MeanEmbedder:
    """Word vectors' mean over the known tokens at length 1; zero if none is known."""

    def __init__(self, vocab: dict[str, int], rows: np.ndarray, id: str = "word2vec-v1"):
        self.vocab, self.rows, self.id, self.dim = vocab, rows.astype(np.float32), id, rows.shape[1]

    def has(self, token: str) -> bool:
        return token in self.vocab

    def embed(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for n, text in enumerate(texts):
            known = [self.vocab[t] for t in simple_tokens(text) if t in self.vocab]
            if known:
                out[n] = self.rows[known].mean(axis=0)
        return unit_rows(out)


#: Weights of n-gram and bigram rows beside a token's 1.
NGRAM_WEIGHT, BIGRAM_WEIGHT = 0.35, 0.45


def features(tokens: list[str], vocab: dict[str, int], ngrams: int, bigrams: int) -> tuple[np.ndarray, np.ndarray]:
    """(columns, weights) of a text: token rows, then n-gram buckets, then bigram buckets; weights sum to 1."""
    cols: list[int] = []
    weights: list[float] = []
    v = len(vocab)
    for t in tokens:
        if t in vocab:
            cols.append(vocab[t])
            weights.append(1.0)
        own = ngram_buckets(t, ngrams) if ngrams else []
        cols += [v + b for b in own]
        weights += [NGRAM_WEIGHT] * len(own)
    if bigrams:
        pairs = [bucket(f"{a}_{b}".encode("utf-8", "surrogatepass"), BIGRAM_SALT, bigrams) for a, b in zip(tokens, tokens[1:], strict=False)]
        cols += [v + ngrams + b for b in pairs]
        weights += [BIGRAM_WEIGHT] * len(pairs)
    w = np.array(weights)
    return np.array(cols, np.int64), w / w.sum() if len(w) else w


class ContrastiveEmbedder:
    """Tokens, their character n-grams and adjacent pairs, pooled by weight, at length 1."""

    def __init__(self, vocab: dict[str, int], rows: np.ndarray, ngrams: int = 4096, bigrams: int = 4096, id: str = "contrastive-v2"):
        self.vocab, self.rows, self.ngrams, self.bigrams = vocab, rows.astype(np.float32), ngrams, bigrams
        self.id, self.dim = id, rows.shape[1]

    def embed(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for n, text in enumerate(texts):
            cols, w = features(simple_tokens(text), self.vocab, self.ngrams, self.bigrams)
            if len(cols):
                out[n] = w @ self.rows[cols]
        return unit_rows(out)


def embed(df: DataFrame, embedder: Embedder, key: str, text: str, out_key: str = "id") -> DataFrame:
    """(out_key, vec) of every row; a null text is an empty one. The embedder travels once as a broadcast."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(embedder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rows = np.ascontiguousarray(own.embed(batch.column(1).to_pylist()), np.float32)
            offsets = pa.array(np.arange(0, rows.size + 1, own.dim, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))], names=[out_key, "vec"])

    rows = spread(df.select(F.col(key).cast("bigint").alias(out_key), F.col(text).alias("text")))
    return rows.mapInArrow(run, f"{out_key} bigint, vec array<float>")
