"""Trainers of the word2vec and contrastive embedders. Both fit on a bounded sample on the driver, with a
sorted vocabulary and a fixed seed, so that equal input gives equal weights; embedding is distributed."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from lanternspark.functions.constants import NO_EVIDENCE_ID, NO_EVIDENCE_TEXT, OUT_OF_SCOPE
from lanternspark.operators.embedders import ContrastiveEmbedder, MeanEmbedder, features, simple_tokens, unit_rows

#: Chunks and pairs that a trainer takes at most; callers sample beyond that, by the least hashes of ids.
MAX_CHUNKS, MAX_PAIRS = 20_000, 50_000


def _vocabulary(texts: list[list[str]], min_count: int) -> dict[str, int]:
    counts = Counter(t for ts in texts for t in ts)
    return {t: n for n, t in enumerate(sorted(t for t, c in counts.items() if c >= min_count))}


@dataclass(frozen=True)
class Word2VecConfig:
    dim: int = 64
    epochs: int = 40
    window: int = 5
    negative: int = 5
    lr: float = 0.05
    min_count: int = 1
    seed: int = 0xC0FFEE
    doc_repeat: int = 8


def train_word2vec(texts: Sequence[str | None], c: Word2VecConfig = Word2VecConfig()) -> MeanEmbedder:
    """Skip-gram with negative sampling; negatives by count^0.75, the rate falls linearly to nothing.

    Each text counts doc_repeat times: its pairs are drawn in that many passes an epoch.
    """
    docs = [simple_tokens(t) for t in texts]
    vocab = _vocabulary(docs, c.min_count)
    if not vocab:
        raise ValueError("no token is frequent enough to train on")
    rng = np.random.default_rng(c.seed)
    size = len(vocab)
    rows, outs = (rng.random((size, c.dim)) - 0.5) / c.dim, np.zeros((size, c.dim))
    counts = np.zeros(size)
    centre, near = [], []
    for doc in docs:
        ids = [vocab[t] for t in doc if t in vocab]
        np.add.at(counts, ids, 1)
        for i, x in enumerate(ids):
            for j in range(max(0, i - c.window), min(len(ids), i + c.window + 1)):
                if i != j:
                    centre.append(x)
                    near.append(ids[j])
    odds = np.cumsum(counts**0.75)
    odds /= odds[-1]
    a, b = np.array(centre, np.int64), np.array(near, np.int64)
    passes = c.epochs * c.doc_repeat
    for n in range(passes if len(a) else 0):
        rate = c.lr * max(1 - n / passes, 1e-4)
        for part in np.array_split(rng.permutation(len(a)), max(1, len(a) // 256)):
            x, good = a[part], b[part]
            bad = np.searchsorted(odds, rng.random((len(part), c.negative)))
            target = np.concatenate([good[:, None], bad], axis=1)
            label = np.zeros(target.shape)
            label[:, 0] = 1
            label[:, 1:][bad == good[:, None]] = np.nan  # a negative that is the word itself doesn't count
            z = np.clip(np.einsum("nd,nkd->nk", rows[x], outs[target]), -30, 30)
            g = np.nan_to_num(label - 1 / (1 + np.exp(-z))) * rate
            step = np.einsum("nk,nkd->nd", g, outs[target])
            np.add.at(outs, target, g[..., None] * rows[x][:, None, :])
            np.add.at(rows, x, step)
    return MeanEmbedder(vocab, unit_rows(rows))


@dataclass(frozen=True)
class ContrastiveConfig:
    dim: int = 128
    epochs: int = 420
    lr: float = 0.08
    momentum: float = 0.9
    temperature: float = 0.05
    min_count: int = 1
    seed: int = 0xA11CE
    ngram_buckets: int = 4096
    bigram_buckets: int = 4096
    full_doc_softmax: bool = True
    max_negatives: int = 32
    hard_k: int = 5
    hard_start_epoch: int = 100
    hard_temperature: float = 0.04
    hard_weight: float = 0.15
    query_query_weight: float = 0.0
    batch: int = 16


def out_of_scope_pairs(n_pairs: int) -> list[tuple[str, int]]:
    """The out-of-scope questions towards the sentinel, repeated 2 to 6 times so that they aren't drowned."""
    n = len(OUT_OF_SCOPE)
    repeats = 2 if n_pairs <= n else min(6, max(2, math.ceil(n_pairs / n)))
    return [(q, NO_EVIDENCE_ID) for _ in range(repeats) for q in OUT_OF_SCOPE]


class _Bag:
    """Texts as rows of a sparse matrix of weighted features."""

    def __init__(self, texts: list[list[str]], vocab: dict[str, int], c: ContrastiveConfig):
        parts = [features(t, vocab, c.ngram_buckets, c.bigram_buckets) for t in texts]
        self.cols, self.weights = [p[0] for p in parts], [p[1] for p in parts]

    def pool(self, table: np.ndarray, which: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        """(unit rows, lengths before)."""
        raw = np.array([self.weights[i] @ table[self.cols[i]] if len(self.cols[i]) else np.zeros(table.shape[1]) for i in which])
        size = np.linalg.norm(raw, axis=1, keepdims=True)
        return raw / np.where(size > 0, size, 1), size

    def add(self, grad: np.ndarray, which: Sequence[int], g: np.ndarray) -> None:
        """Back through the pooling; the normalisation is taken as constant."""
        for n, i in enumerate(which):
            np.add.at(grad, self.cols[i], self.weights[i][:, None] * g[n])


def _pull(q: np.ndarray, d: np.ndarray, pos: np.ndarray, allowed: np.ndarray, temperature: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of InfoNCE for queries and documents."""
    z = np.clip(q @ d.T / temperature, -40, 40)
    z[~allowed] = -np.inf
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(q)), pos] -= 1
    p /= temperature
    return p @ d, p.T @ q


def train_contrastive(chunks: Sequence[tuple[int, str | None]], pairs: Sequence[tuple[str, int]], c: ContrastiveConfig = ContrastiveConfig()) -> ContrastiveEmbedder:
    """InfoNCE of (query, chunk id) pairs against all chunks, with momentum and a cosine learning rate from 1
    to 0.15 times lr; from hard_start_epoch on also against the hardest wrong chunks, the sentinel aside."""
    where = {i: n for n, (i, _) in enumerate(chunks)}
    lost = {i for _, i in pairs if i not in where}
    if lost or not pairs:
        raise ValueError(f"pairs name chunks that aren't there: {sorted(lost)[:5]}" if pairs else "no training pairs")
    doc_tokens = [simple_tokens(t) for _, t in chunks]
    query_tokens = [simple_tokens(q) for q, _ in pairs]
    vocab = _vocabulary(doc_tokens + query_tokens, c.min_count)
    rng = np.random.default_rng(c.seed)
    n_rows = len(vocab) + c.ngram_buckets + c.bigram_buckets
    table = (rng.random((n_rows, c.dim)) - 0.5) / c.dim
    table[len(vocab) :] *= 0.5
    docs, queries = _Bag(doc_tokens, vocab, c), _Bag(query_tokens, vocab, c)
    gold = np.array([where[i] for _, i in pairs])
    sentinel = where.get(NO_EVIDENCE_ID, -1)
    speed = np.zeros_like(table)
    same: dict[int, list[int]] = {}
    for n, g in enumerate(gold.tolist()):
        same.setdefault(g, []).append(n)
    every = np.arange(len(chunks))
    for epoch in range(c.epochs):
        rate = c.lr * (0.15 + 0.85 * 0.5 * (1 + math.cos(math.pi * epoch / max(1, c.epochs - 1))))
        order = rng.permutation(len(pairs))
        for part in np.array_split(order, max(1, math.ceil(len(order) / c.batch))):
            pos = gold[part]
            q, _ = queries.pool(table, part)
            d, _ = docs.pool(table, every)
            allowed = np.ones((len(part), len(every)), bool)
            if not c.full_doc_softmax:
                allowed[:] = False
                for n in range(len(part)):
                    allowed[n, rng.choice(len(every), min(c.max_negatives, len(every)), replace=False)] = True
                allowed[np.arange(len(part)), pos] = True
            gq, gd = _pull(q, d, pos, allowed, c.temperature)
            if c.hard_weight > 0 and epoch >= c.hard_start_epoch and len(every) > 1:
                near = q @ d.T
                near[np.arange(len(part)), pos] = -np.inf
                if sentinel >= 0:
                    near[:, sentinel] = -np.inf
                hard = np.argpartition(-near, min(c.hard_k, len(every)) - 1, axis=1)[:, : c.hard_k]
                only = np.zeros_like(allowed)
                np.put_along_axis(only, hard, True, axis=1)
                only &= np.isfinite(near)
                only[np.arange(len(part)), pos] = True
                real = (pos != sentinel)[:, None]
                hq, hd = _pull(q, d, pos, only, c.hard_temperature)
                hd = np.zeros_like(gd) if not real.any() else _pull(q[real[:, 0]], d, pos[real[:, 0]], only[real[:, 0]], c.hard_temperature)[1]
                gq, gd = gq + c.hard_weight * hq * real, gd + c.hard_weight * hd
            grad = np.zeros_like(table)
            queries.add(grad, part, gq)
            docs.add(grad, every, gd)
            if c.query_query_weight > 0:
                other = np.array([rng.choice(same[g]) for g in pos.tolist()])
                o, _ = queries.pool(table, other)
                queries.add(grad, part, c.query_query_weight * (q - o))
                queries.add(grad, other, c.query_query_weight * (o - q))
            speed = c.momentum * speed - rate * grad / len(part)
            table += speed
    table[: len(vocab)] = unit_rows(table[: len(vocab)])
    return ContrastiveEmbedder(vocab, table, c.ngram_buckets, c.bigram_buckets)


def with_sentinel(chunks: Sequence[tuple[int, str | None]]) -> list[tuple[int, str | None]]:
    """The chunks with the sentinel; one that is there must be the genuine one."""
    own = dict(chunks)
    if own.get(NO_EVIDENCE_ID, NO_EVIDENCE_TEXT) != NO_EVIDENCE_TEXT:
        raise ValueError("chunk id -1 is reserved for the sentinel, and the one present isn't it")
    return [*chunks] if NO_EVIDENCE_ID in own else [*chunks, (NO_EVIDENCE_ID, NO_EVIDENCE_TEXT)]
