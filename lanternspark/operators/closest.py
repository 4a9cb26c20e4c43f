"""For stated token lists the highest similarity that any of very many others has: Jaccard and common subsequence.

Lists that share a template are alike in pairs without number, so pairs are never listed. The stated lists
travel in blocks; a task turns its texts into postings, a segment of bounded size at a time, and takes each
stated list's tokens from the rarest on, until texts not met so far could no longer beat the best. Only
texts whose bound beats the best are compared in full.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternspark.functions.similarity import lcs_ratio
from lanternspark.session import rows_of, spread

#: Stated lists that go to the workers at a time, and tokens of texts a task holds at a time.
BLOCK, SEGMENT = 1 << 15, 1 << 21


def occurrences(tokens: list[str]) -> list[tuple[str, int]]:
    """Every token with how many of its kind stand before it, so that a list is a set."""
    seen: Counter = Counter()
    out = []
    for t in tokens:
        out.append((t, seen[t]))
        seen[t] += 1
    return out


class Segment:
    def __init__(self, texts: list[list[str]]):
        self.texts = texts
        self.length = np.array([len(t) for t in texts], np.int64)
        self.distinct = np.array([len(set(t)) for t in texts], np.int64)
        where: dict[tuple[str, int], list[int]] = {}
        for n, own in enumerate(texts):
            for x in occurrences(own):
                where.setdefault(x, []).append(n)
        self.where = {x: np.array(v, np.int64) for x, v in where.items()}
        self.common, self.shared = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)

    def best(self, own: list[str], sequence: float, jaccard: float) -> tuple[float, float]:
        """The highest (sequence, jaccard) of the segment's texts, or the given ones if none is higher."""
        items = occurrences(own)
        live = sorted(((len(self.where[x]), x) for x in items if x in self.where), key=lambda p: p[0])
        rest, rest_distinct = len(live), sum(k == 0 for _, (_, k) in live)
        n, n_distinct = len(items), len(set(own))
        touched: list[np.ndarray] = []
        for _, x in live:
            # of texts not met yet, none of which has a token taken so far
            if rest_distinct <= jaccard * n_distinct and 2 * rest <= sequence * (n + rest):
                break
            at = self.where[x]
            self.common[at] += 1
            rest -= 1
            if x[1] == 0:
                self.shared[at] += 1
                rest_distinct -= 1
            touched.append(at)
            high = self.shared[at] / (n_distinct + self.distinct[at] - self.shared[at])  # of its final value a lower bound
            jaccard = max(jaccard, float(high.max()))
        if touched:
            met = np.unique(np.concatenate(touched))
            taken = len(touched)
            for _, x in live[taken:]:
                at = self.where[x]
                there = met[at[np.minimum(np.searchsorted(at, met), len(at) - 1)] == met]
                self.common[there] += 1
                if x[1] == 0:
                    self.shared[there] += 1
            both = self.shared[met]
            jaccard = max(jaccard, float((both / (n_distinct + self.distinct[met] - both)).max()))
            bound = 2 * self.common[met] / (n + self.length[met])
            for k in np.argsort(-bound, kind="stable"):
                if bound[k] <= sequence:
                    break
                sequence = max(sequence, lcs_ratio(own, self.texts[met[k]]))
            self.common[met] = 0
            self.shared[met] = 0
        return sequence, jaccard


def _run(shared, sequence: float, jaccard: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, lists = shared.value
        # just under the limits: what doesn't reach them isn't asked for
        best_s, best_j = np.full(len(qids), sequence - 1e-9), np.full(len(qids), jaccard - 1e-9)
        held: set[tuple[str, ...]] = set()
        size = 0

        def take() -> None:
            own = Segment([list(t) for t in sorted(held)])
            for n, tokens in enumerate(lists):
                best_s[n], best_j[n] = own.best(tokens, best_s[n], best_j[n])

        for batch in batches:
            for tokens in batch.column(0).to_pylist():
                if tokens and (key := tuple(tokens)) not in held:
                    held.add(key)
                    size += len(key)
                    if size >= SEGMENT:
                        take()
                        held, size = set(), 0
        if held:
            take()
        some = np.flatnonzero((best_s >= sequence) | (best_j >= jaccard))
        yield pa.RecordBatch.from_arrays([pa.array(qids[some]), pa.array(best_s[some]), pa.array(best_j[some])], names=["qid", "s", "j"])

    return run


def closest(asked: DataFrame, others: DataFrame, sequence: float, jaccard: float) -> DataFrame:
    """(qid, s, j): of every list (qid, q) the highest sequence similarity and Jaccard to any list (t) of others.

    Lists that reach neither limit are left out, and a value that doesn't reach its own is just under it.
    Null and empty lists have no similar one. The others are read once for each block of stated lists.
    """
    spark = asked.sparkSession
    rows = spread(others.select("t").where(F.size("t") > 0))
    out = spark.createDataFrame([], "qid bigint, s double, j double")
    block: list[tuple[int, list[str]]] = []

    def found() -> DataFrame:
        sent = spark.sparkContext.broadcast((np.array([i for i, _ in block], np.int64), [q for _, q in block]))
        return out.unionByName(rows.mapInArrow(_run(sent, sequence, jaccard), "qid bigint, s double, j double"))

    for row in rows_of(asked.select("qid", "q").where(F.size("q") > 0), BLOCK):
        block.append((row.qid, list(row.q)))
        if len(block) == BLOCK:
            out, block = found(), []
    if block:
        out = found()
    return out.groupBy("qid").agg(F.max("s").alias("s"), F.max("j").alias("j"))
