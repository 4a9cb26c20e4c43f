"""Exact top-k by cosine: blocks of the stated queries against every row, reduced on each partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lanternspark.operators.sparse import top_k
from lanternspark.session import rows_of

#: Query vectors that go to the workers at a time, and scores a task holds at a time.
QUERY_BLOCK, SCORES = 16_384, 1 << 21


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows at length 1, zero rows as they are."""
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1)


def vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, places) of the vectors of the right size; null ones, and those with a null in them, are left out."""
    sizes = np.diff(column.offsets.to_numpy())
    if not column.null_count and not column.values.null_count and (sizes == dim).all():  # as they lie
        flat = column.values.to_numpy()[column.offsets[0].as_py() : column.offsets[-1].as_py()]
        return flat.reshape(-1, dim).astype(np.float64), np.arange(len(column))
    rows = column.to_pylist()
    places = [i for i, v in enumerate(rows) if v is not None and len(v) == dim and None not in v]
    return np.array([rows[i] for i in places], np.float64).reshape(-1, dim), np.array(places, np.int64)


def keep(row: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (row, id, score) triples each row's k best by 9 digits, ties to the smaller id."""
    order = np.lexsort((ids, -np.round(scores, 9), row))
    rank = np.arange(len(row)) - np.searchsorted(row[order], row[order])
    order = order[rank < k]
    return row[order], ids[order], scores[order]


class Best:
    """The k best of every query so far; only scores that reach a query's k-th best are ever sorted."""

    def __init__(self, n: int, k: int):
        self.k, self.floor = k, np.full(n, -np.inf)
        self.held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))

    def add(self, scores: np.ndarray, ids: np.ndarray, which: np.ndarray | None = None) -> None:
        """The scores of some rows for all queries, or for those at the places ``which``."""
        keys = np.round(scores, 9)
        which = np.arange(len(self.floor)) if which is None else which
        if scores.shape[1] > self.k:
            least = scores.shape[1] - self.k
            self.floor[which] = np.maximum(self.floor[which], np.partition(keys, least, axis=1)[:, least])
        row, col = np.nonzero(keys >= self.floor[which][:, None])
        self.held = keep(*(np.concatenate(x) for x in zip(self.held, (which[row], ids[col], scores[row, col]), strict=True)), self.k)
        full = np.flatnonzero(np.bincount(self.held[0], minlength=len(self.floor)) == self.k)
        last = np.searchsorted(self.held[0], full, "right") - 1
        self.floor[full] = np.maximum(self.floor[full], np.round(self.held[2][last], 9))


def _search(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, matrix = shared.value
        best = Best(len(qids), k)
        step = max(16, SCORES // max(1, len(qids)))
        for batch in batches:
            rows, places = vectors(batch.column(1), matrix.shape[1])
            ids = batch.column(0).to_numpy(zero_copy_only=False)[places].astype(np.int64) if len(places) else np.empty(0, np.int64)
            for a in range(0, len(rows), step):
                best.add(np.round(matrix @ unit(rows[a : a + step]).T, 12), ids[a : a + step])
        row, ids, scores = best.held
        yield pa.RecordBatch.from_arrays([pa.array(qids[row]), pa.array(ids), pa.array(scores)], names=["qid", "id", "score"])

    return run


def search(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, hit_rank): for every query of (qid, vec) the k rows of (id, vec) nearest by cosine.

    Ties go to the smaller id. A zero vector has cosine 0 with all; null vectors, null ids and those of a
    size other than the query's are no hits. Queries travel in blocks of at most QUERY_BLOCK, so what is
    sent doesn't grow with the data; each partition sends its own k best of a query.
    """
    spark = rows.sparkSession
    rows = rows.select("id", "vec").where("id is not null and vec is not null")
    out = None
    for dim, block in _blocks(queries.select("qid", "vec").where("qid is not null and vec is not null")):
        ids = np.array([q for q, _ in block], np.int64)
        shared = spark.sparkContext.broadcast((ids, unit(np.array([v for _, v in block], np.float64).reshape(-1, dim))))
        found = rows.mapInArrow(_search(shared, k), "qid bigint, id bigint, score double")
        out = found if out is None else out.unionByName(found)
    return top_k(out if out is not None else spark.createDataFrame([], "qid bigint, id bigint, score double"), k)


def _blocks(queries: DataFrame) -> Iterator[tuple[int, list]]:
    held: dict[int, list] = {}
    for row in rows_of(queries, QUERY_BLOCK):
        own = held.setdefault(len(row.vec), [])
        own.append((row.qid, row.vec))
        if len(own) == QUERY_BLOCK:
            yield len(row.vec), held.pop(len(row.vec))
    yield from held.items()
