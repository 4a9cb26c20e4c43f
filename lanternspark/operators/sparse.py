"""BM25: postings and document frequencies as aggregates, and top-k search in one pass over the documents.

A common term is in most documents and most queries, so joining queries to postings would make nearly
every pair a row. Search sends the stated queries in blocks of bounded size to the documents instead. A
task turns its documents into postings, a segment of bounded size at a time, and takes each query's
terms from the rarest on: once what the other terms can add at most is less than the query's k-th best
score so far, no further document can come in, and the other terms are only looked up for those that are
still in the running. So common terms cost nothing but for the few documents that rare ones have found.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternspark.functions.text import NO_EVIDENCE_ID, tokens
from lanternspark.operators.embedders import simple_tokens
from lanternspark.session import cut, rows_of, spread

K1, B = 1.2, 0.75
#: Queries that go to the workers at a time, and tokens of the documents a task holds at a time.
QUERY_BLOCK, SEGMENT = 1 << 16, 1 << 21
#: What scores that count as equal may differ by.
SLACK = 1e-8


def store(chunks: DataFrame) -> DataFrame:
    """(id, source, text): the chunk store, rows delivered twice once; null ids are dropped.

    Of an id with several texts or sources the least of (text, source) stays, nulls first.
    """
    rows = chunks.select(F.col("id").cast("bigint").alias("id"), F.struct("text", "source").alias("r")).where("id is not null")
    return rows.groupBy("id").agg(F.min("r").alias("r")).select("id", "r.source", "r.text")


@dataclass
class Bm25:
    """The index of a store. Null texts are documents of length 0: they count in N and the mean length."""

    docs: DataFrame
    postings: DataFrame
    stats: DataFrame

    @classmethod
    def build(cls, chunks: DataFrame) -> Bm25:
        """Over (id, text) of every chunk but the sentinel.

        Terms are counted per document before anything is joined; the mean length and N are one row.
        """
        own = store(chunks).where(F.col("id") != NO_EVIDENCE_ID).select("id", "text")
        docs = own.select("id", tokens(F.col("text")).alias("t"))
        length = F.size("t")
        terms = docs.select("id", length.alias("len"), F.explode("t").alias("term"))
        postings = terms.groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
        stats = docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg(length), F.lit(0.0)).alias("avgdl"))
        return cls(own, postings, stats)

    def df(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, df), of the given ``terms`` only; counted where the documents lie, before any shuffle."""
        rows = self.docs.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
        return (rows if terms is None else rows.join(terms, "term", "left_semi")).groupBy("term").agg(F.count("*").alias("df"))

    @staticmethod
    def idf(n_docs: Column, df: Column) -> Column:
        return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))

    @staticmethod
    def query_tf(queries: DataFrame) -> DataFrame:
        """(qid, term, qtf) of (qid, query); stop words stay."""
        return queries.select("qid", F.explode(tokens(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))

    def _weight(self, postings: DataFrame, df: DataFrame) -> DataFrame:
        """(term, id, w): what of a posting's score doesn't depend on the query."""
        size = K1 * (1 - B + B * F.col("len") / F.col("avgdl"))
        rows = postings.join(df, "term").crossJoin(F.broadcast(self.stats))  # one row
        return rows.select("term", "id", (self.idf(F.col("n_docs"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + size)).alias("w"))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(qid, id, score, hit_rank): the k best with a score over 0, ties to the smaller id.

        The documents are read once for the length statistics, once for the frequencies of all terms that
        queries have, and once for each block of QUERY_BLOCK queries.
        """
        spark = queries.sparkSession
        n_docs, avgdl = self.stats.first()
        asked = queries.where("qid is not null").select(F.explode(tokens(F.col("query"))).alias("term")).distinct()
        frequencies = cut(self.df(asked))
        rows, out = spread(self.docs), None
        for block in _blocks(queries):
            terms = spark.createDataFrame([(t,) for t in sorted({t for _, q in block for t in q})], "term string")
            #: A row a term of the block at most.
            df = {r.term: r.df for r in frequencies.join(terms, "term", "left_semi").collect()}
            shared = spark.sparkContext.broadcast(Asked(block, df, n_docs, avgdl))
            found = rows.mapInArrow(_search(shared, k), "qid bigint, id bigint, score double")
            out = found if out is None else out.unionByName(found)
        return top_k(out if out is not None else spark.createDataFrame([], "qid bigint, id bigint, score double"), k)

    def score_ids(self, pairs: DataFrame, queries: DataFrame) -> DataFrame:
        """(qid, id, score) of given pairs; 0 for a document that isn't indexed or shares no term.

        Only the pairs' own terms are joined, and only their postings are weighed.
        """
        asked = self.query_tf(queries)
        used = self.postings.join(asked.select("term").distinct(), "term", "left_semi")
        weighed = self._weight(used, used.groupBy("term").agg(F.count("*").alias("df")))
        own = pairs.select("qid", "id").distinct()
        sums = own.join(asked, "qid").join(weighed, ["id", "term"]).groupBy("qid", "id").agg(F.sum(F.col("w") * F.col("qtf")).alias("score"))
        return pairs.select("qid", "id").join(sums, ["qid", "id"], "left").select("qid", "id", F.coalesce("score", F.lit(0.0)).alias("score"))

    def max_score(self, queries: DataFrame) -> DataFrame:
        """(qid, max_score) of every query, 0 without any hit."""
        best = self.search(queries, 1).select("qid", F.col("score").alias("m"))
        return queries.select("qid").distinct().join(best, "qid", "left").select("qid", F.coalesce("m", F.lit(0.0)).alias("max_score"))


def _blocks(queries: DataFrame) -> Iterator[list[tuple[int, Counter]]]:
    """(qid, term counts) of the queries with a term; rows of one qid are one query."""
    block: dict[int, Counter] = {}
    for row in rows_of(queries.select("qid", "query").where("qid is not null"), QUERY_BLOCK):
        own = Counter(simple_tokens(row.query))
        if own:
            if row.qid not in block and len(block) == QUERY_BLOCK:
                yield [*block.items()]
                block = {}
            block[row.qid] = block.get(row.qid, Counter()) + own
    if block:
        yield [*block.items()]


class Asked:
    """A block of queries: their terms as numbers with what each is worth, the most valuable first."""

    def __init__(self, block: list[tuple[int, Counter]], df: dict[str, int], n_docs: int, avgdl: float):
        self.number = {t: n for n, t in enumerate(sorted(df))}
        self.avgdl = float(avgdl) or 1.0
        idf = {t: float(np.log(1 + (n_docs - d + 0.5) / (d + 0.5))) for t, d in df.items()}
        self.qids = np.array([i for i, _ in block], np.int64)
        self.terms = [sorted(((qtf * idf[t], self.number[t]) for t, qtf in q.items() if t in df), reverse=True) for _, q in block]


class Segment:
    """The postings of some documents: of each term the places of its documents, in order, with their part of the score."""

    def __init__(self, ids: list[int], texts: list[list[str]], asked: Asked):
        self.ids = np.array(ids, np.int64)
        length = np.array([len(t) for t in texts], np.int64)
        flat = np.fromiter((asked.number.get(t, -1) for own in texts for t in own), np.int64, int(length.sum()))
        doc = np.repeat(np.arange(len(texts)), length)
        keys, tf = np.unique((flat * len(texts) + doc)[flat >= 0], return_counts=True)
        term, self.doc = np.divmod(keys, max(1, len(texts)))
        size = K1 * (1 - B + B * length / asked.avgdl)
        self.part = tf * (K1 + 1) / (tf + size[self.doc])
        self.starts = np.searchsorted(term, np.arange(len(asked.number) + 1))
        #: The largest part of each term, 0 of those that aren't there.
        self.most = np.zeros(len(asked.number))
        some = np.flatnonzero(np.diff(self.starts))
        if len(some):
            self.most[some] = np.maximum.reduceat(self.part, self.starts[some])
        self.score = np.zeros(len(texts))

    def best(self, terms: list[tuple[float, int]], k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the k best documents, and others that are no worse than ``floor``, if any."""
        score = self.score
        live = sorted(((w * self.most[t], w, t) for w, t in terms if self.most[t]), reverse=True)
        rest = sum(x for x, _, _ in live)
        touched: list[np.ndarray] = []
        n = 0
        for bound, w, t in live:
            if rest < floor - SLACK:
                break
            a, b = self.starts[t], self.starts[t + 1]
            doc = self.doc[a:b]
            score[doc] += w * self.part[a:b]
            touched.append(doc)
            rest -= bound
            n += 1
            if rest and b - a >= k:  # documents of this term alone already give a floor
                floor = max(floor, float(np.partition(score[doc], len(doc) - k)[len(doc) - k]))
        if not touched:
            return np.empty(0, np.int64), np.empty(0)
        running = np.unique(np.concatenate(touched)) if len(touched) > 1 else touched[0]
        for bound, w, t in live[n:]:
            running = running[score[running] + rest >= floor - SLACK]
            a, b = self.starts[t], self.starts[t + 1]
            at = np.searchsorted(self.doc[a:b], running)
            at[at == b - a] = 0
            there = self.doc[a:b][at] == running
            score[running[there]] += w * self.part[a + at[there]]
            rest -= bound
            if len(running) >= k:
                floor = max(floor, float(np.partition(score[running], len(running) - k)[len(running) - k]))
        running = running[score[running] >= floor - SLACK]
        found = score[running]
        for doc in touched:
            score[doc] = 0.0
        return running, found


def _keep(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best by 9 digits, ties to the smaller id."""
    order = np.lexsort((ids, -np.round(scores, 9)))[:k]
    return ids[order], scores[order]


def _search(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def take(ids: list[int], texts: list[list[str]]) -> None:
            own = Segment(ids, texts, asked)
            for n, terms in enumerate(asked.terms):
                before = held.get(n)
                floor = float(before[1][-1]) if before is not None and len(before[0]) == k else 0.0
                at, scores = own.best(terms, k, floor)
                if len(at):
                    found, scores = own.ids[at], scores
                    if before is not None:
                        found, scores = np.concatenate([before[0], found]), np.concatenate([before[1], scores])
                    held[n] = _keep(found, scores, k)

        ids: list[int] = []
        texts: list[list[str]] = []
        size = 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(simple_tokens(text))
                size += len(texts[-1]) + 1
                if size >= SEGMENT:
                    take(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            take(ids, texts)
        count = [len(v[0]) for v in held.values()]
        qids = np.repeat(asked.qids[[*held]] if held else asked.qids[:0], count)
        found, scores = ((np.concatenate(x) for x in zip(*held.values(), strict=True)) if held else (np.empty(0, np.int64), np.empty(0)))
        yield pa.RecordBatch.from_arrays([pa.array(qids), pa.array(found), pa.array(scores)], names=["qid", "id", "score"])

    return run


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, hit_rank) by score to 9 digits, ties to the smaller id; Spark prunes each partition first."""
    order = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "id")
    return scored.withColumn("hit_rank", F.row_number().over(order)).where(F.col("hit_rank") <= k).select("qid", "id", "score", "hit_rank")
