"""The whole way from chunks to grounded answers, for a DataFrame of queries at a time."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternspark.functions.constants import NO_EVIDENCE_ID, NO_EVIDENCE_SOURCE, NO_EVIDENCE_TEXT
from lanternspark.functions.text import is_blank
from lanternspark.operators import dense, fusion, grounding
from lanternspark.operators.chunking import number
from lanternspark.operators.embedders import Embedder, HashingEmbedder, embed
from lanternspark.operators.fusion import HybridConfig
from lanternspark.operators.grounding import GroundingConfig
from lanternspark.operators.sparse import Bm25, store, top_k
from lanternspark.operators.training import (
    MAX_CHUNKS,
    MAX_PAIRS,
    ContrastiveConfig,
    Word2VecConfig,
    out_of_scope_pairs,
    train_contrastive,
    train_word2vec,
    with_sentinel,
)
from lanternspark.session import cut
from lanternspark.sources import index

#: Hits fetched beyond k, so that the sentinel and blanks leave enough.
FETCH = 9


def sentinel_row(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(NO_EVIDENCE_ID, NO_EVIDENCE_SOURCE, NO_EVIDENCE_TEXT)], "id bigint, source string, text string")


def sampled(rows: DataFrame, most: int, *key: str) -> DataFrame:
    """All rows if they are few enough, else the ``most`` with the least hashes of ``key``: a fitting sample."""
    return rows.orderBy(F.xxhash64(*key), *key).limit(most)


@dataclass
class Retriever:
    spark: SparkSession
    chunks: DataFrame
    vectors: DataFrame
    embedder: Embedder
    mode: str = "hybrid"
    config: HybridConfig = field(default_factory=HybridConfig)

    def __post_init__(self) -> None:
        self.set_mode(self.mode)
        self.bm25 = Bm25.build(self.chunks)

    def set_mode(self, mode: str) -> None:
        self.mode = fusion.parse_mode(mode)

    def set_hybrid_config(self, config: HybridConfig) -> None:
        if config.fusion not in fusion.KINDS:
            raise ValueError(f"fusion {config.fusion!r} is none of {', '.join(fusion.KINDS)}")
        self.config = config

    @classmethod
    def build(cls, spark: SparkSession, chunks: DataFrame, embedder: Embedder | None = None, **kw) -> Retriever:
        """Every chunk is embedded once, the sentinel as well if it is there."""
        own = store(chunks)
        embedder = embedder or HashingEmbedder()
        return cls(spark, own, cut(embed(own, embedder, "id", "text")), embedder, **kw)

    @classmethod
    def build_word2vec(cls, spark: SparkSession, chunks: DataFrame, c: Word2VecConfig = Word2VecConfig(), **kw) -> Retriever:
        texts = [r.text for r in sampled(store(chunks), MAX_CHUNKS, "id").orderBy("id").collect()]
        return cls.build(spark, chunks, train_word2vec(texts, c), **kw)

    @classmethod
    def build_contrastive(cls, spark: SparkSession, chunks: DataFrame, pairs: DataFrame, c: ContrastiveConfig = ContrastiveConfig(), **kw) -> Retriever:
        """Adds the sentinel and out-of-scope questions, trains on (query, pos_id), then builds.

        Training takes at most MAX_CHUNKS chunks, those that pairs name before others, and at most MAX_PAIRS
        of the distinct pairs that name one of them, all by the least hashes.
        """
        own = store(chunks)
        known = pairs.select("query", F.col("pos_id").cast("bigint").alias("pos_id")).where(~is_blank(F.col("query")) & F.col("pos_id").isNotNull()).distinct()
        named = known.select(F.col("pos_id").alias("id"), F.lit(True).alias("named")).distinct()
        first = own.join(named, "id", "left").orderBy(F.col("id") != NO_EVIDENCE_ID, F.col("named").isNull(), F.xxhash64("id"), "id").limit(MAX_CHUNKS)
        rows = with_sentinel(sorted((r.id, r.text) for r in first.select("id", "text").collect()))
        there = spark.createDataFrame([(i,) for i, _ in rows], "pos_id bigint")
        chosen = [(r.query, r.pos_id) for r in sampled(known.join(there, "pos_id", "left_semi"), MAX_PAIRS, "query", "pos_id").orderBy("query", "pos_id").collect()]
        if own.where(F.col("id") == NO_EVIDENCE_ID).isEmpty():
            own = own.unionByName(sentinel_row(spark))
        return cls.build(spark, own, train_contrastive(rows, chosen + out_of_scope_pairs(len(chosen)), c), **kw)

    def embed_queries(self, queries: DataFrame) -> DataFrame:
        return embed(queries, self.embedder, "qid", "query", "qid")

    def search_dense(self, queries: DataFrame, k: int) -> DataFrame:
        """The sentinel is a hit like any other. Exact, so recall is 1."""
        return dense.search(self.embed_queries(queries), self.vectors, k)

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame:
        """(qid, id, score, hit_rank, score_is_cosine, source, text, passage_tokens) of the k best of every (qid, query).

        In hybrid mode fusion settles which k are in; they are then ordered by cosine alone.
        """
        queries = queries.select(F.col("qid").cast("bigint").alias("qid"), "query")
        pool = max(k, self.config.pool)
        if self.mode == "sparse":
            hits = self.bm25.search(queries, k).withColumn("score_is_cosine", F.lit(False))
        elif self.mode == "dense":
            hits = top_k(self.search_dense(queries, pool), k).withColumn("score_is_cosine", F.lit(True))
        else:
            near = cut(self.search_dense(queries, pool))
            far = cut(self.bm25.search(queries, pool))
            best = far.where("hit_rank = 1").select("qid", F.col("score").alias("max_score"))
            if self.config.fusion == "dense_primary":  # each dense hit's boost is by its own score, in the pool or not
                others = near.select("qid", "id").join(far.select("qid", "id"), ["qid", "id"], "left_anti")
                own = self.bm25.score_ids(others, queries).where("score > 0").withColumn("hit_rank", F.lit(1 << 30))
                sparse = cut(far.unionByName(own))
            else:
                sparse = far
            # lists of the pool's size a query: cheaper to keep than to compute again in each branch
            fused = cut(fusion.fuse(near, sparse, best, k, "hybrid", self.config))
            hits = fusion.rescore_by_cosine(fused, self._cosines(fused, near, queries)).withColumn("score_is_cosine", F.lit(True))
        return grounding.with_text(hits, self.chunks)

    def _cosines(self, fused: DataFrame, near: DataFrame, queries: DataFrame) -> DataFrame:
        """(qid, id, cosine): known ones from the dense pool, the others from stored vectors."""
        from lanternspark.functions.similarity import cosine

        known = near.select("qid", "id", F.col("score").alias("cosine"))
        others = fused.select("qid", "id").join(known.select("qid", "id"), ["qid", "id"], "left_anti")
        others = others.join(self.vectors, "id").join(self.embed_queries(queries).withColumnRenamed("vec", "qvec"), "qid")
        return known.unionByName(others.select("qid", "id", cosine(F.col("vec"), F.col("qvec")).alias("cosine")))

    def top_real_id(self, queries: DataFrame, k: int = 8) -> DataFrame:
        """(qid, id): the first hit but the sentinel, -1 without one."""
        real = self.retrieve(queries, k).where(F.col("id") != NO_EVIDENCE_ID).groupBy("qid").agg(F.min_by("id", "hit_rank").alias("id"))
        return queries.select("qid").join(real, "qid", "left").select("qid", F.coalesce("id", F.lit(NO_EVIDENCE_ID)).alias("id"))

    def candidates(self, queries: DataFrame, k: int, c: GroundingConfig) -> DataFrame:
        """(qid, query, candidates, used); a blank query is not retrieved for and has neither."""
        asked = queries.where(~is_blank(F.col("query")))
        return grounding.collect(grounding.gated(self.retrieve(asked, max(k, FETCH)), asked, c), queries, c)

    def ask(self, queries: DataFrame, k: int = 5, c: GroundingConfig = GroundingConfig()) -> DataFrame:
        """(qid, query, candidates, used, refused, mode, answer, check, prompt), one row per query."""
        rows = grounding.answers(self.candidates(queries, k, c), c)
        return rows.withColumn("prompt", grounding.grounded_prompt(F.col("query"), F.col("used")))

    def ask_with_model(self, queries: DataFrame, generate, k: int = 5, c: GroundingConfig = GroundingConfig()) -> DataFrame:
        """The same with a model: ``generate`` turns a list of prompts into texts, for queries that have a
        context only; texts that don't validate are replaced by the extractive answer."""
        from lanternspark.plans.prompts import generated

        return grounding.finalize(generated(self.candidates(queries, k, c), generate), c)

    def add(self, batch: DataFrame, renumber: bool = True) -> tuple[Retriever, DataFrame]:
        """A retriever with further chunks, embedded by the same embedder, and the batch's (id, source, text).

        The batch is checked as a whole, in one job, before anything is changed. Renumbered ids go on from
        the last one, in the order of the batch's rows; without renumbering they must be new.
        """
        rows = cut(batch.select(F.monotonically_increasing_id().alias("key"), F.lit(0).alias("pos"), F.col("id").cast("bigint").alias("own"), "source", "text"))
        state = rows.agg(F.count_if(is_blank(F.col("text"))).alias("blank"), F.count_if(F.col("own") < 0).alias("negative"), F.count_if(F.col("own").isNull()).alias("missing"), F.count("*").alias("n")).first()
        if state.blank:
            raise ValueError("a chunk's text is empty")
        if state.negative:
            raise ValueError("negative ids are reserved")
        if renumber:
            new = number(rows, index.next_chunk_id(self.chunks))
        else:
            if state.missing or rows.select("own").distinct().count() < state.n:
                raise ValueError("the batch has a missing or repeated id")
            new = rows.withColumn("id", F.col("own"))
        new = new.select("id", "source", "text")
        taken = new.join(self.chunks.select("id"), "id", "left_semi").head()
        if taken is not None:
            raise ValueError(f"chunk id {taken.id} is already there")
        chunks = self.chunks.select("id", "source", "text").unionByName(new)
        vectors = self.vectors.unionByName(cut(embed(new, self.embedder, "id", "text")))
        return Retriever(self.spark, chunks, vectors, self.embedder, self.mode, self.config), new

    def contains(self, *ids: int) -> bool:
        """Whether all of the ids are in the store."""
        return self.get(*ids).count() == len(set(ids))

    def get(self, *ids: int) -> DataFrame:
        """(id, source, text) of the given ids that are there; the filter reaches the store's scan."""
        return self.chunks.where(F.col("id").isin(*ids)).select("id", "source", "text")

    def sizes(self) -> dict[str, int]:
        row = self.chunks.agg(F.count("*").alias("n"), F.count_if(F.col("id") != NO_EVIDENCE_ID).alias("real")).first()
        return {"size": row.n, "real_size": row.real, "index_size": self.vectors.count()}

    def save(self, path: str) -> index.IndexMeta:
        return index.save(self.spark, path, self.chunks, self.vectors, self.embedder)

    @classmethod
    def open(cls, spark: SparkSession, path: str, **kw) -> Retriever:
        _, chunks, vectors, embedder = index.load(spark, path)
        return cls(spark, chunks, vectors, embedder, **kw)


def add_to_index(spark: SparkSession, path: str, batch: DataFrame, out: str, renumber: bool = True) -> DataFrame:
    """Open, add and save as a new version under ``out``, which must be another folder."""
    if out.rstrip("/") == path.rstrip("/"):
        raise ValueError("write the new version to another folder, then switch to it")
    bigger, new = Retriever.open(spark, path).add(batch, renumber)
    bigger.save(out)
    return new
