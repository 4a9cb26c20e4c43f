"""Fusion of a dense and a sparse ranking: (qid, id, score, hit_rank) each, best first."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternspark.functions.text import NO_EVIDENCE_ID
from lanternspark.operators.sparse import top_k

MODES = ("dense", "sparse", "hybrid")
KINDS = ("dense_primary", "rrf", "weighted")


@dataclass(frozen=True)
class HybridConfig:
    """Defaults of the hybrid mode. ``min_sparse_signal`` is kept for the record; nothing reads it."""

    fusion: str = "dense_primary"
    dense_weight: float = 0.55
    sparse_weight: float = 0.45
    sparse_boost: float = 0.08
    rrf_k: int = 60
    pool: int = 32
    min_sparse_signal: float = 1.0
    strong_sparse_inject: float = 2.5
    inject_share: float = 0.85


def parse_mode(name: str) -> str:
    if name not in MODES:
        raise ValueError(f"retrieve mode {name!r} is none of {', '.join(MODES)}")
    return name


def min_max(value: Column, partition: str = "qid") -> Column:
    """(x - lo) / span within the query; 0 everywhere if the span is nothing."""
    w = Window.partitionBy(partition)
    lo, span = F.min(value).over(w), F.max(value).over(w) - F.min(value).over(w)
    return F.when(span <= 1e-12, 0.0).otherwise((value - lo) / span)


def rrf(dense: DataFrame, sparse: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """Sum of 1 / (rrf_k + rank) over both lists, added up before the shuffle."""
    parts = [d.select("qid", "id", (1.0 / (F.lit(rrf_k) + F.col("hit_rank"))).alias("s")) for d in (dense, sparse)]
    return top_k(parts[0].unionAll(parts[1]).groupBy("qid", "id").agg(F.sum("s").alias("score")), k)


def _both(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    one = dense.select("qid", "id", F.col("score").alias("d"), F.lit(True).alias("in_dense"))
    two = sparse.select("qid", "id", F.col("score").alias("s"), F.lit(True).alias("in_sparse"))
    return one.join(two, ["qid", "id"], "full_outer")


def weighted(dense: DataFrame, sparse: DataFrame, k: int, config: HybridConfig = HybridConfig()) -> DataFrame:
    """Weighted sum of both scores, missing ones 0, each scaled to 0..1 within its query."""
    rows = _both(dense, sparse).select("qid", "id", F.coalesce("d", F.lit(0.0)).alias("d"), F.coalesce("s", F.lit(0.0)).alias("s"))
    score = config.dense_weight * min_max(F.col("d")) + config.sparse_weight * min_max(F.col("s"))
    return top_k(rows.select("qid", "id", score.alias("score")), k)


def dense_primary(dense: DataFrame, sparse: DataFrame, k: int, config: HybridConfig = HybridConfig()) -> DataFrame:
    """Dense hits with a boost where BM25 is strong; strong hits that dense lacks come in below its best.

    A dense hit without a sparse one has no boost. The sentinel is never boosted.
    """
    strong = (F.coalesce("s", F.lit(0.0)) >= config.strong_sparse_inject) & (F.col("id") != NO_EVIDENCE_ID)
    boost = config.sparse_boost * F.coalesce("s", F.lit(0.0))
    rows = _both(dense, sparse).withColumn("top", F.coalesce(F.max("d").over(Window.partitionBy("qid")), F.lit(0.0)))
    score = F.when(F.col("in_dense"), F.col("d") + F.when(strong, boost).otherwise(0.0))
    score = score.when(F.coalesce("s", F.lit(0.0)) >= config.strong_sparse_inject, F.greatest(config.inject_share * F.col("top"), boost))
    return top_k(rows.select("qid", "id", score.alias("score")).where("score is not null"), k)


def fuse(dense: DataFrame, sparse: DataFrame, max_sparse: DataFrame, k: int, mode: str = "hybrid", config: HybridConfig = HybridConfig()) -> DataFrame:
    """The ranking of a mode. Hybrid queries whose best BM25 score (qid, max_score) is weak stay dense."""
    if parse_mode(mode) != "hybrid":
        return top_k(dense if mode == "dense" else sparse, k)
    strong = max_sparse.where(F.col("max_score") >= config.strong_sparse_inject).select("qid")
    strong = strong.join(sparse.select("qid").distinct(), "qid", "left_semi")
    own_d, own_s = dense.join(strong, "qid", "left_semi"), sparse.join(strong, "qid", "left_semi")
    if config.fusion == "rrf":
        fused = rrf(own_d, own_s, k, config.rrf_k)
    else:
        fused = {"dense_primary": dense_primary, "weighted": weighted}[config.fusion](own_d, own_s, k, config)
    return fused.unionByName(top_k(dense.join(strong, "qid", "left_anti"), k))


def rescore_by_cosine(fused: DataFrame, cosines: DataFrame) -> DataFrame:
    """Fusion settles who is in the list; its order is by cosine (qid, id, cosine), ties to the smaller id."""
    rows = fused.select("qid", "id").join(cosines, ["qid", "id"], "left").select("qid", "id", F.coalesce("cosine", F.lit(0.0)).alias("score"))
    return top_k(rows, 1 << 30)
