"""The evaluation suite: integrity, retrieval by mode, refusals, grounding and ablations, as one report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternspark.functions.constants import DONT_KNOW
from lanternspark.functions.similarity import token_jaccard
from lanternspark.operators import evaluation as ev
from lanternspark.operators.embedders import HashingEmbedder
from lanternspark.operators.grounding import HIT, GroundingConfig, validate
from lanternspark.operators.training import ContrastiveConfig, Word2VecConfig
from lanternspark.plans.retriever import Retriever
from lanternspark.sources import tsv

#: Hits fetched for evaluation beyond the ranks that count.
EXTRA = 4
#: How the word vectors of the ablation are trained.
ABLATION = Word2VecConfig(epochs=80, doc_repeat=12, seed=42)


def eval_mode(retriever: Retriever, labeled: DataFrame, mode: str, k: int = 5) -> dict[str, float]:
    before, retriever.mode = retriever.mode, mode
    try:
        hits = retriever.retrieve(labeled.select("qid", "query"), k + EXTRA)
        row = ev.retrieval_metrics(ev.gold_ranks(labeled, hits, k)).first()
    finally:
        retriever.mode = before
    return {n: float(row[n]) for n in ("recall_1", "recall_3", "recall_5", "mrr")} if row else {}


def run(spark: SparkSession, chunks: DataFrame, pairs: DataFrame, easy: DataFrame, hard: DataFrame, refuse: DataFrame, ablations: bool = True, config: ContrastiveConfig = ContrastiveConfig()) -> dict[str, float]:
    """Raises if evaluation queries are training queries or a hard one leaks; else the report."""
    for rows in (easy, hard, refuse):
        ev.assert_disjoint(rows, pairs)
    ev.assert_disjoint(hard, easy)
    leak = ev.hard_leaks(hard, pairs, chunks).head()
    if leak is not None:
        raise ValueError(f"hard query {leak.qid} leaks by {leak.rule} ({leak.value:.3f})")
    own = Retriever.build_contrastive(spark, chunks, pairs, config)
    report: dict[str, float] = {}
    for name, rows in (("easy", easy), ("hard", hard)):
        for mode in ("hybrid", "dense", "sparse"):
            prefix = name if mode == "hybrid" else f"{mode}_{name}"
            report |= {f"{prefix}_{k}": v for k, v in eval_mode(own, rows, mode).items()}
    refused = ev.refusal_metrics(own.ask(refuse)).first()
    grounded = ev.grounding_metrics(own.ask(easy), easy).first()
    report |= {"refuse_pass": refused.pass_rate, "grounding_pass": grounded.full_pass_rate, "answer_rate": grounded.answer_rate}
    if ablations:
        hashing, words = Retriever.build(spark, chunks, HashingEmbedder(config.dim)), Retriever.build_word2vec(spark, chunks, ABLATION)
        for name, other, mode in (("hashing", hashing, "hybrid"), ("hashing_dense", hashing, "dense"), ("word2vec", words, "hybrid")):
            for set_name, rows in (("easy", easy), ("hard", hard)):
                report |= {f"{name}_{set_name}_{k}": v for k, v in eval_mode(other, rows, mode).items()}
    return report


def run_folder(spark: SparkSession, root: str, ablations: bool = True) -> dict[str, float]:
    p = tsv.demo_paths(root)
    return run(spark, tsv.load_chunks(spark, p["chunks"]), tsv.load_train_pairs(spark, p["train_pairs"]), tsv.load_labeled(spark, p["easy"]), tsv.load_labeled(spark, p["hard"]), tsv.load_refuse(spark, p["refuse"]), ablations)


def paraphrase(retriever: Retriever, labeled: DataFrame, max_jaccard: float = 0.30) -> dict[str, float]:
    """Share of paraphrased queries whose first real hit is the gold chunk; too similar ones are an error."""
    own = retriever.chunks.select(F.col("id").alias("gold_id"), F.col("text").alias("_t"))
    worst = labeled.join(own, "gold_id").select("qid", token_jaccard(F.col("query"), F.col("_t")).alias("j")).where(F.col("j") > max_jaccard).head()
    if worst is not None:
        raise ValueError(f"query {worst.qid} is too close to its gold passage ({worst.j:.3f})")
    rows = labeled.join(retriever.top_real_id(labeled), "qid")
    n, good = rows.agg(F.count("*"), F.count_if(F.col("id") == F.col("gold_id"))).first()
    return {"n": n, "recall_1": good / n if n else 0.0}


def validator_negatives(spark: SparkSession) -> list[str]:
    """Said of one passage, and of none: what the validator judges wrongly."""
    passage = "Swifts sleep on the wing and land only to breed."
    cases = [
        (True, "Swifts eat granite [#99]", False), (True, passage, False), (True, f"{passage} [#7]", True), (True, "Granite erodes in acid baths [#7]", False),
        (False, DONT_KNOW, True), (False, "Swifts eat granite.", False), (False, f"{DONT_KNOW} [#7]", False),
    ]
    hit = F.struct(F.lit(7).cast("bigint").alias("id"), F.lit(0.9).alias("score"), F.lit("t").alias("source"), F.lit(passage).alias("text"), F.lit(True).alias("score_is_cosine"))
    rows = spark.createDataFrame(cases, "given boolean, said string, want boolean")
    used = F.when(F.col("given"), F.array(hit)).otherwise(F.array().cast(f"array<{HIT}>"))
    got = rows.withColumn("used", used).select("said", "want", validate(F.col("said"), F.col("used"))["ok"].alias("ok"))
    return [r.said for r in got.where("ok != want").collect()]


def grounding(retriever: Retriever, labeled: DataFrame, out_of_scope: DataFrame, c: GroundingConfig = GroundingConfig()) -> dict[str, float]:
    """Rates, and how many cases of each kind failed: in the domain, out of it or blank, and the validator's."""
    inside = ev.grounding_metrics(retriever.ask(labeled, c=c), labeled).first()
    outside = ev.refusal_metrics(retriever.ask(out_of_scope, c=c)).first()
    return {
        "answer_rate": inside.answer_rate, "full_pass_rate": inside.full_pass_rate, "refuse_pass": outside.pass_rate,
        "failed_in_domain": inside.n - round(inside.n * inside.full_pass_rate), "failed_out_of_scope": outside.n_failed,
        "failed_validator": len(validator_negatives(retriever.spark)),
    }
