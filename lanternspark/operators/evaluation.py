"""Retrieval, refusal and grounding metrics, and checks that evaluation data doesn't leak."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternspark.functions.constants import NO_EVIDENCE_ID
from lanternspark.functions.similarity import keyword_overlap, ngram_coverage
from lanternspark.functions.text import content_tokens, is_dont_know, normalize_query
from lanternspark.operators.closest import closest


def overlapping(evals: DataFrame, train: DataFrame, column: str = "query") -> DataFrame:
    """The evaluation rows whose normalised query is also a training query; it should be empty."""
    known = train.select(normalize_query(F.col(column)).alias("_k")).where("_k != ''").distinct()
    return evals.withColumn("_k", normalize_query(F.col(column))).join(known, "_k", "left_semi").drop("_k")


def assert_disjoint(evals: DataFrame, train: DataFrame, column: str = "query") -> None:
    first = overlapping(evals, train, column).select(column).head()
    if first is not None:
        raise ValueError(f"an evaluation query is also a training query: {first[0]!r}")


def gold_overlap(labeled: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, shared): the content tokens that a query shares with its gold passage, if any."""
    own = chunks.select(F.col("id").alias("gold_id"), F.col("text").alias("_t"))
    return labeled.join(own, "gold_id").select("qid", keyword_overlap(F.col("query"), F.col("_t")).alias("shared")).where(F.size("shared") > 0)


def assert_zero_keyword_overlap(labeled: DataFrame, chunks: DataFrame) -> None:
    first = gold_overlap(labeled, chunks).head()
    if first is not None:
        raise ValueError(f"query {first.qid} shares {list(first.shared)} with its gold passage")


@dataclass(frozen=True)
class LeakLimits:
    """Similarities from which a hard query counts as leaked (n-gram coverage: beyond which)."""

    sequence: float = 0.50
    jaccard: float = 0.25
    ngram: float = 0.15
    token_bytes: int = 4


def hard_leaks(hard: DataFrame, train: DataFrame, chunks: DataFrame, limits: LeakLimits = LeakLimits()) -> DataFrame:
    """(qid, rule, value) of every integrity rule that a hard query breaks.

    Of similarities to training queries only the highest counts, so no pairs are listed (see ``closest``).
    If neither query has any content token both similarities are 1, which the existence of such a training
    query settles.
    """
    gold = chunks.select(F.col("id").alias("gold_id"), F.col("text").alias("_t"))
    own = hard.select("qid", "query", "gold_id", content_tokens(F.col("query")).alias("q"))
    with_gold = own.join(gold, "gold_id")
    shared = with_gold.select("qid", F.size(keyword_overlap(F.col("query"), F.col("_t"))).cast("double").alias("value")).where("value > 0")
    covered = with_gold.select("qid", ngram_coverage(F.col("query"), F.col("_t")).alias("value")).where(F.col("value") > limits.ngram)

    every = train.select(F.col("query").alias("tq"), F.col("pos_id"), content_tokens(F.col("query")).alias("t"))
    wordless = every.where(F.size("t") == 0).limit(1).select(F.lit(1.0).alias("s"), F.lit(1.0).alias("j"))
    alike = own.where(F.size("q") == 0).select("qid").crossJoin(F.broadcast(wordless))
    other = every.where(F.size("t") > 0)
    worst = closest(own, other, limits.sequence, limits.jaccard).unionByName(alike).groupBy("qid").agg(F.max("s").alias("s"), F.max("j").alias("j"))
    long_ = lambda c: F.explode(F.filter(F.array_distinct(c), lambda x: F.octet_length(x) >= limits.token_bytes)).alias("w")
    same = own.select("qid", "gold_id", long_("q")).join(other.select(F.col("pos_id").alias("gold_id"), long_("t")).distinct(), ["gold_id", "w"])
    same = same.groupBy("qid").agg(F.countDistinct("w").cast("double").alias("value"))
    rules = [
        shared.withColumn("rule", F.lit("gold_overlap")),
        covered.withColumn("rule", F.lit("ngram_coverage")),
        worst.where(F.col("s") >= limits.sequence).select("qid", F.col("s").alias("value"), F.lit("sequence").alias("rule")),
        worst.where(F.col("j") >= limits.jaccard).select("qid", F.col("j").alias("value"), F.lit("jaccard").alias("rule")),
        same.withColumn("rule", F.lit("same_gold_tokens")),
    ]
    out = rules[0].select("qid", "rule", "value")
    for r in rules[1:]:
        out = out.unionByName(r.select("qid", "rule", "value"))
    return out


def ranked_real(hits: DataFrame, k: int, *by: str) -> DataFrame:
    """Hits without the sentinel, ranked anew for each query and value of ``by``, the first k."""
    order = Window.partitionBy("qid", *by).orderBy("hit_rank", "id")
    return hits.where(F.col("id") != NO_EVIDENCE_ID).withColumn("hit_rank", F.row_number().over(order)).where(F.col("hit_rank") <= k)


def gold_ranks(labeled: DataFrame, hits: DataFrame, k: int = 5) -> DataFrame:
    """(qid, gold_rank): the rank of each query's gold chunk among its real hits, null if it isn't there."""
    found = ranked_real(hits, k).select("qid", F.col("id").alias("gold_id"), "hit_rank").groupBy("qid", "gold_id").agg(F.min("hit_rank").alias("gold_rank"))
    return labeled.select("qid", "gold_id").join(found, ["qid", "gold_id"], "left").select("qid", "gold_rank")


def retrieval_metrics(ranks: DataFrame, *by: str) -> DataFrame:
    """n, recall at 1, 3 and 5 and mean reciprocal rank (0 beyond the ranks given)."""
    at = lambda k: F.avg(F.coalesce((F.col("gold_rank") <= k).cast("double"), F.lit(0.0))).alias(f"recall_{k}")
    return ranks.groupBy(*by).agg(F.count("*").alias("n"), at(1), at(3), at(5), F.avg(F.coalesce(1.0 / F.col("gold_rank"), F.lit(0.0))).alias("mrr"))


def refusal_metrics(answered: DataFrame) -> DataFrame:
    """Over answers to questions without an answer: rates of refusals, of empty contexts and of both."""
    idk, empty = is_dont_know(F.col("answer")), F.size("used") == 0
    rate = lambda c, name: F.coalesce(F.avg(c.cast("double")), F.lit(0.0)).alias(name)
    return answered.agg(F.count("*").alias("n"), rate(idk, "idk_rate"), rate(empty, "empty_used_rate"), rate(idk & empty, "pass_rate"), F.count_if(~(idk & empty)).alias("n_failed"))


def grounding_metrics(answered: DataFrame, labeled: DataFrame, *by: str) -> DataFrame:
    """Answer and full-pass rates over all queries; validity, gold citations and illegal ones over answers."""
    rows = answered.join(labeled.select("qid", "gold_id"), "qid")
    given = ~F.col("refused")
    ok = F.col("check.ok")
    cites_gold = F.array_contains("check.cited_ids", F.col("gold_id"))
    illegal = F.size("check.illegal_ids") > 0
    over = lambda c, name: F.coalesce(F.avg(F.when(given, c.cast("double"))), F.lit(0.0)).alias(name)
    full = given & ok & F.coalesce(cites_gold, F.lit(False)) & ~illegal
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.coalesce(F.avg(given.cast("double")), F.lit(0.0)).alias("answer_rate"),
        over(ok, "validator_ok_rate"),
        over(cites_gold, "gold_cited_rate"),
        over(illegal, "illegal_rate"),
        F.coalesce(F.avg(full.cast("double")), F.lit(0.0)).alias("full_pass_rate"),
    )


@dataclass(frozen=True)
class QualityGates:
    easy_recall_1: float = 0.85
    easy_mrr: float = 0.88
    hard_recall_1: float = 0.0
    hard_mrr: float = 0.0
    refuse_pass: float = 0.90
    grounding_pass: float = 0.85


def check_gates(report: dict[str, float], gates: QualityGates = QualityGates()) -> list[str]:
    """What fails: the floors, and that training beats hashing (easy) and hybrid doesn't lose to dense (hard)."""
    out = [f"{k}: {report.get(k, 0.0):.3f} is under {v:.3f}" for k, v in asdict(gates).items() if report.get(k, 0.0) + 1e-9 < v]
    if report.get("hashing_easy_recall_1", -1.0) > report.get("easy_recall_1", 0.0) + 1e-9:
        out.append("easy_recall_1 is under that of hashing")
    if report.get("dense_hard_recall_1", -1.0) > report.get("hard_recall_1", 0.0) + 1e-9:
        out.append("hard_recall_1 is under that of dense retrieval alone")
    return out


def format_report(report: dict[str, float]) -> str:
    width = max(map(len, report), default=0)
    return "\n".join(f"{k:<{width}}  {v:.3f}" for k, v in report.items())
