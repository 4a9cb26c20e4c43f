"""The registered queries of the problems tagged llm: (spark, sf_dir) -> DataFrame, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternspark.llm import copies, leaks, mojibake, splitting, tokens
from lanternspark.llm.near_duplicates import NearDuplicates
from lanternspark.llm.overlap import SplitOverlap
from lanternspark.session import ship, table


def _near(spark: SparkSession, d: str) -> NearDuplicates:
    return NearDuplicates(table(spark, d, "chunks"), shingle=3, threshold=0.6)


def _overlap(spark: SparkSession, d: str) -> SplitOverlap:
    return SplitOverlap(table(spark, d, "labeled"), table(spark, d, "train_pairs"), "qid", "pair_id", "query", 0.7)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).pairs()


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).groups()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlap(spark, d).pairs().select(F.col("eval_id").alias("qid"), F.col("train_id").alias("pair_id"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Per split and source of labeled: pairs found, records concerned, and all records."""
    counts = _overlap(spark, d).counts().withColumnRenamed("eval_id", "qid")
    rows = table(spark, d, "labeled").select("qid", "split_name", "source").join(counts, "qid", "left")
    return rows.groupBy("split_name", "source").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"), F.count("n").alias("n_overlapping"), F.count("*").alias("n_records"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_pieces(spark, d).where("n_pieces > 1").select("id").distinct()


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(table(spark, d, "chunks"), table(spark, d, "chunker_config"))


def _copies(spark: SparkSession, d: str) -> dict[str, copies.HiddenCopies]:
    return {t: copies.HiddenCopies(table(spark, d, t), i, "query") for t, i in (("train_pairs", "pair_id"), ("labeled", "qid"))}


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    one, two = (h.copies().select(F.lit(t).alias("tbl"), "keep_id", "copy_id") for t, h in _copies(spark, d).items())
    return one.unionByName(two)


def p5_collapsed(spark: SparkSession, d: str) -> DataFrame:
    one, two = (h.collapsed().select(F.lit(t).alias("tbl"), "keep_id", "text", "n_copies") for t, h in _copies(spark, d).items())
    return one.unionByName(two)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(table(spark, d, "documents"))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The text that the ids of every document decode to."""
    return tokens.texts(tokens.token_ids(table(spark, d, "documents")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_passages"))


def p7_documents(spark: SparkSession, d: str) -> DataFrame:
    """Per document the items that leaked into it; at most as many as there are items."""
    return p7_found(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled(table(spark, d, "documents")).select("doc_id")


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled(table(spark, d, "documents"))


ALL = (p1_found, p1_groups, p2_found, p2_report, p3_found, p3_pieces, p5_found, p5_collapsed, p6_ids, p6_round_trip, p7_found, p7_documents, p8_found, p8_restored)


def queries() -> dict:
    return {f.__name__: lambda spark, d, f=f: f(ship(spark), d) for f in ALL}
