"""Tab-separated chunk stores, pairs and query lists: UTF-8 lines, empty lines and # comments skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternspark.functions.constants import NO_EVIDENCE_ID
from lanternspark.functions.text import is_sentinel_row, normalize_query

#: Digits that a number field begins with; what follows them is ignored.
_LEADING = r"^[ \t\n\r\f\x0b]*([+-]?[0-9]+)"

#: Files of the demo set under its root.
DEMO = {
    "chunks": "chunks.tsv",
    "train_pairs": "train_pairs.tsv",
    "easy": "eval/retrieval.tsv",
    "hard": "eval/retrieval_hard.tsv",
    "refuse": "eval/refuse.tsv",
}


def demo_paths(root: str) -> dict[str, str]:
    return {k: f"{root}/{v}" for k, v in DEMO.items()}


def _is_record() -> Column:
    return (F.col("value") != "") & ~F.startswith("value", F.lit("#"))


def _fail(message: Column) -> Column:
    """An error, but for lines that are no records: conditions of a plan may be evaluated before they are left out."""
    return F.when(_is_record(), F.raise_error(message))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, value): the records of a text file; ``ord`` rises in the order of its lines."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.withColumn("ord", F.monotonically_increasing_id()).where(_is_record())


def number(field: Column) -> Column:
    """The integer a field begins with; an error without one."""
    found = F.regexp_extract(field, _LEADING, 1)
    return F.when(found != "", found.try_cast("bigint")).otherwise(_fail(F.concat(F.lit("no number in: "), F.col("value"))))


def _require(rows: DataFrame, what: str) -> DataFrame:
    if rows.isEmpty():
        raise ValueError(f"no {what}")
    return rows


def load_chunks(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """(id, source, text, ord), split at the first two tabs only."""
    rows = lines(spark, path)
    tabs = F.length("value") - F.length(F.replace("value", F.lit("\t"), F.lit("")))
    good = F.when(tabs >= 2, F.col("value")).otherwise(_fail(F.concat(F.lit("fewer than two tabs: "), F.col("value"))))
    parts = F.split(good, "\t", 3)
    out = rows.select(number(F.get(parts, F.lit(0))).alias("id"), F.get(parts, F.lit(1)).alias("source"), F.get(parts, F.lit(2)).alias("text"), "ord")
    return validate_store(out) if check else out


def validate_store(chunks: DataFrame) -> DataFrame:
    """The same rows, after one job has found ids unique and negative ones to be the sentinel only."""
    bad = chunks.groupBy("id").agg(F.count("*").alias("n"), F.min(is_sentinel_row(F.col("id"), F.col("source"), F.col("text"))).alias("s"))
    first = bad.where("n > 1 or (id < 0 and not s)").head()
    if first is not None:
        raise ValueError(f"duplicate chunk id {first.id}" if first.n > 1 else f"chunk id {first.id} is reserved")
    return chunks


def save_chunks(chunks: DataFrame, path: str, order: str = "ord") -> None:
    """Rows in their order as text part files; tabs and line breaks in a field are an error.

    ``path`` is a folder that a text scan reads back; range-sorted parts keep the order without one task.
    """
    def plain(c: str) -> Column:
        return F.when(F.rlike(F.col(c), F.lit(r"[\t\n\r]")), F.raise_error(F.lit(f"{c} holds a tab or a line break"))).otherwise(F.coalesce(F.col(c), F.lit("")))

    # a text line can't begin with # or be empty, so ids lead
    rows = chunks.orderBy(order) if order in chunks.columns else chunks.orderBy("id")
    text = F.when(F.rlike("text", F.lit(r"[\n\r]")), F.raise_error(F.lit("text holds a line break"))).otherwise(F.coalesce("text", F.lit("")))
    rows.select(F.concat_ws("\t", F.col("id").cast("string"), plain("source"), text).alias("value")).write.mode("overwrite").text(path)


def _pairs(spark: SparkSession, path: str, column: str) -> DataFrame:
    parts = F.split("value", "\t")
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    good = F.when((F.size(parts) >= 2) & (first != ""), first).otherwise(_fail(F.concat(F.lit("no query and id in: "), F.col("value"))))
    return lines(spark, path).select(good.alias("query"), number(second).alias(column), "ord")


def load_train_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(query, pos_id, ord); empty queries and an empty file are errors."""
    return _require(_pairs(spark, path, "pos_id"), "training pairs")


def load_labeled(spark: SparkSession, path: str, allow_empty: bool = False) -> DataFrame:
    """(qid, query, gold_id); the sentinel can't be the gold chunk."""
    rows = _pairs(spark, path, "gold_id")
    gold = F.when(F.col("gold_id") == NO_EVIDENCE_ID, F.raise_error(F.lit("a labeled query points to the sentinel"))).otherwise(F.col("gold_id"))
    rows = rows.select(F.col("ord").alias("qid"), "query", gold.alias("gold_id"))
    return rows if allow_empty else _require(rows, "labeled queries")


def load_refuse(spark: SparkSession, path: str) -> DataFrame:
    """(qid, query): one query a line."""
    return lines(spark, path).select(F.col("ord").alias("qid"), F.col("value").alias("query"))


def train_query_set(pairs: DataFrame) -> DataFrame:
    """(query): the distinct normalised training queries."""
    return pairs.select(normalize_query(F.col("query")).alias("query")).distinct()
