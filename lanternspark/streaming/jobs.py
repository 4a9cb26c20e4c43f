"""Streams, an addition of this engine: chunks that arrive are embedded and appended, questions answered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lanternspark.operators.embedders import Embedder, embed
from lanternspark.service.rag import RagService


def ingest(stream: DataFrame, embedder: Embedder, path: str, checkpoint: str, late: str = "7 days") -> StreamingQuery:
    """Appends (id, source, text) and (id, vec) of new chunks to the tables under ``path``.

    ``stream`` has (id, source, text, added_at). A row delivered again within ``late`` is dropped; null ids
    are dropped. Batch numbers are kept as a partition, so a batch that is run again replaces itself.
    """
    rows = stream.where("id is not null").withWatermark("added_at", late).dropDuplicatesWithinWatermark(["id"])

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.select("id", "source", "text").persist()
        batch.write.mode("overwrite").parquet(f"{path}/chunks/batch={number}")
        embed(batch, embedder, "id", "text").write.mode("overwrite").parquet(f"{path}/vectors/batch={number}")
        batch.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def answer(stream: DataFrame, service: RagService, path: str, checkpoint: str) -> StreamingQuery:
    """Answers a stream of (qid, body) requests into (qid, status, body) rows under ``path``."""

    def write(batch: DataFrame, number: int) -> None:
        service.answer_requests(batch.select("qid", "body")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def hit_counts(stream: DataFrame, window: str = "1 hour", late: str = "2 days") -> DataFrame:
    """(start, retrieve_mode, n_hits, n_refusable) per window of ``asked_at``: hits, and those of the sentinel.

    ``stream`` has the columns of a log of hits. Rows later than ``late`` are dropped by the watermark.
    """
    rows = stream.withWatermark("asked_at", late).groupBy(F.window("asked_at", window), "retrieve_mode")
    rows = rows.agg(F.count("*").alias("n_hits"), F.count_if(F.col("id") == -1).alias("n_refusable"))
    return rows.select(F.col("window.start").alias("start"), "retrieve_mode", "n_hits", "n_refusable")
