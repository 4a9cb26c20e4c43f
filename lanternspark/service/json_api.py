"""Requests and answers as JSON columns."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternspark.functions.constants import MISSING_SOURCE
from lanternspark.functions.text import let

MAX_K = 1000


def number(value: float) -> str:
    """Fixed with 6 decimals, trailing zeros cut."""
    text = f"{value:.6f}".rstrip("0").rstrip(".")
    return "0" if text in ("-0", "") else text


def parse_ask(body: Column, default_k: int = 5) -> Column:
    """struct(query, k, error) of a request. The query, a string, is required; k, a number, is in 1..1000, a
    fraction is cut off; other members are skipped unless they are objects or arrays. Malformed bodies,
    repeated members among them, are errors. Values are told apart by their JSON type, never by their look."""
    parsed = F.try_parse_json(body)
    is_object = F.coalesce(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), F.lit(False))

    def read(members: Column) -> Column:
        kind = lambda name: F.schema_of_variant(F.try_element_at(members, F.lit(name)))
        nested = F.exists(F.map_values(members), lambda v: F.rlike(F.schema_of_variant(v), F.lit("^(OBJECT|ARRAY)")))
        query = F.when(kind("query") == "STRING", F.try_element_at(members, F.lit("query")).cast("string"))
        given = F.map_contains_key(members, "k")
        number = F.rlike(kind("k"), F.lit("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"))
        k = F.when(given & number, F.try_element_at(members, F.lit("k")).cast("double")).when(~given, float(default_k))
        error = (
            F.when(query.isNull(), "query is required")
            .when(k.isNull() | (k < 1) | (k >= MAX_K + 1), f"k must be between 1 and {MAX_K}")
            .when(nested, "nested values are not supported")
        )
        return F.struct(query.alias("query"), k.cast("int").alias("k"), error.alias("error"))

    broken = F.struct(F.lit(None).cast("string").alias("query"), F.lit(None).cast("int").alias("k"), F.lit("malformed JSON object").alias("error"))
    return F.when(is_object, let(parsed.cast("map<string,variant>"), read)).otherwise(broken)


def chunk_json(hit: Column) -> Column:
    return F.struct(hit["id"].alias("id"), F.round(hit["score"], 6).alias("score"), hit["source"].alias("source"), hit["text"].alias("text"))


def answer_json(answered: DataFrame, k: int | None = None, by: str | None = None) -> DataFrame:
    """(qid, body): an answer as JSON. Cited ids are resolved among used chunks, then candidates, else as a
    stub; an answer that cites nothing cites what it used."""
    cands = F.col("candidates") if k is None else F.slice("candidates", 1, k)
    pool = F.concat("used", "candidates")

    def resolve(i: Column) -> Column:
        own = F.filter(pool, lambda h: h["id"] == i)
        stub = F.struct(i.alias("id"), F.lit(0.0).alias("score"), F.lit(MISSING_SOURCE).alias("source"), F.lit("").alias("text"))
        return F.when(F.size(own) > 0, chunk_json(F.try_element_at(own, F.lit(1)))).otherwise(stub)

    cited = F.when(F.size("check.cited_ids") > 0, F.transform("check.cited_ids", resolve)).otherwise(F.transform("used", chunk_json))
    check = F.struct(F.col("check.ok").alias("ok"), F.col("check.refused").alias("refused"), F.col("check.reason").alias("reason"), F.col("check.illegal_ids").alias("illegal_ids"), F.round("check.content_support", 6).alias("content_support"))
    body = F.struct("query", "refused", "mode", "answer", check.alias("grounding"), cited.alias("citations"), F.transform(cands, chunk_json).alias("candidates"))
    return answered.select("qid", *([by] if by else ()), F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))


def error_json(status: int, message: str) -> str:
    return json.dumps({"error": {"status": status, "message": message}}, ensure_ascii=False)
