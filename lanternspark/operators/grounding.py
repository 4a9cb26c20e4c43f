"""Whether passages answer a question, extractive answers with citations, and their validation.

A hit is a struct<id, score, source, text, score_is_cosine>; a query's hits are one array of bounded
length (the retrieval's k), so answers are row-wise expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternspark.functions import constants as C
from lanternspark.functions.text import citation_ids, content_tokens, is_blank, is_dont_know, let, normalize_ws

HIT = "struct<id:bigint,score:double,source:string,text:string,score_is_cosine:boolean>"


@dataclass(frozen=True)
class GroundingConfig:
    min_score: float = 0.25
    min_score_without_query_support: float = 0.60
    min_query_support: float = 0.20
    min_query_support_hits: int = 1
    max_context_chunks: int = 3
    require_citations: bool = True
    min_content_support: float = 0.25


DISTINCTIVE = 5  # bytes from which a missing query token blocks the lexical way
#: Keys that the sentinel's hits, a tenth of all, are spread over when they get its text.
SENTINEL_SALTS = 64


def answerable(query_tokens: Column, hit_id: Column, score: Column, is_cosine: Column, passage_tokens: Column, c: GroundingConfig = GroundingConfig()) -> Column:
    """Whether a passage answers a query, both as content tokens. A null score counts as 0."""
    score, is_cosine = F.coalesce(score, F.lit(0.0)), F.coalesce(is_cosine, F.lit(False))
    near = is_cosine & (score >= c.min_score_without_query_support)

    def by_tokens(have: Column) -> Column:
        missing = F.exists(query_tokens, lambda t: (F.octet_length(t) >= DISTINCTIVE) & ~F.array_contains(have, t))
        hits = F.size(F.filter(query_tokens, lambda t: F.array_contains(have, t)))
        enough = (hits >= c.min_query_support_hits) & (hits >= c.min_query_support * F.size(query_tokens)) & (F.size(query_tokens) > 0)
        return F.when(missing, near).when(enough, True).otherwise(near)

    return F.when(hit_id == C.NO_EVIDENCE_ID, False).when(is_cosine & (score < c.min_score), False).otherwise(let(passage_tokens, by_tokens))


def with_text(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits (qid, id, …) with (source, text, passage_tokens) of their chunk, or the fixed placeholder.

    A chunk is tokenised once, however many hits name it; unused columns are pruned before the join. The
    sentinel, which very many hits name, stands there once for each of SENTINEL_SALTS keys.
    """
    reserved = F.coalesce(F.col("id") == C.NO_EVIDENCE_ID, F.lit(False))
    salts = F.when(reserved, F.sequence(F.lit(0), F.lit(SENTINEL_SALTS - 1))).otherwise(F.array(F.lit(0)))
    own = chunks.select("id", F.explode(salts).alias("_salt"), "source", "text", content_tokens(F.col("text")).alias("passage_tokens"), F.lit(True).alias("_there"))
    salted = hits.withColumn("_salt", F.when(reserved, F.pmod(F.hash("qid"), F.lit(SENTINEL_SALTS))).otherwise(0))
    rows = salted.join(own, ["id", "_salt"], "left").drop("_salt")
    gone = F.col("_there").isNull()
    rows = rows.withColumn("passage_tokens", F.when(gone, content_tokens(F.lit(C.MISSING_TEXT))).otherwise(F.col("passage_tokens")))
    return rows.withColumn("source", F.when(gone, C.MISSING_SOURCE).otherwise(F.col("source"))).withColumn("text", F.when(gone, C.MISSING_TEXT).otherwise(F.col("text"))).drop("_there")


def gated(hits: DataFrame, queries: DataFrame, c: GroundingConfig = GroundingConfig()) -> DataFrame:
    """Hits as ``with_text`` gives them, with (query, query_blank, is_answerable)."""
    asked = queries.select("qid", "query", content_tokens(F.col("query")).alias("_q"), is_blank(F.col("query")).alias("query_blank"))
    ok = ~F.col("query_blank") & answerable(F.col("_q"), F.col("id"), F.col("score"), F.col("score_is_cosine"), F.col("passage_tokens"), c)
    return hits.join(asked, "qid").withColumn("is_answerable", ok).drop("_q", "passage_tokens")


def refuses_no_evidence(hits: Column, answerable_ids: Column) -> Column:
    """Reported only: the sentinel came first and nothing behind it is answerable."""
    return (F.size(hits) > 0) & (F.try_element_at(hits, F.lit(1))["id"] == C.NO_EVIDENCE_ID) & (F.size(answerable_ids) == 0)


def collect(rows: DataFrame, queries: DataFrame, c: GroundingConfig = GroundingConfig(), by: tuple[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(qid, query, candidates, used) from gated hits: one row per query, its candidates in rank order and
    the first few answerable ones. Queries without a hit have empty arrays. ``by`` is a column of
    the hits with its values, such as the modes: each query then has a row for each of them."""
    hit = F.struct("hit_rank", "id", "score", "source", "text", "score_is_cosine", "is_answerable")
    keys = ["qid", *((by[0],) if by else ())]
    per = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(hit)).alias("all"))
    strip = lambda h: F.struct(h["id"].alias("id"), h["score"].cast("double").alias("score"), h["source"].alias("source"), h["text"].alias("text"), h["score_is_cosine"].alias("score_is_cosine"))
    empty = F.array().cast(f"array<{HIT}>")
    used = F.slice(F.filter("all", lambda h: h["is_answerable"]), 1, c.max_context_chunks)
    asked = queries.select("qid", "query")
    if by:
        asked = asked.withColumn(by[0], F.explode(F.array(*map(F.lit, by[1]))))
    out = asked.join(per, keys, "left")
    return out.select(*keys, "query", F.coalesce(F.transform("all", strip), empty).alias("candidates"), F.coalesce(F.transform(used, strip), empty).alias("used"))


def extractive_answer(used: Column) -> Column:
    def quote(h: Column) -> Column:
        text = normalize_ws(F.coalesce(h["text"], F.lit("")))
        return F.concat(F.lit(" "), text, F.when((text != "") & ~F.endswith(text, F.lit(".")), ".").otherwise(""), F.lit(" [#"), h["id"].cast("string"), F.lit("]"))

    return F.when(F.size(used) == 0, C.DONT_KNOW).otherwise(F.concat(F.lit(C.EXTRACTIVE_PREFIX), F.array_join(F.transform(used, quote), "")))


def allowed_ids(used: Column) -> Column:
    return F.transform(used, lambda h: h["id"])


def context_blob(used: Column) -> Column:
    return F.array_join(F.transform(used, lambda h: F.concat(F.coalesce(h["text"], F.lit("")), F.lit(" "))), "")


def content_support(answer: Column, used: Column) -> Column:
    """Share of the answer's content tokens, citations and prefix left out, that the context has; 0 without any."""
    bare = F.regexp_replace(F.coalesce(answer, F.lit("")), r"\[#?[ \t\n\r\f\x0b]*-?[0-9]+[ \t\n\r\f\x0b]*\]", " ")
    bare = F.regexp_replace(bare, f"^(?i){C.EXTRACTIVE_PREFIX}", "")
    share = lambda own: let(content_tokens(context_blob(used)), lambda have: F.size(F.filter(own, lambda t: F.array_contains(have, t))) / F.size(own))
    return let(content_tokens(bare), lambda own: F.when(F.size(own) == 0, 0.0).otherwise(share(own)))


def validate(answer: Column, used: Column, c: GroundingConfig = GroundingConfig()) -> Column:
    """struct(ok, refused, reason, cited_ids, illegal_ids, content_support) by the rules in their order."""
    none = F.array().cast("array<bigint>")
    empty = F.size(used) == 0

    def judge(x: Column) -> Column:
        cited, refused, support = x["cited"], x["refused"], x["support"]
        illegal = F.array_except(cited, allowed_ids(used))
        judged = ~empty & ~refused
        uncited = (F.size(cited) == 0) & c.require_citations
        reason = (
            F.when(empty & ~refused, C.REASON_NO_CONTEXT)
            .when(empty & (F.size(cited) > 0), C.REASON_REFUSAL_CITES)
            .when(empty, C.REASON_REFUSED_EMPTY)
            .when(refused, C.REASON_REFUSED)
            .when(F.size(illegal) > 0, C.REASON_ILLEGAL)
            .when(uncited, C.REASON_UNCITED)
            .when(support + 1e-9 < c.min_content_support, F.format_string(C.REASON_UNSUPPORTED, support))
            .otherwise(C.REASON_OK)
        )
        return F.struct(
            F.startswith(reason, F.lit("ok")).alias("ok"),
            refused.alias("refused"),
            reason.alias("reason"),
            cited.alias("cited_ids"),
            F.when(judged, illegal).otherwise(none).alias("illegal_ids"),
            F.when(judged & (F.size(illegal) == 0) & ~uncited, support).otherwise(0.0).alias("content_support"),
        )

    def facts(said: Column) -> Column:
        support = F.when(empty, 0.0).otherwise(content_support(said, used))
        return let(F.struct(citation_ids(said).alias("cited"), is_dont_know(said).alias("refused"), support.alias("support")), judge)

    return let(answer, facts)


def six_digits(value: float | None) -> str:
    """A number in 6 significant digits, as C++ streams print it."""
    return f"{0.0 if value is None else value:.6g}"


def _context(used: Column, none: str) -> Column:
    @F.pandas_udf("array<string>")
    def numbers(s: pd.Series) -> pd.Series:
        return pd.Series([[six_digits(x) for x in v] for v in s])

    scores = numbers(F.transform(used, lambda h: F.coalesce(h["score"], F.lit(0.0))))
    block = lambda h, s: F.concat(F.lit("[#"), h["id"].cast("string"), F.lit(" source="), F.coalesce(h["source"], F.lit("")), F.lit(" score="), s, F.lit("]\n"), F.coalesce(h["text"], F.lit("")), F.lit("\n\n"))
    return F.concat(F.lit("Context:\n"), F.when(F.size(used) == 0, none).otherwise(F.array_join(F.zip_with(used, scores, block), "")))


def _ask(query: Column) -> Column:
    return F.concat(F.lit("Question: "), F.coalesce(query, F.lit("")), F.lit("\n\n"))


def grounded_prompt(query: Column, used: Column) -> Column:
    return F.concat(F.lit(C.SYSTEM_RULES + "\n"), _context(used, C.NO_PASSAGES_RULED), _ask(query), F.lit("Answer:"))


def rag_prompt(query: Column, hits: Column) -> Column:
    return F.concat(F.lit(C.RAG_INTRO), _context(hits, C.NO_PASSAGES), _ask(query), F.lit("Answer:"))


def user_content(query: Column, used: Column) -> Column:
    return F.concat(_context(used, C.NO_PASSAGES_RULED), _ask(query), F.lit(C.USER_CLOSING))


def answers(collected: DataFrame, c: GroundingConfig = GroundingConfig()) -> DataFrame:
    """``collected`` + (refused, no_evidence, mode, answer, check): refusals and extractive answers.

    ``no_evidence`` only reports that the sentinel came first and nothing was answerable.
    """
    empty = F.size("used") == 0
    rows = collected.withColumn("refused", empty).withColumn("mode", F.when(empty, "refuse").otherwise("extractive"))
    rows = rows.withColumn("no_evidence", refuses_no_evidence(F.col("candidates"), allowed_ids(F.col("used"))))
    rows = rows.withColumn("answer", extractive_answer(F.col("used")))
    return rows.withColumn("check", validate(F.col("answer"), F.col("used"), c))


def finalize(collected: DataFrame, c: GroundingConfig = GroundingConfig()) -> DataFrame:
    """The same from rows with a ``model_text``: it is kept if it validates, else the extractive answer is."""
    rows = answers(collected, c).withColumn("_m", validate(F.col("model_text"), F.col("used"), c))
    own = ~F.col("refused") & F.col("_m.ok")
    fell = ~F.col("refused") & ~F.col("_m.ok")
    text = normalize_ws(F.coalesce("model_text", F.lit("")))
    said = F.concat(F.lit("model failed grounding ("), F.col("_m.reason"), F.lit("); used extractive fallback"))
    check = F.when(own, F.col("_m")).otherwise(F.when(fell, F.col("check").withField("reason", said)).otherwise(F.col("check")))
    return rows.select(
        *(c for c in collected.columns if c != "model_text"), "no_evidence",
        F.when(own, is_dont_know(text)).otherwise(F.col("refused")).alias("refused"),
        F.when(own, "generated").when(fell, "extractive_fallback").otherwise(F.col("mode")).alias("mode"),
        F.when(own, text).otherwise(F.col("answer")).alias("answer"),
        check.alias("check"),
    )
