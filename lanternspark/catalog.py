"""Every registered query of the core, by name, with the SQL that gives the same rows where there is one.

All run over whole tables. Search queries of the embeddings are the rows whose id is divisible by 50.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternspark.functions import constants as C
from lanternspark.functions import hashing as H
from lanternspark.functions import similarity as sim
from lanternspark.functions import text as tx
from lanternspark.operators import chunking, dense, evaluation, fusion, grounding, ivf, rejects
from lanternspark.operators.embedders import HashingEmbedder, embed
from lanternspark.operators.sparse import Bm25, store, top_k
from lanternspark.plans import prompts as chat
from lanternspark.plans.retriever import Retriever, sentinel_row
from lanternspark.service.json_api import answer_json, parse_ask
from lanternspark.session import shared_folder, ship, table
from lanternspark.sources import tsv
from lanternspark.streaming.jobs import hit_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(ship(spark), d)
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# SQL text of the functions that queries share


def _lower(x: str) -> str:
    return f"translate(coalesce({x}, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def _tokens(x: str) -> str:
    stem = "CASE WHEN strlen(t) > 4 AND suffix(t, 's') AND NOT suffix(t, 'ss') THEN left(t, length(t) - 1) ELSE t END"
    return rf"list_transform(regexp_extract_all({_lower(x)}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+'), lambda t: {stem})"


def _content(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in C.STOP_WORDS)
    return f"list_filter({_tokens(x)}, lambda t: NOT (t IN ({stop}) OR strlen(t) <= 1))"


_WS = r"[ \t\n\r\f\x0b]+"


def _tidy(x: str) -> str:
    return rf"trim(regexp_replace({x}, '{_WS}', ' ', 'g'), ' ')"


_STORE = "(SELECT id, source, text FROM chunks WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY text NULLS FIRST, source NULLS FIRST) = 1)"


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _jaccard(a: str, b: str) -> str:
    either = f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {either} = 0 THEN 1.0 ELSE len(list_intersect({a}, {b})) / {either}::DOUBLE END"


# hashes and hashed vectors

_BITS = 18446744073709551616  # 2 to the 64


def _fnv(x: str) -> str:
    byte = f"('0x' || hex({x})[i:i + 1])::UHUGEINT"
    return f"list_reduce(list_transform(range(1, length(hex({x})), 2), lambda i: {byte}), lambda h, b: (xor(h, b) * {H.FNV_PRIME}) % {_BITS}, {H.FNV_OFFSET}::UHUGEINT)"


def _mixed(x: str) -> str:
    one = f"(({x} + {H.MIX_STEP}) % {_BITS})"
    # each step is bound to a name by a list of one, as it is named twice
    step = lambda v, bits, factor: f"list_transform({v}, lambda y: (xor(y, y >> {bits}) * {factor}) % {_BITS})"
    return f"list_transform({step(step(f'[{one}]', 30, H.MIX_A), 27, H.MIX_B)}, lambda y: xor(y, y >> 31))[1]"


_SIGNED = "CASE WHEN {h} >= 9223372036854775808 THEN ({h}::HUGEINT - 18446744073709551616)::BIGINT ELSE {h}::BIGINT END"



def _hashed(name: str, rows: str, key: str, text: str, dim: int) -> str:
    """CTE ``name`` (key, vec): the hashing embedding of a text, as 32-bit floats."""
    return f"""
        {name}_t AS (SELECT {key}, unnest({_tokens(text)}) AS term FROM {rows}),
        {name}_h AS (SELECT term, {_fnv('term')} AS h FROM (SELECT DISTINCT term FROM {name}_t)),
        {name}_s AS (SELECT {key}, (h % {dim})::INT AS place, sum(CASE WHEN (h >> 32) % 2 = 1 THEN 1.0::DOUBLE ELSE -1 END) AS v FROM {name}_t JOIN {name}_h USING (term) GROUP BY ALL),
        {name}_m AS (SELECT {key}, map(list(place), list(v)) AS m, sqrt(sum(v * v)) AS size FROM {name}_s GROUP BY {key}),
        {name} AS (SELECT r.{key}, list_transform(range({dim}), lambda i: CASE WHEN coalesce(size, 0) = 0 THEN 0 ELSE coalesce(m[i::INT], 0) / size END::FLOAT) AS vec
                   FROM (SELECT DISTINCT {key} FROM {rows}) r LEFT JOIN {name}_m USING ({key}))"""


# tokens and text


@query(f"""
    SELECT id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct, len(c)::BIGINT AS n_content
    FROM (SELECT id, {_tokens('text')} AS t, {_content('text')} AS c FROM {_STORE})""")
def token_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = store(table(spark, d, "chunks")).select("id", tx.tokens(F.col("text")).alias("t"), tx.content_tokens(F.col("text")).alias("c"))
    return rows.select("id", *(F.size(x).cast("bigint").alias(n) for x, n in ((F.col("t"), "n_tokens"), (F.array_distinct("t"), "n_distinct"), (F.col("c"), "n_content"))))


@query(f"SELECT DISTINCT {_tidy(_lower('query'))} AS query FROM train_pairs WHERE query IS NOT NULL")
def normalized_train_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "train_pairs").where("query is not null").select(tx.normalize_query(F.col("query")).alias("query")).distinct()


@query(f"""
    SELECT DISTINCT doc_id, {_tidy('text')} AS clean, coalesce({_tidy('text')} = '', true) AS is_blank,
           coalesce({_tidy(_lower('text'))} IN ('i don''t know', 'i do not know'), false) AS is_refusal FROM documents""")
def clean_documents(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", tx.sanitize(t).alias("clean"), tx.is_blank(t).alias("is_blank"), tx.is_dont_know(t).alias("is_refusal"))


_NGRAMS = """list_distinct(flatten(list_transform({c}, lambda t: list_concat(
    list_transform(range(1, greatest(length(t) + 1, 1)), lambda i: ('^' || t || '$')[i:i + 2]),
    list_transform(range(1, greatest(length(t), 1)), lambda i: ('^' || t || '$')[i:i + 3])))))"""


@query(f"SELECT qid, len({_NGRAMS.format(c=_content('query'))})::BIGINT AS n_ngrams FROM labeled")
def query_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labeled").select("qid", F.size(tx.content_ngrams(F.col("query"))).cast("bigint").alias("n_ngrams"))


@query(rf"""
    SELECT id, list_transform(regexp_extract_all(s, '\[#?{_WS[:-1]}*(-?[0-9]+){_WS[:-1]}*\]', 1), lambda x: x::BIGINT) AS raw_ids,
           len(list_distinct(regexp_extract_all(s, '\[#?{_WS[:-1]}*(-?[0-9]+){_WS[:-1]}*\]', 1)))::BIGINT AS n_ids
    FROM (SELECT id, coalesce(text, '') || ' [#' || id || '] [ ' || id || ' ] [#7]' AS s FROM {_STORE})""")
def citation_ids(spark: SparkSession, d: str) -> DataFrame:
    s = F.concat(F.coalesce("text", F.lit("")), F.lit(" [#"), F.col("id").cast("string"), F.lit("] [ "), F.col("id").cast("string"), F.lit(" ] [#7]"))
    raw = F.transform(F.regexp_extract_all(s, F.lit(tx.CITATION), F.lit(1)), lambda x: x.cast("bigint"))
    return store(table(spark, d, "chunks")).select("id", raw.alias("raw_ids"), F.size(tx.citation_ids(s)).cast("bigint").alias("n_ids"))


_MASKED = r"regexp_replace(regexp_replace(coalesce(text, ''), '([0-9])\.([0-9])', '\1' || chr(57344) || '\2', 'g'), '([0-9])\.([0-9])', '\1' || chr(57344) || '\2', 'g')"


@query(rf"""
    SELECT doc_id, p.pos::BIGINT AS pos, p.piece FROM (
        SELECT doc_id, unnest(list_transform(list_zip(range(1, len(s) + 1), s), lambda x: {{'pos': x[1] - 1, 'piece': x[2]}})) AS p FROM (
            SELECT doc_id, list_filter(list_transform(regexp_extract_all({_MASKED}, '(?s)[^.!?]*[.!?]["'')\]]*|[^.!?]+$'),
                lambda u: {_tidy("replace(u, chr(57344), '.')")}), lambda u: u <> '') AS s FROM documents))""")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(tx.split_sentences(F.col("text"))).alias("pos", "piece")).withColumn("pos", F.col("pos").cast("bigint"))


@query(rf"""
    SELECT doc_id, p.pos::BIGINT AS pos, p.piece FROM (
        SELECT doc_id, unnest(list_transform(list_zip(range(1, len(s) + 1), s), lambda x: {{'pos': x[1] - 1, 'piece': x[2]}})) AS p FROM (
            SELECT doc_id, list_filter(list_transform(string_split_regex(replace(coalesce(text, ''), chr(13), ''), '\n{{2,}}'),
                lambda u: {_tidy('u')}), lambda u: u <> '') AS s FROM documents))""")
def paragraph_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(tx.split_paragraphs(F.col("text"))).alias("pos", "piece")).withColumn("pos", F.col("pos").cast("bigint"))


@query(rf"""
    WITH p AS (SELECT doc_id, text, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '(?m)^(#{{1,6}} )', chr(57345) || '\1', 'g'), chr(57345)), lambda u:
                   CASE WHEN regexp_matches(u, '^#{{1,6}} ')
                        THEN {{'heading': {_tidy("regexp_replace(split_part(u, chr(10), 1), '^#{1,6} ', '')")}, 'body': CASE WHEN contains(u, chr(10)) THEN {_tidy("u[strpos(u, chr(10)) + 1:]")} ELSE '' END}}
                        ELSE {{'heading': '', 'body': {_tidy('u')}}} END), lambda s: s.heading <> '' OR s.body <> '') AS s FROM documents)
    SELECT doc_id, x.pos::BIGINT AS pos, x.s.heading AS heading, x.s.body AS body FROM (
        SELECT doc_id, unnest(list_transform(list_zip(range(len(k)), k), lambda z: {{'pos': z[1], 's': z[2]}})) AS x FROM (
            SELECT doc_id, CASE WHEN len(s) = 0 THEN [{{'heading': '', 'body': {_tidy("coalesce(text, '')")}}}] ELSE s END AS k FROM p))""")
def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(tx.markdown_sections(F.col("text"))).alias("pos", "s"))
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "s.heading", "s.body")


@query("""
    SELECT doc_id, CASE WHEN coalesce(rel_path, '') = '' THEN source WHEN coalesce(source, '') = '' THEN rel_path ELSE source || '#' || rel_path END AS joined FROM documents""")
def joined_sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.join_source(F.col("source"), F.col("rel_path")).alias("joined"))


@query()
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document by the configuration of its source."""
    return chunking.chunk_rows(table(spark, d, "documents"), table(spark, d, "chunker_config"), "doc_id", "text", "source")


def _strategy(name: str):
    def f(spark: SparkSession, d: str) -> DataFrame:
        return chunking.chunk_rows(table(spark, d, "documents"), chunking.ChunkerConfig(name), "doc_id", "text", "source")

    f.__name__ = f"{name}_chunks"
    return query()(f)


for _name in ("window", "sentence", "paragraph", "markdown"):
    _strategy(_name)


@query()
def numbered_chunks(spark: SparkSession, d: str) -> DataFrame:
    """All documents' chunks as one store, numbered on by path and position."""
    rows = table(spark, d, "documents").withColumn("path", F.concat_ws("/", "rel_path", F.lpad(F.col("doc_id").cast("string"), 20, "0")))
    return chunking.number(chunking.chunk_rows(rows, chunking.ChunkerConfig(), "path", "text", "source")).select("id", "source", "text")


# the chunk store


@query("""
    SELECT coalesce(max(id) FILTER (id >= 0), -1) + 1 AS next_id, count(DISTINCT id) AS n_chunks,
           count(DISTINCT id) FILTER (id <> -1) AS n_real, max((id = -1)::BIGINT) AS has_no_evidence FROM chunks""")
def store_counts(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    rows = store(table(spark, d, "chunks"))
    return rows.agg((F.coalesce(F.max(F.when(i >= 0, i)), F.lit(-1)) + 1).alias("next_id"), F.count("*").alias("n_chunks"), F.count_if(i != -1).alias("n_real"), F.max((i == -1).cast("bigint")).alias("has_no_evidence"))


@query(f"""
    SELECT id, count(*) AS n_rows, min((coalesce(id = -1 AND source = 'system' AND text = '{C.NO_EVIDENCE_TEXT}', false))::BIGINT) AS is_sentinel
    FROM chunks GROUP BY id HAVING count(*) > 1 OR id < 0""")
def store_violations(spark: SparkSession, d: str) -> DataFrame:
    """Ids that a strict load refuses, being there twice, and reserved ones with whether they are genuine."""
    own = tx.is_sentinel_row(F.col("id"), F.col("source"), F.col("text"))
    return table(spark, d, "chunks").groupBy("id").agg(F.count("*").alias("n_rows"), F.min(own.cast("bigint")).alias("is_sentinel")).where("n_rows > 1 or id < 0")


@query(f"SELECT id, coalesce({_tidy('source')}, '') AS source, coalesce({_tidy('text')}, '') AS text FROM {_STORE}")
def tsv_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The store, sanitised, written as tab-separated lines and loaded again under the store's rules."""
    rows = store(table(spark, d, "chunks")).select("id", tx.sanitize(F.col("source")).alias("source"), tx.sanitize(F.col("text")).alias("text"))
    rows = rows.withColumn("text", F.when(F.col("id") == C.NO_EVIDENCE_ID, C.NO_EVIDENCE_TEXT).otherwise(F.col("text")))
    tsv.save_chunks(rows, path := shared_folder(spark))
    return tsv.load_chunks(spark, path).select("id", "source", "text")


_LINE = f"{_tidy('query')} <> '' AND NOT starts_with({_tidy('query')}, '#')"


@query(f"""
    SELECT 'train' AS kind, {_tidy('query')} AS query, pos_id AS id FROM train_pairs WHERE pos_id IS NOT NULL AND {_LINE}
    UNION ALL SELECT 'labeled', {_tidy('query')}, gold_id FROM labeled WHERE gold_id >= 0 AND {_LINE} UNION ALL SELECT 'refuse', {_tidy('query')}, NULL FROM refuse WHERE {_LINE}""")
def tsv_queries(spark: SparkSession, d: str) -> DataFrame:
    """Training pairs, labeled and refusal questions through their tab-separated files."""
    out = []
    for name, key, load in (("train_pairs", "pos_id", tsv.load_train_pairs), ("labeled", "gold_id", tsv.load_labeled), ("refuse", None, tsv.load_refuse)):
        q = tx.sanitize(F.col("query"))
        rows = table(spark, d, name).where((q != "") & ~F.startswith(q, F.lit("#")) & (F.col(key) >= (0 if name == "labeled" else -1) if key else F.lit(True)))
        rows.select(F.concat_ws("\t", q, *([F.col(key).cast("string")] if key else []))).write.text(path := shared_folder(spark))
        out.append(load(spark, path).select(F.lit(name.split("_")[0]).alias("kind"), "query", (F.col(key) if key else F.lit(None)).cast("bigint").alias("id")))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"""
    SELECT count(*) AS n_chunks, count(*) FILTER (id <> -1) AS n_real_chunks, max((id = -1)::INT)::BIGINT AS has_no_evidence, 64::BIGINT AS dim, count(*) AS n_vectors,
           sum(strlen(coalesce(text, '')))::BIGINT AS n_bytes, 'hashing-v1' AS embedder FROM {_STORE}""")
def index_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """An index that is saved, then opened and checked against its meta file, as one row of what it holds."""
    Retriever.build(spark, table(spark, d, "chunks"), HashingEmbedder(64)).save(path := shared_folder(spark))
    own = Retriever.open(spark, path)
    n_vectors = own.vectors.agg(F.count("*").alias("n_vectors"), F.max(F.size("vec")).cast("bigint").alias("dim"))
    i = F.col("id")
    held = own.chunks.agg(F.count("*").alias("n_chunks"), F.count_if(i != -1).alias("n_real_chunks"), F.max((i == -1).cast("bigint")).alias("has_no_evidence"), F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("n_bytes"))
    return held.join(F.broadcast(n_vectors), F.lit(True)).withColumn("embedder", F.lit(own.embedder.id))


# BM25

def _bm25_sql(asked: str) -> str:
    return f"""
    d AS (SELECT id, {_tokens('text')} AS t FROM {_STORE} WHERE id <> -1),
    stats AS (SELECT count(*) AS n, coalesce(avg(len(t)), 0) AS avgdl FROM d),
    p AS (SELECT id, term, len, count(*) AS tf FROM (SELECT id, len(t) AS len, unnest(t) AS term FROM d) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({_tokens('query')}) AS term FROM {asked}) GROUP BY ALL),
    s AS (SELECT qid, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl)) * qtf) AS score
          FROM q JOIN p USING (term) JOIN df USING (term) CROSS JOIN stats GROUP BY ALL)"""


_BM25 = _bm25_sql("labeled")


def _top(k: int, source: str = "s") -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS hit_rank FROM {source} QUALIFY hit_rank <= {k})"


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.select("qid", "id", F.round("score", 6).alias("score"), F.col("hit_rank").cast("bigint").alias("hit_rank"))


def _bm25(spark: SparkSession, d: str) -> tuple[Bm25, DataFrame]:
    return Bm25.build(table(spark, d, "chunks")), table(spark, d, "labeled")


@query(f"WITH {_BM25} SELECT term, df FROM df")
def term_df(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d)[0].df()


@query(f"WITH {_BM25} SELECT n AS n_docs, round(avgdl, 6) AS avgdl FROM stats")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d)[0].stats.select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {_BM25} SELECT qid, id, round(score, 6) AS score, hit_rank FROM {_top(5)}")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    index, asked = _bm25(spark, d)
    return _rounded(index.search(asked, 5))


@query(f"WITH {_BM25} SELECT qid, round(coalesce(max(score), 0), 6) AS max_score FROM (SELECT DISTINCT qid FROM labeled) LEFT JOIN s USING (qid) GROUP BY qid")
def bm25_max_signal(spark: SparkSession, d: str) -> DataFrame:
    index, asked = _bm25(spark, d)
    return index.max_score(asked).select("qid", F.round("max_score", 6).alias("max_score"))


@query(f"WITH {_BM25} SELECT l.qid, l.gold_id AS id, round(coalesce(s.score, 0), 6) AS score FROM labeled l LEFT JOIN s ON s.qid = l.qid AND s.id = l.gold_id")
def bm25_gold_score(spark: SparkSession, d: str) -> DataFrame:
    index, asked = _bm25(spark, d)
    return index.score_ids(asked.select("qid", F.col("gold_id").alias("id")), asked).select("qid", "id", F.round("score", 6).alias("score"))


# dense retrieval


@query(f"""
    WITH s AS (SELECT q.vec_id AS qid, e.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score
               FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 50 = 0)
    SELECT qid, id, round(score, 6) AS score, hit_rank FROM {_top(10)}""")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return _rounded(dense.search(rows.where("id % 50 = 0").withColumnRenamed("id", "qid"), rows, 10))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


@query()
def ivf_topk(spark: SparkSession, d: str) -> DataFrame:
    """By the partitioned index: not all rows are compared, so not all of the exact hits need be there."""
    rows = _vectors(spark, d)
    return _rounded(ivf.InvertedFile.build(rows).search(rows.where("id % 50 = 0").withColumnRenamed("id", "qid"), 10))


@query("SELECT count(*) * least(10, (SELECT count(*) FROM embeddings)) AS n, true AS reaches_09 FROM embeddings WHERE vec_id % 50 = 0")
def ivf_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether the partitioned index has at least 0.9 of the exact hits."""
    rows = _vectors(spark, d)
    asked = rows.where("id % 50 = 0").withColumnRenamed("id", "qid")
    found = ivf.recall(ivf.InvertedFile.build(rows).search(asked, 10), dense.search(asked, rows, 10))
    return found.select("n", (F.col("recall") >= 0.9).alias("reaches_09"))


@query(f"""
    WITH s AS (SELECT q.vec_id AS qid, e.vec_id AS id, q.label AS own, e.label, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score
               FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
         r AS (SELECT qid, own, min(hit_rank) FILTER (label = own) AS gold_rank FROM {_top(5)} GROUP BY ALL)
    SELECT own AS label, count(*) AS n, round(avg(coalesce((gold_rank <= 1)::DOUBLE, 0)), 6) AS recall_1, round(avg(coalesce((gold_rank <= 3)::DOUBLE, 0)), 6) AS recall_3,
           round(avg(coalesce((gold_rank <= 5)::DOUBLE, 0)), 6) AS recall_5, round(avg(coalesce(1.0::DOUBLE / gold_rank, 0)), 6) AS mrr FROM r GROUP BY own""")
def label_recall(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    vec = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    hits = dense.search(vec.where("id % 50 = 0").withColumnRenamed("id", "qid"), vec, 6).where("id != qid")
    hits = top_k(hits, 5).join(rows.select(F.col("vec_id").alias("id"), F.col("label").alias("hit_label")), "id")
    own = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "label")
    ranks = own.join(hits, "qid", "left").groupBy("qid", "label").agg(F.min(F.when(F.col("label") == F.col("hit_label"), F.col("hit_rank"))).alias("gold_rank"))
    m = evaluation.retrieval_metrics(ranks, "label")
    return m.select("label", "n", *(F.round(c, 6).alias(c) for c in ("recall_1", "recall_3", "recall_5", "mrr")))


@query(f"WITH {_hashed('e', _STORE, 'id', 'text', 128)} SELECT id, list_transform(vec, lambda x: round(x::DOUBLE, 5)) AS vec FROM e")
def hashing_embeddings(spark: SparkSession, d: str) -> DataFrame:
    rows = embed(store(table(spark, d, "chunks")), HashingEmbedder(128), "id", "text")
    return rows.select("id", F.transform("vec", lambda x: F.round(x.cast("double"), 5)).alias("vec"))


@query("""
    SELECT a.vec_id, round(coalesce(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0), 6) AS cosine, round(sqrt(list_sum(list_transform(a.embedding::DOUBLE[], lambda x: x * x))), 4) AS norm,
           1.0::DOUBLE AS unit_norm, 1.0::DOUBLE AS unit_cosine
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def vector_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's length, its cosine with the next one, and the length and cosine of the vector at length 1."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    rows = rows.join(after, "vec_id").withColumn("unit", sim.l2_normalize(F.col("embedding")))
    own = F.round(sim.norm(F.col("unit")), 5).alias("unit_norm"), F.round(sim.cosine(F.col("unit"), F.col("embedding")), 5).alias("unit_cosine")
    return rows.select("vec_id", F.round(sim.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"), F.round(sim.norm(F.col("embedding")), 4).alias("norm"), *own)


@query(f"""
    WITH {_hashed('e', _STORE, 'id', 'text', 128)}, {_hashed('q', 'labeled', 'qid', 'query', 128)},
         s AS (SELECT qid, id, coalesce(CASE WHEN isnan(c) THEN 0 ELSE c END, 0) AS score FROM (SELECT qid, id, list_cosine_similarity(q.vec::DOUBLE[], e.vec::DOUBLE[]) AS c FROM q CROSS JOIN e))
    SELECT qid, id, round(score, 6) AS score, hit_rank FROM {_top(5)}""")
def hashing_topk(spark: SparkSession, d: str) -> DataFrame:
    own = Retriever.build(spark, table(spark, d, "chunks"), HashingEmbedder(128), mode="dense")
    return _rounded(own.search_dense(table(spark, d, "labeled"), 5))


# fusion of the logged rankings


def _ranking(mode: str) -> str:
    return f"(SELECT qid, id, min(hit_rank) AS r, max(coalesce(score, 0)) AS score FROM hits WHERE retrieve_mode = '{mode}' GROUP BY qid, id)"


_LISTS = f"d AS {_ranking('dense')}, b AS {_ranking('sparse')}, j AS (SELECT qid, id, d.score AS d, b.score AS s FROM d FULL JOIN b USING (qid, id))"


def _ranked(spark: SparkSession, d: str, mode: str) -> DataFrame:
    rows = table(spark, d, "hits").where(F.col("retrieve_mode") == mode).groupBy("qid", "id")
    return rows.agg(F.min("hit_rank").alias("hit_rank"), F.max(F.coalesce("score", F.lit(0.0))).alias("score"))


@query(f"""
    WITH {_LISTS}, s AS (SELECT qid, id, sum(1.0::DOUBLE / (60 + r)) AS score FROM (SELECT qid, id, r FROM d UNION ALL SELECT qid, id, r FROM b) GROUP BY qid, id)
    SELECT qid, id, round(score, 6) AS score, hit_rank FROM {_top(5)}""")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(fusion.rrf(_ranked(spark, d, "dense"), _ranked(spark, d, "sparse"), 5))


_SCALE = "CASE WHEN max({x}) OVER (PARTITION BY qid) - min({x}) OVER (PARTITION BY qid) <= 1e-12 THEN 0 ELSE ({x} - min({x}) OVER (PARTITION BY qid)) / (max({x}) OVER (PARTITION BY qid) - min({x}) OVER (PARTITION BY qid)) END"


@query(f"""
    WITH {_LISTS}, c AS (SELECT qid, id, coalesce(d, 0) AS d, coalesce(s, 0) AS b FROM j),
         s AS (SELECT qid, id, 0.55::DOUBLE * ({_SCALE.format(x='d')}) + 0.45::DOUBLE * ({_SCALE.format(x='b')}) AS score FROM c)
    SELECT qid, id, round(score, 6) AS score, hit_rank FROM {_top(5)}""")
def weighted_fusion(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(fusion.weighted(_ranked(spark, d, "dense"), _ranked(spark, d, "sparse"), 5))


_PRIMARY = """
    t AS (SELECT qid, id, d, coalesce(s, 0) AS b, coalesce(max(d) OVER (PARTITION BY qid), 0) AS top FROM j),
    s AS (SELECT qid, id, CASE WHEN d IS NOT NULL THEN d + CASE WHEN b >= 2.5 AND id <> -1 THEN 0.08::DOUBLE * b ELSE 0 END
                               ELSE greatest(0.85::DOUBLE * top, 0.08::DOUBLE * b) END AS score FROM t WHERE d IS NOT NULL OR b >= 2.5)"""


@query(f"WITH {_LISTS}, {_PRIMARY} SELECT qid, id, round(score, 6) AS score, hit_rank FROM {_top(5)}")
def dense_primary_fusion(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(fusion.dense_primary(_ranked(spark, d, "dense"), _ranked(spark, d, "sparse"), 5))


@query(f"""
    WITH {_LISTS}, {_PRIMARY}, w AS (SELECT qid FROM b GROUP BY qid HAVING max(score) >= 2.5),
         f AS (SELECT qid, id, score FROM s WHERE qid IN (SELECT qid FROM w) UNION ALL SELECT qid, id, score FROM d WHERE qid NOT IN (SELECT qid FROM w))
    SELECT qid, id, round(score, 6) AS score, hit_rank FROM {_top(5, 'f')}""")
def adaptive_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid with its fallback to dense where the best sparse score is weak."""
    sparse = _ranked(spark, d, "sparse")
    return _rounded(fusion.fuse(_ranked(spark, d, "dense"), sparse, sparse.groupBy("qid").agg(F.max("score").alias("max_score")), 5))


def _hybrid(asked: str, k: int, dim: int = 128) -> str:
    """CTE hy (qid, id, score, hit_rank): the k best of the hybrid mode over hashing embeddings and BM25."""
    return f"""{_bm25_sql(asked)}, {_hashed('e', _STORE, 'id', 'text', dim)}, {_hashed('k', asked, 'qid', 'query', dim)},
    cs AS (SELECT qid, id, coalesce(CASE WHEN isnan(c) THEN 0 ELSE c END, 0) AS score FROM (SELECT qid, id, list_cosine_similarity(k.vec::DOUBLE[], e.vec::DOUBLE[]) AS c FROM k CROSS JOIN e)),
    near AS {_top(32, 'cs')}, far AS {_top(32)}, strong AS (SELECT qid FROM far GROUP BY qid HAVING max(score) >= 2.5),
    pool AS (SELECT qid, id, n.score AS d, coalesce(s.score, 0) AS b, max(n.score) OVER (PARTITION BY qid) AS top
             FROM near n FULL JOIN (SELECT qid, id, score FROM s WHERE (qid, id) IN (SELECT (qid, id) FROM near UNION ALL SELECT (qid, id) FROM far)) s USING (qid, id)),
    fused AS (SELECT qid, id, CASE WHEN d IS NOT NULL THEN d + CASE WHEN b >= 2.5 AND id <> -1 THEN 0.08::DOUBLE * b ELSE 0 END ELSE greatest(0.85::DOUBLE * top, 0.08::DOUBLE * b) END AS score
              FROM pool WHERE qid IN (SELECT qid FROM strong) AND (d IS NOT NULL OR b >= 2.5)
              UNION ALL SELECT qid, id, score FROM near WHERE qid NOT IN (SELECT qid FROM strong)),
    ids AS (SELECT qid, id FROM {_top(k, 'fused')}), scored AS (SELECT qid, id, score FROM ids JOIN cs USING (qid, id)), hy AS {_top(1 << 30, 'scored')}"""


@query(f"""
    WITH {_hybrid('labeled', 5)} SELECT qid, hy.id, round(score, 6) AS score, hit_rank, true AS score_is_cosine, source FROM hy JOIN {_STORE} c USING (id)""")
def hybrid_retrieval(spark: SparkSession, d: str) -> DataFrame:
    own = Retriever.build(spark, table(spark, d, "chunks"), HashingEmbedder(128))
    return own.retrieve(table(spark, d, "labeled"), 5).select("qid", "id", F.round("score", 6).alias("score"), F.col("hit_rank").cast("bigint").alias("hit_rank"), "score_is_cosine", "source")


# grounding over the logged hits

_HITS = "(SELECT DISTINCT qid, retrieve_mode, hit_rank, id, score, score_is_cosine FROM hits)"


def _hits(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "hits").select("qid", "retrieve_mode", "hit_rank", "id", "score", "score_is_cosine").distinct()
    return grounding.with_text(rows, store(table(spark, d, "chunks")))


@query(f"""
    SELECT h.qid, h.retrieve_mode, h.hit_rank, h.id, CASE WHEN c.id IS NULL THEN '?' ELSE c.source END AS source,
           CASE WHEN c.id IS NULL THEN '{C.MISSING_TEXT}' ELSE c.text END AS text FROM {_HITS} h LEFT JOIN {_STORE} c USING (id)""")
def hit_texts(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).select("qid", "retrieve_mode", "hit_rank", "id", "source", "text")


def _gate(hits: str, asked: str) -> str:
    """CTEs g and a: hits (qid, retrieve_mode, hit_rank, id, score, score_is_cosine) with ok, whether they answer."""
    text = f"CASE WHEN c.id IS NULL THEN '{C.MISSING_TEXT}' ELSE c.text END"
    return f"""
    g AS (SELECT h.qid, h.retrieve_mode, h.hit_rank, h.id, coalesce(h.score, 0) AS score, coalesce(h.score_is_cosine, false) AS cos, q.query,
                 CASE WHEN c.id IS NULL THEN '{C.MISSING_SOURCE}' ELSE c.source END AS source,
                 coalesce({_tidy('q.query')} = '', true) AS blank, {text} AS text, {_content('q.query')} AS qt, {_content(text)} AS pt
          FROM {hits} h JOIN {asked} q USING (qid) LEFT JOIN {_STORE} c ON c.id = h.id),
    a AS (SELECT *, CASE WHEN blank THEN false WHEN id = -1 THEN false WHEN cos AND score < 0.25 THEN false
                         WHEN len(list_filter(qt, lambda t: strlen(t) >= 5 AND NOT list_contains(pt, t))) > 0 THEN cos AND score >= 0.6
                         WHEN len(list_filter(qt, lambda t: list_contains(pt, t))) >= 1 AND len(list_filter(qt, lambda t: list_contains(pt, t))) / len(qt)::DOUBLE >= 0.2 THEN true
                         ELSE cos AND score >= 0.6 END AS ok FROM g)"""


_GATE = _gate(_HITS, "labeled")


@query(f"WITH {_GATE} SELECT qid, retrieve_mode, hit_rank, id, ok AS is_answerable FROM a")
def answerability_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = grounding.gated(_hits(spark, d), table(spark, d, "labeled"))
    return rows.select("qid", "retrieve_mode", "hit_rank", "id", "is_answerable")


_MODES = ("retrieve_mode", fusion.MODES)
_EVERY = f"(SELECT l.*, unnest([{', '.join(map(repr, fusion.MODES))}]) AS retrieve_mode FROM labeled l)"
_CITED = rf"\[#?{_WS[:-1]}*(-?[0-9]+){_WS[:-1]}*\]"
_QUOTED = f"' ' || {_tidy("coalesce(text, '')")} || CASE WHEN {_tidy("coalesce(text, '')")} <> '' AND NOT suffix({_tidy("coalesce(text, '')")}, '.') THEN '.' ELSE '' END || ' [#' || id || ']'"
_BLOCK = "'[#' || id || ' source=' || coalesce(source, '') || ' score=' || printf('%g', score) || ']' || chr(10) || coalesce(text, '') || chr(10) || chr(10)"

def _answered(gate: str, asked: str) -> str:
    """CTEs of the gate and r: of every question and mode what is used, in order, and the extractive answer."""
    return f"""{gate},
    u AS (SELECT *, row_number() OVER (PARTITION BY qid, retrieve_mode ORDER BY hit_rank, id) AS n FROM a WHERE ok QUALIFY n <= 3),
    x AS (SELECT qid, retrieve_mode, list(id ORDER BY n) AS ids, string_agg(coalesce(text, '') || ' ', '' ORDER BY n) AS ctx, string_agg({_QUOTED}, '' ORDER BY n) AS body,
                 string_agg({_BLOCK}, '' ORDER BY n) AS blocks, first(text ORDER BY n) AS first_text FROM u GROUP BY ALL),
    y AS (SELECT qid, retrieve_mode, string_agg({_BLOCK}, '' ORDER BY hit_rank, id) AS all_blocks, first(id ORDER BY hit_rank, id) AS first_hit FROM a GROUP BY ALL),
    r AS (SELECT l.*, x.qid IS NULL AS refused, coalesce(x.ids, []) AS ids, coalesce(x.ctx, '') AS ctx, x.blocks, x.first_text, y.all_blocks, y.first_hit,
                 CASE WHEN x.qid IS NULL THEN '{C.DONT_KNOW.replace("'", "''")}' ELSE '{C.EXTRACTIVE_PREFIX}' || x.body END AS answer
          FROM {asked} l LEFT JOIN x USING (qid, retrieve_mode) LEFT JOIN y USING (qid, retrieve_mode))"""


_ANSWERS = _answered(_GATE, _EVERY)


def _judged(source: str, said: str, p: str) -> str:
    """The rows of ``source`` with the validator's findings on ``said``, their names beginning with ``p``."""
    bare = f"regexp_replace(regexp_replace(coalesce({said}, ''), '{_CITED}', ' ', 'g'), '(?i)^{C.EXTRACTIVE_PREFIX}', '')"
    refused = f"coalesce({_tidy(_lower(said))} IN ('i don''t know', 'i do not know'), false) AND {said} IS NOT NULL"
    ids = f"list_transform(regexp_extract_all(coalesce({said}, ''), '{_CITED}', 1), lambda i: TRY_CAST(i AS BIGINT))"
    return f"""
        (SELECT * EXCLUDE ({p}1, {p}2, {p}3), starts_with({p}reason, 'ok') AS {p}ok,
                CASE WHEN len(ids) > 0 AND NOT {p}refused THEN {p}3 ELSE [] END AS {p}illegal,
                CASE WHEN len(ids) > 0 AND NOT {p}refused AND len({p}3) = 0 AND len({p}cited) > 0 THEN {p}2 ELSE 0 END AS {p}support
         FROM (SELECT *, CASE WHEN len(ids) = 0 AND NOT {p}refused THEN {_lit(C.REASON_NO_CONTEXT)} WHEN len(ids) = 0 AND len({p}cited) > 0 THEN {_lit(C.REASON_REFUSAL_CITES)}
                         WHEN len(ids) = 0 THEN {_lit(C.REASON_REFUSED_EMPTY)} WHEN {p}refused THEN {_lit(C.REASON_REFUSED)} WHEN len({p}3) > 0 THEN {_lit(C.REASON_ILLEGAL)}
                         WHEN len({p}cited) = 0 THEN {_lit(C.REASON_UNCITED)} WHEN {p}2 + 1e-9 < 0.25 THEN printf({_lit(C.REASON_UNSUPPORTED)}, {p}2) ELSE {_lit(C.REASON_OK)} END AS {p}reason
               FROM (SELECT *, list_filter({p}cited, lambda i: NOT list_contains(ids, i)) AS {p}3,
                            CASE WHEN len(ids) = 0 OR len({p}1) = 0 THEN 0 ELSE len(list_filter({p}1, lambda t: list_contains({_content('ctx')}, t))) / len({p}1)::DOUBLE END AS {p}2
                     FROM (SELECT *, {refused} AS {p}refused, {_content(bare)} AS {p}1,
                                  list_sort(list_distinct(CASE WHEN list_contains(list_transform({ids}, lambda i: i IS NULL), true) THEN ({ids})[1:list_position(list_transform({ids}, lambda i: i IS NULL), true) - 1] ELSE {ids} END)) AS {p}cited
                           FROM {source}))))"""


def _collected(spark: SparkSession, d: str) -> DataFrame:
    """Of every question and mode the candidates and what of them is used."""
    asked = table(spark, d, "labeled")
    return grounding.collect(grounding.gated(_hits(spark, d), asked), asked, by=_MODES)


def _answers(spark: SparkSession, d: str) -> DataFrame:
    return grounding.answers(_collected(spark, d))


_CHECK = "{p}ok AS ok, {p}refused AS refused, {p}reason AS reason, {p}cited AS cited_ids, list_sort({p}illegal) AS illegal_ids, round({p}support, 6) AS content_support"


@query(f"""
    WITH {_ANSWERS} SELECT qid, retrieve_mode, refused, coalesce(first_hit = -1, false) AND refused AS no_evidence, CASE WHEN refused THEN 'refuse' ELSE 'extractive' END AS mode, answer FROM r""")
def extractive_answers(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select("qid", "retrieve_mode", "refused", "no_evidence", "mode", "answer")


@query(f"WITH {_ANSWERS} SELECT qid, retrieve_mode, {_CHECK.format(p='v_')} FROM {_judged('r', 'answer', 'v_')}")
def validated_answers(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("check")
    ids = (F.array_sort(c[n]).alias(n) for n in ("cited_ids", "illegal_ids"))
    return _answers(spark, d).select("qid", "retrieve_mode", c["ok"].alias("ok"), c["refused"].alias("refused"), c["reason"].alias("reason"), *ids, F.round(c["content_support"], 6).alias("content_support"))


_SAID = "(SELECT *, coalesce(first_text, '') || ' [#' || (ids[1] + qid % 2) || ']' AS said FROM r)"


@query(f"""
    WITH {_ANSWERS}, j AS (SELECT * FROM {_judged(_judged(_SAID, 'answer', 'v_'), 'said', 'm_')})
    SELECT qid, retrieve_mode, CASE WHEN refused THEN true WHEN m_ok THEN m_refused ELSE false END AS refused,
           CASE WHEN refused THEN 'refuse' WHEN m_ok THEN 'generated' ELSE 'extractive_fallback' END AS mode,
           CASE WHEN NOT refused AND m_ok THEN {_tidy('said')} ELSE answer END AS answer, CASE WHEN NOT refused AND m_ok THEN true ELSE v_ok END AS ok,
           CASE WHEN refused THEN v_reason WHEN m_ok THEN m_reason ELSE 'model failed grounding (' || m_reason || '); used extractive fallback' END AS reason FROM j""")
def validated_model_texts(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in model texts, half of which cite what isn't in the context, through the validator's fallback."""
    first = F.try_element_at("used", F.lit(1))
    said = F.concat(F.coalesce(first["text"], F.lit("")), F.lit(" [#"), (first["id"] + F.col("qid") % 2).cast("string"), F.lit("]"))
    rows = grounding.finalize(_collected(spark, d).withColumn("model_text", said))
    return rows.select("qid", "retrieve_mode", "refused", "mode", "answer", F.col("check.ok").alias("ok"), F.col("check.reason").alias("reason"))


_QUESTION = "'Question: ' || coalesce(query, '') || chr(10) || chr(10)"


@query(f"""
    WITH {_ANSWERS} SELECT qid, retrieve_mode, {_lit(C.SYSTEM_RULES)} || chr(10) || 'Context:' || chr(10) || coalesce(blocks, {_lit(C.NO_PASSAGES_RULED)}) || {_QUESTION} || 'Answer:' AS prompt,
        {_lit(C.RAG_INTRO)} || 'Context:' || chr(10) || coalesce(all_blocks, {_lit(C.NO_PASSAGES)}) || {_QUESTION} || 'Answer:' AS rag_prompt FROM r""")
def prompts(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select("qid", "retrieve_mode", grounding.grounded_prompt(F.col("query"), F.col("used")).alias("prompt"), grounding.rag_prompt(F.col("query"), F.col("candidates")).alias("rag_prompt"))


@query(f"""
    WITH {_ANSWERS} SELECT qid, retrieve_mode, '<|im_start|>system' || chr(10) || {_lit(C.SYSTEM_RULES)} || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || 'Context:' || chr(10)
        || coalesce(blocks, {_lit(C.NO_PASSAGES_RULED)}) || {_QUESTION} || {_lit(C.USER_CLOSING)} || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt FROM r""")
def chat_prompts(spark: SparkSession, d: str) -> DataFrame:
    """In the tags of the family that a model without a sidecar file gets."""
    return _answers(spark, d).select("qid", "retrieve_mode", chat.generate_prompt(F.col("query"), F.col("used")).alias("prompt"))


@query(f"WITH {_ANSWERS} SELECT qid, retrieve_mode, ids, ctx AS context FROM r")
def answer_contexts(spark: SparkSession, d: str) -> DataFrame:
    return _collected(spark, d).select("qid", "retrieve_mode", grounding.allowed_ids(F.col("used")).alias("ids"), grounding.context_blob(F.col("used")).alias("context"))


@query()
def ask_json(spark: SparkSession, d: str) -> DataFrame:
    """Answers as JSON, by question and mode."""
    return answer_json(_answers(spark, d), by="retrieve_mode")


def _asked_hybrid(asked: str) -> str:
    """CTE r over hybrid retrieval of 9 hits for every question that isn't blank."""
    hits = "(SELECT *, 'hybrid' AS retrieve_mode, true AS score_is_cosine FROM hy)"
    return _hybrid(f"(SELECT * FROM {asked} WHERE {_tidy('query')} <> '')", 9) + ", " + _answered(_gate(hits, asked), f"(SELECT *, 'hybrid' AS retrieve_mode FROM {asked})")


@query(f"""
    WITH asked AS (SELECT qid, query FROM labeled UNION ALL SELECT qid, query FROM refuse), {_asked_hybrid('asked')}
    SELECT qid, refused, CASE WHEN refused THEN 'refuse' ELSE 'extractive' END AS mode, answer, v_ok AS ok FROM {_judged('r', 'answer', 'v_')}""")
def ask_grounded(spark: SparkSession, d: str) -> DataFrame:
    """From questions to validated answers, refusal questions included, by hybrid retrieval."""
    own = Retriever.build(spark, table(spark, d, "chunks").unionByName(sentinel_row(spark), allowMissingColumns=True), HashingEmbedder(128))
    asked = table(spark, d, "labeled").select("qid", "query").unionByName(table(spark, d, "refuse"))
    return own.ask(asked).select("qid", "refused", "mode", "answer", F.col("check.ok").alias("ok"))


_BODY = """CASE qid % 9 WHEN 0 THEN '{"query":' || j || ',"k":' || (qid % 2000 - 3) || '}' WHEN 1 THEN '{"query":"[' || qid || ']","other":null}' WHEN 2 THEN '{"query":' || j || ',"x":{"a":1}}'
    WHEN 3 THEN '{"k":5}' WHEN 4 THEN '{"query": ' WHEN 5 THEN '{"query":7}' WHEN 6 THEN '{"query":' || j || ',"k":"3"}' WHEN 7 THEN ' {"query":' || j || ',"k":2.9,"x":true,"y":"{}"}' ELSE '[' || j || ']' END"""


@query(f"""
    WITH b AS (SELECT qid, {_BODY} AS body FROM (SELECT qid, to_json(coalesce(query, '{{}}'))::VARCHAR AS j FROM labeled)),
         p AS (SELECT qid, body, json_valid(body) AND CASE WHEN json_valid(body) THEN json_type(body) END = 'OBJECT' AS object, CASE WHEN json_valid(body) THEN body END AS b FROM b),
         t AS (SELECT *, CASE WHEN object AND json_type(b, '$.query') = 'VARCHAR' THEN b->>'$.query' END AS query, CASE WHEN object AND json_type(b, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN (b->>'$.k')::DOUBLE
                      WHEN object AND json_type(b, '$.k') IS NULL THEN 5 END AS k, object AND (json_type(b, '$.x') IN ('OBJECT', 'ARRAY')) AS nested FROM p)
    SELECT qid, query, trunc(k)::INT AS k, CASE WHEN NOT coalesce(object, false) THEN 'malformed JSON object' WHEN query IS NULL THEN 'query is required'
           WHEN k IS NULL OR k < 1 OR k >= 1001 THEN 'k must be between 1 and 1000' WHEN nested THEN 'nested values are not supported' END AS error FROM t""")
def parsed_requests(spark: SparkSession, d: str) -> DataFrame:
    """Sound and unsound request bodies made of the questions, parsed and checked."""
    as_json = F.regexp_replace(F.to_json(F.array(F.coalesce("query", F.lit("{}")))), r"^\[|\]$", "").alias("j")
    rows = table(spark, d, "labeled").select("qid", as_json).select("qid", F.expr(_BODY).alias("body"))
    return rows.select("qid", parse_ask(F.col("body")).alias("r")).select("qid", "r.query", "r.k", "r.error")


# similarity of questions and passages

_PAIR = f"(SELECT l.qid, {_tokens('l.query')} AS qt, {_tokens('c.text')} AS pt, {_content('l.query')} AS qc, {_content('c.text')} AS pc FROM labeled l JOIN {_STORE} c ON c.id = l.gold_id)"


def _gold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labeled").join(store(table(spark, d, "chunks")).select(F.col("id").alias("gold_id"), "text"), "gold_id")


@query(f"""
    SELECT qid, round({_jaccard('qt', 'pt')}, 6) AS token_jaccard, round({_jaccard('qc', 'pc')}, 6) AS content_jaccard,
           len(list_intersect(qc, pc))::BIGINT AS n_shared,
           round(CASE WHEN len(qc) = 0 THEN 0 ELSE len(list_filter(qc, lambda t: list_contains(pc, t))) / len(qc)::DOUBLE END, 6) AS support FROM {_PAIR}""")
def gold_similarity(spark: SparkSession, d: str) -> DataFrame:
    q, t = F.col("query"), F.col("text")
    return _gold(spark, d).select(
        "qid",
        F.round(sim.token_jaccard(q, t), 6).alias("token_jaccard"),
        F.round(sim.content_token_jaccard(q, t), 6).alias("content_jaccard"),
        F.size(sim.keyword_overlap(q, t)).cast("bigint").alias("n_shared"),
        F.round(sim.query_support(q, t), 6).alias("support"),
    )


@query(f"""
    SELECT qid, round(CASE WHEN len(qg) = 0 THEN 0 ELSE len(list_intersect(qg, pg)) / len(qg)::DOUBLE END, 6) AS coverage
    FROM (SELECT qid, {_NGRAMS.format(c='qc')} AS qg, {_NGRAMS.format(c='pc')} AS pg FROM {_PAIR})""")
def gold_ngram_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _gold(spark, d).select("qid", F.round(sim.ngram_coverage(F.col("query"), F.col("text")), 6).alias("coverage"))


def _lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence of two lists: a row of the table for each item of ``a``."""
    hits = f"list_transform({a}, lambda x: list_transform({b}, lambda y: (x = y)::INT))"
    cell = "CASE WHEN m[i] = 1 THEN coalesce(above[i - 1], 0) + 1 ELSE above[i] END"
    row = f"list_transform(range(1, len(m) + 1), lambda i: {cell})"
    # along a row lengths never fall, so each is the highest so far
    highest = f"list_transform(range(1, len(m) + 1), lambda j: list_max(({row})[1:j]))"
    return f"list_max(list_reduce({hits}, lambda above, m: {highest}, list_transform({b}, lambda y: 0)))"


def _lcs_ratio(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN (len({a}) = len({b}))::DOUBLE ELSE 2.0::DOUBLE * {_lcs(a, b)} / (len({a}) + len({b})) END"


@query(f"SELECT qid, round({_lcs_ratio('qc', 'pc')}, 6) AS similarity FROM {_PAIR}")
def gold_sequence_similarity(spark: SparkSession, d: str) -> DataFrame:
    return _gold(spark, d).select("qid", F.round(sim.sequence_similarity(F.col("query"), F.col("text")), 6).alias("similarity"))


@query(f"""
    SELECT token, {_SIGNED.format(h='h')} AS hash, ({_mixed(f'xor(h, {H.NGRAM_SALT}::UHUGEINT)')} % 4096)::INT AS bucket
    FROM (SELECT token, {_fnv('token')} AS h FROM (SELECT DISTINCT unnest({_tokens('query')}) AS token FROM labeled))""")
def token_hashes(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "labeled").select(F.explode(tx.tokens(F.col("query"))).alias("token")).distinct()
    return words.select("token", H.hash_column(F.col("token")).alias("hash"), H.mix_column(F.col("token"), H.NGRAM_SALT, 4096).alias("bucket"))


# evaluation

_REAL = "(SELECT *, row_number() OVER (PARTITION BY qid, retrieve_mode ORDER BY hit_rank, id) AS r FROM (SELECT DISTINCT qid, retrieve_mode, hit_rank, id FROM hits WHERE id <> -1) QUALIFY r <= 5)"


@query(f"""
    WITH g AS (SELECT l.qid, m.retrieve_mode, min(h.r) AS r FROM labeled l CROSS JOIN (SELECT DISTINCT retrieve_mode FROM hits) m
               LEFT JOIN {_REAL} h ON h.qid = l.qid AND h.retrieve_mode = m.retrieve_mode AND h.id = l.gold_id GROUP BY ALL)
    SELECT retrieve_mode, count(*) AS n, round(avg(coalesce((r <= 1)::DOUBLE, 0)), 6) AS recall_1, round(avg(coalesce((r <= 3)::DOUBLE, 0)), 6) AS recall_3,
           round(avg(coalesce((r <= 5)::DOUBLE, 0)), 6) AS recall_5, round(avg(coalesce(1.0::DOUBLE / r, 0)), 6) AS mrr FROM g GROUP BY retrieve_mode""")
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    labeled, hits = table(spark, d, "labeled"), table(spark, d, "hits").select("qid", "retrieve_mode", "hit_rank", "id").distinct()
    parts = [evaluation.gold_ranks(labeled, hits.where(F.col("retrieve_mode") == m)).withColumn("retrieve_mode", F.lit(m)) for m in fusion.MODES]
    m = evaluation.retrieval_metrics(parts[0].unionByName(parts[1]).unionByName(parts[2]), "retrieve_mode")
    return m.select("retrieve_mode", "n", *(F.round(c, 6).alias(c) for c in ("recall_1", "recall_3", "recall_5", "mrr")))


@query(f"SELECT l.qid, l.retrieve_mode, coalesce(h.id, -1) AS id FROM {_EVERY} l LEFT JOIN {_REAL} h ON h.qid = l.qid AND h.retrieve_mode = l.retrieve_mode AND h.r = 1")
def top_real_id(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "hits").select("qid", "retrieve_mode", "hit_rank", "id").distinct()
    first = evaluation.ranked_real(hits, 1, "retrieve_mode").select("qid", "retrieve_mode", "id")
    asked = table(spark, d, "labeled").select("qid", F.explode(F.array(*map(F.lit, fusion.MODES))).alias("retrieve_mode"))
    return asked.join(first, ["qid", "retrieve_mode"], "left").select("qid", "retrieve_mode", F.coalesce("id", F.lit(-1).cast("bigint")).alias("id"))


@query(f"SELECT qid FROM labeled WHERE {_tidy(_lower('query'))} IN (SELECT {_tidy(_lower('query'))} FROM train_pairs WHERE query IS NOT NULL) AND {_tidy(_lower('query'))} <> '' AND query IS NOT NULL")
def eval_overlap(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.overlapping(table(spark, d, "labeled"), table(spark, d, "train_pairs")).select("qid")


@query(f"SELECT qid, len(list_intersect(qc, pc))::BIGINT AS n_shared FROM {_PAIR} WHERE len(list_intersect(qc, pc)) > 0")
def gold_overlap(spark: SparkSession, d: str) -> DataFrame:
    rows = evaluation.gold_overlap(table(spark, d, "labeled"), store(table(spark, d, "chunks")))
    return rows.select("qid", F.size("shared").cast("bigint").alias("n_shared"))


@query(f"""
    WITH h AS (SELECT qid, query, gold_id, {_content('query')} AS q FROM labeled WHERE split_name = 'hard'),
         t AS (SELECT DISTINCT pos_id, {_content('query')} AS t FROM train_pairs),
         g AS (SELECT qid, h.q, {_content('c.text')} AS p FROM h JOIN {_STORE} c ON c.id = h.gold_id),
         j AS (SELECT qid, q, t, {_jaccard('q', 't')} AS j, len(list_filter(q, lambda x: list_contains(t, x))) AS a, len(list_filter(t, lambda x: list_contains(q, x))) AS b FROM h CROSS JOIN (SELECT DISTINCT t FROM t)),
         s AS (SELECT qid, {_lcs_ratio('q', 't')} AS s FROM j WHERE 2 * least(a, b) >= 0.5 * (len(q) + len(t))),
         n AS (SELECT qid, {_NGRAMS.format(c='q')} AS qg, {_NGRAMS.format(c='p')} AS pg FROM g)
    SELECT qid, 'gold_overlap' AS rule, len(list_intersect(q, p))::DOUBLE AS value FROM g WHERE len(list_intersect(q, p)) > 0
    UNION ALL SELECT qid, 'ngram_coverage', round(len(list_intersect(qg, pg)) / len(qg)::DOUBLE, 6) FROM n WHERE len(qg) > 0 AND len(list_intersect(qg, pg)) / len(qg)::DOUBLE > 0.15
    UNION ALL SELECT qid, 'sequence', round(max(s), 6) FROM s GROUP BY qid HAVING max(s) >= 0.5
    UNION ALL SELECT qid, 'jaccard', round(max(j), 6) FROM j GROUP BY qid HAVING max(j) >= 0.25
    UNION ALL SELECT qid, 'same_gold_tokens', count(DISTINCT x)::DOUBLE FROM (SELECT qid, gold_id, unnest(q) AS x FROM h) JOIN (SELECT DISTINCT pos_id AS gold_id, unnest(t) AS x FROM t) USING (gold_id, x)
        WHERE strlen(x) >= 4 GROUP BY qid""")
def hard_leaks(spark: SparkSession, d: str) -> DataFrame:
    hard = table(spark, d, "labeled").where("split_name = 'hard'")
    rows = evaluation.hard_leaks(hard, table(spark, d, "train_pairs"), store(table(spark, d, "chunks")))
    return rows.select("qid", "rule", F.round("value", 6).alias("value"))


@query(f"""
    WITH {_asked_hybrid('refuse')} SELECT count(*) AS n, coalesce(avg(refused::INT), 0)::DOUBLE AS idk_rate, coalesce(avg(refused::INT), 0)::DOUBLE AS empty_used_rate,
        coalesce(avg(refused::INT), 0)::DOUBLE AS pass_rate, count(*) FILTER (NOT refused) AS n_failed FROM r""")
def refusal_metrics(spark: SparkSession, d: str) -> DataFrame:
    """In the primary mode, with the sentinel, so that answers by cosine count as failures."""
    own = Retriever.build(spark, table(spark, d, "chunks").unionByName(sentinel_row(spark), allowMissingColumns=True), HashingEmbedder(128))
    return evaluation.refusal_metrics(own.ask(table(spark, d, "refuse")))


@query(f"""
    WITH {_ANSWERS}, v AS (SELECT *, coalesce(list_contains(v_cited, gold_id), false) AS gold FROM {_judged('r', 'answer', 'v_')})
    SELECT retrieve_mode, count(*) AS n, round(avg((NOT refused)::INT), 6) AS answer_rate, round(coalesce(avg(v_ok::INT) FILTER (NOT refused), 0), 6) AS validator_ok_rate,
           round(coalesce(avg(gold::INT) FILTER (NOT refused AND gold_id IS NOT NULL), 0), 6) AS gold_cited_rate, round(coalesce(avg((len(v_illegal) > 0)::INT) FILTER (NOT refused), 0), 6) AS illegal_rate,
           round(avg((NOT refused AND v_ok AND gold AND len(v_illegal) = 0)::INT), 6) AS full_pass_rate FROM v GROUP BY retrieve_mode""")
def grounding_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = evaluation.grounding_metrics(_answers(spark, d), table(spark, d, "labeled"), "retrieve_mode")
    return m.select("retrieve_mode", "n", *(F.round(c, 6).alias(c) for c in m.columns if c.endswith("_rate")))


@query("SELECT date_trunc('hour', asked_at)::TIMESTAMP AS start, retrieve_mode, count(*) AS n_hits, count(*) FILTER (id = -1) AS n_refusable FROM hits GROUP BY ALL")
def hits_by_hour(spark: SparkSession, d: str) -> DataFrame:
    """The stream's windowed counts over the whole log as a batch."""
    return hit_counts(table(spark, d, "hits"))


# loading with rejects


_FIELD = '(?:"(?:[^"]|"")*"|[^"\\t][^\\t]*|)'


def _unquoted(x: str) -> str:
    return f"CASE WHEN starts_with({x}, '\"') THEN replace({x}[2:-2], '\"\"', '\"') ELSE {x} END"


def _records(feed: str) -> str:
    """(rec_id, feed, raw_line, reason, a, b, c) of a feed's records, fields unquoted."""
    columns, place = rejects.FEEDS[feed]
    names = "abc"[:columns]
    groups = ", ".join(f"'{n}'" for n in names)
    own = names[place]
    return f"""
        SELECT *, CASE WHEN NOT regexp_full_match(line, '{_FIELD}(?:\\t{_FIELD})*') THEN 'quoting' WHEN NOT whole THEN 'columns'
                       WHEN NOT regexp_full_match({own}, '[+-]?[0-9]+') OR TRY_CAST({own} AS BIGINT) IS NULL OR TRY_CAST({own} AS BIGINT) < -1 OR (TRY_CAST({own} AS BIGINT) = -1 AND {'b' if feed == 'chunks' else "'system'"} <> 'system') THEN 'value' END AS reason
        FROM (SELECT rec_id, feed, raw_line, line, whole, {', '.join(f"{_unquoted(f'f.{n}')} AS {n}" for n in names)}{'' if columns == 3 else ', NULL AS c'} FROM (
            SELECT *, regexp_full_match(line, '{_FIELD}' || repeat('\\t{_FIELD}', {columns - 1})) AS whole, regexp_extract(line, '\\A({_FIELD})' || repeat('\\t({_FIELD})', {columns - 1}) || '\\z', [{groups}]) AS f
            FROM (SELECT *, regexp_replace(raw_line, '\\r\\z', '') AS line FROM raw_records WHERE feed = '{feed}') WHERE line <> '' AND NOT starts_with(raw_line, '#')))"""


_LOADED = f"""
    SELECT rec_id, feed, reason, CASE WHEN reason IS NULL THEN a::BIGINT END AS id, CASE WHEN reason IS NULL THEN b END AS source, CASE WHEN reason IS NULL THEN c END AS text, NULL::VARCHAR AS query,
           CASE WHEN reason IS NOT NULL THEN raw_line END AS raw_line FROM ({_records('chunks')})
    UNION ALL SELECT rec_id, feed, reason, CASE WHEN reason IS NULL THEN b::BIGINT END, NULL, NULL, CASE WHEN reason IS NULL THEN a END, CASE WHEN reason IS NOT NULL THEN raw_line END FROM ({_records('train_pairs')})"""


@query(f"SELECT rec_id, reason FROM ({_LOADED}) WHERE reason IS NOT NULL")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.rejected(table(spark, d, "raw_records"))


@query(_LOADED)
def p4_loaded(spark: SparkSession, d: str) -> DataFrame:
    """Every record of both feeds: sound ones with their types, the others with their reason."""
    return rejects.load(table(spark, d, "raw_records"))


@query(f"""
    SELECT (SELECT coalesce(max(id) FILTER (id >= 0), -1) + 1 FROM chunks) + row_number() OVER (ORDER BY rec_id) - 1 AS id, source, text
    FROM ({_LOADED}) WHERE reason IS NULL AND feed = 'chunks' AND id >= 0 AND {_tidy('text')} <> ''""")
def incremental_add(spark: SparkSession, d: str) -> DataFrame:
    """The sound uploads appended to the store under new ids."""
    batch = rejects.loaded(table(spark, d, "raw_records"), "chunks").where((F.col("id") >= 0) & ~tx.is_blank(F.col("text")))
    return Retriever.build(spark, table(spark, d, "chunks"), HashingEmbedder(64)).add(batch)[1]
