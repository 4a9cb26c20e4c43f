import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternspark import catalog
from lanternspark.__main__ import parser, smoke
from lanternspark.functions.constants import NO_EVIDENCE_TEXT, OUT_OF_SCOPE
from lanternspark.operators import chunking, grounding
from lanternspark.operators import evaluation as ev
from lanternspark.operators.embedders import ContrastiveEmbedder, HashingEmbedder, MeanEmbedder
from lanternspark.operators.training import ContrastiveConfig, Word2VecConfig, out_of_scope_pairs, train_contrastive, train_word2vec, with_sentinel
from lanternspark.plans import prompts as chat
from lanternspark.plans import suite
from lanternspark.plans.retriever import Retriever, add_to_index, sentinel_row
from lanternspark.service.json_api import answer_json
from lanternspark.service.rag import RagService, respond
from lanternspark.sources import files, index, tsv
from lanternspark.streaming.jobs import hit_counts, ingest

TEXTS = [
    "The heron nests in reeds beside slow rivers",
    "Copper wire conducts electric current with little loss",
    "Glaciers carve deep valleys as they slide downhill",
    "Bees store honey in wax cells through the winter",
    "A cache keeps recent pages in memory for fast reads",
    "Comets grow bright tails when they near the sun",
]
PAIRS = [
    ("where does the heron nest", 0), ("bird living in reeds", 0), ("which metal conducts current", 1), ("copper electric loss", 1),
    ("what carves deep valleys", 2), ("ice sliding downhill", 2), ("who stores honey in winter", 3), ("wax cells insects", 3),
    ("what keeps recent pages", 4), ("fast memory reads", 4), ("what grows tails near the sun", 5), ("bright objects by the sun", 5),
]
CHUNKS = "id bigint, source string, text string"


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(i, "s", t) for i, t in enumerate(TEXTS)], CHUNKS)


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(PAIRS, "query string, pos_id bigint")


SMALL = ContrastiveConfig(dim=32, epochs=60, ngram_buckets=256, bigram_buckets=256, hard_start_epoch=20)


def test_contrastive_beats_chance_and_refuses(spark, chunks, pairs):
    own = Retriever.build_contrastive(spark, chunks, pairs, SMALL, mode="dense")
    queries = spark.createDataFrame([(n, q, i) for n, (q, i) in enumerate((("heron in reeds", 0), ("copper current", 1), ("valleys carved by ice", 2), ("honey in wax", 3), ("pages in memory", 4), ("tails of comets", 5)))], "qid bigint, query string, gold_id bigint")
    assert own.sizes() == {"size": 7, "real_size": 6, "index_size": 7}
    row = ev.retrieval_metrics(ev.gold_ranks(queries, own.retrieve(queries, 5))).first()
    assert row.recall_1 >= 0.8
    asked = spark.createDataFrame([(n, q) for n, q in enumerate(OUT_OF_SCOPE[:6])], "qid bigint, query string")
    assert ev.refusal_metrics(own.ask(asked)).first().pass_rate >= 0.8
    again = train_contrastive(with_sentinel(list(enumerate(TEXTS))), PAIRS, SMALL)
    assert np.array_equal(again.rows, train_contrastive(with_sentinel(list(enumerate(TEXTS))), PAIRS, SMALL).rows)
    loaded = index.parse_weights(index.dump_weights(again))
    assert np.allclose(loaded.embed(["heron reeds"]), again.embed(["heron reeds"]))
    for bad in (b"nope", index.dump_weights(again)[:-4]):
        with pytest.raises(ValueError):
            index.parse_weights(bad)


def trained_on(spark, monkeypatch, chunks, pairs, most_chunks, most_pairs):
    """The chunks' ids and the pairs that build_contrastive hands to the trainer."""
    from lanternspark.plans import retriever

    class Stop(Exception):
        pass

    def take(rows, chosen, _):
        raise Stop({i for i, _ in rows if i >= 0}, [p for p in chosen if p[1] >= 0])

    monkeypatch.setattr(retriever, "MAX_CHUNKS", most_chunks)
    monkeypatch.setattr(retriever, "MAX_PAIRS", most_pairs)
    monkeypatch.setattr(retriever, "train_contrastive", take)
    with pytest.raises(Stop) as stopped:
        Retriever.build_contrastive(spark, chunks, pairs)
    return stopped.value.args


def test_training_keeps_the_pairs_of_its_chunks(spark, monkeypatch):
    ids = F.col("id")
    chunks = spark.range(15_000).select("id", F.lit("s").alias("source"), F.concat(F.lit("text "), ids).alias("text"))
    pairs = spark.range(10_500).select(F.concat(F.lit("query "), ids).alias("query"), ids.alias("pos_id"))
    there, chosen = trained_on(spark, monkeypatch, chunks, pairs.union(pairs), 12_000, 50_000)
    assert len(there) == 12_000 and sorted(i for _, i in chosen) == list(range(10_500))
    there, chosen = trained_on(spark, monkeypatch, chunks, pairs, 2_000, 1_000)  # fewer chunks than are named
    assert len(there) == 2_000 and max(there) < 10_500 and len(chosen) == 1_000 and {i for _, i in chosen} <= there


def test_a_frequent_query_does_not_fill_the_sample(spark, monkeypatch):
    chunks = spark.range(300).select("id", F.lit("s").alias("source"), F.lit("text").alias("text"))
    hot = spark.range(1000).select(F.concat(F.lit("hot "), "id").alias("q")).orderBy(F.xxhash64("q")).first().q  # of a small hash
    own = F.col("id") % 3 == 0
    for copies in (1, 100):  # a third of the rows: one pair again and again, or many pairs
        pairs = spark.range(300).select(F.when(own, hot).otherwise(F.concat(F.lit("query "), "id")).alias("query"), F.when(own, F.col("id") % copies).otherwise(F.col("id")).alias("pos_id"))
        _, chosen = trained_on(spark, monkeypatch, chunks, pairs, 300, 60)
        assert len(chosen) == len(set(chosen)) == 60 and sum(q == hot for q, _ in chosen) < 40


def test_training_variants_and_errors():
    docs = list(enumerate(TEXTS))
    for c in (ContrastiveConfig(dim=8, epochs=3, full_doc_softmax=False, max_negatives=3), ContrastiveConfig(dim=8, epochs=3, query_query_weight=0.1, hard_start_epoch=0)):
        assert np.isfinite(train_contrastive(docs, PAIRS, c).rows).all()
    with pytest.raises(ValueError):
        train_contrastive(docs, [("x", 99)])
    with pytest.raises(ValueError):
        with_sentinel([(-1, "fake")])
    assert len(out_of_scope_pairs(85)) == 112 and len(out_of_scope_pairs(3)) == 56
    w = train_word2vec(TEXTS, Word2VecConfig(dim=8, epochs=2, doc_repeat=1))
    assert w.has("heron") and not w.embed(["zzz"]).any() and np.linalg.norm(w.embed(["heron reeds"])) == pytest.approx(1)


def test_hybrid_order_is_by_cosine(spark, chunks):
    own = Retriever.build(spark, chunks, HashingEmbedder(64))
    queries = spark.createDataFrame([(1, "heron reeds rivers"), (2, ""), (3, "unknown zebra")], "qid bigint, query string")
    rows = own.retrieve(queries, 3).where("qid = 1").orderBy("hit_rank").collect()
    assert rows[0].id == 0 and [r.score for r in rows] == sorted((r.score for r in rows), reverse=True) and all(r.score_is_cosine for r in rows)
    for kind in ("rrf", "weighted"):
        own.set_hybrid_config(type(own.config)(fusion=kind))
        assert own.retrieve(queries, 3).where("qid = 1").orderBy("hit_rank").first().id == 0
    with pytest.raises(ValueError):
        own.set_hybrid_config(type(own.config)(fusion="none"))
    assert {r.qid: r.id for r in own.top_real_id(queries).collect()}[1] == 0
    answered = {r.qid: r for r in own.ask(queries).collect()}
    assert answered[2].refused and not answered[2].candidates


def test_index_round_trip_and_append(spark, chunks, tmp_path):
    own = Retriever.build(spark, chunks.unionByName(sentinel_row(spark)), HashingEmbedder(16))
    meta = own.save(f"{tmp_path}/one")
    assert (meta.n_chunks, meta.n_real_chunks, meta.has_no_evidence) == (7, 6, 1)
    batch = spark.createDataFrame([(99, "n", "New text one"), (100, "n", "New text two")], CHUNKS).coalesce(1)
    new = add_to_index(spark, f"{tmp_path}/one", batch, f"{tmp_path}/two")
    assert sorted((r.id, r.text) for r in new.collect()) == [(6, "New text one"), (7, "New text two")]
    opened = Retriever.open(spark, f"{tmp_path}/two")
    assert opened.sizes() == {"size": 9, "real_size": 8, "index_size": 9}
    kept, _ = own.add(batch, renumber=False)
    assert kept.chunks.where("id in (99, 100)").count() == 2
    for rows in ([(6, "n", " ")], [(-1, "system", NO_EVIDENCE_TEXT)], [(3, "n", "x")], [(8, "n", "x"), (8, "n", "y")]):
        with pytest.raises(ValueError):
            own.add(spark.createDataFrame(rows, CHUNKS), renumber=False)
    with pytest.raises(ValueError):
        add_to_index(spark, f"{tmp_path}/one", batch, f"{tmp_path}/one/")
    broken = meta.__class__(**{**meta.__dict__, "n_chunks": 3})
    with pytest.raises(ValueError):
        index.validate_index(broken, opened.chunks, opened.vectors)


def test_weights_keep_both_bucket_counts(spark, tmp_path):
    rng = np.random.default_rng(0)
    own = ContrastiveEmbedder({"heron": 0, "reeds": 1}, rng.normal(size=(2 + 64 + 16, 8)), 64, 16)
    index.save_weights(spark, own, f"{tmp_path}/w")
    meta = index.IndexMeta(embedder_id=own.id, dim=8)
    loaded = index.load_embedder(spark, meta, f"{tmp_path}/w")
    assert (loaded.ngrams, loaded.bigrams) == (64, 16)
    assert np.allclose(loaded.embed(["heron in reeds"]), own.embed(["heron in reeds"]))
    old = spark.createDataFrame([("token", "a", 0, [1.0] * 8), ("bucket", None, 1, [1.0] * 8)], "kind string, name string, n int, vec array<float>")
    old.write.parquet(f"{tmp_path}/old")
    with pytest.raises(ValueError):
        index.load_embedder(spark, meta, f"{tmp_path}/old")


def test_word_vectors_in_binary_form():
    own = MeanEmbedder({"heron": 0, "été": 1}, np.array([[1.0, 2.0], [3.0, 4.0]]))
    data = index.dump_weights(own)
    # magic, version, size, words, then each word's length, bytes and row
    assert data[:4] == b"NW2V" and data[4:16] == struct.pack("<3I", 1, 2, 2) and data[16:23] == b"\x05\x00heron" and data[23:31] == np.array([1, 2], "<f4").tobytes()
    back = index.parse_weights(data)
    assert back.vocab == own.vocab and np.array_equal(back.rows, own.rows)
    for bad in (data[:-1], data[:20], data[:3], struct.pack("<4s3I", b"NW2V", 1, 2, 0), struct.pack("<4s3I", b"NW2V", 2, 2, 1)):
        with pytest.raises(ValueError):
            index.parse_weights(bad)


def test_look_ups_and_a_fake_sentinel(spark, chunks):
    own = Retriever.build(spark, chunks, HashingEmbedder(8))
    assert own.contains(0, 3) and not own.contains(0, 77) and [r.text for r in own.get(2, 77).collect()] == [TEXTS[2]]
    fake = chunks.unionByName(spark.createDataFrame([(-1, "system", "not the fixed text")], CHUNKS))
    other = Retriever.build(spark, fake, HashingEmbedder(8))
    with pytest.raises(ValueError):
        index.validate_index(index.describe(fake, other.embedder), other.chunks, other.vectors)


def test_a_configuration_without_the_default_row(frame):
    config = frame("source string, strategy string, max_chars bigint, overlap_chars bigint, min_chars bigint, prefer_word_break boolean", ("a", "window", 30, 0, 1, True))
    docs = frame("doc_id bigint, text string, source string", (1, "word " * 20, "a"), (2, "word " * 20, "zzz"), (3, "word " * 20, None))
    got = {}
    for r in chunking.chunk_rows(docs, config, "doc_id", "text", "source").collect():
        got.setdefault(r.key, []).append(r.text)
    assert len(got[1]) > 3 and got[2] == got[3] == [("word " * 20).strip()]


def test_answers_as_json(frame):
    hit = "struct<id:bigint,score:double,source:string,text:string,score_is_cosine:boolean>"
    one, two = (4, 0.25, "s", 'Herons "fish" in\tthe reeds.', True), (9, 0.5, None, "Other", True)
    rows = frame(f"qid bigint, query string, candidates array<{hit}>, used array<{hit}>", (1, "herons?", [one, two], [one]), (2, None, [two], []))
    got = {r.qid: json.loads(r.body) for r in answer_json(grounding.answers(rows)).collect()}
    first = {"id": 4, "score": 0.25, "source": "s", "text": one[3]}
    assert got[1]["citations"] == [first] and got[1]["candidates"] == [first, {"id": 9, "score": 0.5, "source": None, "text": "Other"}]
    assert got[1]["mode"] == "extractive" and got[1]["grounding"]["ok"] and not got[1]["refused"]
    assert got[2]["refused"] and got[2]["query"] is None and got[2]["citations"] == [] and got[2]["grounding"]["reason"] == "ok: refused with empty context"


def test_chat_settings(spark, tmp_path):
    (tmp_path / "m.meta.txt").write_text("chat_family=llama3\nhas_chat_template=1\ndefault_system=Be brief\nother=1\n")
    meta = chat.load_meta(spark, f"{tmp_path}/m.bin")
    assert (meta.chat_family, meta.has_chat_template, meta.default_system) == ("llama3", True, "Be brief")
    assert chat.load_meta(spark, f"{tmp_path}/none.bin").chat_family == "raw"
    assert chat.generation_settings(chat.ChatOptions(max_new_tokens=9, stop=("X",)), meta) == {"chat_family": "llama3", "max_new_tokens": 9, "temperature": 0.0, "stop": ["X", "<|eot_id|>"]}
    with pytest.raises(ValueError):
        chat.generation_settings(chat.ChatOptions(chat_family="hf_jinja"), meta)


def test_grounding_suite_counts_failures(spark, chunks):
    assert suite.validator_negatives(spark) == []
    own = Retriever.build(spark, chunks, HashingEmbedder(64), mode="sparse")
    labeled = spark.createDataFrame([(1, "heron nests in reeds", 0), (2, "zebra zebra", 1)], "qid bigint, query string, gold_id bigint")
    asked = spark.createDataFrame([(1, ""), (2, "purple dragons"), (3, "copper wire conducts")], "qid bigint, query string")
    report = suite.grounding(own, labeled, asked)
    assert (report["failed_in_domain"], report["failed_out_of_scope"], report["failed_validator"]) == (1, 1, 0)


def test_meta_rules():
    m = index.IndexMeta(embedder_id="hashing-v1", dim=4, n_chunks=3, n_real_chunks=2, has_no_evidence=1)
    assert index.parse_meta(index.dump_meta(m)) == m
    old = index.parse_meta("embedder_id=hashing-v1\ndim=4\nn_chunks=3\nhas_no_evidence=1\nother=7\n")
    assert old.version == 0 and old.n_real_chunks == 2
    for bad in ("dim=0", "metric=l2", "metric=zzz", "version=9", "embedder_id=", "has_no_evidence=2"):
        with pytest.raises(ValueError):
            index.parse_meta(index.dump_meta(m) + bad + "\n")


def test_tsv(spark, tmp_path):
    p = tmp_path / "chunks.tsv"
    p.write_text("# comment\n\n3\ta\ttext\twith tab\n12abc\tb\tmore\n-1\tsystem\t" + NO_EVIDENCE_TEXT + "\n")
    rows = tsv.load_chunks(spark, str(p))
    assert [(r.id, r.source, r.text) for r in rows.orderBy("ord").collect()][:2] == [(3, "a", "text\twith tab"), (12, "b", "more")]
    tsv.save_chunks(rows, f"{tmp_path}/out")
    assert tsv.load_chunks(spark, f"{tmp_path}/out").count() == 3
    for body in ("1\ta\tb\n1\ta\tc\n", "-5\ta\tb\n", "1\tonly one tab\n", "x\ta\tb\n"):
        p.write_text(body)
        with pytest.raises(Exception):  # noqa: B017 - raised here or by Spark
            tsv.load_chunks(spark, str(p)).collect()
    q = tmp_path / "pairs.tsv"
    q.write_text("Who is it\t4\n# c\nWHO  is it\t5\n")
    assert [r.pos_id for r in tsv.load_train_pairs(spark, str(q)).orderBy("ord").collect()] == [4, 5]
    # a condition on a column may be evaluated on comment lines as well
    assert tsv.load_train_pairs(spark, str(q)).where("pos_id > 4 and length(query) > 1").count() == 1
    assert tsv.train_query_set(tsv.load_train_pairs(spark, str(q))).count() == 1 and tsv.load_refuse(spark, str(q)).count() == 2
    q.write_text("a\t-1\n")
    with pytest.raises(Exception):  # noqa: B017
        tsv.load_labeled(spark, str(q)).collect()
    q.write_text("# none\n")
    with pytest.raises(ValueError):
        tsv.load_labeled(spark, str(q))
    assert tsv.load_labeled(spark, str(q), allow_empty=True).count() == 0 and tsv.demo_paths("r")["hard"] == "r/eval/retrieval_hard.tsv"


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "b.md").write_text("# Head\nA sentence of some length here.\n")
    (tmp_path / "a.txt").write_text("A first paragraph that is long.\n\nA second paragraph, as long.")
    (tmp_path / "README").write_text("No ending, but text all the same.")
    (tmp_path / "x.bin").write_bytes(b"\x00\x01")
    rows = files.chunk_files(spark, str(tmp_path)).orderBy("id").collect()
    assert [r.id for r in rows] == [0, 1, 2, 3] and [r.source for r in rows] == ["README", "a.txt", "a.txt", "d/b.md#Head"]


def test_evaluation_rules(spark, frame):
    hits = frame("qid bigint, id bigint, hit_rank int", (1, -1, 1), (1, 3, 2), (1, 1, 3), (1, 7, 4), (2, 5, 1))
    labeled = frame("qid bigint, query string, gold_id bigint", (1, "q", 1), (2, "q", 9), (3, "q", 1))
    ranks = {r.qid: r.gold_rank for r in ev.gold_ranks(labeled, hits).collect()}
    assert ranks == {1: 2, 2: None, 3: None}
    row = ev.retrieval_metrics(ev.gold_ranks(labeled, hits)).first()
    assert (row.n, row.recall_1, round(row.recall_3, 4), round(row.mrr, 4)) == (3, 0.0, 0.3333, 0.1667)
    train = frame("query string, pos_id bigint", ("  HELLO   world ", 1), ("bird reeds nest place", 1), (None, None))
    with pytest.raises(ValueError):
        ev.assert_disjoint(frame("query string", ("hello world",)), train)
    ev.assert_disjoint(frame("query string", ("other",), (None,)), train)
    chunks = frame(CHUNKS, (1, "s", "herons like water"))
    hard = frame("qid bigint, query string, gold_id bigint", (1, "herons swim", 1), (2, "bird reeds nest place", 1), (3, "qqq www", 1))
    rules = {(r.qid, r.rule) for r in ev.hard_leaks(hard, train, chunks).collect()}
    assert {(1, "gold_overlap"), (1, "ngram_coverage"), (2, "sequence"), (2, "jaccard"), (2, "same_gold_tokens")} == rules
    with pytest.raises(ValueError):
        ev.assert_zero_keyword_overlap(hard, chunks)
    assert ev.check_gates({"easy_recall_1": 1, "easy_mrr": 1, "refuse_pass": 1, "grounding_pass": 1}) == []
    assert len(ev.check_gates({"easy_recall_1": 0.5, "hashing_easy_recall_1": 0.9})) == 5
    assert "mrr" in ev.format_report({"mrr": 0.5})


def test_hard_queries_without_content_tokens_leak(frame):
    chunks = frame(CHUNKS, (1, "s", "herons like water"))
    hard = frame("qid bigint, query string, gold_id bigint", (1, None, 1), (2, " ", 1), (3, "what is the", 9), (4, "qqq www", 1))
    schema, sound = "query string, pos_id bigint", ("bird reeds nest place", 1)
    for empty in (None, "  ", "is it the"):
        rows = sorted((r.qid, r.rule, r.value) for r in ev.hard_leaks(hard, frame(schema, sound, (empty, 2), (empty, 3)), chunks).collect())
        assert rows == [(q, rule, 1.0) for q in (1, 2, 3) for rule in ("jaccard", "sequence")]
    assert ev.hard_leaks(hard, frame(schema, sound), chunks).count() == 0


def test_refusal_metrics_count_near_answers(spark, frame, tmp_path):
    frame(CHUNKS, *((i, "s", t) for i, t in enumerate(TEXTS))).write.parquet(str(tmp_path / "chunks.parquet"))
    asked = [(1, TEXTS[0] + " quietly"), (2, "zzz qqq"), (3, " ")]
    frame("qid bigint, query string", *asked).write.parquet(str(tmp_path / "refuse.parquet"))
    row = catalog.queries()["refusal_metrics"](spark, str(tmp_path)).first()
    assert (row.n, row.n_failed) == (3, 1)


def test_service(spark, chunks):
    service = RagService(spark, Retriever.build(spark, chunks, HashingEmbedder(64), mode="sparse"))
    status, body = respond(service, "POST", "/ask", '{"query":"heron nests in reeds","k":2}')
    got = json.loads(body)
    assert status == 200 and [c["id"] for c in got["citations"]] == [0] and len(got["candidates"]) <= 2
    assert respond(service, "POST", "/ask", "{}")[0] == 400 and respond(service, "GET", "/health", "")[0] == 200
    assert respond(service, "GET", "/ask", "")[0] == 405 and respond(service, "GET", "/no", "")[0] == 404 and respond(service, "OPTIONS", "/x", "")[0] == 204


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "s", "text a", "2025-01-01 00:00:00"), (1, "s", "text a", "2025-01-01 00:00:00"), (None, "s", "x", "2025-01-01 00:00:00")], "id bigint, source string, text string, added_at string")
    rows.withColumn("added_at", F.to_timestamp("added_at")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id bigint, source string, text string, added_at timestamp").parquet(f"{tmp_path}/in")
    job = ingest(stream, HashingEmbedder(8), f"{tmp_path}/out", f"{tmp_path}/ck")
    job.processAllAvailable()
    job.stop()
    assert spark.read.parquet(f"{tmp_path}/out/chunks").count() == 1 and len(spark.read.parquet(f"{tmp_path}/out/vectors").first().vec) == 8
    hits = spark.createDataFrame([(-1, "dense", "2025-01-01 00:10:00"), (4, "dense", "2025-01-01 00:50:00")], "id bigint, retrieve_mode string, t string").withColumn("asked_at", F.to_timestamp("t"))
    assert [(r.n_hits, r.n_refusable) for r in hit_counts(hits).collect()] == [(2, 1)]


def test_command_line(spark):
    assert smoke(spark) == []
    assert parser().parse_args(["ask", "--index", "i", "-q", ""]).k == 5
    with pytest.raises(SystemExit):
        parser().parse_args(["chunk"])


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't there")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_against_sql(spark, name):
    import duckdb

    got = catalog.queries()[name](spark, DATA)
    rows = got.collect()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got.columns
        return
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    assert sorted(names) == sorted(got.columns)
    order = [got.columns.index(n) for n in names]
    mine = sorted(map(repr, (tuple(clean(r[k]) for k in order) for r in rows)))
    theirs = sorted(map(repr, (tuple(clean(v) for v in r) for r in want)))
    assert mine == theirs


def clean(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if hasattr(v, "replace") and hasattr(v, "tzinfo"):
        return v.replace(tzinfo=None)
    return v
