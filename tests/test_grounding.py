import json

import pytest
from pyspark.sql import functions as F

from lanternspark.functions import constants as C
from lanternspark.operators import grounding as g
from lanternspark.plans import prompts
from lanternspark.service.json_api import answer_json, error_json, number, parse_ask

HITS = "qid bigint, id bigint, score double, hit_rank int, score_is_cosine boolean"
CHUNKS = "id bigint, source string, text string"


@pytest.fixture
def collected(frame):
    chunks = frame(CHUNKS, (10, "w", "Water boils at 373.15 kelvin"), (20, "x", "Iron melts late."), (30, None, None), (-1, "system", C.NO_EVIDENCE_TEXT))
    queries = frame("qid bigint, query string", (1, "When does water boil kelvin boils"), (2, "  "), (3, None), (4, "ethanol boiling temperature"), (5, "iron melts"))
    hits = frame(HITS, (1, -1, 0.95, 1, True), (1, 10, 0.92, 2, True), (1, 20, 0.15, 3, True), (2, 10, 0.99, 1, True), (4, 10, 3.5, 1, False), (5, 20, 4.2, 1, False), (5, 99, 4.0, 2, False), (5, 30, None, 3, None))
    return g.collect(g.gated(g.with_text(hits, chunks), queries), queries)


def test_gate_and_answers(collected):
    got = {r.qid: r for r in g.answers(collected).collect()}
    assert [h.id for h in got[1].used] == [10] and [h.id for h in got[1].candidates] == [-1, 10, 20]
    assert got[1].answer == "Evidence from retrieved passages: Water boils at 373.15 kelvin. [#10]" and got[1].check.ok
    assert got[5].answer == "Evidence from retrieved passages: Iron melts late. [#20]"
    assert [h.source for h in got[5].candidates] == ["x", "?", None] and got[5].candidates[1].text == C.MISSING_TEXT
    for q in (2, 3, 4):
        assert got[q].refused and got[q].answer == C.DONT_KNOW and got[q].check.reason == C.REASON_REFUSED_EMPTY


@pytest.mark.parametrize(
    ("answer", "reason"),
    [
        ("I don't know", C.REASON_REFUSED),
        ("Water boils [#99]", C.REASON_ILLEGAL),
        ("Water boils", C.REASON_UNCITED),
        ("Purple dragons sing loudly [#10]", "answer not supported by context tokens (support=0.000000)"),
        ("Yes. [#10]", "answer not supported by context tokens (support=0.000000)"),
        ("Water boils at 373.15 kelvin [#10]", C.REASON_OK),
        (None, C.REASON_UNCITED),
    ],
)
def test_validator(collected, answer, reason):
    row = collected.where("qid = 1").select(g.validate(F.lit(answer).cast("string"), F.col("used")).alias("c")).first().c
    assert row.reason == reason and row.ok == reason.startswith("ok")
    assert row.illegal_ids == ([99] if reason == C.REASON_ILLEGAL else [])


def test_validator_without_context(collected):
    for answer, reason in (("Something", C.REASON_NO_CONTEXT), ("I don't know", C.REASON_REFUSED_EMPTY)):
        assert collected.where("qid = 2").select(g.validate(F.lit(answer), F.col("used")).alias("c")).first().c.reason == reason


def test_model_text_and_fallback(collected):
    said = F.when(F.col("qid") == 1, "Water  boils at kelvin [#10]").otherwise("Made up [#77]")
    got = {r.qid: r for r in g.finalize(collected.withColumn("model_text", said)).collect()}
    assert (got[1].mode, got[1].answer) == ("generated", "Water boils at kelvin [#10]")
    assert got[5].mode == "extractive_fallback" and got[5].check.reason.startswith("model failed grounding (cited id")
    assert got[2].mode == "refuse"


def test_model_is_called_for_contexts_only(collected):
    rows = prompts.generated(collected, lambda ps: [f"{len(p)} [#10]" for p in ps])
    assert {r.qid: r.model_text is not None for r in rows.collect()} == {1: True, 2: False, 3: False, 4: False, 5: True}


def test_prompts(collected):
    row = collected.where("qid = 1").select(g.grounded_prompt(F.col("query"), F.col("used")), g.rag_prompt(F.col("query"), F.col("candidates")), prompts.generate_prompt(F.col("query"), F.col("used"))).first()
    assert "[#10 source=w score=0.92]\nWater boils" in row[0] and row[0].endswith("Answer:") and row[0].startswith(C.SYSTEM_RULES)
    assert row[1].count("[#") == 4 and row[2].startswith("<|im_start|>system\n")
    none = collected.where("qid = 2").select(g.grounded_prompt(F.col("query"), F.col("used"))).first()[0]
    assert C.NO_PASSAGES_RULED in none
    for family, tag in (("llama3", "<|begin_of_text|>"), ("tinyllama", "<|system|>"), ("raw", "You are")):
        assert collected.where("qid = 1").select(prompts.generate_prompt(F.col("query"), F.col("used"), prompts.ChatOptions(family))).first()[0].startswith(tag)
    with pytest.raises(ValueError):
        prompts.enforce_policy("hf_jinja", prompts.ChatMeta(), False)
    assert collected.select(prompts.generate_prompt(F.col("query"), F.col("used"), prompts.ChatOptions(prompt_override="as is"))).first()[0] == "as is"


def test_json(collected, frame):
    got = {r.qid: json.loads(r.body) for r in answer_json(g.answers(collected), 1).collect()}
    assert [c["id"] for c in got[1]["citations"]] == [10] and len(got[1]["candidates"]) == 1 and got[2]["citations"] == []
    bodies = ['{"query":"a","k":3.7}', '{"k":2}', "nope", '{"query":"a","k":0}', '{"query":"a","x":{"y":1}}', '{"query":"a","x":true}', None]
    rows = frame("n int, body string", *enumerate(bodies)).select("n", parse_ask(F.col("body")).alias("r")).orderBy("n").collect()
    assert [(r.r.error is None, r.r.k) for r in rows][:1] == [(True, 3)] and [r.r.error is None for r in rows] == [True, False, False, False, False, True, False]
    assert number(1.5) == "1.5" and number(-0.0000001) == "0" and json.loads(error_json(400, 'a"b'))["error"]["message"] == 'a"b'
