import math

import numpy as np
import pytest

from lanternspark.operators import dense, fusion
from lanternspark.operators.embedders import HashingEmbedder, embed, simple_tokens
from lanternspark.operators.sparse import Bm25

CHUNKS = "id bigint, source string, text string, score double"
ROWS = [
    (1, "a", "Water boils at 373.15 kelvin under one atmosphere", 0.0),
    (2, "a", "Ethanol is a liquid", 0.0),
    (3, None, None, 0.0),
    (3, None, None, 0.0),
    (4, "b", "", 0.0),
    (-1, "system", "NO_EVIDENCE: the corpus contains no answer to this question.", 0.0),
]


def brute(query, docs):
    toks = {i: simple_tokens(t) for i, t in docs.items()}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    out = {}
    for i, t in toks.items():
        s = 0.0
        for w in simple_tokens(query):
            df = sum(w in x for x in toks.values())
            tf = t.count(w)
            if tf:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg))
        if s > 0:
            out[i] = s
    return out


def test_bm25_values_ties_and_edges(frame):
    index = Bm25.build(frame(CHUNKS, *ROWS))
    queries = frame("qid bigint, query string", (1, "water boils water"), (2, "nothing known"), (3, None), (4, "Ethanol liquid"))
    got = {(r.qid, r.id): r.score for r in index.search(queries, 5).collect()}
    docs = {i: t for i, _, t, _ in ROWS if i != -1}
    want = {(q, i): s for q, text in ((1, "water boils water"), (4, "Ethanol liquid")) for i, s in brute(text, docs).items()}
    assert got == pytest.approx(want)
    assert {r.qid: r.max_score > 0 for r in index.max_score(queries).collect()} == {1: True, 2: False, 3: False, 4: True}
    zero = index.score_ids(frame("qid bigint, id bigint", (2, 1), (1, 99)), queries).collect()
    assert [r.score for r in zero] == [0.0, 0.0]
    assert Bm25.build(frame(CHUNKS, *ROWS).limit(0)).search(queries, 3).count() == 0


def test_dense_against_brute_force(frame):
    rng = np.random.default_rng(0)
    vecs = rng.normal(size=(300, 8)).astype(np.float32)
    vecs[5] = vecs[6]
    rows = frame("id bigint, vec array<float>", *[(i, v.tolist()) for i, v in enumerate(vecs)], (900, None), (901, [1.0]), (902, [0.0] * 8)).repartition(5)
    queries = frame("qid bigint, vec array<float>", *[(i, vecs[i].tolist()) for i in range(0, 50, 5)], (77, None))
    got = {}
    for r in dense.search(queries, rows, 4).collect():
        got.setdefault(r.qid, {})[r.hit_rank] = r.id
    full = np.vstack([vecs.astype(float), np.zeros(8)])
    unit = full / np.maximum(np.linalg.norm(full, axis=1, keepdims=True), 1e-300)
    names = [*range(300), 902]
    for q in range(0, 50, 5):
        order = sorted(range(301), key=lambda j: (-round(float(unit[q] @ unit[j]), 9), names[j]))[:4]
        assert [got[q][k] for k in (1, 2, 3, 4)] == [names[j] for j in order]
    assert 77 not in got and dense.search(queries.limit(0), rows, 4).count() == 0


def test_hashing_embedder_in_a_frame(frame):
    rows = frame("id bigint, text string", (1, "cat sat"), (2, None), (3, ""))
    got = {r.id: np.array(r.vec) for r in embed(rows, HashingEmbedder(16), "id", "text").collect()}
    assert np.linalg.norm(got[1]) == pytest.approx(1) and not got[2].any() and not got[3].any()


LIST = "qid bigint, id bigint, score double, hit_rank int"


@pytest.fixture
def lists(frame):
    dense_rows = frame(LIST, (1, 10, 0.9, 1), (1, 11, 0.5, 2), (1, -1, 0.4, 3), (2, 10, 0.7, 1))
    sparse_rows = frame(LIST, (1, 11, 4.0, 1), (1, 12, 3.0, 2), (1, -1, 9.0, 3), (2, 13, 1.0, 1))
    return dense_rows, sparse_rows


def ranked(df, q=1):
    return [(r.id, round(r.score, 6)) for r in df.where(f"qid = {q}").orderBy("hit_rank").collect()]


def test_fusion_values(lists):
    d, s = lists
    assert ranked(fusion.rrf(d, s, 9))[0] == (11, round(1 / 62 + 1 / 61, 6))
    assert ranked(fusion.dense_primary(d, s, 9)) == [(10, 0.9), (11, 0.82), (12, 0.765), (-1, 0.4)]
    w = dict(ranked(fusion.weighted(d, s, 9)))
    assert w[10] == pytest.approx(0.55, abs=1e-6) and w[11] == pytest.approx(0.55 * 0.5 / 0.9 + 0.45 * 4 / 9, abs=1e-6)


def test_adaptive_fallback_and_modes(lists, frame):
    d, s = lists
    best = frame("qid bigint, max_score double", (1, 9.0), (2, 1.0))
    assert ranked(fusion.fuse(d, s, best, 5), 2) == [(10, 0.7)]
    assert ranked(fusion.fuse(d, s, best, 1, "sparse")) == [(-1, 9.0)]
    cos = frame("qid bigint, id bigint, cosine double", (1, 12, 0.99), (1, 10, 0.2))
    assert ranked(fusion.rescore_by_cosine(fusion.dense_primary(d, s, 3), cos))[0] == (12, 0.99)
    with pytest.raises(ValueError):
        fusion.parse_mode("fuzzy")
