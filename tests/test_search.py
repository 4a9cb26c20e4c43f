"""Top-k search and closest lists against brute force, on small data of awkward kinds."""

import random

import numpy as np
import pytest

from lanternspark.functions.similarity import lcs_ratio
from lanternspark.operators import closest, dense, ivf, sparse
from lanternspark.operators.embedders import simple_tokens
from lanternspark.service.json_api import parse_ask


@pytest.mark.parametrize("segment", [40, 1 << 21])
def test_bm25_against_brute_force(frame, monkeypatch, segment):
    monkeypatch.setattr(sparse, "SEGMENT", segment)
    rng = random.Random(3)
    common, rare = ["the", "of", "is"], [f"w{i}" for i in range(30)]
    text = lambda: " ".join([*rng.choices(common, k=6), *rng.choices(rare, k=rng.randint(0, 5))])
    docs = [(i, "s", text()) for i in range(60)] + [(60, None, None), (61, "s", ""), (62, "s", "the " * 500)]
    asked = [(i, text()) for i in range(20)] + [(20, None), (21, "zzz"), (22, "the of is"), (23, "the the the")]
    index = sparse.Bm25.build(frame("id bigint, source string, text string", *docs, docs[0]).repartition(3))
    tokens = {i: simple_tokens(t) for i, _, t in docs}
    n, mean = len(tokens), np.mean([len(t) for t in tokens.values()])
    df = {t: sum(t in set(own) for own in tokens.values()) for own in tokens.values() for t in own}

    def score(q, own):
        return sum(np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * own.count(t) * 2.2 / (own.count(t) + 1.2 * (0.25 + 0.75 * len(own) / mean)) for t in simple_tokens(q) if t in own)

    for k in (1, 3, 100):
        got = {}
        for r in index.search(frame("qid bigint, query string", *asked), k).collect():
            got.setdefault(r.qid, {})[r.hit_rank] = (r.id, round(r.score, 6))
        for i, q in asked:
            best = sorted(((-round(score(q, own), 9), d) for d, own in tokens.items() if score(q, own) > 0))[:k]
            assert [got.get(i, {}).get(j + 1) for j in range(len(best))] == [(d, round(-s, 6)) for s, d in best]
            assert len(got.get(i, {})) == len(best)


def test_one_id_with_two_texts_is_read_the_same_way_always(frame):
    rows = [(1, "b", "later"), (1, "a", "early"), (1, "a", "early"), (2, None, None), (None, "x", "y")]
    for own in (rows, rows[::-1]):
        assert [tuple(r) for r in sparse.store(frame("id bigint, source string, text string", *own)).orderBy("id").collect()] == [(1, "a", "early"), (2, None, None)]


def test_dense_search_against_brute_force(frame, monkeypatch):
    monkeypatch.setattr(dense, "SCORES", 64)
    rng = np.random.default_rng(2)
    vecs = rng.integers(-2, 3, (80, 4)).astype(float)  # many ties
    rows = [(i, v.tolist()) for i, v in enumerate(vecs)]
    asked = [(i, v.tolist()) for i, v in enumerate(vecs[:10])]
    odd = [(900, None), (None, [1.0, 0.0, 0.0, 0.0]), (901, [1.0]), (902, [None, 0.0, 0.0, 1.0])]
    got = {}
    for r in dense.search(frame("qid bigint, vec array<double>", *asked, (77, None)), frame("id bigint, vec array<double>", *rows, *odd).repartition(3), 5).collect():
        got.setdefault(r.qid, []).append((r.hit_rank, r.id))
    unit = dense.unit(vecs)
    for q in range(10):
        best = sorted(((-round(float(unit[q] @ unit[i]), 9), i) for i in range(80)))[:5]
        assert [i for _, i in sorted(got[q])] == [i for _, i in best]
    assert set(got) == set(range(10))


def test_partitioned_search(frame):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(12, 16)) * 2
    vecs = [(i, v.tolist()) for i, v in enumerate(middle[rng.integers(0, 12, 600)] + rng.normal(size=(600, 16)))]
    vecs += [(600 + i, vecs[0][1]) for i in range(300)]  # a third of the rows in one list
    rows = frame("id bigint, vec array<double>, list int", *[(*v, 7) for v in vecs], (None, vecs[0][1], 7), (2000, None, 7), (2001, [1.0], 7)).repartition(4)
    asked = frame("qid bigint, vec array<double>", *vecs[:40], (70, None), (71, [1.0]))
    index = ivf.InvertedFile.build(rows, 12)
    assert index.lists.count() == 900
    exact = dense.search(asked.where("qid < 70"), rows.where("size(vec) = 16"), 8)
    every = index.search(asked, 8, probes=12)
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, exact.collect()))
    assert ivf.recall(index.search(asked, 8, probes=4), exact).first().recall >= 0.9
    empty = ivf.InvertedFile.build(rows.limit(0))
    assert empty.search(asked, 8).count() == 0 and index.search(asked.limit(0), 8).count() == 0


@pytest.mark.parametrize("segment", [30, 1 << 21])
def test_closest_against_brute_force(frame, monkeypatch, segment):
    monkeypatch.setattr(closest, "SEGMENT", segment)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(12)]
    draw = lambda: rng.choices(words, k=rng.randint(1, 7))
    asked, others = [(i, draw()) for i in range(40)], [draw() for _ in range(80)]
    for s, j in ((0.5, 0.25), (0.8, 0.6), (1.0, 1.0)):
        rows = closest.closest(frame("qid bigint, q array<string>", *asked, (99, []), (98, None)), frame("t array<string>", *[(t,) for t in others], ([],), (None,)), s, j)
        got = {r.qid: (r.s, r.j) for r in rows.collect()}
        for i, q in asked:
            high_s = max(lcs_ratio(q, t) for t in others)
            high_j = max(len(set(q) & set(t)) / len(set(q) | set(t)) for t in others)
            assert (i in got) == (high_s >= s or high_j >= j)
            if i in got:
                assert got[i] == pytest.approx((high_s if high_s >= s else s, high_j if high_j >= j else j), abs=1e-8)
        assert not {98, 99} & set(got)


def test_requests_are_told_by_their_types(frame):
    bodies = {
        '{"query":"[when does water boil]"}': (None, "[when does water boil]", 5), '{"query":"{}","k":2.9}': (None, "{}", 2), '{"query":"a","x":"[1]","y":null}': (None, "a", 5),
        '{"query":"a","x":[]}': ("nested values are not supported", "a", 5), '{"query":"a","k":"3"}': ("k must be between 1 and 1000", "a", None),
        '{"query":null}': ("query is required", None, 5), '{"query":["a"]}': ("query is required", None, 5), '[]': ("malformed JSON object", None, None), '"x"': ("malformed JSON object", None, None),
        "": ("malformed JSON object", None, None), '{"query":"a","k":0.5}': ("k must be between 1 and 1000", "a", 0), '{"query":"a","k":1001}': ("k must be between 1 and 1000", "a", 1001), None: ("malformed JSON object", None, None),
    }
    rows = frame("body string", *[(b,) for b in bodies])
    got = {r.body: r.r for r in rows.select("body", parse_ask(rows.body).alias("r")).collect()}
    assert {b: (r.error, r.query, r.k) for b, r in got.items()} == bodies
