import random
import re
from itertools import combinations

import numpy as np
import pytest

from lanternspark.llm import near_duplicates as nd
from lanternspark.llm.copies import HiddenCopies
from lanternspark.llm.overlap import Shard, SplitOverlap, class_key, merged
from lanternspark.llm.words import Fingerprints, shingles, words

DOCS = "id bigint, text string, rep string, shingles int"


def corpus(n=120, seed=5):
    """Families of edited texts, copies, and texts of their own."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    out = []
    while len(out) < n:
        base = [word() for _ in range(rng.choice((6, 30, 60)))]
        for _ in range(rng.choice((1, 1, 4))):
            own = base[:]
            for _ in range(rng.choice((0, 1, 3, 8))):
                own[rng.randrange(len(own))] = word()
            out.append(" ".join(own))
    return out[:n]


def triples(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_pairs_and_groups_against_brute_force(frame):
    texts = [*corpus(), None, "", "two words", "ten thousand " * 3000, "Ten, THOUSAND! " * 3000]
    rows = [(i, t, "clash", 0) for i, t in enumerate(texts)]
    docs = frame(DOCS, *rows, rows[3], (None, texts[3], "x", 0)).repartition(3)
    own = nd.NearDuplicates(docs, shingle=3, threshold=0.6)
    sets = {i: s for i, t in enumerate(texts) if t and (s := triples(t, 3))}
    want = {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b]) - 1e-9}
    got = [(r.id_a, r.id_b) for r in own.pairs().collect()]
    assert set(got) == want and len(got) == len(want) > 30
    groups = {r.id: r for r in own.groups().collect()}
    assert set(groups) == set(sets)
    parent = {i: i for i in sets}
    for a, b in want:
        x, y = root(parent, a), root(parent, b)
        parent[max(x, y)] = min(x, y)
    assert {i: g.group_id for i, g in groups.items()} == {i: root(parent, i) for i in sets}
    assert groups[len(texts) - 1].class_id == len(texts) - 2


def root(parent, i):
    while parent[i] != i:
        i = parent[i]
    return i


def test_one_large_bucket_is_taken_in_blocks(frame, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 7)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([*base, f"own{i}"]) for i in range(40)]
    got = nd.NearDuplicates(frame("id bigint, text string", *enumerate(texts)), shingle=5, threshold=0.8).pairs().collect()
    assert len(got) == 40 * 39 // 2


def test_empty_tables(frame):
    own = nd.NearDuplicates(frame("id bigint, text string", (1, None)))
    assert own.pairs().count() == 0 and own.groups().count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 62, 900, dtype=np.uint64)
    b = np.concatenate([a[:600], rng.integers(0, 1 << 62, 300, dtype=np.uint64)])
    width = 320
    turns = np.lib.stride_tricks.sliding_window_view(nd._ranks(7, width), width)
    same = (nd.signature(a, turns) == nd.signature(b, turns)).mean()
    assert abs(same - 600 / 1200) < 0.1


def test_overlaps_in_slices():
    rows = [np.array(x) for x in ([1, 2, 3], [2, 3, 4], [9], [1, 2, 3, 4])]
    for width in (1, 2, 100):
        got = nd.overlaps(rows, width)
        assert all(got[i, j] == len(set(rows[i].tolist()) & set(rows[j].tolist())) for i in range(4) for j in range(4) if i != j)


def test_components_of_a_path_and_a_star(frame):
    edges = [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)] + [("star", f"s{i}") for i in range(50)]
    got = nd.components(frame("a string, b string", *edges)).collect()
    assert len(got) == 61 + 51 and len({r.label for r in got}) == 2
    assert nd.components(frame("a string, b string", ("x", "x"))).count() == 0


def test_words_and_shingles():
    assert words("Été_2024 x²—½ İs") == ["été", "2024", "x²", "½", "i̇s"] and words(None) == []
    h = Fingerprints().of(["a", "b", "c", "a", "b", "c"])
    s = shingles(h, 3)
    assert len(s) == 4 and s[0] == s[3] and len(set(s.tolist())) == 3 and len(shingles(h, 7)) == 0


EVAL = "qid bigint, query string, line string"
TRAIN = "pair_id bigint, query string, class_key string"


@pytest.mark.parametrize("shard", [20, 500_000])
def test_overlap_against_brute_force(frame, monkeypatch, shard):
    from lanternspark.llm import overlap

    monkeypatch.setattr(overlap, "SHARD_WORDS", shard)
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(40)]
    train = [" ".join(rng.sample(vocab, rng.randint(1, 8))) for _ in range(150)]
    evals = [", ".join(reversed(rng.choice(train).upper().split())) for _ in range(30)] + [" ".join(rng.sample(vocab, 6)) for _ in range(10)] + [None, "", "?!", "word " * 5000]
    e = frame(EVAL, *[(i, t, "x") for i, t in enumerate(evals)], (0, evals[0], "x"))
    t = frame(TRAIN, *[(1000 + i, x, "x") for i, x in enumerate(train)], (1999, None, "x"), (1000, train[0], "x"))
    got = [(r.eval_id, r.train_id) for r in SplitOverlap(e, t, "qid", "pair_id", "query", 0.7).pairs().collect()]
    sets = lambda rows: {i: s for i, x in rows if (s := set(words(x)))}
    want = {(i, 1000 + j) for i, a in sets(enumerate(evals)).items() for j, b in sets(enumerate(train)).items() if len(a & b) >= 0.7 * len(a | b) - 1e-9}
    assert set(got) == want and len(got) == len(want) >= 30
    n = {r.eval_id: r.n for r in SplitOverlap(e, t, "qid", "pair_id", "query", 0.7).counts().collect()}
    assert n == {i: sum(a == i for a, _ in want) for i in {a for a, _ in want}}
    assert SplitOverlap(e.limit(0), t, "qid", "pair_id", "query", 0.7).pairs().count() == 0


def shard_of(*texts, threshold=0.7):
    return Shard([(class_key(words(t)), words(t)) for t in texts], threshold)


def test_matched_intervals_are_merged():
    assert merged([(4, 6), (0, 2), (1, 3), (3, 4), (8, 9)]) == [(0, 6), (8, 9)] and merged([]) == []
    record = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    shard = shard_of(record)
    # half of the record stands there twice: counted without merging it would be covered in full
    half = words("alpha beta gamma delta epsilon x1 x2 x3 x4 x5 alpha beta gamma delta epsilon")
    assert shard.scan(half) == []
    ((_, covered, common, either),) = shard.scan(words("so " + record.replace("zeta", "zita")))
    assert (covered, common, either) == (9, 9, 12)
    # every other word reversed: no passage of two words is whole, the sets are equal
    ((_, covered, common, either),) = shard.scan(words(record)[::-1])
    assert covered < common == either == 10


def test_a_lone_word_counts_for_the_sets_but_for_no_interval():
    record = "one two three four five six seven eight nine ten"
    text = "one x two three four five six seven eight nine ten"
    ((_, covered, common, either),) = shard_of(record).scan(words(text))
    assert common == 10 and either == 11 and covered <= common


def test_copies_against_brute_force(frame):
    rng = random.Random(4)
    vocab = ["Red cat", "blue", "Ärger", "x 1", "x1", "??"]
    texts = [rng.choice([" | ", ";", "|"]).join(rng.sample(vocab, rng.randint(1, 4))) for _ in range(200)]
    texts += [t.upper() + " !" for t in texts[:50]] + [None, "", "?;|", "ab", "ba", "long " * 4000, " LONG" * 4000]
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    own = HiddenCopies(frame("id bigint, text string, key string", *rows, rows[0], (None, "Red cat", "x")), "id", "text")
    groups = {}
    for i, t in enumerate(texts):
        key = tuple(sorted(f for f in (" ".join(words(p)) for p in re.split("[|;]", t or "")) if f))
        if key:
            groups.setdefault(key, []).append(i)
    want = {(g[0], i) for g in groups.values() for i in g[1:]}
    assert {(r.keep_id, r.copy_id) for r in own.copies().collect()} == want
    assert {r.keep_id: r.n_copies for r in own.collapsed().collect()} == {g[0]: len(g) for g in groups.values()}
    assert HiddenCopies(frame("id bigint, text string", (1, None)), "id", "text").copies().count() == 0
