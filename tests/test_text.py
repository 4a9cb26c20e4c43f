import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lanternspark.functions import similarity as sim
from lanternspark.functions import text as tx
from lanternspark.functions.constants import OUT_OF_SCOPE, STOP_WORDS
from lanternspark.functions.hashing import HashTable, bucket, fnv1a64, hash_column, mix64, ngram_buckets
from lanternspark.operators.embedders import simple_tokens

TEXTS = [None, "", "   ", "Cats chase the mice, don't they? GLASS boss's classes", "Ça, Ärger und Été—naïve", "a\tb\nc  ", "v1.2.3 boils at 373.15. Next! \"Quoted.\" (End.) tail", "x" * 50_000]


def run(frame, column, *texts):
    rows = frame("n int, text string", *enumerate(texts))
    return [r[0] for r in rows.orderBy("n").select(column(F.col("text"))).collect()]


def test_tokens_agree_with_the_python_form(frame):
    assert run(frame, tx.tokens, *TEXTS) == [simple_tokens(t) for t in TEXTS]
    assert simple_tokens("GLASS cats bus buses") == ["glass", "cats", "bus", "buse"]
    assert simple_tokens("tests") == ["test"]


def test_content_tokens_drop_stop_words(frame):
    assert run(frame, tx.content_tokens, "What is the boiling point of iron", None) == [["boiling", "iron"], []]
    assert len(STOP_WORDS) == 75 and len(OUT_OF_SCOPE) == 28


def test_white_space_and_refusals(frame):
    assert run(frame, tx.sanitize, "  a\tb\nc  \x0b\f", None) == ["a b c", None]
    assert run(frame, tx.normalize_query, "  Hello   World  ") == ["hello world"]
    assert run(frame, tx.is_blank, None, " \n", "x") == [True, True, False]
    assert run(frame, tx.is_dont_know, "I  DON'T know", "I don't know.", "I do not know", "I don't know but", None) == [True, False, True, False, False]


def test_citations_in_first_seen_order_and_overflow(frame):
    assert run(frame, tx.citation_ids, "a [#10] b [20] c [#10] [ -3 ]", "none", None, "[1] [99999999999999999999] [2]") == [[10, 20, -3], [], [], [1]]


def test_sentences_paragraphs_sections(frame):
    assert run(frame, tx.split_sentences, "Boils at 373.15. Next fact continues. v1.2.3 stays (yes.) tail") == [["Boils at 373.15.", "Next fact continues.", "v1.2.3 stays (yes.)", "tail"]]
    assert run(frame, tx.split_paragraphs, "a\nb\r\n\r\nc\n \nd", None) == [["a b", "c d"], []]
    got = run(frame, tx.markdown_sections, "pre\n# One\nbody\n## Two \n#No\n", "", None)
    assert [[(s.heading, s.body.strip()) for s in x] for x in got] == [[("", "pre"), ("One", "body"), ("Two", "#No")], [("", "")], [("", "")]]


def test_join_source(frame):
    rows = frame("a string, b string", ("x", "y"), ("", "y"), ("x", ""), (None, "y"), ("x", None))
    assert [r[0] for r in rows.select(tx.join_source(F.col("a"), F.col("b"))).collect()] == ["x#y", "y", "x", "y", "x"]


def test_hashes(frame):
    assert fnv1a64(b"") == 14695981039346656037 and fnv1a64(b"a") == 0xAF63DC4C8601EC8C
    assert mix64(0) == 0xE220A8397B1DCDAF
    assert len(ngram_buckets("cat", 64)) == 5 and all(0 <= b < 64 for b in ngram_buckets("cat", 64))
    assert bucket(b"x", 1, 7) == mix64(fnv1a64(b"x") ^ 1) % 7
    got = run(frame, hash_column, "cat", None, "é")
    assert [None if g is None else g % (1 << 64) for g in got] == [fnv1a64(b"cat"), None, fnv1a64("é".encode())]
    small = HashTable(2)
    assert [small[t] for t in "abcab"] == [fnv1a64(t.encode()) for t in "abcab"] and len(small) <= 2


def test_set_similarities(frame):
    rows = frame("a string, b string", ("red cat", "red dog"), ("", ""), ("cat", ""), (None, None), ("red red cat runs", "red cat"))
    got = rows.select(sim.token_jaccard(F.col("a"), F.col("b")), sim.query_support(F.col("a"), F.col("b")), sim.ngram_coverage(F.col("a"), F.col("b")), sim.sequence_similarity(F.col("a"), F.col("b"))).collect()
    assert [round(r[0], 4) for r in got] == [0.3333, 1.0, 0.0, 1.0, 0.6667]
    assert [round(r[1], 4) for r in got] == [0.5, 0.0, 0.0, 0.0, 0.75]
    assert got[1][2] == 0.0 and [round(r[3], 4) for r in got] == [0.5, 1.0, 0.0, 1.0, 0.6667]


def test_cosine_edges(frame):
    rows = frame("n int, a array<float>, b array<float>", (0, [1.0, 0.0], [1.0, 1.0]), (1, [0.0, 0.0], [1.0, 1.0]), (2, [1.0], [1.0, 1.0]), (3, [], []), (4, None, [1.0]))
    got = [r[1] for r in rows.select("n", sim.cosine(F.col("a"), F.col("b"))).orderBy("n").collect()]
    assert got == [pytest.approx(2**-0.5), 0.0, 0.0, 0.0, 0.0]
    assert [round(x, 3) for x in rows.where("n = 0").select(sim.l2_normalize(F.col("b"))).first()[0]] == [0.707, 0.707]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc")), st.lists(st.sampled_from("abc")))
def test_lcs_against_recursion(a, b):
    def lcs(x, y):
        if not x or not y:
            return 0
        return 1 + lcs(x[1:], y[1:]) if x[0] == y[0] else max(lcs(x[1:], y), lcs(x, y[1:]))

    a, b = a[:7], b[:7]
    want = 2 * lcs(a, b) / (len(a) + len(b)) if a and b else float(not a and not b)
    assert sim.lcs_ratio(a, b) == pytest.approx(want)


def test_ngrams(frame):
    got = run(frame, tx.content_ngrams, "cat cat", "", None)
    marked = "^cat$"
    assert sorted(got[0]) == sorted({marked[i : i + n] for n in (3, 4) for i in range(len(marked) - n + 1)}) and got[1:] == [[], []]
    assert re.fullmatch(r"[\^\$a-z]+", "".join(got[0]))
