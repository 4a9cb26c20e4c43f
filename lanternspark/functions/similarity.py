"""Similarity of vectors, token sets and token sequences."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lanternspark.functions.text import content_ngrams, content_tokens, let, tokens


def _doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    return let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: (x / n).cast("float"))).otherwise(v))


def cosine(a: Column, b: Column) -> Column:
    """Summed in doubles; 0 for null, empty or zero vectors and for different sizes."""
    found = let(norm(a) * norm(b), lambda both: F.when(both > 0, dot(a, b) / both).otherwise(0.0))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), found).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets: 1 if both are empty, 0 if one is."""
    sizes = F.struct(F.size(F.array_intersect(a, b)).alias("both"), F.size(F.array_union(a, b)).alias("either"))
    return let(sizes, lambda n: F.when(n["either"] == 0, 1.0).otherwise(n["both"] / n["either"]))


def token_jaccard(a: Column, b: Column) -> Column:
    return jaccard(tokens(a), tokens(b))


def content_token_jaccard(a: Column, b: Column) -> Column:
    return jaccard(content_tokens(a), content_tokens(b))


def keyword_overlap(query: Column, passage: Column) -> Column:
    """Distinct shared content tokens, in the query's order."""
    return F.array_intersect(content_tokens(query), content_tokens(passage))


def has_zero_keyword_overlap(query: Column, passage: Column) -> Column:
    return F.size(keyword_overlap(query, passage)) == 0


def ngram_coverage(query: Column, passage: Column) -> Column:
    """Share of the query's character n-grams that the passage has; 0 without any."""
    return let(content_ngrams(query), lambda own: F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.array_intersect(own, content_ngrams(passage))) / F.size(own)))


def support_hits(query_tokens: Column, passage_tokens: Column) -> Column:
    """How many of the query's tokens, repeated ones included, the passage has."""
    return let(passage_tokens, lambda have: F.size(F.filter(query_tokens, lambda t: F.array_contains(have, t))))


def query_support(query: Column, passage: Column) -> Column:
    return let(content_tokens(query), lambda own: F.when(F.size(own) == 0, 0.0).otherwise(support_hits(own, content_tokens(passage)) / F.size(own)))


def lcs_ratio(a: list[str], b: list[str]) -> float:
    """2 LCS / (n + m) of two sequences: 1 if both are empty, 0 if one is."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    above = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[j]))
        above = row
    return 2.0 * above[-1] / (len(a) + len(b))


def sequence_similarity(a: Column, b: Column) -> Column:
    """Longest common subsequence of the content tokens; an Arrow UDF, as no built-in function has it."""

    @F.pandas_udf("double")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([lcs_ratio(x, y) for x, y in zip(left, right, strict=True)], dtype="float64")

    return run(content_tokens(a), content_tokens(b))
