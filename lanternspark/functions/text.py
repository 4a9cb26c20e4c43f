"""Tokens, normal forms and citations of text as Column expressions; all stay inside the JVM."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanternspark.functions.constants import DONT_KNOW_FORMS, NO_EVIDENCE_ID, NO_EVIDENCE_SOURCE, NO_EVIDENCE_TEXT, STOP_WORDS

#: A run of ASCII letters and digits and of whatever lies beyond ASCII.
TOKEN = r"([0-9a-z\x{80}-\x{10FFFF}]+)"
SPACE = r"[ \t\n\r\f\x0b]+"
CITATION = r"\[#?[ \t\n\r\f\x0b]*(-?[0-9]+)[ \t\n\r\f\x0b]*\]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, even if ``use`` names it in a lambda of its own."""
    return F.element_at(F.transform(F.array(value), use), 1)


def ascii_lower(text: Column) -> Column:
    """Lower case of ASCII letters only."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def light_stem(token: Column) -> Column:
    """Without a final s, if the token has over 4 bytes and doesn't end in ss."""
    plural = (F.octet_length(token) > 4) & F.endswith(token, F.lit("s")) & ~F.endswith(token, F.lit("ss"))
    return F.when(plural, F.substring(token, F.lit(1), F.length(token) - 1)).otherwise(token)


def is_stop(token: Column) -> Column:
    return token.isin(*STOP_WORDS) | (F.octet_length(token) <= 1)


def tokens(text: Column) -> Column:
    """Stemmed tokens in order, repeated ones included; [] for a null text."""
    return F.transform(F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(1)), light_stem)


def content_tokens(text: Column) -> Column:
    """The tokens that aren't stop words."""
    return F.filter(tokens(text), lambda t: ~is_stop(t))


def normalize_ws(text: Column) -> Column:
    """Runs of white space become one space, the ends are trimmed; also the sanitised text of a chunk."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


sanitize = normalize_ws


def normalize_query(text: Column) -> Column:
    return normalize_ws(ascii_lower(text))


def is_blank(text: Column) -> Column:
    """True for null as well."""
    return F.coalesce(normalize_ws(text) == "", F.lit(True))


def is_dont_know(answer: Column) -> Column:
    """Exactly a refusal; a sentence that merely begins as one isn't."""
    return F.coalesce(normalize_query(answer).isin(*DONT_KNOW_FORMS), F.lit(False))


def is_no_evidence(chunk_id: Column) -> Column:
    return F.coalesce(chunk_id == NO_EVIDENCE_ID, F.lit(False))


def is_sentinel_row(chunk_id: Column, source: Column, text: Column) -> Column:
    """Id, source and text are all those of the sentinel."""
    return F.coalesce((chunk_id == NO_EVIDENCE_ID) & (source == NO_EVIDENCE_SOURCE) & (text == NO_EVIDENCE_TEXT), F.lit(False))


def citation_ids(answer: Column) -> Column:
    """Cited ids, each once, in order; an id over 64 bits ends the scan and the earlier ones are kept."""
    found = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(CITATION), F.lit(1))
    ids = F.transform(found, lambda x: x.try_cast("bigint"))
    first_bad = F.array_position(F.transform(ids, lambda x: x.isNull()), True)
    return F.array_distinct(F.when(first_bad > 0, F.slice(ids, F.lit(1), (first_bad - 1).cast("int"))).otherwise(ids))


def char_ngrams(token: Column) -> Column:
    """3- and 4-grams of the token between ^ and $."""
    marked = F.concat(F.lit("^"), token, F.lit("$"))

    def of(n: int) -> Column:
        last = F.length(marked) - n + 1
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(marked, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.concat(of(3), of(4))


def content_ngrams(text: Column) -> Column:
    """The distinct character n-grams of the content tokens."""
    return F.array_distinct(F.flatten(F.transform(content_tokens(text), char_ngrams)))


def join_source(base: Column, part: Column) -> Column:
    """``base#part``; if either is empty, the other."""
    return F.when(F.coalesce(part, F.lit("")) == "", base).when(F.coalesce(base, F.lit("")) == "", part).otherwise(F.concat(base, F.lit("#"), part))


def split_sentences(text: Column) -> Column:
    """Sentences: they end behind . ! ? and closing marks, but not at a dot between two digits."""
    cut = r"((?s).*?(?:[!?]|(?<![0-9])\.|\.(?![0-9]))[\"')\]]*|(?s).+$)"
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(cut), F.lit(1))
    return F.filter(F.transform(found, sanitize), lambda s: s != "")


def split_paragraphs(text: Column) -> Column:
    """Paragraphs: apart by two line feeds or more, carriage returns don't count."""
    found = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r", ""), "\n{2,}")
    return F.filter(F.transform(found, sanitize), lambda s: s != "")


def markdown_sections(text: Column) -> Column:
    """[(heading, body)], both sanitised: cut before every line that starts with one to six # and a space."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?md)^(?=#{1,6} )")

    def section(part: Column) -> Column:
        headed = F.rlike(part, F.lit(r"^#{1,6} "))
        line = F.when(headed, sanitize(F.regexp_replace(F.substring_index(part, "\n", 1), r"^#{1,6} ", ""))).otherwise("")
        body = F.when(~headed, part).when(F.instr(part, "\n") > 0, F.regexp_replace(part, r"(?d)^[^\n]*\n", "")).otherwise("")
        return F.struct(line.alias("heading"), sanitize(body).alias("body"))

    kept = F.filter(F.transform(parts, section), lambda s: (s["heading"] != "") | (s["body"] != ""))
    whole = F.array(F.struct(F.lit("").alias("heading"), sanitize(F.coalesce(text, F.lit(""))).alias("body")))
    return F.when(F.size(kept) == 0, whole).otherwise(kept)
