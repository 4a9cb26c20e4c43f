"""Problem 3: texts over a size limit are cut into pieces at natural boundaries, with overlap.

A text's white-space runs become one space and its ends are trimmed; every byte that stays keeps its place in
the raw text. Prefix sums turn code points into byte offsets; each kind of boundary has a sorted array of
byte offsets: ends of paragraphs and beginnings of headings, which the raw white space tells, ends of
lines, of sentences, of clauses and of words. A piece ends at the last boundary under the limit, found by
binary search, strongest kind first; without one it is cut hard between code points. The next piece starts
the overlap earlier, so every byte is in a piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternspark.session import cut

#: Boundaries lie behind these matches: ends of sentences and of clauses.
SENTENCE, CLAUSE = (re.compile(p) for p in (r"[.!?…。！？]+[\"'”’)\]]*(?: |(?<=[。！？]))", r"[,;:] "))
#: White space, runs of which become one space.
BLANK = b" \t\n\r\f\x0b"
#: Ids that aren't unique up to which they are sent to the texts; of more, the texts go to them.
FEW = 1_000_000
#: Kinds of boundaries that a piece must be half full for, else a weaker one serves better.
STRONG = 4


def squeezed(text: str) -> tuple[bytes, np.ndarray, list[np.ndarray]]:
    """The text squeezed, as bytes, the place of each in the raw text, and the offsets behind white space that
    ends a paragraph or stands before a heading, that holds a line break, and of any kind."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    blank = np.isin(raw, np.frombuffer(BLANK, np.uint8))
    ink = np.flatnonzero(~blank)
    if not len(ink):
        return b"", ink, [ink] * 3
    first = blank & ~np.concatenate([[True], blank[:-1]])  # of each run the first byte
    first[: ink[0]] = False
    first[ink[-1] :] = False
    at = np.flatnonzero(~blank | first)
    out = raw[at]
    gaps = np.flatnonzero(blank[at])
    out[gaps] = 32
    after = at[gaps + 1]  # where the raw text goes on
    feeds = np.concatenate([[0], np.cumsum(raw == 10)])
    lines = feeds[after] - feeds[at[gaps]]
    strong = (lines > 1) | ((lines > 0) & (raw[after] == 35))
    return out.tobytes(), at, [gaps[strong] + 1, gaps[lines > 0] + 1, gaps + 1]


def cut_points(text: str, limit: int, overlap: int, gaps: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Byte ranges of the pieces of a squeezed text, with its ``gaps`` as ``squeezed`` tells them, or else spaces; each is of ``limit`` bytes at most, but never under a code point.

    Consecutive pieces share ``overlap`` bytes, less what is needed to start at a code point, behind the
    start of the piece before and within the limit. Every piece goes on beyond the one before it.
    """
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    if n <= limit:
        return [(0, n)] if n else []
    #: starts[i] is the byte offset of code point i: the prefix sums of the code points' sizes.
    starts = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    starts = np.append(starts, n)
    none = np.empty(0, np.int64)
    paragraphs, lines, spaces = gaps if gaps is not None else (none, none, np.flatnonzero(np.frombuffer(raw, np.uint8) == 32) + 1)
    sentences, clauses = (starts[np.fromiter((m.end() for m in p.finditer(text)), np.int64)] for p in (SENTENCE, CLAUSE))
    kinds = [paragraphs, lines, sentences, clauses, spaces]
    out, at, done = [], 0, 0
    while True:
        if n - at <= limit:
            out.append((at, n))
            return out
        end = -1
        for k, marks in enumerate(kinds):
            low = max(done, at + (limit // 2 if k < STRONG else 0))
            i = int(np.searchsorted(marks, at + limit, "right")) - 1
            if i >= 0 and marks[i] > low:
                end = int(marks[i])
                break
        if end < 0:
            end = int(starts[np.searchsorted(starts, at + limit, "right") - 1])
            if end <= max(at, done):
                end = int(starts[np.searchsorted(starts, max(at, done), "right")])
        out.append((at, end))
        if end >= n:
            return out
        back = int(starts[np.searchsorted(starts, max(end - overlap, at + 1), "left")])
        done = end
        step = int(starts[np.searchsorted(starts, done, "right")])  # the next piece must reach beyond this one
        if step - back > limit:
            back = int(starts[np.searchsorted(starts, step - limit, "left")])
        at = min(back, end)


PIECES = "id bigint, piece_no int, n_pieces int, start bigint, stop bigint, raw_start bigint, raw_stop bigint, piece string"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    names = [c.split()[0] for c in PIECES.split(", ")]
    for batch in batches:
        out: tuple[list, ...] = tuple([] for _ in types)
        for i, text, limit, overlap in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            raw, place, gaps = squeezed(text)
            ranges = cut_points(raw.decode("utf-8", "surrogatepass"), max(1, limit), max(0, min(overlap, limit - 1)), gaps)
            for k, (a, b) in enumerate(ranges):
                row = (i, k, len(ranges), a, b, int(place[a]), int(place[b - 1]) + 1, raw[a:b].decode("utf-8", "surrogatepass"))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)


def with_limits(chunks: DataFrame, config: DataFrame, default: str = "doc") -> DataFrame:
    """(id, text, max_chars, overlap_chars): the raw text with the limits of its source's label.

    The label is the source up to the first ``#``; an unknown label or a null source takes ``default``.
    ``config`` is one row per label and joins by Spark's own size check; of several the least stays.
    """
    limits = config.groupBy(F.col("source").alias("label")).agg(F.min(F.struct("max_chars", "overlap_chars")).alias("own"))
    other = limits.where(F.col("label") == default).select(F.col("own").alias("other"))
    rows = chunks.select(F.col("id").cast("bigint").alias("id"), "text", F.substring_index("source", "#", 1).alias("label")).where("text is not null and id is not null")
    rows = rows.join(limits, "label", "left").join(other, F.lit(True), "left")
    return rows.select("id", "text", *(F.coalesce(F.col("own")[c], F.col("other")[c]).alias(c) for c in ("max_chars", "overlap_chars")))


def pieces(chunks: DataFrame, config: DataFrame, default: str = "doc") -> DataFrame:
    """(id, piece_no, n_pieces, start, stop, raw_start, raw_stop, piece): every text as ordered pieces within its limit.

    ``start`` and ``stop`` are bytes of the squeezed text, ``raw_start`` and ``raw_stop`` of the text as it came,
    so its white space can be had back. Null texts and ids give no piece, nor do blank texts. Rows
    delivered twice give their pieces once; only rows whose id isn't unique are shuffled for that. A limit
    under 1 counts as 1, and a code point that is itself over the limit is a piece of its own. An overlap
    is held between 0 and the limit less one. Rows without any configuration are left whole. Of a
    configuration only max_chars and overlap_chars count.
    """
    rows = with_limits(chunks, config, default)
    twice = cut(chunks.groupBy(F.col("id").cast("bigint").alias("id")).agg(F.count("*").alias("n")).where("n > 1 and id is not null").select("id"))
    if twice.count() <= FEW:
        twice = F.broadcast(twice)
    rows = rows.join(twice, "id", "left_anti").unionByName(rows.join(twice, "id", "left_semi").distinct())
    rows = rows.select("id", "text", F.coalesce("max_chars", F.lit(2**62)).alias("m"), F.coalesce("overlap_chars", F.lit(0)).alias("o"))
    return rows.mapInArrow(_pieces, PIECES)
