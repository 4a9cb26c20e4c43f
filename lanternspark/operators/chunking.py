"""Chunkers. Sentences, paragraphs and sections are Column expressions; windows and packing go step by
step through a text's bytes, so they run in Arrow batches on the workers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternspark.session import cut

STRATEGIES = {
    "paragraph": "paragraph", "para": "paragraph", "sentence": "sentence", "sent": "sentence",
    "window": "window", "fixed": "window", "markdown": "markdown", "md": "markdown",
}


@dataclass(frozen=True)
class ChunkerConfig:
    """All sizes are bytes."""

    strategy: str = "paragraph"
    max_chars: int = 800
    overlap_chars: int = 100
    start_id: int = 0
    source: str = "doc"
    prefer_word_break: bool = True
    min_chars: int = 20

    def __post_init__(self) -> None:
        object.__setattr__(self, "strategy", parse_strategy(self.strategy))
        if self.max_chars <= 0:
            raise ValueError("max_chars must be over 0")
        if self.start_id < 0:
            raise ValueError("start_id must not be negative: negative ids are reserved for the sentinel")


def parse_strategy(name: str) -> str:
    if name not in STRATEGIES:
        raise ValueError(f"chunk strategy {name!r} is none of {', '.join(sorted(STRATEGIES))}")
    return STRATEGIES[name]


_RUN = re.compile(rb"[ \t\n\r\f\x0b]+")
_SENTENCE = re.compile(rb"(?s).*?(?:[!?]|(?<![0-9])\.|\.(?![0-9]))[\"')\]]*|.+$")
_HEADING = re.compile(rb"(?m)^(?=#{1,6} )")


def tidy(raw: bytes) -> bytes:
    """Runs of white space as one space, ends trimmed."""
    return _RUN.sub(b" ", raw).strip(b" ")


def floor(raw: bytes, at: int) -> int:
    """The start of the code point that ``at`` lies in."""
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    return at


def sentences(raw: bytes) -> list[bytes]:
    return [s for s in (tidy(m.group()) for m in _SENTENCE.finditer(raw)) if s]


def paragraphs(raw: bytes) -> list[bytes]:
    return [p for p in map(tidy, re.split(rb"\n{2,}", raw.replace(b"\r", b""))) if p]


def sections(raw: bytes) -> list[tuple[bytes, bytes]]:
    out = []
    for part in _HEADING.split(raw):
        if re.match(rb"#{1,6} ", part):
            line, _, body = part.partition(b"\n")
            out.append((tidy(line.lstrip(b"#")), tidy(body)))
        else:
            out.append((b"", tidy(part)))
    return [s for s in out if any(s)] or [(b"", tidy(raw))]


def windows(raw: bytes, c: ChunkerConfig) -> list[bytes]:
    """Stretches of at most max_chars, ended at a space where one lies in the last three quarters, each
    starting overlap_chars before the end of the one before. A short last stretch is left out."""
    text = tidy(raw)
    out: list[bytes] = []
    at, n = 0, len(text)
    while at < n:
        end = min(at + c.max_chars, n)
        if end < n:
            if c.prefer_word_break:
                # the byte at ``end`` may itself be the space
                space = text.rfind(b" ", at + 1, end + 1)
                if space > at + c.max_chars // 4:
                    end = space
            end = floor(text, end)
            if end <= at:  # narrower than a code point: take it whole
                end = at + 1
                while end < n and text[end] & 0xC0 == 0x80:
                    end += 1
        piece = tidy(text[at:end])
        if piece and (end < n or len(piece) >= c.min_chars or not out):
            out.append(piece)
        if end >= n:
            break
        back = floor(text, max(end - c.overlap_chars, 0))
        at = back if back > at else end
    return out


def pack(units: list[bytes], c: ChunkerConfig) -> list[bytes]:
    """Units joined greedily up to max_chars; a new run starts with the tail of the piece before it."""
    out: list[bytes] = []
    run = b""

    def close() -> None:
        done = tidy(run)
        if done and (len(done) >= c.min_chars or not out):
            out.append(done)

    for unit in units:
        if len(unit) > c.max_chars:
            if run and len(run) < c.min_chars:  # too short to stand alone: its text goes along
                unit = run + b" " + unit
            else:
                close()
            out += windows(unit, c)
            run = b""
        elif not run:
            run = unit
        elif len(run) + 1 + len(unit) <= c.max_chars:
            run += b" " + unit
        else:
            close()
            run = unit
            if c.overlap_chars and out and len(out[-1]) > c.overlap_chars:
                tail = tidy(out[-1][floor(out[-1], len(out[-1]) - c.overlap_chars) :])
                seeded = tail + b" " + unit if tail else unit
                if len(seeded) <= c.max_chars:
                    run = seeded
    close()
    return out


def _pieces(raw: bytes, c: ChunkerConfig) -> list[bytes]:
    if c.strategy == "window":
        return windows(raw, c)
    if c.strategy == "sentence":
        return pack(sentences(raw), c)
    out: list[bytes] = []
    for p in paragraphs(raw):
        if len(p) > c.max_chars:
            out += windows(p, c)
        elif len(p) >= c.min_chars or not out:
            out.append(p)
    return out


def chunk_text(text: str | None, c: ChunkerConfig, source: str | None = None) -> list[tuple[str, str]]:
    """(source, text) of every chunk of a text, in order; none for null or blank texts."""
    if not text:
        return []
    base = source or c.source
    raw = text.encode("utf-8", "surrogatepass")
    if c.strategy == "markdown":
        sub = replace(c, strategy="sentence")
        found = []
        for heading, body in sections(raw):
            name = heading.decode("utf-8", "replace")
            label = f"{base}#{name}" if base and name else base or name
            found += [(label, t) for _, t in chunk_text((heading + b". " + body if heading else body).decode("utf-8", "replace"), sub, "-")]
        return found
    kept: list[bytes] = []
    for p in _pieces(raw, c):
        if p and len(p) < c.min_chars and kept and len(kept[-1]) + 1 + len(p) <= 2 * c.max_chars:
            kept[-1] = tidy(kept[-1] + b" " + p)
        elif p:
            kept.append(p)
    return [(base, p.decode("utf-8", "replace")) for p in kept]


def _chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (key, text, source, strategy, max_chars, overlap_chars, min_chars, prefer_word_break)."""
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [])
        for key, text, source, strategy, most, overlap, least, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            c = ChunkerConfig(strategy, most, overlap, 0, source or "doc", words, least)
            for pos, (label, piece) in enumerate(chunk_text(text, c)):
                for column, value in zip(out, (key, pos, label, piece), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.column(0).type), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], names=["key", "pos", "source", "text"])


def chunk_rows(docs: DataFrame, config: ChunkerConfig | DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(key, pos, source, text): the chunks of every document in order.

    ``config`` is one for all, or a table by ``source`` whose row ``doc`` serves documents without their
    own, and the defaults of ChunkerConfig those of a table without that row. A null source counts as
    ``doc``. Null and blank texts give no chunk. ``key`` keeps its type.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(F.col(source), F.lit("doc")).alias("source"))
    names = ("strategy", "max_chars", "overlap_chars", "min_chars", "prefer_word_break")
    if isinstance(config, ChunkerConfig):
        rows = rows.select("*", *(F.lit(getattr(config, n)).alias(n) for n in names))
    else:
        table = config.groupBy(F.col("source").alias("_s")).agg(F.min(F.struct(*names)).alias("_own"))
        other = table.where("_s = 'doc'").select(F.col("_own").alias("_doc"))  # a row at most
        rows = rows.join(table, F.substring_index("source", "#", 1) == F.col("_s"), "left").join(F.broadcast(other), F.lit(True), "left")
        rows = rows.select("key", "text", "source", *(F.coalesce(F.col(f"_own.{n}"), F.col(f"_doc.{n}"), F.lit(getattr(ChunkerConfig(), n))).alias(n) for n in names))
    kind = dict(rows.dtypes)["key"]
    return rows.mapInArrow(_chunk, f"key {kind}, pos int, source string, text string")


def number(chunks: DataFrame, start_id: int = 0) -> DataFrame:
    """``id`` from start_id on, over all chunks by (key, pos), without sorting all rows in one task.

    Each range partition is numbered by itself; the offsets of the partitions come from their counts.
    """
    rows = cut(chunks.repartitionByRange("key", "pos").sortWithinPartitions("key", "pos").withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_at", 33)).withColumn("_in", F.col("_at").bitwiseAND((1 << 33) - 1))
    counts = {r["_part"]: r["n"] for r in rows.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # a row a partition
    first, base = [], start_id
    for part in sorted(counts):
        first.append((part, base))
        base += counts[part]
    offsets = F.broadcast(chunks.sparkSession.createDataFrame(first, "_part bigint, _first bigint"))  # a row a partition
    return rows.join(offsets, "_part").withColumn("id", F.col("_first") + F.col("_in")).drop("_at", "_part", "_in", "_first")
