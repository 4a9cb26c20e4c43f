import random
import re
from dataclasses import replace

import pytest

from lanternspark.operators.chunking import ChunkerConfig, chunk_rows, chunk_text, number, pack, paragraphs, sections, sentences, windows


def test_window_sizes_and_progress():
    got = windows(b"a" * 100, ChunkerConfig("window", 20, 5, min_chars=1))
    assert len(got) >= 4 and all(len(w) <= 20 for w in got)


def test_windows_cover_every_probe():
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(1, 9))) for _ in range(400)).encode()
    got = windows(text, ChunkerConfig("window", 120, 40, min_chars=1))
    assert all(any(text[i : i + 25] in w for w in got) for i in range(0, len(text) - 25, 7))


@pytest.mark.parametrize("size", [1, 3, 7])
def test_windows_keep_code_points_whole(size):
    for w in windows("éüñ ößä".encode() * 5, ChunkerConfig("window", size, 0, min_chars=1)):
        w.decode("utf-8")


def test_pack_seeds_with_the_tail_and_rescues_a_short_run():
    c = ChunkerConfig("sentence", 30, 8, min_chars=5)
    got = pack([b"first sentence here.", b"second one is here.", b"third."], c)
    assert got[0] == b"first sentence here." and got[1].startswith(b"ce here.") and all(len(p) <= 30 for p in got)
    long = b"x" * 50
    assert b"ab" in pack([b"ab", long], c)[0]


def test_splitters():
    assert sentences(b"Boils at 373.15. Next.") == [b"Boils at 373.15.", b"Next."]
    assert paragraphs(b"a\nb\n\nc\n \nd") == [b"a b", b"c d"]
    assert sections(b"") == [(b"", b"")] and sections(b"x\n## H\ny")[1][0] == b"H"


def test_chunk_text_strategies():
    assert chunk_text(None, ChunkerConfig()) == [] and chunk_text(" \n", ChunkerConfig()) == []
    assert chunk_text("one\n\n" + "two " * 10, ChunkerConfig(min_chars=20)) == [("doc", "one"), ("doc", ("two " * 10).strip())]
    md = chunk_text("# Top\nA body sentence that is long enough.\n## Sub\nAnother body sentence, long enough.", ChunkerConfig("md"), "f")
    assert [s for s, _ in md] == ["f#Top", "f#Sub"] and md[0][1].startswith("Top. A body")
    for bad in ({"strategy": "no"}, {"max_chars": 0}, {"start_id": -1}):
        with pytest.raises(ValueError):
            ChunkerConfig(**bad)


def test_rows_with_nulls_long_texts_and_clashing_columns(frame):
    rows = frame("doc_id bigint, text string, source string, pos string, key int", (1, None, "a", "p", 0), (2, "", None, "p", 0), (3, "word " * 40_000, None, None, None), (4, "short text but fine here", "b#x", "p", 1))
    config = frame("source string, strategy string, max_chars bigint, overlap_chars bigint, min_chars bigint, prefer_word_break boolean", ("doc", "window", 500, 50, 20, True), ("b", "sent", 100, 0, 5, False))
    got = chunk_rows(rows, config, "doc_id", "text", "source").collect()
    assert {r.key for r in got} == {3, 4} and all(len(r.text) <= 500 for r in got) and len([r for r in got if r.key == 3]) > 400
    assert chunk_rows(rows.limit(0), config, "doc_id", "text", "source").count() == 0


def test_numbering_goes_on_over_partitions(frame):
    rows = frame("key string, pos int, text string", *[(f"k{i // 3:03}", i % 3, str(i)) for i in range(60)]).repartition(4)
    got = {r.text: r.id for r in number(rows, 10).collect()}
    assert got == {str(i): 10 + i for i in range(60)}
    assert number(rows.limit(0)).count() == 0


class Plain:
    """The rules of the chunkers over lists of characters, one step at a time, for comparison."""

    def __init__(self, c):
        self.c = c

    @staticmethod
    def size(chars):
        return sum(len(x.encode()) for x in chars)

    @staticmethod
    def tidied(text):
        return " ".join(x for x in re.split("[ \t\n\r\f\x0b]+", text) if x)

    def windows(self, text):
        """Byte places of characters are counted by hand; a place inside a character goes back to its start."""
        text = self.tidied(text)
        starts, at = [], 0
        for x in text:
            starts.append(at)
            at += len(x.encode())
        total, out, here = at, [], 0
        floor = lambda b: max(s for s in [*starts, total] if s <= b)
        cut = lambda a, b: self.tidied("".join(x for x, s in zip(text, starts, strict=True) if a <= s < b))
        while here < total:
            end = min(here + self.c.max_chars, total)
            if end < total:
                spaces = [s for x, s in zip(text, starts, strict=True) if x == " " and here < s <= end]
                if self.c.prefer_word_break and spaces and spaces[-1] > here + self.c.max_chars // 4:
                    end = spaces[-1]
                end = floor(end)
                if end <= here:
                    end = min(s for s in [*starts, total] if s > here)
            piece = cut(here, end)
            if piece and (end < total or len(piece.encode()) >= self.c.min_chars or not out):
                out.append(piece)
            if end >= total:
                break
            back = floor(max(end - self.c.overlap_chars, 0))
            here = back if back > here else end
        return out

    def packed(self, units):
        out, run = [], ""
        length = lambda s: len(s.encode())
        keep = lambda s: out.append(self.tidied(s)) if self.tidied(s) and (length(self.tidied(s)) >= self.c.min_chars or not out) else None
        for unit in units:
            if length(unit) > self.c.max_chars:
                if run and length(run) < self.c.min_chars:
                    unit = f"{run} {unit}"
                else:
                    keep(run)
                out += self.windows(unit)
                run = ""
            elif run and length(run) + 1 + length(unit) <= self.c.max_chars:
                run = f"{run} {unit}"
            elif not run:
                run = unit
            else:
                keep(run)
                run = unit
                if self.c.overlap_chars and out and length(out[-1]) > self.c.overlap_chars:
                    last, tail = out[-1], ""
                    for x in reversed(last):  # back to the start of the character that the place lies in
                        tail = x + tail
                        if length(tail) >= self.c.overlap_chars:
                            break
                    tail = self.tidied(tail)
                    if tail and length(f"{tail} {unit}") <= self.c.max_chars:
                        run = f"{tail} {unit}"
        keep(run)
        return out

    def sentences(self, text):
        out, now, at = [], "", 0
        while at < len(text):
            x = text[at]
            between = x == "." and 0 < at < len(text) - 1 and text[at - 1] in DIGITS and text[at + 1] in DIGITS
            now += x
            at += 1
            if x in ".!?" and not between:
                while at < len(text) and text[at] in "\"')]":
                    now += text[at]
                    at += 1
                out.append(now)
                now = ""
        return [s for s in map(self.tidied, [*out, now]) if s]

    def paragraphs(self, text):
        return [p for p in map(self.tidied, re.split("\n\n+", text.replace("\r", ""))) if p]

    def chunks(self, text, source):
        if self.c.strategy == "markdown":
            sub, out = Plain(replace(self.c, strategy="sentence")), []
            parts = [("", [])]
            for line in text.split("\n"):
                if re.match("#{1,6} ", line):
                    parts.append((self.tidied(line.lstrip("#")), []))
                else:
                    parts[-1][1].append(line)
            for heading, lines in parts:
                body = self.tidied("\n".join(lines))
                if heading or body:
                    out += [(f"{source}#{heading}" if heading else source, t) for _, t in sub.chunks(f"{heading}. {body}" if heading else body, "-")]
            return out
        if self.c.strategy == "window":
            pieces = self.windows(text)
        elif self.c.strategy == "sentence":
            pieces = self.packed(self.sentences(text))
        else:
            pieces = []
            for p in self.paragraphs(text):
                if len(p.encode()) > self.c.max_chars:
                    pieces += self.windows(p)
                elif len(p.encode()) >= self.c.min_chars or not pieces:
                    pieces.append(p)
        out = []
        for p in pieces:
            if len(p.encode()) < self.c.min_chars and out and len(out[-1].encode()) + 1 + len(p.encode()) <= 2 * self.c.max_chars:
                out[-1] = self.tidied(f"{out[-1]} {p}")
            else:
                out.append(p)
        return [(source, p) for p in out]


DIGITS = "0123456789"


@pytest.mark.parametrize("strategy", ["window", "sentence", "paragraph", "markdown"])
def test_chunks_of_a_frame_against_plain_rules(frame, strategy):
    rng = random.Random(len(strategy))
    parts = ["alpha", "b", " ", "  ", "\n", "\n\n", "\n# Head two\n", ". ", "! ", "3.14", "é漢", "🧊", "?\") ", "\t", "longwordwithoutanyend", "\r\n", "## x\n", "Some more words here. "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(120)]
    for most, overlap, least, words in ((40, 10, 8, True), (25, 0, 1, False), (7, 3, 5, True), (200, 50, 20, True), (3, 1, 1, True)):
        c = ChunkerConfig(strategy, most, overlap, min_chars=least, prefer_word_break=words)
        got = {}
        for r in chunk_rows(frame("id bigint, text string, source string", *[(i, t, "s") for i, t in enumerate(texts)]), c, "id", "text", "source").collect():
            got.setdefault(r.key, []).append((r.pos, r.source, r.text))
        for i, t in enumerate(texts):
            assert [(s, x) for _, s, x in sorted(got.get(i, []))] == Plain(c).chunks(t, "s"), (i, c)
