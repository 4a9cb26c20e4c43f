"""Problem 6: token ids by a public byte-level BPE, as a streaming transducer with bounded lookahead.

A prefix of a word has one tokenisation, and cutting a tokenisation between two tokens leaves the
tokenisations of both parts. So the last token of every prefix describes them all: each prefix points
back to the prefix before its last token. An automaton over all tokens gives those that end at a byte,
longest first; the last token is the first of them that stays as it is behind the token before it. Whatever
bytes follow, the final tokenisation passes through one of the last L prefixes, L being the longest token
of the merge list; that is the lookahead that suffices. Tokens on the way back that these prefixes share
are stable and are emitted at once.
"""

from __future__ import annotations

import base64
import codecs
import math
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternspark.session import spread

DEFAULT_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words whose ids a worker keeps, and characters cut at a time.
CACHE_LIMIT, SLICE = 1 << 18, 1 << 16
#: Pairs of tokens whose compatibility a worker keeps.
PAIR_LIMIT = 1 << 18

#: Fixed pattern of the tokenizer: contractions, words, numbers, other signs, white space.
FULL = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same in the standard library's classes, commonest kinds first, for texts without the characters
#: on which they differ; and for ASCII texts.
PLAIN = re.compile(r" ?[^\W\d_]+|'(?:[sdmt]|ll|ve|re)| ?\d+| ?(?:[^\s\w]+|_+)+|\s+(?!\S)|\s+")
ASCII = re.compile(r" ?[A-Za-z]+|'(?:[sdmt]|ll|ve|re)| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
#: Separators that only the standard library counts as white space.
SEPARATOR = re.compile("[\x1c-\x1f]")


@lru_cache(1)
def _odd() -> frozenset[str]:
    """Numbers that are no decimal digits: words to the standard library, but no letters."""
    return frozenset(c for c in map(chr, range(128, 0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())


@lru_cache(1)
def _full() -> Callable:
    import regex

    return regex.compile(FULL).findall


def _findall(text: str) -> list[str]:
    if text.isascii():
        return ASCII.findall(text)
    return PLAIN.findall(text) if SEPARATOR.search(text) is None and _odd().isdisjoint(text) else _full()(text)


@dataclass(frozen=True)
class Part:
    """Some of a word that is longer than a slice; ``last`` tells that it ends there."""

    text: str
    last: bool


@lru_cache(1)
def _runs() -> tuple:
    """Patterns of what continues a word: letters, numbers, white space, other signs."""
    import regex

    return tuple(map(regex.compile, (r"\p{L}*+", r"\p{N}*+", r"\p{White_Space}*+", r"[^\p{White_Space}\p{L}\p{N}]*+")))


def split(text: str) -> Iterator[list[str] | Part]:
    """The words of ``text``, a slice at a time; a word that touches a slice's end waits for more text.

    A word longer than a slice comes in parts, so memory is bounded by the slice.
    """
    if len(text) <= SLICE:
        yield _findall(text)
        return
    at = 0
    while at < len(text):
        part = text[at : at + SLICE]
        found = _findall(part)
        if at + SLICE < len(text):
            kept = len(found)
            end = len(part)
            while kept and end > len(part) - 2:  # unstable: more text could lengthen it or move its end
                kept -= 1
                end -= len(found[kept])
            if not kept:
                at = yield from _long(text, at)
                continue
            found, part = found[:kept], part[:end]
        yield found
        at += len(part)


def _long(text: str, at: int) -> Iterator[Part]:
    """The parts of the word at ``at``, which fills a slice; returns where it ends."""
    blank = _runs()[2]
    kind = next(k for k in _runs() if k.match(text[at + 1]).end())
    end = at + 1
    while True:  # where the run ends, a slice at a time
        more = kind.match(text, end, end + SLICE).end() - end
        if more < SLICE:
            end += more
            break
        yield Part(text[at:end], False)
        at, end = end, end + more
    if kind is blank and end < len(text):
        end -= 1  # the last white space belongs to what follows
    yield Part(text[at:end], True)
    return end


class Merges:
    """A merge list: token bytes with ranks that are also their ids."""

    def __init__(self, path: str = DEFAULT_PATH):
        import ahocorasick

        lines = (line.split() for line in Path(path).read_bytes().splitlines() if line)
        self.rank = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.token = {rank: token for token, rank in self.rank.items()}
        #: Bytes of lookahead after which what all open prefixes share can't change.
        self.lookahead = max(map(len, self.rank))
        self.size = {rank: len(token) for token, rank in self.rank.items()}
        if any(bytes([b]) not in self.rank for b in range(256)):
            raise ValueError("the merge list doesn't hold every byte")
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in self.rank.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        #: Of pairs of tokens (left << 32 | right) whether they fit.
        self.known: dict[int, bool] = {}
        self._spines: tuple[dict, dict] = ({}, {})

    def by_merging(self, word: bytes) -> list[int]:
        """Ids by the merge list itself, lowest rank first; it is quadratic, and tests hold ``fits`` against it."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            ranked = [(self.rank.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            least, i = min(ranked)
            if least == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[p] for p in parts]

    def _spine(self, token: int, right: bool) -> tuple[list[bytes], list[float]]:
        """The parts of a token at its right or left edge, from the byte to the token, as merging makes them,
        and for each the rank of the merge that ends it."""
        known = self._spines[right].get(token)
        if known is None:
            whole = self.token[token]
            parts = [whole]
            while len(parts[-1]) > 1:  # the last merge of a token is of the two parts that are left without it
                a, b = self.halves(parts[-1])
                parts.append(b if right else a)
            parts.reverse()
            known = self._spines[right][token] = (parts, [*(self.rank[p] for p in parts[1:]), math.inf])
        return known

    def halves(self, token: bytes) -> tuple[bytes, bytes]:
        """The two parts whose merge gives the token."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            i = min(range(len(parts) - 1), key=lambda i: self.rank.get(parts[i] + parts[i + 1], 1 << 60))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts[0], parts[1]

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are side by side; left -1: at the start of a word.

        At each time of merging one part of the left token and one of the right token meet at the border. They
        would become one if their merge came before the merges that end either of them; of equal ones the
        leftmost comes first.
        """
        key = left << 32 | right
        known = self.known.get(key)
        if known is None:
            if len(self.known) >= PAIR_LIMIT:
                self.known.clear()
            known = True
            if left >= 0:
                (ends, until), (starts, till) = self._spine(left, True), self._spine(right, False)
                i = j = 0
                while known:
                    rank = self.rank.get(ends[i] + starts[j], math.inf)
                    known = not (rank < until[i] and rank <= till[j])
                    if i == len(ends) - 1 and j == len(starts) - 1:
                        break
                    if until[i] <= till[j]:
                        i += 1
                    else:
                        j += 1
            self.known[key] = known
        return known


class Transducer:
    """Turns the bytes of one word into ids; ``feed`` returns those that have become stable."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.base = self.end = 0  # the prefixes between are open
        self.last: dict[int, int] = {0: -1}  # the last token of the prefix of each length
        self.scan = merges.automaton.iter("")

    def _back(self, end: int) -> list[int]:
        """The tokens from the open start to a prefix's end."""
        last, size, way = self.last, self.merges.size, []
        while end > self.base:
            way.append(token := last[end])
            end -= size[token]
        return way[::-1]

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        last, fits, size = self.last, self.merges.fits, self.merges.size
        for k in range(0, len(data), 256):
            piece = data[k : k + 256]
            self.scan.set(piece.decode("latin-1"), False)
            for place, token in self.scan:  # the tokens that end at a byte, longest first
                end = place + 1
                if end not in last:
                    before = last.get(end - size[token])
                    if before is not None and fits(before, token):
                        last[end] = token
            self.end += len(piece)
            out += self._emit()
            last = self.last
        return out

    def _emit(self) -> list[int]:
        """Where the ways back of the last ``lookahead`` prefixes have all met, what lies before is stable."""
        low = self.end - self.merges.lookahead + 1
        if low <= self.base:  # the start is still open
            return []
        last, size = self.last, self.merges.size
        open_, far = set(range(low, self.end + 1)), self.end
        while len(open_) > 1:  # the farthest goes back one token
            while far not in open_:
                far -= 1
            open_.remove(far)
            open_.add(far - size[last[far]])
        stable = open_.pop()
        out = self._back(stable)
        self.base = stable
        self.last = {e: t for e, t in last.items() if e >= stable}
        return out

    def finish(self) -> list[int]:
        return self._back(self.end)


def encode_word(word: str, merges: Merges) -> tuple[int, ...]:
    data = word.encode("utf-8", "surrogatepass")
    if (whole := merges.rank.get(data)) is not None and merges.fits(-1, whole):
        return (whole,)
    if len(data) > merges.lookahead:
        run = Transducer(merges)
        return (*run.feed(data), *run.finish())
    # nothing can be emitted early, so the prefixes' last tokens are all there is to keep
    last, size, fits, known = [-1] + [None] * len(data), merges.size, merges.fits, merges.known
    for place, token in merges.automaton.iter(data.decode("latin-1")):
        if last[place + 1] is None and (before := last[place + 1 - size[token]]) is not None:
            good = known.get(before << 32 | token)
            if good or (good is None and fits(before, token)):
                last[place + 1] = token
    end, way = len(data), []
    while end:
        way.append(last[end])
        end -= size[last[end]]
    return tuple(way[::-1])


class Encoder(dict):
    """word -> its number; the ids of all numbered words lie in one flat table. Filled by the transducer."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges, self.flat, self.starts = merges, array("i"), array("q", [0])

    def __missing__(self, word: str) -> int:
        number = self[word] = self.added(encode_word(word, self.merges))
        return number

    def added(self, ids: Iterable[int]) -> int:
        self.flat.extend(ids)
        self.starts.append(len(self.flat))
        return len(self.starts) - 2

    def trim(self) -> None:
        """Forget all words when they take more than their share of memory; called between batches."""
        if len(self) > CACHE_LIMIT or len(self.flat) > 8 * CACHE_LIMIT:
            self.clear()
            self.flat, self.starts = array("i"), array("q", [0])

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of all texts: words become numbers, and numbers ranges of the flat table."""
        numbers, counts = array("i"), [0]
        for text in texts:
            run: Transducer | None = None  # of a word in parts, which isn't kept
            for found in split(text) if text else ():
                if isinstance(found, Part):
                    run = run or Transducer(self.merges)
                    numbers.append(self.added(run.feed(found.text.encode("utf-8", "surrogatepass"))))
                    if found.last:
                        numbers.append(self.added(run.finish()))
                        run = None
                else:
                    numbers.extend(map(self.__getitem__, found))
            counts.append(len(numbers))
        starts, flat = np.array(self.starts), np.array(self.flat, np.int32)
        code = np.array(numbers, np.int64)
        size = np.diff(starts)[code] if len(code) else np.empty(0, np.int64)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.arange(total) + np.repeat(starts[code] - (ends - size), size)] if total else np.empty(0, np.int32)
        return np.concatenate([[0], ends])[counts], ids


class Decoder:
    """ids -> text by a state machine over bytes: ``feed`` returns the characters that are complete."""

    def __init__(self, merges: Merges):
        self.token, self.state = merges.token, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        return self.state.decode(b"".join(map(self.token.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    return Encoder(Merges(path))


def _by_size(batch: pa.RecordBatch, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most 1024 rows and, but for longer single texts, ``most`` bytes."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0)
    offsets = np.concatenate([[0], np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)])
    at = 0
    while at < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        stop = min(max(stop, at + 1), at + 1024, batch.num_rows)
        yield batch.slice(at, stop - at)
        at = stop


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _encoder(path)
        for batch in batches:
            for part in _by_size(batch):
                offsets, ids = known.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))], names=["doc_id", "ids"])
                known.trim()

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _encoder(path).merges
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                machine = Decoder(merges)
                texts.append("".join([*(machine.feed(ids[k : k + 4096]) for k in range(0, len(ids or ()), 4096)), machine.finish()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def token_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = DEFAULT_PATH) -> DataFrame:
    """(doc_id, ids): the ids of every row's text, without special tokens; [] for an empty or null text.

    Every row gives one row, repeated rows and null ids included; extra columns are dropped. ``path`` is
    the vocabulary file on every executor. Strings of special tokens in a text are ordinary text.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return spread(rows).mapInArrow(_encode(path), "doc_id bigint, ids array<int>")


def texts(tokens: DataFrame, path: str = DEFAULT_PATH) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text, cut characters U+FFFD."""
    return tokens.select("doc_id", "ids").mapInArrow(_decode(path), "doc_id bigint, text string")
