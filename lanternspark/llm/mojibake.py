"""Problem 8: text decoded with the wrong encoding, restored by minimum description length.

A text is taken in segments, as only some of it may be garbled. Candidate decodings of a segment are
compressed with zstandard, using dictionaries for each language; a description's length is the shortest of
these, plus what spelling out uncommon signs costs, plus the cost of the chain of encodings that made it. What
is compressed are the segment's signs beyond ASCII with some characters around them, since the rest is the
same in every decoding, in code units of two bytes, so that no alphabet is cheaper than another. The chain
that shortens the whole document most is applied to the segments it shortens, again and again until no chain
pays for itself; a text for which none ever does is left unchanged. Signs lost to replacement characters
are told in the same way, by what a sign in their place would save.

All of this is learnt from every labelled text, whole, of every language: what is counted is counted over all of
them. Of a dictionary, which has a fixed size, the texts are passages that hold most of what is common by these
counts, and the entropy tables are trained on passages in proportion to their counts.

Texts and segments all of whose signs stand as they commonly do in the labelled texts aren't tried, which
saves most of the work, and damage that is merely cited, alone in quotes or code, isn't taken for damage.
Texts and segments that a chain makes more like the rest of the texts are left out of what is learnt.
A language with too few texts for zstandard's trainer has passages of them, without tables, for its dictionary.
"""

from __future__ import annotations

import codecs
import heapq
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, reduce
from hashlib import blake2b
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternspark.session import cut, spread

#: Bytes of a dictionary that tables are trained with, and of the passages in it, as compressors with tables for such
#: short texts reach less far back; bytes and number of passages it is made from, the commonest of a language.
DICTIONARY, REACH, TRAINED, PASSAGES = 48 << 10, 8 << 10, 1_500_000, 50_000
#: Of `fit` only: documents a language, code points of each, and languages.
SAMPLE_DOCS, SAMPLE_CHARS, LANGUAGES = 400, 4000, 24
#: Share of a language's documents that a character must be in to count as common.
COMMON = 0.015
#: Bytes a chain costs: once for the document, and for each segment it is applied to.
CHAIN_COST = {"utf-8": 1.0, "single": 1.5}
SEGMENT_COST = {"utf-8": 0.25, "single": 1.0}
#: The same of signs lost to replacement characters, and how many characters around those are compressed.
LOST_COST, LOST_PLACE_COST, AROUND = 2.5, 0.5, 16
#: Bytes of a sign beyond ASCII that a decoding brings in and no language has commonly, as it must be spelled out.
SPELLED = 4.0

#: Fixed values: (read as, really) of the decodings that occur in practice.
UTF8_READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1254", "iso8859-15", "iso8859-2", "koi8-r", "mac_roman", "cp437", "cp850", "cp866")
SINGLE = (
    ("latin-1", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1251", "cp1252"), ("cp1250", "cp1252"), ("cp866", "cp1252"),
    ("cp1252", "cp1251"), ("latin-1", "cp1251"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("mac_roman", "cp1251"), ("cp437", "cp1251"),
    ("cp1251", "koi8-r"), ("cp1252", "koi8-r"), ("latin-1", "koi8-r"), ("cp866", "koi8-r"),
    ("cp1251", "cp866"), ("cp1252", "cp866"), ("latin-1", "cp866"), ("cp437", "cp866"), ("koi8-r", "cp866"),
    ("cp1252", "mac_roman"), ("latin-1", "mac_roman"), ("cp1252", "cp437"), ("latin-1", "cp437"), ("cp1252", "cp850"), ("latin-1", "cp850"),
    ("cp1252", "cp1250"), ("latin-1", "cp1250"),
)

#: Up to the end of a sentence or line, with the white space behind it; nothing of a text is lost.
SEGMENT = re.compile(r"[^\n.!?…]*(?:[\n.!?…]+[ \t\r\n]*|$)")
#: Damage that is merely cited: signs alone, in quotes or in a code span.
CITED = re.compile(r"`[^\sA-Za-z0-9`]+`|“[^\sA-Za-z0-9“”]+”|\"[^\sA-Za-z0-9\"]+\"|«[^\sA-Za-z0-9«»]+»|„[^\sA-Za-z0-9„“]+“|'[^\sA-Za-z0-9']+'|‘[^\sA-Za-z0-9‘’]+’")
QUOTES = frozenset("`“\"«„'‘")
#: What stands in a trained dictionary between its tables and its texts: the first offsets, 1, 4 and 8.
OFFSETS = b"\1\0\0\0\4\0\0\0\10\0\0\0"
LOST = "�"
ASCII = frozenset(map(chr, range(128)))
PLACE = re.compile(f"{LOST}+")
WORD = re.compile(r"[^ \t\r\n]+")
SPACE = re.compile(r"([ \t\r\n]+)")
#: Signs beyond ASCII with one neighbour on either side, and with as many as are compressed.
RUN = re.compile(r"[\x00-\x7f]?[^\x00-\x7f]+[\x00-\x7f]?")
WINDOW = re.compile(r"[\x00-\x7f]{0,8}(?:[^\x00-\x7f]+[\x00-\x7f]{0,8})+")
#: Both are slow where they don't match, at every character before it; `runs`, `windows` and `Beyond` find the same.
BEYOND = re.compile("[\x80-\U0010ffff][\x80-\U0010ffff]*")
GAP = re.compile(r"([\x00-\x7f]{9,})")
#: Passages that are counted: up to eight words in a row of what is compressed, or up to four, two or one.
LONGEST, *SHORTER = (r"(?:[ \t\r\n]*[^ \t\r\n]+){1,%d}[ \t\r\n]*" % n for n in (8, 4, 2, 1))
PASSAGE = re.compile(LONGEST)


def code_page(name: str) -> str:
    """The 256 characters of an encoding; bytes it leaves undefined are read as control characters."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@dataclass
class Chain:
    """One step back: the characters ``read_as`` gives become bytes, which ``really`` decodes."""

    read_as: str
    really: str
    chars: frozenset = field(init=False)
    table: dict = field(init=False)

    def __post_init__(self) -> None:
        page = code_page(self.read_as)
        self.to_bytes = codecs.charmap_build(page)
        self.chars = frozenset(page[128:])
        self.kind = "utf-8" if self.really == "utf-8" else "single"
        if self.kind == "utf-8":
            self.table = {ord(c): chr(128 + k) for k, c in enumerate(page[128:])}
            self.lead, self.rest = page[0xC2:0xF5], page[0x80:0xC0]
            self.pair = re.compile(f"[{re.escape(self.lead)}][{re.escape(self.rest)}]").search
        else:
            self.target = code_page(self.really)
            self.table = {ord(c): self.target[128 + k] for k, c in enumerate(page[128:])}

    def back(self, text: str) -> str | None:
        """The text before this step, or None if it can't have been made by it."""
        if self.kind == "utf-8" and not self.pair(text):
            return None
        try:
            own = codecs.charmap_encode(text, "strict", self.to_bytes)[0]
        except UnicodeEncodeError:  # not all of it is in the code page: the rest stays
            own = None
        if self.kind == "utf-8":
            try:
                moved = (text.translate(self.table).encode("latin-1") if own is None else own).decode("utf-8")
            except UnicodeError:
                return None
        else:
            moved = text.translate(self.table) if own is None else codecs.charmap_decode(own, "strict", self.target)[0]
        return moved if moved != text else None


CHAINS = tuple(Chain(a, "utf-8") for a in UTF8_READ_AS) + tuple(Chain(a, b) for a, b in SINGLE)


def high(text: str) -> frozenset:
    """The characters of a text that aren't ASCII."""
    return frozenset(text) - ASCII


def runs(text: str) -> Iterator[str]:
    """What RUN finds."""
    end = 0
    for match in BEYOND.finditer(text):
        start, stop = match.span()
        yield text[max(end, start - 1) : stop + 1]
        end = stop + 1


def windows(text: str) -> list[str]:
    """What WINDOW finds."""
    pieces = GAP.split(text)
    out: list[str] = []
    before, used = "", 0  # the signs before a piece, and how many of them are in the last window
    for piece, after in zip(pieces[::2], [*pieces[1::2], ""], strict=True):
        if not piece.isascii():
            out.append(before[max(used, len(before) - 8) :] + piece + after[:8])
            used = 8
        before = after
    return out


class Beyond:
    """The runs, windows and words beyond ASCII of many texts, each with the number of its text."""

    def __init__(self, texts: list[str]):
        self.joined = "".join(texts)
        self.signs = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        at = np.flatnonzero(self.signs > 127)
        owners = np.searchsorted(ends, at, "right")
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] - at[:-1] > 1) | (owners[1:] != owners[:-1])
        first = np.flatnonzero(new)
        #: Of each run its place, its text, and that text's place.
        self.starts, self.stops = at[first], at[np.append(first[1:], len(at))[: len(first)] - 1] + 1
        self.owners = owners[first]
        self.low, self.high = (ends - sizes)[self.owners], ends[self.owners]

    def _cut(self, first: np.ndarray, last: np.ndarray, around: int) -> tuple[list[str], list[int]]:
        """What stands from one run to another and as far around them, but not in what was cut before."""
        lo = np.maximum(self.starts[first] - around, self.low[first])
        hi = np.minimum(self.stops[last] + around, self.high[last])
        lo[1:] = np.maximum(lo[1:], hi[:-1])
        return self._pieces(lo, hi), self.owners[first].tolist()

    def _pieces(self, lo: np.ndarray, hi: np.ndarray) -> list[str]:
        return [self.joined[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]

    def runs(self) -> tuple[list[str], list[int]]:
        every = np.arange(len(self.starts))
        return self._cut(every, every, 1)

    def windows(self) -> tuple[list[str], list[int]]:
        new = np.ones(len(self.starts), bool)
        new[1:] = (self.starts[1:] - self.stops[:-1] > 8) | (self.owners[1:] != self.owners[:-1])
        first = np.flatnonzero(new)
        return self._cut(first, np.append(first[1:], len(new))[: len(first)] - 1, 8)

    def words(self) -> tuple[list[str], list[int]]:
        spaces = np.flatnonzero((self.signs == 32) | (self.signs == 9) | (self.signs == 10) | (self.signs == 13))
        spaces = np.concatenate([[-1], spaces, [len(self.signs)]])
        at = np.searchsorted(spaces, self.starts)
        lo, hi = np.maximum(spaces[at - 1] + 1, self.low), np.minimum(spaces[at], self.high)
        new = np.ones(len(lo), bool)
        new[1:] = lo[1:] > lo[:-1]
        return self._pieces(lo[new], hi[new]), self.owners[new].tolist()


def twice(text: str) -> bool:
    """Whether the text holds a word damaged through UTF-8 by any code page."""
    own = [c for c in CHAINS if c.kind == "utf-8" and c.pair(text)]
    return bool(own) and any(c.back(w) is not None for w in WORD.findall(text) if not w.isascii() for c in own if high(w) <= c.chars)


#: Single-byte chains as arrays: the place of a sign (its code point plus 1) among the signs of all code pages, 0 for
#: others, and the sign at each place after each chain.
SINGLES = tuple(c for c in CHAINS if c.kind == "single")
SIGNS = np.array([0, *sorted({ord(x) + 1 for c in SINGLES for p in (c.read_as, c.really) for x in code_page(p)[128:]})], np.int64)
PLACES = np.zeros(SIGNS[-1] + 2, np.int64)
PLACES[SIGNS] = np.arange(len(SIGNS))
MOVED = [np.array([0, *(ord(c.table.get(x - 1, chr(x - 1))) + 1 for x in SIGNS[1:].tolist())], np.int64) for c in SINGLES]
#: Bits of a sign in the key of three; characters that are worked on at once; keys whose gains are kept in memory.
BITS, CHUNK, KEPT = 21, 1 << 19, 1 << 18


def places(signs: np.ndarray) -> np.ndarray:
    return PLACES[np.minimum(signs, len(PLACES) - 1)]


def triples(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Every three signs in a row whose middle one is beyond ASCII, overlapping, and two where such a sign comes
    first, as (key, number of its text); those no chain can change or lead to are left out."""
    ends = np.cumsum([len(x) + 1 for x in texts], dtype=np.int64) - 1
    signs = np.frombuffer(("\0".join(texts) + "\0\0\0").encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint32(1)
    signs[ends] = signs[-2:] = 0  # what is outside a text
    beyond = signs > 128
    at = np.flatnonzero((beyond[:-2] | beyond[1:-1]) & (signs[:-2] > 0))
    a, b, c = (signs[at + k].astype(np.int64) for k in range(3))
    c[~beyond[at + 1]] = 0
    known = (places(a) > 0) | (places(b) > 0) | (places(c) > 0)
    return (a << 2 * BITS | b << BITS | c)[known], np.searchsorted(ends, at[known])


def votes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(key, in how many of the texts it is)."""
    keys, owners = triples(texts)
    order = np.lexsort((keys, owners))
    keys, owners = keys[order], owners[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
    return np.unique(keys[new], return_counts=True)


class Vote:
    """Whether a decoding by a single-byte chain is made of what more of the distinct labelled texts hold.

    Damage is in as many texts as were damaged, what it was made from in all the others, so that damage
    is outvoted unless most of the texts went through the same chain.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]
        self._forget()

    def _forget(self) -> None:
        self.known, self.known_gains = np.empty(0, np.int64), np.empty((0, len(SINGLES)), np.float32)

    def __getstate__(self) -> tuple:
        return self.keys, self.counts

    def __setstate__(self, state: tuple) -> None:
        self.keys, self.counts = state
        self._forget()

    def logs(self, keys: np.ndarray) -> np.ndarray:
        """The logarithm of one more than each key's count."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.log(np.where(self.keys[at] == keys, self.counts[at], 0) + 1)

    def gains(self, keys: np.ndarray) -> np.ndarray:
        """Of each key, by chain, the logarithm of how much more common it becomes, within 1 either way, as a rare
        sound sign may come to look like a very common one; 0 by chains that don't change it."""
        signs = [keys >> 2 * BITS, keys >> BITS & (1 << BITS) - 1, keys & (1 << BITS) - 1]
        at, own = [places(x) for x in signs], self.logs(keys)
        out = np.zeros((len(keys), len(SINGLES)), np.float32)
        for k, moved in enumerate(MOVED):
            a, b, c = (np.where(n > 0, moved[n], x) for n, x in zip(at, signs, strict=True))
            x = a << 2 * BITS | b << BITS | c
            other = np.flatnonzero(x != keys)
            out[other, k] = np.clip(self.logs(x[other]) - own[other], -1, 1)
        return out

    def outvoted(self, texts: list[str]) -> np.ndarray:
        """Of each text whether some chain makes it more common."""
        out = np.zeros(len(texts), bool)
        keys, owners = triples(texts) if texts else (self.keys[:0], None)
        if not len(keys) or not len(self.keys):
            return out
        keys, places_ = np.unique(keys, return_inverse=True)
        fresh = np.setdiff1d(keys, self.known, assume_unique=True)
        if len(self.known) + len(fresh) > KEPT:
            self._forget()
            fresh = keys
        if len(fresh):
            order = np.argsort(known := np.concatenate([self.known, fresh]))
            self.known, self.known_gains = known[order], np.concatenate([self.known_gains, self.gains(fresh)])[order]
        gains = self.known_gains[np.searchsorted(self.known, keys)]
        # where no part gains by any chain, the text doesn't
        open_ = np.zeros(len(texts), bool)
        open_[owners[(gains > 0).any(axis=1)[places_]]] = True
        kept = open_[owners]
        owners, places_ = owners[kept], places_[kept]
        if not len(owners):
            return out
        starts = np.flatnonzero(np.diff(owners, prepend=-1))
        total = np.add.reduceat(gains[places_].astype(np.float64), starts, axis=0)
        out[owners[starts]] = (total > 1e-6).any(axis=1)
        return out


def described(text: str) -> bytes:
    """What of a text is compressed."""
    return "\n".join(windows(text)).encode("utf-16-le", "surrogatepass")


def chunks(texts: Iterable) -> Iterator[list]:
    """Pairs of something and a text, in lists of about CHUNK characters."""
    own, size = [], 0
    for pair in texts:
        own.append(pair)
        size += len(pair[1])
        if size >= CHUNK:
            yield own
            own, size = [], 0
    if own:
        yield own


def learnt(vote: Vote, rows: list[tuple[str, str]]) -> tuple[dict[str, Counter], dict[str, Counter]]:
    """Of distinct (language, text): by language, in how many texts each sign and run of signs is, and how often
    each passage of up to eight words; both of sound segments of sound texts."""
    seen, passages = ({lang: Counter() for lang, _ in rows} for _ in range(2))
    sound = [row for row, out in zip(rows, vote.outvoted([text for _, text in rows]), strict=True) if not out]
    parts = [(n, s) for n, (_, text) in enumerate(sound) for s in filterfalse(str.isascii, SEGMENT.findall(text)) if LOST not in s]
    parts = [part for part, out in zip(parts, vote.outvoted([s for _, s in parts]), strict=True) if not out]
    words, owners = Beyond([s for _, s in parts]).words()
    damaged = set(filter(twice, set(words)))
    if damaged:
        left = {k for word, k in zip(words, owners, strict=True) if word in damaged}
        parts = [part for k, part in enumerate(parts) if k not in left]
    beyond = Beyond([s for _, s in parts])
    own: list[set[str]] = [set() for _ in sound]
    for run, k in zip(*beyond.runs(), strict=True):
        own[parts[k][0]].add(run)
    for (lang, _), found in zip(sound, own, strict=True):
        seen[lang].update(high("".join(found)) | found)
    whole: dict[str, list[str]] = defaultdict(list)
    for window, k in zip(*beyond.windows(), strict=True):
        # most have eight words at most and are a passage as they are
        whole[sound[parts[k][0]][0]] += (window,) if len(window) <= 16 or sum(map(window.count, " \t\r\n")) < 8 else PASSAGE.findall(window)
    for lang, found_ in whole.items():
        passages[lang].update(found_)
    return seen, passages


def shortened(passages: Counter) -> Counter:
    """The counts where passages that occur once are taken as shorter ones, as long as those occur once, too."""
    out: Counter = Counter()
    for shorter in SHORTER:
        out.update({x: n for x, n in passages.items() if n > 1})
        passages = Counter(part for x, n in passages.items() if n == 1 for part in re.findall(shorter, x))
    out.update(passages)
    return out


def cover(counted: list[tuple[str, int]]) -> bytes:
    """Passages that hold most of what is common, up to REACH bytes, the best at the end: one after the other that
    whose four signs in a row count most for its length, where those in a chosen passage count no more."""

    numbers: dict[str, int] = {}
    fours = {x: [numbers.setdefault(y, len(numbers)) for y in {x[k : k + 4] for k in range(max(1, len(x) - 3))}] for x, _ in counted}
    counts = [0] * len(numbers)

    def weight(x: str) -> float:
        return -sum(map(counts.__getitem__, fours[x])) / (len(x) + 1)

    for x, n in counted:
        for y in fours[x]:
            counts[y] += n
    # counts only fall, so a passage is best if it is still the first when it is weighed again
    heap = [(weight(x), x) for x, _ in counted]
    heapq.heapify(heap)
    chosen: list[str] = []
    size = 0
    while heap and size < REACH:
        _, x = heapq.heappop(heap)
        own = weight(x)
        if heap and own > heap[0][0]:
            heapq.heappush(heap, (own, x))
            continue
        chosen.append(x)
        size += 2 * len(x)
        for y in fours[x]:
            counts[y] = 0
    return "".join(reversed(chosen)).encode("utf-16-le", "surrogatepass")


def train(counted: list[tuple[str, int]]) -> bytes:
    """A language's dictionary, from its passages with their counts, commonest first.

    The trainer, whose entropy tables are taken, is given passages as often as they are in all texts, or in
    proportion to it where that is more than TRAINED bytes, mixed and four to a piece.
    """
    import zstandard

    share = min(1.0, TRAINED / max(1, sum(2 * len(x) * n for x, n in counted)))
    mixed: list[str] = []
    size = 0
    for x, n in counted:
        times = max(1, round(n * share))
        mixed += [x] * times
        size += 2 * len(x) * times
        if size > TRAINED:
            break
    random.Random(0).shuffle(mixed)
    pieces = ["\n".join(mixed[k : k + 4]).encode("utf-16-le", "surrogatepass") for k in range(0, len(mixed), 4)]
    content = cover(counted)
    try:
        trained = zstandard.train_dictionary(DICTIONARY, pieces, level=9).as_bytes()
    except zstandard.ZstdError:
        return content  # too few texts for the trainer: there are no tables
    return trained[: trained.index(OFFSETS) + len(OFFSETS)] + content


#: The chains as bits, all of them and those of UTF-8.
ALL, UTF8 = ((1 << k) - 1 for k in (len(CHAINS), len(UTF8_READ_AS)))


class Parts:
    """A segment's citations, what stands outside of them, and its words, which are the same for all chains."""

    def __init__(self, segment: str):
        self.segment = segment
        self.found = [*CITED.finditer(segment)] if not QUOTES.isdisjoint(segment) else []
        self.cited = [m.group() for m in self.found]

    @cached_property
    def bare(self) -> bool:
        """Whether nothing but citations could be damaged."""
        return bool(self.found) and CITED.sub("", self.segment).isascii()

    @cached_property
    def outside(self) -> list[tuple[str, list[str], list[int], list[str]]]:
        """Before, between and behind the citations: the text, its words and spaces, and the words beyond ASCII with their places."""
        ends = [0, *(m.end() for m in self.found)]
        out = []
        for a, b in zip(ends, [*(m.start() for m in self.found), len(self.segment)], strict=True):
            pieces = SPACE.split(self.segment[a:b])
            at = [n for n, x in enumerate(pieces) if not x.isascii()]
            out.append((self.segment[a:b], pieces, at, [pieces[n] for n in at]))
        return out

    @cached_property
    def strange(self) -> list[tuple[str, frozenset]]:
        """Words of the whole segment beyond ASCII, and the signs in them."""
        return [(w, high(w)) for w in WORD.findall(self.segment) if not w.isascii()]


class Model:
    """Per-language dictionaries and the common characters, of labelled texts."""

    def __init__(self, sample: list[tuple[str, str]]):
        rows = sorted(set(sample))
        vote = Vote(*votes([*{text for _, text in rows}]))
        seen, passages = learnt(vote, rows)
        texts = Counter(lang for lang, _ in rows)
        often = {x for lang, own in seen.items() for x, n in own.items() if n > 1 and n >= COMMON * texts[lang]}
        self._take(often, [train(sorted(shortened(own).items(), key=lambda item: (-item[1], item[0]))[:PASSAGES]) for own in passages.values()])

    @classmethod
    def of(cls, often: set[str], dictionaries: list[bytes]) -> Model:
        """A model of the signs and runs of signs that are often in texts of a language, and dictionaries."""
        model = cls.__new__(cls)
        model._take(often, dictionaries)
        return model

    def _take(self, often: set[str], dictionaries: list[bytes]) -> None:
        self.common = {x for x in often if len(x) == 1}
        self.usual = often
        self.dictionaries = sorted(set(dictionaries))
        self._ready()

    def _ready(self) -> None:
        import zstandard

        kinds = [(zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_AUTO) if d else None) for d in self.dictionaries] or [None]
        params = zstandard.ZstdCompressionParameters.from_level(9, source_size=256, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        for k in kinds:
            if k is not None:
                k.precompute_compress(compression_params=params)
        compressors = [zstandard.ZstdCompressor(compression_params=params, dict_data=k) if k is not None else zstandard.ZstdCompressor(compression_params=params) for k in kinds]
        self.compress = [c.compress for c in compressors]
        #: Lengths and words taken back that are known already.
        self.lengths: dict[bytes, int] = {}
        self.words: list[dict[str, str]] = [{} for _ in CHAINS]
        #: What a replacement character may stand for.
        self.signs = sorted(self.common - {LOST}) or ["é"]
        #: Of single-byte chains: the characters that become common ones.
        self.to_common = [frozenset(x for x in c.chars if c.kind == "utf-8" or c.table[ord(x)] in self.common) for c in CHAINS]
        #: Of a character, as bits, the chains of which it is such, and those of which it may begin or go on a sign.
        self.bits: dict[str, tuple[int, int, int]] = {}
        for x in frozenset().union(*(c.chars for c in CHAINS)):
            good = sum(1 << k for k, own in enumerate(self.to_common) if x in own)
            lead, rest = (sum(1 << k for k, c in enumerate(CHAINS) if c.kind == "utf-8" and x in part(c)) for part in (lambda c: c.lead, lambda c: c.rest))
            self.bits[x] = good, lead, rest

    def __getstate__(self) -> dict:
        return {"common": self.common, "usual": self.usual, "dictionaries": self.dictionaries}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._ready()

    def length(self, text: str) -> int:
        """Bytes of the shortest description, by the best dictionary."""
        data = described(text)
        if data not in self.lengths:
            if len(self.lengths) >= KEPT >> 3:
                self.lengths.clear()
            self.lengths[data] = min([len(compress(data)) for compress in self.compress])
        return self.lengths[data]

    def candidates(self, segment: str) -> Iterator[tuple[Chain, str, float]]:
        """Decodings of a segment, by each chain of the whole of it, or else of words of it, and what spelling out
        costs: by UTF-8, which is often undone in several steps, of uncommon signs beyond as many as were there;
        by single bytes of each new sign, and of those in words left out that the chain could have made as well."""
        chars = high(segment)
        # chains by bits: all signs, or some uncommon ones, may have come by it, and some may begin or go on a sign
        every, some, lead, rest = ALL, 0, 0, 0
        for x in chars:
            good, begins, goes_on = self.bits.get(x, (0, 0, 0))
            every &= good
            some |= good if x not in self.common else 0
            lead |= begins
            rest |= goes_on
        some |= UTF8
        open_ = (lead & rest) | ((some | every) & ~UTF8)
        if not open_:
            return
        parts = Parts(segment)
        before = -1
        whole = False  # a segment that is UTF-8 in full wasn't of single bytes
        while open_:
            k = (open_ & -open_).bit_length() - 1
            open_ &= open_ - 1
            chain = CHAINS[k]
            if whole and chain.kind == "single":
                break
            if chain.kind == "utf-8" and not chain.pair(segment):
                continue
            found = None
            if every >> k & 1 and not parts.bare:
                found = chain.back(segment)
                whole |= found is not None and chain.kind == "utf-8"
            left: set[str] = set()
            if found is None and some >> k & 1:
                good = self.to_common[k]
                found = self.by_words(parts, k)
                if chain.kind == "single":
                    left = {c for w, own in parts.strange if own <= chain.chars and not own <= good for c in {chain.table[ord(x)] for x in own}}
            if found is not None and found != segment:
                if chain.kind == "utf-8":
                    before = self.uncommon(segment) if before < 0 else before
                    more = max(0, self.uncommon(found) - before)
                else:
                    more = len((high(found) | left) - self.common - chars)
                yield chain, found, SPELLED * more

    def uncommon(self, text: str) -> int:
        return sum(map(text.count, high(text) - self.common))

    def by_words(self, parts: Parts, k: int) -> str:
        """The segment with the words taken back that can have gone through a chain. Damage that is
        merely cited stays, unless other words are damaged or the citation was damaged itself."""
        chain, good, known = CHAINS[k], self.to_common[k], self.words[k]

        def word(own: str) -> str:
            if len(known) >= KEPT >> 6:
                known.clear()
            signs = high(own)
            stays = not signs <= good or (chain.kind == "single" and signs <= self.common)
            known[own] = own if stays else chain.back(own) or own
            return known[own]

        damaged = False
        fixed = []
        for text, pieces, at, words in parts.outside:
            new = [known.get(x) or word(x) for x in words]
            if new != words:
                pieces = pieces.copy()
                for x, n in zip(new, at, strict=True):
                    pieces[n] = x
                text, damaged = "".join(pieces), True
            fixed.append(text)
        out = [fixed[0]]
        for own, part in zip(parts.cited, fixed[1:], strict=True):
            inner = chain.back(own[1:-1]) if high(own[1:-1]) <= good else None
            out += [own[0] + inner + own[-1] if inner and (damaged or twice(inner)) else own, part]
        return "".join(out)

    def lossy(self, text: str) -> bool:
        """Whether characters were lost for good: some sign in the place of the replacement characters makes the
        description shorter by more than that costs. It stays unknown which sign it was."""
        gain = 0.0
        for match in PLACE.finditer(text) if LOST in text else ():
            a, lost, b = (x.replace(LOST, "e") if n % 2 == 0 else x for n, x in enumerate((text[max(0, match.start() - AROUND) : match.start()], match.group(), text[match.end() : match.end() + AROUND])))
            gain += self.length(a + lost + b) - min(self.length(a + c + b) for c in self.signs) - LOST_PLACE_COST
            if gain > LOST_COST:
                return True
        return False

    def gains(self, segment: str) -> list[tuple[Chain, str, float]]:
        """The decodings that shorten a segment, and by how much."""
        tried = [(c, found, left + SEGMENT_COST[c.kind]) for c, found, left in self.candidates(segment)]
        own = self.length(segment) if tried else 0
        lengths = {x: self.length(x) for x in {x for _, x, _ in tried}}
        return [(c, x, gain) for c, x, costs in tried if (gain := own - lengths[x] - costs) > 0]

    def repair(self, text: str) -> tuple[str, list[str]]:
        """The restored text and the steps taken, [] if the text is left unchanged."""
        return self.undone(*self.unusual([text]).get(0, ([text], [])))

    def unusual(self, texts: list[str]) -> dict[int, tuple[list[str], list[int]]]:
        """Of texts with signs that don't stand as they commonly do, by number: the segments, and which hold such signs."""
        own: dict[int, tuple[list[str], list[int]]] = {n: (SEGMENT.findall(texts[n]), []) for n in self._strange(texts)}
        places_ = [(n, k) for n, (segments, _) in own.items() for k in range(len(segments))]
        for at in self._strange([s for segments, _ in own.values() for s in segments]):
            n, k = places_[at]
            own[n][1].append(k)
        return own

    def _strange(self, texts: list[str]) -> list[int]:
        return sorted({n for run, n in zip(*Beyond(texts).runs(), strict=True) if run not in self.usual})

    def undone(self, segments: list[str], unusual: list[int]) -> tuple[str, list[str]]:
        """The same of a text in segments, of which only the unusual ones are tried."""
        steps: list[str] = []
        known: dict[str, list[tuple[Chain, str, float]]] = {}
        while True:  # every step makes the description shorter, so it ends
            best: dict[int, list[tuple[int, str, float]]] = {}
            for n in unusual:
                segment = segments[n]
                if segment not in known:
                    known[segment] = self.gains(segment)
                for chain, found, gain in known[segment]:
                    best.setdefault(id(chain), []).append((n, found, gain))
            paid = [(sum(g for *_, g in best[id(c)]) - CHAIN_COST[c.kind], -k) for k, c in enumerate(CHAINS) if id(c) in best]
            if not paid or max(paid)[0] <= 0:
                break
            chain = CHAINS[-max(paid)[1]]  # of equals the first
            for n, found, _ in best[id(chain)]:
                segments[n] = found
            settled = {n for n, s, _ in best[id(chain)] if self.usual.issuperset(runs(s))}
            unusual = [n for n in unusual if n not in settled]
            steps.append(f"{chain.really} read as {chain.read_as}")
        return "".join(segments), steps


def _labelled(docs: DataFrame, text_col: str, lang_col: str, *more: Column) -> DataFrame:
    """(lang, text) of labelled texts; languages are told by the first part of their code, lower-cased."""
    lang = F.lower(F.regexp_extract(F.col(lang_col), r"^([A-Za-z]{2,3})(?:$|[-_])", 1))
    return docs.select(lang.alias("lang"), F.col(text_col).alias("text"), *more).where("lang not in ('', 'und') and trim(text) != ''")


def _distinct(batches: Iterator[pa.RecordBatch], by_lang: bool) -> Iterator[tuple[str, str]]:
    """(lang, text) once, where all copies of a text are in one partition."""
    known: set[bytes] = set()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            digest = blake2b((f"{lang} {text}" if by_lang else text).encode(), digest_size=16).digest()
            if digest not in known:
                known.add(digest)
                yield lang, text


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in chunks(_distinct(batches, False)):
        keys, counts = votes([text for _, text in chunk])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], names=["key", "n"])


def _learnt(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(_distinct(batches, True)):
            for passage, by in enumerate(learnt(shared.value, chunk)):
                for lang, own in by.items():
                    columns = [pa.array([bool(passage)] * len(own), pa.bool_()), pa.array([lang] * len(own), pa.string()), pa.array([*own], pa.string()), pa.array([*own.values()], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["passage", "lang", "x", "n"])

    return run


def _trained(group: pa.Table) -> pa.Table:
    counted = sorted(zip(group["x"].to_pylist(), group["n"].to_pylist(), strict=True), key=lambda item: (-item[1], item[0]))
    return pa.table({"lang": group["lang"][:1], "dictionary": pa.array([train(counted)], pa.binary())})


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from all labelled texts, whole, of all languages; the same as ``Model`` of the list of them.

    Rows without a language are left out. The driver gets a row for each language, one for each three signs that
    a code page has a part in, the signs and runs that are often in a language's texts, and the dictionaries.
    """
    from pyspark.sql import Window

    spark = docs.sparkSession
    rows = _labelled(docs, text_col, lang_col)
    texts = rows.select("lang", F.md5(F.encode("text", "utf-8")).alias("digest")).distinct().groupBy("lang").agg(F.count("*").alias("texts")).collect()
    if not texts:
        return Model([])
    # ASCII texts hold nothing that is counted but themselves
    foreign = cut(rows.where(F.length("text") < F.octet_length("text")).repartition("text"))
    table = foreign.mapInArrow(_votes, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    shared = spark.sparkContext.broadcast(Vote(table["key"].to_numpy(), table["n"].to_numpy()))
    counted = cut(foreign.mapInArrow(_learnt(shared), "passage boolean, lang string, x string, n bigint").groupBy("passage", "lang", "x").agg(F.sum("n").alias("n")))
    bounds = F.broadcast(spark.createDataFrame([(r.lang, COMMON * r.texts) for r in texts], "lang string, bound double"))
    often = counted.where("not passage and n > 1").join(bounds, "lang").where("n >= bound").select("x").distinct().collect()
    passages, settled = counted.where("passage").select("lang", "x", "n"), []
    for shorter in SHORTER:  # as `shortened` does
        settled.append(passages.where("n > 1"))
        parts = passages.where("n = 1").select("lang", F.explode(F.regexp_extract_all("x", F.lit(shorter), F.lit(0))).alias("x"))
        passages = parts.groupBy("lang", "x").agg(F.count("*").alias("n"))
    passages = reduce(DataFrame.union, settled, passages).groupBy("lang", "x").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "x"))
    best = passages.select("lang", "x", "n", rank.alias("rank")).where(F.col("rank") <= PASSAGES).drop("rank")
    trained = best.groupBy("lang").applyInArrow(_trained, "lang string, dictionary binary").collect()
    dictionaries = {r.lang: b"" for r in texts} | {r.lang: bytes(r.dictionary) for r in trained}
    return Model.of({r.x for r in often}, [*dictionaries.values()])


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """A quick model for callers that pass one to ``garbled``, from at most SAMPLE_DOCS texts of each of at most
    LANGUAGES languages, those with most texts; of a language those whose ids have the least hashes. No query
    uses it: ``learn`` takes all texts.

    Texts are counted first, so that few more than are asked for are ever sorted, in no matter how many partitions.
    """
    from pyspark.sql import Window

    rows = _labelled(docs, text_col, lang_col, F.xxhash64(id_col).alias("h"))
    #: A row for each code of two or three letters at most.
    counted = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not counted:
        return Model([])
    # hashes under the bound are four times as many as are taken; of so many, too few are under it at odds of 1e-300
    bounds = docs.sparkSession.createDataFrame([(r.lang, min(1.0, 4 * SAMPLE_DOCS / r.n) * 2.0**64 - 2.0**63) for r in counted], "lang string, bound double")
    near = rows.join(F.broadcast(bounds), "lang").where(F.col("h") <= F.col("bound")).select("lang", F.substring("text", 1, SAMPLE_CHARS).alias("text"), "h")
    sample = near.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("n") <= SAMPLE_DOCS)
    return Model(sorted((r.lang, r.text) for r in sample.select("lang", "text").collect()))


def _repair(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for chunk in chunks((i, text) for i, text in pairs if text is not None and not text.isascii()):
                unusual = model.unusual([text for _, text in chunk])
                for n, (i, text) in enumerate(chunk):
                    restored, steps = model.undone(*unusual[n]) if n in unusual else (text, [])
                    lost = model.lossy(restored)
                    if steps or lost:
                        for column, value in zip(out, (i, restored, steps, lost), strict=True):
                            column.append(value)
            types = (pa.int64(), pa.string(), pa.list_(pa.string()), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "restored", "steps", "lossy"])

    return run


def garbled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None) -> DataFrame:
    """(doc_id, restored, steps, lossy): the garbled documents only, with their text restored.

    ``steps`` names the decodings undone; ``lossy`` tells that some characters were replaced by U+FFFD and
    can't be recovered, the rest of the text being restored all the same. Null, empty, blank and ASCII
    texts are sound. Repeated rows give repeated rows; extra columns are ignored; whole texts are read.
    """
    spark = docs.sparkSession
    rows = spread(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where(F.col(text_col).isNotNull()))
    shared = spark.sparkContext.broadcast(model or learn(docs, text_col, lang_col))
    return rows.mapInArrow(_repair(shared), "doc_id bigint, restored string, steps array<string>, lossy boolean")
