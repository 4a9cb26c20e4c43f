"""Problem 2: records of evaluation splits that also stand, exactly or almost, in the training split.

Every evaluation record, normalised to its words, is cut into passages: consecutive runs of up to
four words, one around each of its rarest words, so that there are more of them than words may be lost. A shard of records gives one
Aho-Corasick automaton over all its passages, which is built once, broadcast, and scans the training
texts where they lie. A matched passage is an interval of the running text; it grows as long as the text
goes on as the record does, and the intervals of a record are merged into its coverage. Coverage that
reaches the threshold settles the pair. Where it doesn't, the sets of words are compared.

Similarity is of word sets, so a record whose words were reordered, or that got words in between, may keep
no passage whole. For these the automaton also holds each rarest word as a passage of its own: two sets
that are alike enough share a word that is early in both by rarity, and how early is known from the sizes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternspark.llm.words import words
from lanternspark.session import cut, rows_of, spread

#: Words of the records of one automaton; records the driver takes at once; texts whose result a task keeps.
SHARD_WORDS, BLOCK_RECORDS, KEPT = 1 << 19, 20_000, 1 << 14
#: Words of a passage at most; how a word is spelled that no record has.
RUN, OTHER = 4, "   "


def class_key(own: list[str]) -> bytes:
    return xxhash.xxh3_128_digest(" ".join(own).encode("utf-8", "surrogatepass"))


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching intervals as one each, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


class Shard:
    """The records of one shard and the automaton over their passages."""

    def __init__(self, records: list[tuple[bytes, list[str]]], threshold: float):
        import ahocorasick

        self.keys, self.threshold = [k for k, _ in records], threshold
        df = Counter(w for _, own in records for w in set(own))
        #: Words from the rarest on; those of no record are rarer still.
        self.order = {w: n for n, (w, _) in enumerate(sorted(df.items(), key=lambda x: (x[1], x[0])), 1)}
        self.letters = {w: chr(0x4E00 + (n >> 12)) + chr(0x140 + (n >> 6 & 63)) + chr(0x100 + (n & 63)) for w, n in self.order.items()}
        self.records = [own for _, own in records]
        self.sets, self.firsts = [], []
        number: dict[str, int] = {}
        #: Of each passage the records it is a run of, and those it is a rarest word of, by size and rank of that word.
        self.runs: list[dict] = []
        self.ones: list[dict] = []
        #: Of each record its runs: (passage, offset).
        self.cuts: list[list[tuple[int, int]]] = []

        def passage(own: list[str]) -> int:
            n = number.setdefault(" ".join(own), len(number))
            if n == len(self.runs):
                self.runs.append({})
                self.ones.append({})
            return n

        for r, own in enumerate(self.records):
            place: dict[str, int] = {}
            for k, w in enumerate(own):
                place.setdefault(w, k)
            self.sets.append(frozenset(place))
            #: How many of the first k words stand there for the first time.
            self.firsts.append([0, *accumulate(int(place[w] == k) for k, w in enumerate(own))])
            size = len(place)
            lead = sorted(place, key=self.order.__getitem__)[: size - math.ceil(threshold * size - 1e-9) + 1]
            at = sorted((place[w], rank) for rank, w in enumerate(lead))
            cuts = [0, *(p for p, _ in at[1:]), len(own)]
            self.cuts.append([])
            for (p, rank), low, high in zip(at, cuts, cuts[1:], strict=False):
                self.ones[passage([own[p]])].setdefault((size, rank), []).append(r)
                parts = math.ceil((high - low) / RUN)
                marks = [low + (high - low) * k // parts for k in range(parts + 1)]
                for a, b in zip(marks, marks[1:], strict=False):
                    self.cuts[r].append((n := passage(own[a:b]), a))
                    if a <= p < b:
                        self.runs[n].setdefault((size, rank), []).append(r)
        self.lengths = [p.count(" ") + 1 for p in number]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for p, n in number.items():
            self.automaton.add_word(self.spelled(p.split(" ")), n)
        self.automaton.make_automaton()
        self._known: dict[tuple[int, int], tuple] = {}

    def spelled(self, own: list[str]) -> str:
        """Words in three characters each, of an alphabet for each place, so that matches lie on whole words."""
        return "".join([self.letters.get(w, OTHER) for w in own])

    def need(self, own: int, size: int) -> int:
        """The words that sets of these sizes must share."""
        t = self.threshold
        return math.ceil(t / (1 + t) * (own + size) - 1e-9)

    def _led(self, n: int, size: int) -> tuple[list[int], list[tuple[int, list[int]]]]:
        """The records that passage ``n`` leads to in a text of ``size`` words: those it is a run of, and, by
        how far back the word may stand in the text, those it is a rarest word of."""
        key = (n, size)
        led = self._known.get(key)
        if led is None:
            if len(self._known) >= 1 << 18:
                self._known.clear()
            soon = lambda own, rank: rank <= own - self.need(own, size)
            whole = [r for (own, rank), where in self.runs[n].items() if soon(own, rank) for r in where]
            lone = [(size - self.need(own, size), where) for (own, rank), where in self.ones[n].items() if soon(own, rank)]
            led = self._known[key] = (whole, [x for x in lone if x[0] >= 0])
        return led

    def scan(self, text: list[str]) -> list[tuple[int, int, int, int]]:
        """(record, covered, common, either) of every record alike enough to the text."""
        have = set(text)
        size = len(have)
        matched: dict[int, list[int]] = {}
        for end, n in self.automaton.iter(self.spelled(text)):
            matched.setdefault(n, []).append((end + 1) // 3)
        found: set[int] = set()
        early: dict[str, int] = {}
        for n, ends in matched.items():
            whole, lone = self._led(n, size)
            found.update(whole)
            if lone:
                if not early:
                    early = {w: k for k, w in enumerate(sorted(have, key=lambda w: self.order.get(w, 0)))}
                at = early[text[ends[0] - 1]]
                for limit, where in lone:
                    if at <= limit:
                        found.update(where)
        out = []
        for r in sorted(found):
            own, first = len(self.sets[r]), self.firsts[r]
            need = self.need(own, size)
            covered = sum(first[b] - first[a] for a, b in merged(self._intervals(r, text, matched)))
            if covered >= need or len(have & self.sets[r]) >= need:
                common = len(have & self.sets[r])
                out.append((r, covered, common, own + size - common))
        return out

    def _intervals(self, r: int, text: list[str], matched: dict[int, list[int]]) -> list[tuple[int, int]]:
        """The stretches of a record that the running text has around the record's matched passages."""
        own, out = self.records[r], []
        for n, offset in self.cuts[r]:
            length = self.lengths[n]
            for end in matched.get(n, ()):
                out.append(self._grown(own, text, offset, end - length, length))
                if out[-1] == (0, len(own)):
                    return out
        return out

    @staticmethod
    def _grown(own: list[str], text: list[str], offset: int, start: int, length: int) -> tuple[int, int]:
        """A matched passage, longer as long as the text goes on as the record does."""
        a, k = offset, start
        while a and k and own[a - 1] == text[k - 1]:
            a, k = a - 1, k - 1
        b, k = offset + length, start + length
        while b < len(own) and k < len(text) and own[b] == text[k]:
            b, k = b + 1, k + 1
        return a, b


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys, lines = [], [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = words(text)
            if own and i is not None:
                ids.append(i)
                keys.append(class_key(own))
                lines.append(" ".join(own))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(lines, pa.string())], names=["id", "class_key", "line"])


LINKS = "eval_class binary, train_id bigint, covered bigint, n_common bigint, n_either bigint"


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = shared.value
        kept: dict[str, list] = {}  # a text that comes again is scanned once
        types = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        names = [c.split()[0] for c in LINKS.split(", ")]
        for batch in batches:
            out: tuple[list, ...] = tuple([] for _ in types)
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = words(text)
                if not own or i is None:
                    continue
                line = " ".join(own) if len(own) < 256 else ""
                found = kept.get(line) if line else None
                if found is None:
                    found = shard.scan(own)
                    if line:
                        if len(kept) >= KEPT:
                            kept.clear()
                        kept[line] = found
                for r, *numbers in found:
                    for column, value in zip(out, (shard.keys[r], i, *numbers), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    return run


class SplitOverlap:
    """Pairs of an evaluation record and a training record whose word sets have Jaccard >= threshold.

    Both tables are read as (id, text); extra columns are ignored. Null ids and texts without any word are
    no case, a row delivered twice counts once, an id with several texts is compared with each, and an
    empty table gives an empty result. Training texts are scanned in place, once for each shard of
    SHARD_WORDS words of evaluation records; only matches are shuffled.
    """

    def __init__(self, evals: DataFrame, train: DataFrame, eval_id: str, train_id: str, text_col: str, threshold: float = 0.8):
        self.threshold = threshold
        read = lambda df, i: df.select(F.col(i).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("text is not null")
        self.evals = cut(read(evals, eval_id).mapInArrow(_classes, "id bigint, class_key binary, line string").distinct())
        self.train = spread(read(train, train_id))

    def _shards(self) -> Iterator[Shard]:
        block: list[tuple[bytes, list[str]]] = []
        size = 0
        for row in rows_of(self.evals.select("class_key", "line").distinct(), BLOCK_RECORDS):
            own = row.line.split(" ")
            if block and size + len(own) > SHARD_WORDS:
                yield Shard(block, self.threshold)
                block, size = [], 0
            block.append((bytes(row.class_key), own))
            size += len(own)
        if block:
            yield Shard(block, self.threshold)

    def links(self) -> DataFrame:
        """(eval_class, train_id, covered, n_common, n_either) of every training text alike enough to a class.

        ``covered`` is the number of the record's words in the merged intervals of the running text,
        ``n_common`` that of all words both have; it is larger where words stand alone or in another order.
        """
        spark = self.train.sparkSession
        out = spark.createDataFrame([], LINKS)
        for shard in self._shards():
            out = out.unionByName(self.train.mapInArrow(_scan(spark.sparkContext.broadcast(shard)), LINKS))
        return out

    def _classes(self) -> tuple[DataFrame, DataFrame]:
        """Distinct (eval_class, train_id) of links, and (eval_id, eval_class)."""
        return self.links().select("eval_class", "train_id").distinct(), self.evals.select(F.col("id").alias("eval_id"), F.col("class_key").alias("eval_class")).distinct()

    def pairs(self) -> DataFrame:
        """(eval_id, train_id) of every alike pair, copies expanded, once each."""
        links, evals = self._classes()
        return links.join(evals, "eval_class").select("eval_id", "train_id").distinct()

    def counts(self) -> DataFrame:
        """(eval_id, n): how many training records each evaluation record is alike to, if any.

        Copies aren't expanded: a class is counted once for all its records. Only ids with several
        different texts have their own pairs listed, as one training record may be alike to two of them.
        """
        links, evals = self._classes()
        links = cut(links)
        twice = self.evals.groupBy("id").agg(F.count_distinct("class_key").alias("k")).where("k > 1").select(F.col("id").alias("eval_id"))
        own = evals.join(links.groupBy("eval_class").agg(F.count("*").alias("n")), "eval_class")
        one = own.join(twice, "eval_id", "left_anti").select("eval_id", "n")
        some = evals.join(twice, "eval_id", "left_semi").join(links, "eval_class").select("eval_id", "train_id").distinct()
        return one.unionByName(some.groupBy("eval_id").agg(F.count("*").alias("n")))
