"""Problem 7: passages of evaluation items inside a corpus, by a prefix-filtered set join.

A window of an item is a set of word shingles. A document that holds the window holds all of them, so it
is enough to look for the window's rarest shingle in the whole corpus: its prefix. The first pass counts
the items' shingles over all documents and orders them by rarity; the second joins each document's
shingles with the prefixes, applies the bounds that length and position give, and verifies the words
themselves over the item's window. Only matches leave a task; documents are never shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternspark.llm.words import Fingerprints, shingles, words
from lanternspark.session import rows_of, spread

#: Words of items that go to the workers at a time; more items are taken block by block.
BLOCK_WORDS = 1 << 20
#: Items that the driver takes at once; beyond them it reads partition by partition.
BLOCK_ITEMS = 10_000


class Index:
    """The items of one block: their shingles by size, and after ``rank`` their windows' prefixes."""

    def __init__(self, items: list[tuple[int, list[str]]], window: int, shingle: int):
        table = Fingerprints()
        self.window, self.shingle = window, shingle
        self.items = [(i, w) for i, w in items if w]
        self.hashes = [table.of(w) for _, w in self.items]
        self.sizes = sorted({min(shingle, len(w)) for _, w in self.items})
        self.prefixes: dict[int, dict[int, list[tuple[int, int]]]] = {}
        self.sets = {g: np.unique(np.concatenate([shingles(h, g) for h in self.hashes if min(shingle, len(h)) == g])) for g in self.sizes}
        self._draw()

    def _draw(self) -> None:
        """A bit table in front of each sorted set: most shingles of a corpus end there."""
        self.bits = {}
        for g, known in self.sets.items():
            width = max(16, int(len(known) * 32).bit_length())
            bits = np.zeros(1 << width, bool)
            bits[(known >> np.uint64(64 - width)).astype(np.int64)] = True
            self.bits[g] = (np.uint64(64 - width), bits)

    def rank(self, counts: dict[tuple[int, int], int]) -> None:
        """Keep of every window its rarest shingle only; ties go to the smaller fingerprint."""
        for g in self.sizes:
            where: dict[int, set[tuple[int, int]]] = defaultdict(set)
            for n, h in enumerate(self.hashes):
                if min(self.shingle, len(h)) != g:
                    continue
                own = shingles(h, g)
                order = [(counts.get((g, int(x)), 0), int(x), k) for k, x in enumerate(own.tolist())]
                wide = min(self.window, len(h)) - g + 1
                for a in range(len(own) - wide + 1):
                    least = min(order[a : a + wide])
                    if least[0]:  # else no document has it
                        where[least[1]].add((n, least[2]))
            self.prefixes[g] = {x: sorted(v) for x, v in where.items()}
            self.sets[g] = np.array(sorted(where), np.uint64)
        self._draw()

    def hits(self, own: np.ndarray, g: int) -> np.ndarray:
        """Positions in ``own`` of fingerprints that the block knows."""
        shift, bits = self.bits[g]
        known = self.sets[g]
        if not len(known):
            return np.empty(0, np.int64)
        at = np.flatnonzero(bits[(own >> shift).astype(np.int64)])
        found = np.searchsorted(known, own[at])
        return at[known[np.minimum(found, len(known) - 1)] == own[at]]

    def holds(self, doc: list[str], h: np.ndarray, at: int, item: int, offset: int) -> bool:
        """Whether the words around ``at`` that go on as the item's do around ``offset`` fill a window."""
        need = min(self.window, len(self.hashes[item]))
        if len(doc) < need:
            return False
        own = self.hashes[item]
        left_room = min(at, offset, need - 1)
        right_room = min(len(h) - at, len(own) - offset, need)
        if left_room + right_room < need:  # the position leaves no room for a window
            return False
        same = h[at - left_room : at + right_room] == own[offset - left_room : offset + right_room]
        wrong = np.flatnonzero(~same)
        a = int(wrong[wrong < left_room].max(initial=-1)) + 1
        b = int(wrong[wrong >= left_room].min(initial=len(same)))
        if b - a < need:
            return False
        start, stop = at - left_room + a, at - left_room + b
        begin = offset - left_room + a
        return doc[start:stop] == self.items[item][1][begin : begin + stop - start]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[str], np.ndarray, np.ndarray]]:
    """(ids, all words, their fingerprints, offsets of the documents) of each batch."""
    table = Fingerprints()
    for batch in batches:
        ids, flat, offsets = [], [], [0]
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            flat += words(text)
            ids.append(i)
            offsets.append(len(flat))
        yield ids, flat, table.of(flat), np.array(offsets)


def _count(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        total = {g: np.zeros(len(s), np.int64) for g, s in index.sets.items()}
        for _, _, h, offsets in _batches(batches):
            for g in index.sizes:
                own = shingles(h, g)
                at = index.hits(own, g)
                doc = np.searchsorted(offsets, at, "right") - 1
                at = at[at + g <= offsets[doc + 1]]  # not across two documents
                np.add.at(total[g], np.searchsorted(index.sets[g], own[at]), 1)
        for g, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), g, np.int32)), pa.array(index.sets[g][some].view(np.int64)), pa.array(n[some])], names=["g", "shingle", "n"])

    return run


def _match(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for ids, flat, h, offsets in _batches(batches):
            found: set[tuple[int, int]] = set()
            for g in index.sizes:
                own = shingles(h, g)
                at = index.hits(own, g)
                doc = np.searchsorted(offsets, at, "right") - 1
                for p, d in zip(at.tolist(), doc.tolist(), strict=True):
                    if p + g > offsets[d + 1] or ids[d] is None:
                        continue
                    low, high = offsets[d], offsets[d + 1]
                    for item, offset in index.prefixes[g][int(own[p])]:
                        key = (index.items[item][0], ids[d])
                        if key not in found and index.holds(flat[low:high], h[low:high], p - low, item, offset):
                            found.add(key)
            a, b = zip(*sorted(found), strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["item_id", "doc_id"])

    return run


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, list[str]]]]:
    """The items in blocks of at most BLOCK_WORDS words (an item of more is a block of its own)."""
    block, size = [], 0
    for row in rows_of(items, BLOCK_ITEMS):
        own = words(row.text)
        if block and size + len(own) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((row.id, own))
        size += len(own)
    if block:
        yield block


def leaks(docs: DataFrame, items: DataFrame, window: int = 15, shingle: int = 5, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, doc_id) of every document that holds ``window`` consecutive words of an item, or all
    words, consecutively, of an item that has fewer; once each.

    Null ids and null, empty or wordless texts on either side are no case; rows delivered twice count
    once; extra columns are ignored; an empty table gives an empty result. Texts are read whole.
    """
    spark = docs.sparkSession
    rows = spread(docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("text is not null"))
    asked = items.select(F.col(item_id).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null").distinct()
    out = spark.createDataFrame([], "item_id bigint, doc_id bigint")
    for block in _blocks(asked):
        index = Index(block, window, shingle)
        if not index.items:
            continue
        first = spark.sparkContext.broadcast(index)
        counted = rows.mapInArrow(_count(first), "g int, shingle bigint, n bigint").groupBy("g", "shingle").agg(F.sum("n").alias("n"))
        #: At most as many rows as the block has shingles.
        counts = {(r.g, r.shingle & 0xFFFFFFFFFFFFFFFF): r.n for r in counted.collect()}
        index.rank(counts)
        found = rows.mapInArrow(_match(spark.sparkContext.broadcast(index)), "item_id bigint, doc_id bigint")
        out = out.unionByName(found)
    return out.distinct()
