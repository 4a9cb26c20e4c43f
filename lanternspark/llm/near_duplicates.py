"""Problem 1: near-duplicate texts by circulant MinHash, banding and exact Jaccard verification.

Texts whose shingle sets are equal form a class and are handled once, so copies never meet each other.
Two permutations give the whole signature: ``sigma`` scatters shingles over the positions of a circle
and ``pi`` ranks the positions; coordinate k is the least rank after turning the circle by k. A band
of coordinates makes a bucket key. Buckets are counted before anything is gathered; those of two
members are a candidate pair at once, larger ones are taken once per distinct membership and compared
in blocks of bounded size, so no task ever holds an unbounded bucket and only verified pairs leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternspark.llm.words import Fingerprints, mix, shingles, words
from lanternspark.session import cut, spread

#: Fixed parameters. 46 bands of 3 miss a pair of similarity 0.6 with odds 1.4e-5, one of 0.7 with 4e-9. The circle
#: has a place for every value of 16 bits, so its ranks stay in a processor's cache; shingles that share a place
#: only make more candidates.
CIRCLE_BITS, BANDS, ROWS, BLOCK = 16, 46, 3, 1024


def _ranks(seed: int, k: int) -> np.ndarray:
    """``pi`` with its first k entries repeated at its end, so that a turn of the circle is a slice."""
    pi = np.random.default_rng(seed).permutation(1 << CIRCLE_BITS).astype(np.uint16)
    return np.concatenate([pi, pi[:k]])


def signature(sets: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """All coordinates of one text: ``turns`` are the windows of ``pi``, ``sigma`` is a mix of the shingle."""
    at = (mix(sets ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - CIRCLE_BITS)).astype(np.int64)
    low = turns[at[:2048]].min(axis=0)
    for i in range(2048, len(at), 2048):
        np.minimum(low, turns[at[i : i + 2048]].min(axis=0), out=low)
    return low


def _shingle(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Fingerprints()
        for batch in batches:
            ids, keys, sets = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.unique(shingles(table.of(words(text)), size))
                if len(own) and i is not None:
                    ids.append(i)
                    keys.append(xxhash.xxh3_128_digest(own.tobytes()))
                    sets.append(own.view(np.int64))
            offsets = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            values = np.concatenate(sets) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                names=["id", "class_key", "shingles"],
            )

    return run


def _bands(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = BANDS * ROWS
        turns = np.lib.stride_tricks.sliding_window_view(_ranks(seed, width), width)
        salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        for batch in (b.slice(k, 1024) for b in batches for k in range(0, b.num_rows, 1024)):
            lists = batch.column(1)
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            sig = np.stack([signature(values[a:b], turns) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]).reshape(-1, BANDS, ROWS)
            key = np.broadcast_to(salt, sig.shape[:2])
            for r in range(ROWS):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r].astype(np.uint64))
            reps = np.repeat(batch.column(0).to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(reps, pa.int64())], names=["bucket", "rep"])

    return run


def overlaps(rows: list[np.ndarray], slice_width: int = 8192) -> np.ndarray:
    """Sizes of all pairwise intersections of ``rows``; memory is bounded by rows times slice_width."""
    flat = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    _, code, n = np.unique(flat, return_inverse=True, return_counts=True)
    keep = n[code] > 1  # what only one row holds is in no intersection
    owner, (names, code) = owner[keep], np.unique(code[keep], return_inverse=True)
    out = np.zeros((len(rows), len(rows)), np.float32)
    for low in range(0, len(names), slice_width):
        here = (code >= low) & (code < low + slice_width)
        x = np.zeros((len(rows), min(slice_width, len(names) - low)), np.float32)
        x[owner[here], code[here] - low] = 1
        out += x @ x.T
    return out.astype(np.int64)


def _alike(reps: np.ndarray, block: np.ndarray, same: bool, rows: list[np.ndarray], threshold: float) -> list[tuple[int, int, int, int]]:
    """The verified pairs of one task; equal blocks meet in the task of their own, that is if ``same``."""
    size = np.array([len(r) for r in rows])
    if len(rows) <= 8:
        sets = [set(r.tolist()) for r in rows]
        common = np.array([[len(x & y) for y in sets] for x in sets])
    else:
        common = overlaps(rows)
    a, b = np.nonzero(common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9)
    keep = reps[a] < reps[b]
    if not same:
        keep &= block[a] != block[b]
    a, b = a[keep], b[keep]
    both = common[a, b]
    return list(zip(reps[a].tolist(), reps[b].tolist(), both.tolist(), (size[a] + size[b] - both).tolist(), strict=True))


def _verify(threshold: float):
    """Over rows (bucket, i, j, block, rep, shingles) that stand together by (bucket, i, j)."""

    def flush(key: tuple, rows: list) -> list:
        reps, block = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        return _alike(reps, block, key[1] == key[2], [r[2] for r in rows], threshold) if len(rows) > 1 else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, found = None, [], []
        for batch in batches:
            lists = batch.column(5)
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            keys = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
            for n, (key, block, rep) in enumerate(zip(keys, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                if key != now:
                    found += flush(now, held) if held else []
                    now, held = key, []
                held.append((rep, block, values[offsets[n] : offsets[n + 1]].copy()))
            if len(found) > 50_000:
                yield _pairs(found)
                found = []
        found += flush(now, held) if held else []
        yield _pairs(found)

    return run


def _pairs(found: list) -> pa.RecordBatch:
    cols = zip(*found, strict=True) if found else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=["rep_a", "rep_b", "n_common", "n_either"])


class NearDuplicates:
    """Classes of equal shingle sets and the verified links between them.

    ``docs`` is read as (id, text); further columns are ignored. Rows with a null id, a null or blank
    text or fewer words than a shingle are in no class. A row delivered twice counts once. If one id
    has several texts, each of them is compared. An empty table gives empty results. Texts are taken
    whole, whatever their length.
    """

    def __init__(self, docs: DataFrame, id_col: str = "id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, seed: int = 7):
        rows = spread(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("text is not null"))
        # read twice, for members and for classes; a lost executor's part is computed again
        prints = rows.mapInArrow(_shingle(shingle), "id bigint, class_key binary, shingles array<bigint>").persist(StorageLevel.DISK_ONLY)
        self.members = prints.select("id", "class_key").distinct()
        classes = prints.groupBy("class_key").agg(F.min("id").alias("rep"), F.first("shingles").alias("shingles"))
        #: A class is named by its number while it travels through the buckets; numbers are unique, hashes needn't be.
        self.classes = cut(classes.withColumn("number", F.monotonically_increasing_id()))
        self.threshold, self.seed = threshold, seed
        self._links: DataFrame | None = None

    def _similar(self, a: Column, b: Column) -> tuple[Column, Column]:
        both = F.size(F.array_intersect(a, b)).cast("bigint")
        return both, F.size(a) + F.size(b) - both

    def links(self) -> DataFrame:
        """(class_a, class_b, n_common, n_either): each pair of different classes that is alike enough, once."""
        if self._links is not None:
            return self._links
        named = self.classes.select(F.col("number").alias("rep"), "class_key", "shingles")
        bands = named.select("rep", "shingles").mapInArrow(_bands(self.seed), "bucket bigint, rep bigint")
        mixed, other = F.xxhash64("rep", F.lit(1)), F.xxhash64("rep", F.lit(2))
        buckets = cut(
            bands.groupBy("bucket")
            .agg(F.count("*").alias("m"), F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.bit_xor(mixed).alias("x1"), F.bit_xor(other).alias("x2"))
            .where("m > 1")
            .groupBy("m", "lo", "hi", "x1", "x2")
            .agg(F.min("bucket").alias("bucket"))
        )
        sets = named.select("rep", "shingles")
        two = buckets.where("m = 2").select(F.col("lo").alias("rep_a"), F.col("hi").alias("rep_b"))
        two = two.join(sets.toDF("rep_a", "sh_a"), "rep_a").join(sets.toDF("rep_b", "sh_b"), "rep_b")
        common, either = self._similar(F.col("sh_a"), F.col("sh_b"))
        two = two.select("rep_a", "rep_b", common.alias("n_common"), either.alias("n_either")).where(F.col("n_common") >= self.threshold * F.col("n_either") - 1e-9)

        blocks = F.ceil(F.col("m") / BLOCK).cast("int")
        many = bands.join(buckets.where("m > 2").select("bucket", "m"), "bucket").select("bucket", "rep", blocks.alias("n"))
        many = many.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        many = many.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep")
        key = ["bucket", "i", "j"]
        many = many.join(sets, "rep").select(*key, "block", "rep", "shingles").repartition(*key).sortWithinPartitions(*key)
        many = many.mapInArrow(_verify(self.threshold), "rep_a bigint, rep_b bigint, n_common bigint, n_either bigint")
        pairs = two.unionByName(many).dropDuplicates(["rep_a", "rep_b"])
        names = named.select("rep", "class_key")
        self._links = cut(
            pairs.join(names.toDF("rep_a", "class_a"), "rep_a").join(names.toDF("rep_b", "class_b"), "rep_b").select("class_a", "class_b", "n_common", "n_either")
        )
        return self._links

    def pairs(self) -> DataFrame:
        """(id_a, id_b) with id_a < id_b for every pair of alike ids, copies expanded."""
        one, two = self.members.toDF("id_a", "class_a"), self.members.toDF("id_b", "class_b")
        links = self.links().select("class_a", "class_b")
        across = links.join(one, "class_a").join(two, "class_b").where("id_a != id_b")
        across = across.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
        within = one.join(two, F.col("class_a") == F.col("class_b")).where("id_a < id_b").select("id_a", "id_b")
        return across.unionByName(within).distinct()

    def groups(self) -> DataFrame:
        """(id, class_id, group_id, n_links): one row per document.

        ``class_id`` is the least id with the same shingle set, ``group_id`` the least id of the connected
        group, ``n_links`` the number of other classes the document's class is linked to.
        """
        ids = self.classes.select("class_key", F.col("rep").alias("class_id"))
        edges = self.links().select("class_a", "class_b")
        edges = edges.join(ids.toDF("class_a", "a"), "class_a").join(ids.toDF("class_b", "b"), "class_b").select("class_a", "class_b", "a", "b")
        keyed = edges.select(F.hex("class_a").alias("a"), F.hex("class_b").alias("b"))
        label = components(keyed)
        least = label.join(ids.select(F.hex("class_key").alias("node"), "class_id"), "node").groupBy("label").agg(F.min("class_id").alias("group_id"))
        label = label.join(least, "label").select("node", "group_id")
        degree = keyed.select("a").unionAll(keyed.select("b")).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n_links"))
        classes = ids.withColumn("node", F.hex("class_key")).join(label, "node", "left").join(degree, "node", "left")
        classes = classes.select("class_key", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))
        return self.members.join(classes, "class_key").select("id", "class_id", "group_id", "n_links")


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, label) of every node of undirected ``edges`` (a, b); equal labels mean one component.

    Every round takes the least label of the neighbours, then of the label's own node; both are
    aggregated before the shuffle, so a node with very many edges costs no single task its edges.
    Raises when max_rounds don't suffice, rather than returning split components.
    """
    both = cut(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    for _ in range(max_rounds):
        near = both.join(label, both.b == label.node).groupBy("a").agg(F.min("label").alias("near"))
        step = label.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("label", "near").alias("next"), "label")
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        step = step.join(jump, "next").select("node", F.least("next", "far").alias("next"), "label")
        step = cut(step)
        if step.where("next != label").isEmpty():
            return step.select("node", "label")
        label = step.select("node", F.col("next").alias("label"))
    raise RuntimeError(f"components have not settled after {max_rounds} rounds")
