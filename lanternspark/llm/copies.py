"""Problem 5: copies hidden by formatting, by progressive refinement of a partition of the records.

The first round groups by cheap invariants that no formatting changes, the length of the stripped text and
its letter histogram. Only records that still share a class get the costly key: their fields, each as its
words, in sorted order. A round leaves nothing behind but a narrow table, of classes or of (key, id), which
is written once, so a table's texts are read twice in all. Classes are counted before any shuffle, and
those with very many members never go to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternspark.session import cut

WORD_RUN = r"[\p{L}\p{N}]+"


def stripped(text: Column) -> Column:
    """The letters and digits of the text alone, lower-cased: the same for all formats of a record."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def histogram(bare: Column) -> Column:
    """A fingerprint of how often each character occurs, whatever the order."""
    return F.xxhash64(F.array_join(F.array_sort(F.split(bare, "")), ""))


def canonical(text: Column) -> Column:
    """Fields between | or ; as words in order, fields without a word left out, the rest sorted."""
    fields = F.transform(F.split(text, r"[|;]"), lambda f: F.lower(F.array_join(F.regexp_extract_all(f, F.lit(f"({WORD_RUN})"), F.lit(1)), " ")))
    return F.array_join(F.array_sort(F.filter(fields, lambda f: f != "")), "|")


#: Parts of every class in the join of texts with classes; members from which a class's join is by broadcast:
#: there are at most rows / HOT such classes.
SALTS, HOT = 8, 1 << 17


class HiddenCopies:
    """Copies among the queries of one table.

    ``rows`` is read as (id, text); other columns are not compared. Rows with a null id, and texts that
    are null, blank or without any word, are no records. A row delivered twice under one id counts once;
    an id with several different texts is held in the class of each. Empty tables give empty results.
    """

    def __init__(self, rows: DataFrame, id_col: str, text_col: str):
        self.rows = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")

        self._classes: DataFrame | None = None

    def classes(self) -> DataFrame:
        """(key, id) of every record in a class of several members by the cheap invariants, once each."""
        if self._classes is None:
            bare = stripped(F.col("text"))
            rows = self.rows.withColumn("bare", bare).where(F.length("bare") > 0).select("id", "text", F.length("bare").alias("length"), histogram(F.col("bare")).alias("letters"))
            keys = ["length", "letters"]
            # different ids only, so a row delivered twice is no class
            several = cut(rows.groupBy(*keys).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select(*keys))
            several = several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            left = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(several, [*keys, "salt"], "left_semi")
            self._classes = cut(left.select(canonical(F.col("text")).alias("key"), "id").distinct())
        return self._classes

    def copies(self) -> DataFrame:
        """(keep_id, copy_id): every member of a class but its least id."""
        rows = self.classes()
        kept = cut(rows.groupBy("key").agg(F.min("id").alias("keep_id"), F.count("*").alias("n")).where("n > 1"))
        few, many = kept.where(F.col("n") <= HOT).select("key", "keep_id"), kept.where(F.col("n") > HOT).select("key", "keep_id")
        out = rows.join(few, "key").unionByName(rows.join(F.broadcast(many), "key"))
        return out.where("id != keep_id").select("keep_id", F.col("id").alias("copy_id")).distinct()

    def collapsed(self) -> DataFrame:
        """(keep_id, text, n_copies): one record for each class, single ones included, with its count.

        ``text`` is the kept record's own; records without a word are left out.
        """
        rows = self.rows.where(F.length(stripped(F.col("text"))) > 0).groupBy("id").agg(F.min("text").alias("text"))
        copies = cut(self.copies())
        counts = copies.groupBy("keep_id").agg((F.count("*") + 1).alias("n_copies"))
        kept = rows.join(copies.select(F.col("copy_id").alias("id")).distinct(), "id", "left_anti")
        return kept.join(counts, kept.id == counts.keep_id, "left").select(F.col("id").alias("keep_id"), "text", F.coalesce("n_copies", F.lit(1).cast("bigint")).alias("n_copies"))
