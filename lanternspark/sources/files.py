"""Text files as documents, and folders of them as numbered chunks."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternspark.operators.chunking import ChunkerConfig, chunk_rows, number

#: Endings of text files; a name without an ending counts as well.
EXTENSIONS = (".txt", ".md", ".markdown", ".rst", ".text", ".log", "")


def extension(path: Column) -> Column:
    """The lower-cased ending with its dot, '' without one; a leading dot doesn't begin one."""
    name = F.substring_index(path, "/", -1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]*)$", 1))


def is_text(path: Column) -> Column:
    return extension(path).isin(*EXTENSIONS)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of every text file at or under ``path``; bytes that aren't UTF-8 become U+FFFD."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.where(is_text(F.col("path"))).select("path", F.decode("content", "UTF-8").alias("text"))


def chunk_files(spark: SparkSession, path: str, config: ChunkerConfig = ChunkerConfig()) -> DataFrame:
    """(id, source, text): the chunks of all text files, by sorted path, numbered on from start_id.

    The source is the file's path under ``path``, or its name if that is the file; the configured source
    is not used. Markdown files take the markdown strategy in place of paragraphs.
    """
    files = read_files(spark, path)
    root = path.rstrip("/")
    bare = F.regexp_replace("path", "^[a-z]+:/*", "/")
    inside = F.when(bare == root, F.substring_index(bare, "/", -1)).otherwise(F.substring(bare, F.lit(len(root) + 2), F.length(bare)))
    files = files.select("path", "text", inside.alias("source"))
    marked = extension(F.col("path")).isin(".md", ".markdown") & F.lit(config.strategy == "paragraph")
    one = chunk_rows(files.where(~marked), config, "path", "text", "source")
    two = chunk_rows(files.where(marked), replace(config, strategy="markdown"), "path", "text", "source")
    return number(one.unionByName(two), config.start_id).select("id", "source", "text")
