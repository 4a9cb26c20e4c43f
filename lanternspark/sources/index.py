"""An index on disk: chunks and vectors as Parquet, weights, and a meta file that is checked when opened."""

from __future__ import annotations

import json
import struct
from collections import Counter
from dataclasses import asdict, dataclass, fields

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternspark.functions.constants import NO_EVIDENCE_ID
from lanternspark.functions.text import is_sentinel_row
from lanternspark.operators.embedders import ContrastiveEmbedder, Embedder, HashingEmbedder, MeanEmbedder

VERSION = 2
METRICS = {"cosine": "cosine", "euclidean": "euclidean", "l2": "euclidean", "inner_product": "inner_product", "ip": "inner_product", "dot": "inner_product"}


@dataclass(frozen=True)
class IndexMeta:
    version: int = VERSION
    embedder_id: str = ""
    dim: int = 0
    metric: str = "cosine"
    index_kind: str = "exact"
    n_chunks: int = 0
    n_real_chunks: int = 0
    has_no_evidence: int = 0


def parse_metric(name: str) -> str:
    if name not in METRICS:
        raise ValueError(f"metric {name!r} is none of {', '.join(METRICS)}")
    return METRICS[name]


def validate_meta(m: IndexMeta) -> IndexMeta:
    problems = [
        (m.dim <= 0, "dim must be over 0"),
        (not m.embedder_id, "the embedder's id is missing"),
        (not 0 <= m.version <= VERSION, f"version {m.version} is not supported"),
        (m.index_kind not in ("exact", "hnsw"), f"index kind {m.index_kind!r} is not supported"),
        (parse_metric(m.metric) != "cosine", f"metric {m.metric!r} is not supported"),
        (m.has_no_evidence not in (0, 1), "has_no_evidence must be 0 or 1"),
    ]
    for wrong, why in problems:
        if wrong:
            raise ValueError(why)
    return m


def dump_meta(m: IndexMeta) -> str:
    return "".join(f"{k}={v}\n" for k, v in asdict(m).items())


def parse_meta(text: str) -> IndexMeta:
    """From key=value lines or JSON. Unknown keys are ignored; a file without a version is an old one, whose
    number of real chunks follows from the others."""
    raw = json.loads(text) if text.lstrip().startswith("{") else dict(line.split("=", 1) for line in text.splitlines() if "=" in line)
    known = {f.name: type(f.default) for f in fields(IndexMeta)}
    own = {k: known[k](v) for k, v in raw.items() if k in known}
    own.setdefault("version", 0)
    if "n_real_chunks" not in own:
        own["n_real_chunks"] = own.get("n_chunks", 0) - own.get("has_no_evidence", 0)
    return validate_meta(IndexMeta(**own))


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\x00").text(path)


def _read_text(spark: SparkSession, path: str) -> str:
    return "".join(r.value for r in spark.read.text(path, wholetext=True).collect()).rstrip("\x00")


def describe(chunks: DataFrame, embedder: Embedder) -> IndexMeta:
    n, real = chunks.agg(F.count("*"), F.count_if(F.col("id") != NO_EVIDENCE_ID)).first()
    return IndexMeta(embedder_id=embedder.id, dim=embedder.dim, n_chunks=n, n_real_chunks=real, has_no_evidence=int(n > real))


def validate_index(m: IndexMeta, chunks: DataFrame, vectors: DataFrame) -> None:
    """One job over both tables: counts, sizes of vectors and the sentinel must agree with the meta, and a
    reserved id must be the sentinel's by source and text."""
    fake = (F.col("id") < 0) & ~is_sentinel_row(F.col("id"), F.col("source"), F.col("text"))
    c = chunks.agg(F.count("*").alias("n"), F.count_if(F.col("id") != NO_EVIDENCE_ID).alias("real"), F.count_if(fake).alias("fake")).first()
    v = vectors.agg(F.count("*").alias("n"), F.min(F.size("vec")).alias("lo"), F.max(F.size("vec")).alias("hi")).first()
    problems = [
        (c.n != m.n_chunks, f"{c.n} chunks, but the meta says {m.n_chunks}"),
        (c.real != m.n_real_chunks, f"{c.real} real chunks, but the meta says {m.n_real_chunks}"),
        (v.n != c.n, f"{v.n} vectors for {c.n} chunks"),
        (v.n and not v.lo == v.hi == m.dim, f"vectors of {v.lo} to {v.hi}, but the meta says {m.dim}"),
        ((c.n > c.real) != bool(m.has_no_evidence), "the sentinel doesn't agree with the meta"),
        (c.fake, "a reserved id isn't the sentinel's by source and text"),
    ]
    for wrong, why in problems:
        if wrong:
            raise ValueError(why)


def save_weights(spark: SparkSession, embedder: Embedder, path: str) -> None:
    """Weights as (kind, name, n, vec) rows, kind being token, ngram or bigram; hashing has none."""
    if isinstance(embedder, HashingEmbedder):
        return
    names = {n: t for t, n in embedder.vocab.items()}
    first_bigram = len(names) + getattr(embedder, "ngrams", 0)
    rows = [("token" if n in names else "ngram" if n < first_bigram else "bigram", names.get(n), n, row.tolist()) for n, row in enumerate(embedder.rows)]
    spark.createDataFrame(rows, "kind string, name string, n int, vec array<float>").write.mode("overwrite").parquet(path)


def load_embedder(spark: SparkSession, m: IndexMeta, path: str) -> Embedder:
    """The embedder an index was made with; its id and size must be those of the meta."""
    if m.embedder_id.startswith("hashing"):
        return HashingEmbedder(m.dim)
    rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r.n)  # a model, not data: bounded by its vocabulary
    table = np.array([r.vec for r in rows], np.float32)
    vocab = {r.name: r.n for r in rows if r.kind == "token"}
    if m.embedder_id.startswith("word2vec"):
        own: Embedder = MeanEmbedder(vocab, table)
    elif m.embedder_id.startswith("contrastive"):
        count = Counter(r.kind for r in rows)
        if set(count) - {"token", "ngram", "bigram"}:
            raise ValueError("the weights don't tell n-gram from bigram buckets")
        own = ContrastiveEmbedder(vocab, table, count["ngram"], count["bigram"], m.embedder_id)
    else:
        raise ValueError(f"unknown embedder {m.embedder_id!r}")
    if own.dim != m.dim:
        raise ValueError(f"weights of {own.dim}, but the meta says {m.dim}")
    return own


def save(spark: SparkSession, path: str, chunks: DataFrame, vectors: DataFrame, embedder: Embedder) -> IndexMeta:
    """Everything into a new folder; the meta comes last, so a broken write can't be opened."""
    chunks.select("id", "source", "text").write.mode("overwrite").parquet(f"{path}/chunks")
    vectors.select("id", "vec").write.mode("overwrite").parquet(f"{path}/vectors")
    save_weights(spark, embedder, f"{path}/weights")
    meta = describe(spark.read.parquet(f"{path}/chunks"), embedder)
    _write_text(spark, f"{path}/meta", dump_meta(meta))
    return meta


def load(spark: SparkSession, path: str) -> tuple[IndexMeta, DataFrame, DataFrame, Embedder]:
    meta = parse_meta(_read_text(spark, f"{path}/meta"))
    chunks, vectors = spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/vectors")
    validate_index(meta, chunks, vectors)
    return meta, chunks, vectors, load_embedder(spark, meta, f"{path}/weights")


def next_chunk_id(chunks: DataFrame) -> int:
    return chunks.agg(F.coalesce(F.max(F.when(F.col("id") >= 0, F.col("id"))), F.lit(-1)) + 1).first()[0]


#: Weight files of other tools: a magic word, a version, sizes, then names and rows of 32-bit floats.
MAGIC = {"contrastive": b"NCTR", "word2vec": b"NW2V"}
MAX_TOKEN = 65535


def dump_weights(embedder: ContrastiveEmbedder | MeanEmbedder) -> bytes:
    """The binary form. Of contrastive weights, version 2: <magic, version, dim, words, n-gram and bigram
    buckets>, every <length, token>, then all rows. Of word vectors, version 1: <magic, version, dim, words>,
    then every <length, token, row>."""
    words = sorted(embedder.vocab, key=embedder.vocab.get)
    if isinstance(embedder, ContrastiveEmbedder):
        out = [MAGIC["contrastive"], struct.pack("<5I", 2, embedder.dim, len(words), embedder.ngrams, embedder.bigrams)]
    else:
        out = [MAGIC["word2vec"], struct.pack("<3I", 1, embedder.dim, len(words))]
    rows = embedder.rows.astype("<f4")
    apart = isinstance(embedder, ContrastiveEmbedder)
    for w in words:
        raw = w.encode()
        if len(raw) > MAX_TOKEN:
            raise ValueError("a token is longer than 65535 bytes")
        out += [struct.pack("<H", len(raw)), raw, b"" if apart else rows[embedder.vocab[w]].tobytes()]
    return b"".join([*out, rows.tobytes() if apart else b""])


def parse_weights(data: bytes) -> ContrastiveEmbedder | MeanEmbedder:
    """Contrastive weights of versions 1 (words only) and 2, word vectors of version 1; anything cut short or
    of another kind is an error."""
    kind = next((k for k, m in MAGIC.items() if data[:4] == m), None)
    if kind is None or len(data) < 16:
        raise ValueError("not a file of weights")
    version, dim, n = struct.unpack_from("<3I", data, 4)
    if version not in ((1, 2) if kind == "contrastive" else (1,)):
        raise ValueError(f"version {version} is not supported")
    at = 16
    grams = pairs = 0
    vocab: dict[str, int] = {}
    rows: list[np.ndarray] = []
    try:
        if version == 2:
            grams, pairs = struct.unpack_from("<2I", data, 16)
            at = 24
        for k in range(n):
            (size,) = struct.unpack_from("<H", data, at)
            vocab[data[at + 2 : at + 2 + size].decode()] = k
            at += 2 + size
            if kind == "word2vec":
                rows.append(np.frombuffer(data, "<f4", dim, at))
                at += 4 * dim
        if kind == "word2vec":
            if not n or not dim:
                raise ValueError("the file holds no word vectors")
            return MeanEmbedder(vocab, np.stack(rows))
        table = np.frombuffer(data, "<f4", (n + grams + pairs) * dim, at)
    except (struct.error, ValueError) as e:
        raise ValueError(f"the file is cut short or empty: {e}") from e
    return ContrastiveEmbedder(vocab, table.reshape(-1, dim), grams, pairs, f"contrastive-v{version}")
