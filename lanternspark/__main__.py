"""Command line: chunk, ingest, ask, add, serve, eval-suite, eval-paraphrase, eval-grounding, smoke."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from lanternspark.operators.chunking import ChunkerConfig
from lanternspark.operators.evaluation import check_gates, format_report
from lanternspark.operators.grounding import GroundingConfig
from lanternspark.operators.training import ContrastiveConfig
from lanternspark.plans import suite
from lanternspark.plans.retriever import Retriever, add_to_index
from lanternspark.session import build_session
from lanternspark.sources import files, tsv


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lanternspark")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *flags: tuple) -> None:
        own = sub.add_parser(name)
        for names, options in flags:
            own.add_argument(*names, **options)

    f = lambda *names, **options: (names, options)
    cuts = (f("--strategy", default="paragraph"), f("--max-chars", type=int, default=800), f("--overlap", type=int, default=100), f("--min-chars", type=int, default=20), f("--start-id", type=int, default=0), f("--source", default="doc"))
    ask = (f("--k", type=int, default=5), f("--min-score", type=float, default=0.25), f("--retrieve", default="hybrid"))
    command("chunk", f("--input", "-i", required=True), f("--out", "-o", required=True), *cuts)
    command("ingest", f("--chunks", required=True), f("--out", required=True), f("--dim", type=int, default=128), f("--embedder", default="contrastive", choices=("contrastive", "word2vec", "hashing")), f("--pairs"), f("--epochs", type=int, default=420))
    command("ask", f("--index", required=True), f("--query", "-q", required=True), *ask)
    command("add", f("--index", required=True), f("--out", required=True), f("--chunks"), f("--input"), f("--text"), f("--keep-ids", action="store_true"), *cuts)
    command("serve", f("--index", required=True), f("--host", default="127.0.0.1"), f("--port", type=int, default=8443), f("--cert"), f("--key"), *ask)
    command("eval-suite", f("--data", required=True), f("--no-ablations", action="store_true"))
    command("eval-paraphrase", f("--index", required=True), f("--pairs", required=True), f("--max-jaccard", type=float, default=0.30), f("--retrieve", default="hybrid"))
    command("eval-grounding", f("--index", required=True), f("--pairs", required=True), f("--ood-query", action="append", default=[]), f("--min-score", type=float, default=0.25), f("--retrieve", default="hybrid"))
    command("smoke")
    return p


def _queries(spark: SparkSession, *texts: str):
    return spark.createDataFrame(list(enumerate(texts)), "qid bigint, query string")


def smoke(spark: SparkSession) -> list[str]:
    """Four behaviours on three chunks; what fails."""
    rows = [(0, "a", "The lighthouse on Orsk island was built in 1873 by Danish masons."), (1, "b", "Copper boils far above the melting temperature of tin."), (2, "c", "The archive opens on Tuesday mornings.")]
    chunks = spark.createDataFrame(rows, "id bigint, source string, text string")
    own = Retriever.build(spark, chunks, mode="sparse")
    out = {r.qid: r for r in own.ask(_queries(spark, "lighthouse Orsk island built", "", "purple dragons toaster", "archive opens Tuesday")).collect()}
    checks = {
        "an in-domain query cites its chunk": list(out[0].check.cited_ids)[:1] == [0],
        "a blank query is refused": out[1].refused,
        "an out-of-scope query is refused": out[2].refused,
        "every answer validates": all(r.check.ok for r in out.values()),
    }
    return [name for name, good in checks.items() if not good]


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = build_session()
    if a.command == "smoke":
        failed = smoke(spark)
        print("\n".join(failed) or "ok")
        return int(bool(failed))
    cuts = ChunkerConfig(a.strategy, a.max_chars, a.overlap, a.start_id, a.source, True, a.min_chars) if a.command in ("chunk", "add") else None
    if a.command == "chunk":
        tsv.save_chunks(files.chunk_files(spark, a.input, cuts), a.out)
        return 0
    if a.command == "ingest":
        chunks = tsv.load_chunks(spark, a.chunks)
        if a.embedder == "contrastive":
            if not a.pairs:
                raise SystemExit("--pairs is required by the contrastive embedder")
            own = Retriever.build_contrastive(spark, chunks, tsv.load_train_pairs(spark, a.pairs), ContrastiveConfig(dim=a.dim, epochs=a.epochs))
        elif a.embedder == "word2vec":
            own = Retriever.build_word2vec(spark, chunks)
        else:
            from lanternspark.operators.embedders import HashingEmbedder

            own = Retriever.build(spark, chunks, HashingEmbedder(a.dim))
        print(own.save(a.out))
        return 0
    if a.command == "eval-suite":
        report = suite.run_folder(spark, a.data, not a.no_ablations)
        print(format_report(report))
        failed = check_gates(report)
        print("\n".join(failed))
        return int(bool(failed))
    if a.command == "add":
        given = [x for x in (a.chunks, a.input, a.text) if x]
        if len(given) != 1:
            raise SystemExit("exactly one of --chunks, --input and --text is required")
        if a.text:
            batch = spark.createDataFrame([(0, a.source, a.text)], "id bigint, source string, text string")
        else:
            batch = tsv.load_chunks(spark, a.chunks) if a.chunks else files.chunk_files(spark, a.input, cuts)
        print(add_to_index(spark, a.index, batch, a.out, not a.keep_ids).count(), "chunks added")
        return 0
    own = Retriever.open(spark, a.index, mode=a.retrieve)
    if a.command == "ask":
        row = own.ask(_queries(spark, a.query), a.k, GroundingConfig(min_score=a.min_score)).first()
        print(row.answer)
        print(json.dumps({"mode": row.mode, "ok": row.check.ok, "reason": row.check.reason, "cited": list(row.check.cited_ids)}))
        return int(not row.check.ok)
    if a.command == "serve":
        from lanternspark.service.rag import RagService, serve

        serve(RagService(spark, own, a.k, GroundingConfig(min_score=a.min_score)), a.host, a.port, a.cert, a.key).serve_forever()
    labeled = tsv.load_labeled(spark, a.pairs, allow_empty=True)
    if a.command == "eval-paraphrase":
        report = suite.paraphrase(own, labeled, a.max_jaccard)
        failed = report["recall_1"] < 1
    else:
        from lanternspark.functions.constants import OUT_OF_SCOPE

        report = suite.grounding(own, labeled, _queries(spark, "", *(a.ood_query or OUT_OF_SCOPE[:10])), GroundingConfig(min_score=a.min_score))
        failed = any(v for k, v in report.items() if k.startswith("failed_"))
    print(format_report(report))
    return int(failed)


if __name__ == "__main__":
    sys.exit(main())
