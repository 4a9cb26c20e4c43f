"""A long-lived service: an index opened once, requests answered one at a time, and a thin HTTP front."""

from __future__ import annotations

import ssl
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternspark.operators.grounding import GroundingConfig
from lanternspark.plans.retriever import Retriever
from lanternspark.service.json_api import answer_json, error_json, parse_ask

MAX_BODY = 8 << 20


class RagService:
    def __init__(self, spark: SparkSession, retriever: Retriever, k: int = 5, config: GroundingConfig = GroundingConfig(), generate=None):
        self.spark, self.retriever, self.k, self.config, self.generate = spark, retriever, k, config, generate
        self.lock = threading.Lock()
        retriever.chunks.cache()
        retriever.vectors.cache()

    def answer_requests(self, requests: DataFrame) -> DataFrame:
        """(qid, status, body) of (qid, body) requests, all in one plan; candidates are cut to each k's most."""
        parsed = requests.select("qid", parse_ask(F.col("body"), self.k).alias("r")).select("qid", "r.*")
        good = parsed.where("error is null").select("qid", "query", "k")
        most = good.agg(F.coalesce(F.max("k"), F.lit(self.k))).first()[0]
        ask = self.retriever.ask if self.generate is None else lambda q, k, c: self.retriever.ask_with_model(q, self.generate, k, c)
        answered = ask(good.select("qid", "query"), most, self.config)
        answered = answered.join(good.select("qid", "k"), "qid").withColumn("candidates", F.slice(F.col("candidates"), F.lit(1), F.col("k")))
        bodies = answer_json(answered).select("qid", F.lit(200).alias("status"), "body")
        wrong = F.struct(F.struct(F.lit(400).alias("status"), F.col("error").alias("message")).alias("error"))
        return bodies.unionByName(parsed.where("error is not null").select("qid", F.lit(400).alias("status"), F.to_json(wrong).alias("body")))

    def ask_json(self, body: str) -> tuple[int, str]:
        with self.lock:
            try:
                row = self.answer_requests(self.spark.createDataFrame([(0, body)], "qid bigint, body string")).first()
                return row.status, row.body
            except Exception as e:  # noqa: BLE001 - whatever fails is told to the caller
                return 500, error_json(500, str(e).splitlines()[0])


def respond(service: RagService, method: str, path: str, body: str) -> tuple[int, str]:
    """(status, JSON body) of a request."""
    path = path.split("?", 1)[0]
    if method == "OPTIONS":
        return 204, ""
    if path in ("/", "/health"):
        return (200, '{"status":"ok"}') if method in ("GET", "HEAD") else (405, error_json(405, "method not allowed"))
    if path == "/ask":
        return service.ask_json(body) if method == "POST" else (405, error_json(405, "method not allowed"))
    return 404, error_json(404, "not found")


def serve(service: RagService, host: str = "127.0.0.1", port: int = 8443, cert: str | None = None, key: str | None = None) -> ThreadingHTTPServer:
    """A server that isn't started yet; with a certificate it speaks TLS."""

    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if size > MAX_BODY:
                status, text = 413, error_json(413, "the request is too large")
            else:
                status, text = respond(service, self.command, self.path, self.rfile.read(size).decode("utf-8", "replace"))
            data = text.encode()
            self.send_response(status)
            for name, value in (("Content-Type", "application/json"), ("Content-Length", str(len(data))), ("Access-Control-Allow-Origin", "*"), ("Access-Control-Allow-Methods", "GET, POST, OPTIONS"), ("Access-Control-Allow-Headers", "Content-Type")):
                self.send_header(name, value)
            self.end_headers()
            if self.command != "HEAD":
                self.wfile.write(data)

        do_GET = do_POST = do_HEAD = do_OPTIONS = do_PUT = do_DELETE = _do

        def log_message(self, *args) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    if cert:
        context = ssl.SSLContext(ssl.PROTOCOL_TLS_SERVER)
        context.load_cert_chain(cert, key)
        server.socket = context.wrap_socket(server.socket, server_side=True)
    return server
