"""Command line: continue, explain, export, inspect, benchmark, checkpoint, resume and serve.

Exit codes: 0 done, 1 a failed check, 2 wrong use or missing input.
"""

from __future__ import annotations

import argparse
import json
import sys
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .operators import checkpoint, pipeline
from .session import local_session
from .sources import transcripts as sources

TARGETS = ("briefing", "explanation", "claude", "chatgpt", "gemini", "markdown")


def load(spark: SparkSession, path: str, label: str = "", archetype: str = "mixed") -> DataFrame:
    """conv, conversation, label, archetype, path of the transcripts at a path; ``-`` is standard input."""
    if path == "-":
        rows = spark.createDataFrame([("", "", sys.stdin.read().strip())], "path string, label string, text string").where("text <> ''")
    else:
        rows = sources.read_transcripts(spark, path, "*")
    named = rows.withColumn("label", F.lit(label)) if label else rows
    return named.select(F.xxhash64("path").alias("conv"), F.col("text").alias("conversation"), "label", F.lit(archetype).alias("archetype"), "path")


def records(spark: SparkSession, transcripts: DataFrame, tier: str = "full") -> DataFrame:
    now = datetime.now(UTC).isoformat()
    return checkpoint.records(pipeline.run(transcripts), transcripts.withColumn("created_at", F.lit(now)), tier).drop("conv")


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="threadloom", description=__doc__.splitlines()[0])
    parser.add_argument("--version", action="version", version=__version__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("continue", "explain", "export", "inspect", "benchmark", "checkpoint"):
        one = commands.add_parser(name)
        one.add_argument("path")
        one.add_argument("--label", default="")
        one.add_argument("--archetype", default="mixed")
        if name == "export":
            one.add_argument("--target", choices=TARGETS, default="markdown")
        if name == "checkpoint":
            one.add_argument("--store", required=True)
            one.add_argument("--tier", choices=("minimal", "standard", "full"), default="full")
    one = commands.add_parser("resume")
    one.add_argument("project")
    one.add_argument("--store", required=True)
    one.add_argument("--format", default="briefing")
    one = commands.add_parser("serve")
    one.add_argument("--store", required=True)
    one.add_argument("--port", type=int, default=8765)
    return parser


def resumed(spark: SparkSession, store: str, project: str, form: str = "briefing") -> str | None:
    row = checkpoint.resume(spark.read.parquet(store), project, form).first()
    return row and row.text


def handler(spark: SparkSession, store: str):
    """Requests on localhost: GET /health, POST /v1/extract, /v1/checkpoint, /v1/resume."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self, code: int, payload: dict) -> None:
            body = json.dumps(payload, ensure_ascii=False).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self) -> None:  # noqa: N802
            if self.path == "/health":
                self.answer(200, {"status": "ok", "version": __version__})
            else:
                self.answer(404, {"error": "not found"})

        def do_POST(self) -> None:  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
            if self.path in ("/v1/extract", "/v1/checkpoint"):
                text = str(body.get("transcript") or "").strip()
                if not text:
                    return self.answer(400, {"error": "transcript is empty"})
                label = str(body.get("label") or body.get("project") or "")
                one = spark.createDataFrame([(0, text, label, str(body.get("archetype") or "mixed"), "")], "conv long, conversation string, label string, archetype string, path string")
                if self.path == "/v1/extract":
                    return self.answer(200, pipeline.run(one).drop("conv").first().asDict(True))
                made = records(spark, one)
                sources.write_checkpoints(made, store)
                return self.answer(200, made.select("id", "project", "state").first().asDict(True))
            if self.path == "/v1/resume":
                text = resumed(spark, store, str(body.get("project") or ""), str(body.get("format") or "briefing"))
                return self.answer(200, {"text": text}) if text else self.answer(404, {"error": "no such checkpoint"})
            return self.answer(404, {"error": "not found"})

        def log_message(self, *_) -> None:
            pass

    return Handler


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = _parser().parse_args(argv)
    except SystemExit as stop:
        return int(stop.code or 0)
    spark = spark or local_session()
    if args.command == "serve":
        HTTPServer(("127.0.0.1", args.port), handler(spark, args.store)).serve_forever()
    if args.command == "resume":
        text = resumed(spark, args.store, args.project, args.format)
        print(text if text else f"no checkpoint of {args.project}")
        return 0 if text else 2
    rows = load(spark, args.path, args.label, args.archetype)
    if rows.limit(1).count() == 0:
        print("no transcript found")
        return 2
    if args.command == "inspect":
        for r in pipeline.inspect(rows).collect():
            print(json.dumps(r.asDict(True)))
        return 0
    if args.command == "benchmark":
        done = pipeline.benchmark(rows).collect()
        for r in done:
            print(json.dumps(r.asDict(True)))
        return int(any(r.verdict == "fail" for r in done))
    if args.command == "checkpoint":
        sources.write_checkpoints(records(spark, rows, args.tier), args.store)
        return 0
    column = {"continue": "briefing", "explain": "explanation", "export": getattr(args, "target", "")}[args.command]
    for r in pipeline.run(rows).select(column).toLocalIterator():
        print(r[0])
    return 0


if __name__ == "__main__":
    sys.exit(main())
