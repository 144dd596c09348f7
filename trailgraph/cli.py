"""Command line: build, serve, inspect, tags."""

from __future__ import annotations

import argparse
import json
import os
import signal
import threading
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from . import api
from .operators.routes import BROADCAST_EDGES
from .plans.profile import load_profile
from .resident import Resident, TooLate
from .sources import store

#: Limits of the server.
MAX_ROUTES, TIMEOUT_S, MAX_BODY = 4, 30, 64 << 10


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="trailgraph")
    top.add_argument("--graph", default=os.environ.get("GRAPH_PATH", "graph"))
    top.add_argument("--log", default="WARN")
    top.add_argument("--threads", type=int)
    commands = top.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build")
    build.add_argument("pbf")
    for name, extra in (("--out", {}), ("--profile", {}), ("--bbox", {}), ("--usfs", {}), ("--usfs-snap", {"type": float, "default": 50.0}), ("--keep-private", {"action": "store_true"}), ("--no-simplify", {"action": "store_true"})):
        build.add_argument(name, **extra)
    serve = commands.add_parser("serve")
    serve.add_argument("--port", type=int, default=3000)
    serve.add_argument("--host", default="0.0.0.0")
    commands.add_parser("inspect")
    commands.add_parser("tags").add_argument("--profile")
    return top


class Server(ThreadingHTTPServer):
    """``GET /health`` and ``POST /route``, also across origins.

    At most ``MAX_ROUTES`` requests are planned at a time, others wait; one
    that has no answer after ``timeout_s`` gets status 408 and gives its planner
    back.  The graph is loaded once: into this process where it has no more
    than ``resident_edges`` edges, so that a request takes no Spark job; a
    larger one is answered by the batch plan, whose jobs end with the request.
    ``stop`` lets requests in work finish.
    """

    daemon_threads = False
    block_on_close = True

    def __init__(self, spark: SparkSession, path: str, host: str, port: int, timeout_s: float = TIMEOUT_S, resident_edges: int = BROADCAST_EDGES) -> None:
        self.spark, self.profile, self.timeout_s = spark, load_profile(), timeout_s
        self.graph = store.load(spark, path, self.profile.fingerprint())
        self.resident = Resident(self.graph, self.profile) if self.graph.edges.count() <= resident_edges else None
        self.planners = ThreadPoolExecutor(MAX_ROUTES)
        super().__init__((host, port), Handler)

    def answer(self, body: str, group: str, deadline: float) -> tuple[int, str, str]:
        """status, content_type and body for a request's JSON body."""
        if time.monotonic() > deadline:  # it waited too long; nobody listens any more
            raise TooLate
        if self.resident is not None:
            return self.resident.answer(body, deadline)
        self.spark.sparkContext.setJobGroup(group, "a route request", interruptOnCancel=True)
        asked = self.spark.createDataFrame([(0, body)], "request_id long, body string")
        row = api.answer(asked, self.graph, self.profile).first()
        return row["status"], row["content_type"], row["body"]

    def stop(self) -> None:
        """Take no more requests, finish those in work."""
        self.shutdown()
        self.server_close()
        self.planners.shutdown()


class Handler(BaseHTTPRequestHandler):
    timeout = TIMEOUT_S
    server: Server

    def reply(self, status: int, kind: str = "application/json", body: str = "", **headers: str) -> None:
        data = body.encode()
        self.send_response(status)
        own = {"Content-Type": kind, "Content-Length": str(len(data)), "Access-Control-Allow-Origin": "*"}
        for name, value in (own | {k.replace("_", "-"): v for k, v in headers.items()}).items():
            self.send_header(name, value)
        self.end_headers()
        self.wfile.write(data)

    def fail(self, status: int, error: str) -> None:
        self.reply(status, body=json.dumps({"error": error}))

    def do_OPTIONS(self) -> None:
        self.reply(200, Access_Control_Allow_Methods="GET,POST", Access_Control_Allow_Headers="content-type")

    def do_GET(self) -> None:
        if self.path == "/health":
            self.reply(200, body=json.dumps(api.health()))
        else:
            self.fail(404, "not found")

    def do_POST(self) -> None:
        size = int(self.headers.get("Content-Length") or 0)
        if self.path != "/route":
            self.fail(404, "not found")
        elif size > MAX_BODY:
            self.fail(413, "body too large")
        else:
            body = self.rfile.read(size).decode("utf-8", "replace")
            group, deadline = uuid.uuid4().hex, time.monotonic() + self.server.timeout_s
            planned = self.server.planners.submit(self.server.answer, body, group, deadline)
            try:
                self.reply(*planned.result(self.server.timeout_s))
            except (FutureTimeout, TooLate):
                if not planned.cancel():
                    self.server.spark.sparkContext.cancelJobGroup(group)
                self.fail(408, "no answer in time")
            except Exception as error:
                self.fail(500, str(error)[:300])


def server(spark: SparkSession, path: str, host: str, port: int, timeout_s: float = TIMEOUT_S, resident_edges: int = BROADCAST_EDGES) -> Server:
    return Server(spark, path, host, port, timeout_s, resident_edges)


def serve(spark: SparkSession, path: str, host: str, port: int) -> None:
    """Serve until a signal to end."""
    running = server(spark, path, host, port)
    for sign in (signal.SIGINT, signal.SIGTERM):
        signal.signal(sign, lambda *_: threading.Thread(target=running.shutdown).start())
    running.serve_forever()
    running.stop()


def main(args: list[str] | None = None) -> None:
    given = parser().parse_args(args)
    # intermediate tables of answered requests are deleted with the tables that stood for them
    builder = SparkSession.builder.appName("trailgraph").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if given.threads is not None:  # as many threads on this machine; a cluster's master says how many it has
        builder = builder.master(f"local[{given.threads}]")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel(given.log.upper())
    if given.command == "build":
        api.build_from_files(spark, given.pbf, given.out or given.graph, given.profile, given.bbox, given.keep_private, not given.no_simplify, given.usfs, given.usfs_snap).show(truncate=False)
    elif given.command == "serve":
        serve(spark, given.graph, given.host, given.port)
    elif given.command == "inspect":
        api.inspect(spark, given.graph).show(truncate=False)
    else:
        api.tags(spark, given.profile).show(1000, truncate=False)


if __name__ == "__main__":
    main()
