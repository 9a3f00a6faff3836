"""Election, leases, peers, rate limiting, metrics text and the command line, as pure functions and small classes."""

from __future__ import annotations

import argparse
import http.server
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from .state import StateStore


@dataclass(frozen=True)
class Election:
    """Follower, Candidate, Leader; one step a tick."""

    role: str = "Follower"
    term: int = 0

    def tick(self) -> Election:
        if self.role == "Follower":
            return Election("Candidate", self.term + 1)
        return Election("Leader", self.term)

    def step_down(self) -> Election:
        return Election("Follower", self.term)

    @property
    def is_leader(self) -> bool:
        return self.role == "Leader"


def tick_millis(node: int) -> int:
    return 150 + (node * 50) % 150


def claim_lease(now: float, last_heartbeat: float, interval: float, held: bool = False) -> bool:
    """A lease held stays held; else it falls to the claimer after two missed heartbeats."""
    return held or now - last_heartbeat > 2 * interval


class Peers:
    def __init__(self, local: str):
        self.local, self.nodes = local, []

    def register(self, cluster: str, endpoint: str, active: bool = True) -> None:
        self.nodes.append({"cluster_id": cluster, "endpoint_url": endpoint, "is_active": active})


class TokenBucket:
    """Starts full; ``acquire`` waits until the tokens are there."""

    def __init__(self, capacity: float, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.capacity, self.rate, self.clock, self.sleep = capacity, rate, clock, sleep
        self.tokens, self.at, self.lock = float(capacity), clock(), threading.Lock()

    def acquire(self, n: float = 1) -> None:
        if n > self.capacity:
            raise ValueError("more tokens than the bucket holds")
        with self.lock:
            while True:
                now = self.clock()
                self.tokens, self.at = min(self.capacity, self.tokens + (now - self.at) * self.rate), now
                if self.tokens >= n - 1e-9:
                    self.tokens -= n
                    return
                self.sleep(max((n - self.tokens) / self.rate, 0.001))


@dataclass
class Metrics:
    prefix: str = "rillforge"
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("ingested", "processed", "duplicates", "latency_micros", "latency_count"), 0))

    def add(self, name: str, n: int = 1) -> None:
        self.counts[name] += n

    def record_latency(self, micros: int) -> None:
        self.add("latency_micros", micros)
        self.add("latency_count")

    def render(self) -> str:
        c, p = self.counts, self.prefix
        lines = [(f"{p}_events_ingested_total", c["ingested"]), (f"{p}_events_processed_total", c["processed"]), (f"{p}_duplicates_filtered_total", c["duplicates"])]
        text = "".join(f"# TYPE {name} counter\n{name} {n}\n" for name, n in lines)
        name = f"{p}_processing_latency_seconds"
        return text + f"# TYPE {name} summary\n{name}_sum {c['latency_micros'] / 1e6:.6f}\n{name}_count {c['latency_count']}\n"

    def serve(self, port: int = 0) -> http.server.HTTPServer:
        """Prometheus text on a thread; port 0 picks a free one."""
        metrics = self

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_GET(self):
                body = metrics.render().encode()
                self.send_response(200)
                self.send_header("Content-Type", "text/plain; version=0.0.4")
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *_):
                pass

        server = http.server.ThreadingHTTPServer(("127.0.0.1", port), Handler)
        threading.Thread(target=server.serve_forever, daemon=True).start()
        return server


def observed(df: DataFrame, name: str | Observation = "cdc") -> DataFrame:
    """Throughput and replication lag as observed metrics of the query, by name or as an observation to read."""
    lag = F.unix_micros(F.current_timestamp()) - F.unix_micros(F.col("timestamp").cast("timestamp"))
    return df.observe(name, F.count(F.lit(1)).alias("throughput"), F.max(lag).alias("max_lag_micros"), F.avg(lag).alias("avg_lag_micros"))


class MetricsListener(StreamingQueryListener):
    """Adds each micro-batch's rows and duration."""

    def __init__(self, metrics: Metrics):
        self.metrics = metrics

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.metrics.add("ingested", int(event.progress.numInputRows or 0))
        self.metrics.record_latency(int(event.progress.batchDuration or 0) * 1000)

    def onQueryTerminated(self, event):
        pass


class UnknownCommand(Exception):
    pass


def parse_args(args: list[str]) -> tuple[str, str | None]:
    if not args:
        return "status", None
    if args[0] not in ("status", "inspect-offset", "schema-list"):
        return "unknown", " ".join(args)
    parser = argparse.ArgumentParser(add_help=False)
    parser.add_argument("command")
    parser.add_argument("source", nargs="?", default="postgres_users")
    found, _ = parser.parse_known_args(args)
    return found.command, None if found.command == "status" else found.source


def execute(command: tuple[str, str | None], store: StateStore) -> str:
    kind, source = command
    if kind == "status":
        return "HEALTHY"
    if kind == "inspect-offset":
        return f"{source}: {store.get_offset(source) or 'NONE'}"
    if kind == "schema-list":
        return f"{source}: {store.get_schema(source) or 'NONE'}"
    raise UnknownCommand(source or "")
