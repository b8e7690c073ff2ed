"""Wall-clock times of tasks, executor figures from Spark's own REST endpoint, host figures
read by tasks, and a loop that sends them on."""

from __future__ import annotations

import json
import shutil
import socket
import time
import urllib.request
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

FIELDS = ["id", "hostPort", "isActive", "rddBlocks", "memoryUsed", "diskUsed", "totalCores", "maxTasks", "activeTasks", "failedTasks", "completedTasks", "totalTasks", "totalDuration", "totalGCTime", "totalInputBytes", "totalShuffleRead", "totalShuffleWrite", "maxMemory"]


class Timer:
    """Collects (task, seconds)."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, float]] = []

    @contextmanager
    def timed(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.rows.append((name, time.perf_counter() - began))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "task string, seconds double")


def executor_metrics(spark: SparkSession) -> DataFrame:
    """A row per executor; empty where the web UI is off."""
    schema = ", ".join(f"{f} {'string' if f in ('id', 'hostPort') else 'boolean' if f == 'isActive' else 'long'}" for f in FIELDS)
    url = spark.sparkContext.uiWebUrl
    if not url:
        return spark.createDataFrame([], schema)
    with urllib.request.urlopen(f"{url}/api/v1/applications/{spark.sparkContext.applicationId}/executors", timeout=10) as reply:
        found = json.load(reply)
    return spark.createDataFrame([tuple(x.get(f) for f in FIELDS) for x in found], schema)


def graphite_lines(rows: list[dict], epoch: int, prefix: str = "spark") -> list[str]:
    """Plaintext metric lines of executor rows: path value epoch."""
    return [f"{prefix}.{r['id']}.{k} {int(v)} {epoch}" for r in rows for k, v in sorted(r.items()) if k != "id" and isinstance(v, int | float)]


HOST_FIELDS = ["cpuUsage", "cpuUser", "cpuSystem", "cpuIdle", "memoryTotal", "memoryAvailable", "networkIn", "networkOut", "diskTotal", "diskUsed"]


def _counters(interface: str | None) -> tuple[list[int], int, int]:
    """Processor time by kind, bytes received and bytes sent so far; all interfaces but the loopback unless one is named."""
    with open("/proc/stat") as f:
        times = [int(x) for x in f.readline().split()[1:9]]
    got = sent = 0
    with open("/proc/net/dev") as f:
        for line in f.readlines()[2:]:
            name, _, rest = line.partition(":")
            cells = rest.split()
            if name.strip() == interface or interface is None and name.strip() != "lo":
                got, sent = got + int(cells[0]), sent + int(cells[8])
    return times, got, sent


def host_figures(seconds: float = 0.2, interface: str | None = None, folder: str = "/") -> dict[str, float]:
    """This host's processor shares over ``seconds`` in per cent, memory and disk in bytes, network bytes so far."""
    before, *_ = _counters(interface)
    time.sleep(seconds)
    after, got, sent = _counters(interface)
    user, nice, system, idle, wait, irq, soft, stolen = (max(0, b - a) for a, b in zip(before, after, strict=True))
    total = max(1, user + nice + system + idle + wait + irq + soft + stolen)
    with open("/proc/meminfo") as f:
        memory = {x.partition(":")[0]: 1024 * int(x.split()[1]) for x in f}
    disk = shutil.disk_usage(folder)
    rest = 100.0 * (idle + wait) / total
    figures = [100.0 - rest, 100.0 * (user + nice) / total, 100.0 * (system + irq + soft) / total, rest]
    return dict(zip(HOST_FIELDS, [*figures, memory["MemTotal"], memory["MemAvailable"], got, sent, disk.total, disk.used], strict=True))


def host_metrics(spark: SparkSession, seconds: float = 0.2, interface: str | None = None) -> DataFrame:
    """A row for each host that ran one of as many short tasks as the cluster has cores."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sum(b.num_rows for b in batches):
            figures = host_figures(seconds, interface)
            yield pa.RecordBatch.from_arrays([pa.array([socket.gethostname()]), *[pa.array([float(figures[k])]) for k in HOST_FIELDS]], ["host", *HOST_FIELDS])

    n = spark.sparkContext.defaultParallelism
    rows = spark.range(0, n, 1, n).mapInArrow(read, "host string, " + ", ".join(f"{k} double" for k in HOST_FIELDS))
    return rows.dropDuplicates(["host"])


def graphite(host: str = "localhost", port: int = 2003) -> Callable[[list[str]], None]:
    """Sends plaintext lines to a Graphite listener."""

    def send(lines: list[str]) -> None:
        with socket.create_connection((host, port), timeout=10) as s:
            s.sendall("".join(f"{x}\n" for x in lines).encode())

    return send


def poll(spark: SparkSession, send: Callable[[list[str]], None], seconds: float = 1.0, rounds: int | None = None, interface: str | None = None) -> None:
    """Every ``seconds``, the figures of all executors and hosts as lines; for ever unless ``rounds`` is given."""
    k = 0
    while rounds is None or k < rounds:
        began, now = time.monotonic(), int(time.time())
        executors = [r.asDict() for r in executor_metrics(spark).collect()]
        hosts = [{"id": f"host.{r['host']}"} | {f: r[f] for f in HOST_FIELDS} for r in host_metrics(spark, min(0.2, seconds), interface).collect()]  # a row per host
        send(graphite_lines(executors, now) + graphite_lines(hosts, now))
        k += 1
        if rounds is None or k < rounds:
            time.sleep(max(0.0, seconds - (time.monotonic() - began)))
