"""Command line: generate, build-index, query, detect, path, benchmark."""

from __future__ import annotations

import argparse
import json
import os
import platform
import sys
import time
from dataclasses import asdict
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .operators import detect, graph
from .operators.search import plan_trace, save_prepared, search
from .sources import sinks, synthetic
from .sources.ingest import ingest
from .storage import new_path, numbered, passing, written

BENCHMARK_QUERY = "outcome:failure AND user:ana"


def session() -> SparkSession:
    out = SparkSession.builder.appName("siftwick").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    out.sparkContext.setLogLevel("ERROR")
    return out


def rows(df: DataFrame) -> list:
    """Rows for printing; callers pass limited results."""
    return [json.loads(x) for x in df.toJSON().collect()]


def show(value: object) -> None:
    print(json.dumps(value, indent=2, ensure_ascii=False, default=str))


def generate(a: argparse.Namespace, spark: SparkSession) -> None:
    events = synthetic.generate_events(spark, a.count, a.seed, a.scenario)
    (sinks.write_csv if a.format == "csv" else sinks.write_jsonl)(events, a.output)
    print(f"generated={a.count} seed={a.seed} output={a.output}")


def build_index(a: argparse.Namespace, spark: SparkSession) -> None:
    result = ingest(spark, a.input, a.format)
    sinks.save_snapshot(result.events, a.output)
    n = result.counts()
    print(f"indexed={n['valid']} invalid={n['invalid']} duplicates={n['duplicates']} output={a.output}")
    for r in result.invalid.orderBy("row").limit(10).collect():
        print(f"row {r['row']}: {r['code']}: {r['message']}", file=sys.stderr)


def query(a: argparse.Namespace, spark: SparkSession) -> None:
    events = sinks.load_snapshot(spark, a.index)
    show({"query": a.query, "matches": rows(search(events, a.query, a.limit)), "plan": asdict(plan_trace(events, a.query))})


def detections(a: argparse.Namespace, spark: SparkSession) -> None:
    show(rows(detect.detect_all(sinks.load_snapshot(spark, a.index))))


def path(a: argparse.Namespace, spark: SparkSession) -> None:
    events = numbered(sinks.load_snapshot(spark, a.index), ["timestamp", "id"], "event_seq")
    show(asdict(graph.path(*graph.build(events), a.source, a.target, a.mode)))


def benchmark(a: argparse.Namespace, spark: SparkSession) -> None:
    """Build once, then count matches in both modes, which must agree."""
    raw = written(synthetic.generate_events(spark, a.size, a.seed), "benchmark-raw")
    begin = time.perf_counter_ns()
    path = new_path(spark, "benchmark")
    table = save_prepared(raw, path)
    passing(spark, path)
    report: dict = {"events": a.size, "seed": a.seed, "iterations": a.iterations, "query": a.query, "build_ns": time.perf_counter_ns() - begin}
    found: dict[str, int] = {}
    for name, mode in (("indexed", "indexed"), ("linear", "scan")):
        begin = time.perf_counter_ns()
        for _ in range(a.iterations):
            found[name] = search(table, a.query, mode=mode, ordered=False).count()
        report[f"{name}_total_ns"] = time.perf_counter_ns() - begin
        report[f"{name}_mean_ns"] = report[f"{name}_total_ns"] // max(1, a.iterations)
    if found["indexed"] != found["linear"]:
        raise SystemExit("indexed and linear results differ")
    report |= {
        "matches": found["indexed"],
        "observed_speedup": report["linear_total_ns"] / max(1, report["indexed_total_ns"]),
        "recorded_at": datetime.now(timezone.utc).isoformat(),
        "environment": {"os": platform.system(), "arch": platform.machine(), "logical_processors": os.cpu_count(), "spark": spark.version, "python": platform.python_version()},
        "note": "Local observation, not a universal performance claim",
    }
    if a.output:
        Path(a.output).write_text(json.dumps(report, indent=2))
    show(report)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="siftwick", description=__doc__)
    sub = out.add_subparsers(required=True)

    def command(name: str, f) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.set_defaults(run=f)
        return p

    p = command("generate", generate)
    p.add_argument("-c", "--count", type=int, default=10_000)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("-s", "--scenario", choices=synthetic.SCENARIOS, default="mixed")
    p.add_argument("-f", "--format", choices=("jsonl", "csv"), default="jsonl")
    p.add_argument("-o", "--output", required=True)
    p = command("build-index", build_index)
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-f", "--format", choices=("jsonl", "csv"))
    p.add_argument("-o", "--output", required=True)
    p = command("query", query)
    p.add_argument("-i", "--index", required=True)
    p.add_argument("-l", "--limit", type=int, default=100)
    p.add_argument("query")
    p = command("detect", detections)
    p.add_argument("-i", "--index", required=True)
    p = command("path", path)
    p.add_argument("-i", "--index", required=True)
    p.add_argument("--mode", choices=("hops", "risk"), default="hops")
    p.add_argument("source")
    p.add_argument("target")
    p = command("benchmark", benchmark)
    p.add_argument("--size", type=int, default=100_000)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--iterations", type=int, default=25)
    p.add_argument("--query", default=BENCHMARK_QUERY)
    p.add_argument("-o", "--output")
    return out


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    a.run(a, session())


if __name__ == "__main__":
    main()
