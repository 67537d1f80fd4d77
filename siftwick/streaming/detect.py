"""Rules over unbounded events, with state that watermarks let go."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.detect import DetectorConfig
from ..operators.search import predicate
from ..schema import EVENT


def read_events(spark: SparkSession, path: str, late: str = "10 minutes") -> DataFrame:
    """A folder of Parquet event files as a stream; events later than ``late`` may be lost."""
    return spark.readStream.schema(EVENT).parquet(path).withWatermark("timestamp", late)


def search_stream(events: DataFrame, query: str) -> DataFrame:
    """Matching events as they come."""
    return events.where(predicate(events, query))


def failures_by_window(events: DataFrame, config: DetectorConfig | None = None, slide_seconds: int = 60) -> DataFrame:
    """Users with enough failures in a sliding window, once the window is final."""
    config = config or DetectorConfig()
    w = F.window("timestamp", f"{config.window_seconds} seconds", f"{slide_seconds} seconds")
    failed = events.where((F.col("outcome") == "failure") & F.col("user").isNotNull())
    counts = failed.groupBy(w.alias("w"), "user").agg(F.count("*").alias("failures"))
    return counts.where(F.col("failures") >= config.brute_force_failures).select("user", F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "failures")


FOUND = "user string, source_ip string, started_at timestamp, ended_at timestamp, failures int"
STATE = "times array<timestamp>"


def failure_success_stream(events: DataFrame, config: DetectorConfig | None = None) -> DataFrame:
    """A success after enough failures of the same user and address; a hit clears them.

    State holds the failure times of two windows per key. It goes when a key
    has been silent for longer than that in event time. Events of one trigger
    are taken by (timestamp, id).
    """
    config = config or DetectorConfig()
    span = pd.Timedelta(seconds=2 * config.window_seconds)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = [pd.Timestamp(t) for t in state.get[0]] if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["timestamp", "id"], kind="stable")
        hits = []
        for at, outcome in zip(rows["timestamp"], rows["outcome"], strict=True):
            held = [t for t in held if t >= at - span]
            if outcome == "failure":
                held.append(at)
            elif outcome == "success" and len(held) >= config.brute_force_failures:
                hits.append((*key, held[0], at, len(held)))
                held = []
        state.update(([t.to_pydatetime() for t in held],))
        last = int(rows["timestamp"].max().timestamp() * 1000) + 2000 * config.window_seconds
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(hits, columns=["user", "source_ip", "started_at", "ended_at", "failures"])

    rows = events.where(F.col("user").isNotNull() & F.col("source_ip").isNotNull()).select("timestamp", "id", "user", "source_ip", "outcome")
    return rows.groupBy("user", "source_ip").applyInPandasWithState(step, FOUND, STATE, "append", GroupStateTimeout.EventTimeTimeout)
