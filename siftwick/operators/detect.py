"""Detections: four rules over sliding windows of event time.

Windows are closed, [t - W, t]. Events at one time enter by id, so a row sees
earlier-or-equal (timestamp, id) only. Keys and values are case-sensitive, and
no rule looks at the event type. Keys are cut by time, so that no task has all
that a busy key ever did.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import epoch_seconds
from ..schema import SEVERITY_SCORE
from ..storage import written


@dataclass(frozen=True)
class DetectorConfig:
    brute_force_failures: int = 5
    spray_accounts: int = 5
    window_seconds: int = 300
    lateral_hosts: int = 3


# The explanations of the four rules, with places for their numbers.
EXPLANATIONS = {
    "brute-force": "{n} failed authentications for one account inside a {seconds} second sliding window.",
    "password-spray": "One source IP failed against {n} distinct accounts inside a {seconds} second sliding window.",
    "failure-then-success": "A successful authentication followed {n} recent failures for the same identity.",
    "lateral-movement": "One identity authenticated successfully on {n} distinct hosts inside the correlation window.",
}
COLUMNS = ("id", "kind", "severity", "started_at", "ended_at", "entities", "event_ids", "explanation", "evidence")


def _seconds(n: int) -> Column:
    return F.expr(f"INTERVAL {int(n)} SECONDS")


def _text(n: Column) -> Column:
    return n.cast("string")


def _explained(kind: str, n: Column, seconds: int = 0) -> Column:
    before, after = EXPLANATIONS[kind].replace("{seconds}", str(seconds)).split("{n}")
    return F.concat(F.lit(before), n, F.lit(after))


def _shaped(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*[columns[c].alias(c) for c in COLUMNS])


def _first_per(df: DataFrame, key: str) -> DataFrame:
    """The earliest row of each key by (timestamp, id), by partial sums and not a sort."""
    row = F.struct("timestamp", "id", *[c for c in df.columns if c not in ("timestamp", "id")])
    return df.groupBy(F.col(key).alias("__key")).agg(F.min_by(row, F.struct("timestamp", "id")).alias("r")).select("r.*")


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def _piece(seconds: int) -> Column:
    """The number of the stretch of time, as long as the window, that an event is in."""
    return F.floor(F.col("t") / max(1, int(seconds) * 1_000_000)).cast("long")


def _pieces(rows: DataFrame, seconds: int) -> DataFrame:
    """Each event in its piece of time (own) and in the next: a piece then has all that windows which end in it hold.

    So a key that holds a third of all events is dealt to tasks by time.
    """
    rows = rows.withColumn("t", _micros(F.col("timestamp")))
    rows = rows.withColumn("at", F.explode(F.array(F.lit(0), F.lit(1))))
    return rows.withColumns({"piece": _piece(seconds) + F.col("at"), "own": F.col("at") == 0}).drop("at")


def brute_force(events: DataFrame, config: DetectorConfig | None = None) -> DataFrame:
    """The first time that a user has k failures in a window."""
    config = config or DetectorConfig()
    k = max(1, config.brute_force_failures)
    failed = events.where((F.col("outcome") == "failure") & F.col("user").isNotNull()).select("timestamp", "id", "user")
    w = Window.partitionBy("user", "piece").orderBy("timestamp", "id")
    last = _pieces(failed, config.window_seconds)
    last = last.withColumn("begin", F.lag("timestamp", k - 1).over(w) if k > 1 else F.col("timestamp"))
    last = last.withColumn("ids", F.collect_list("id").over(w.rowsBetween(1 - k, 0)))
    hits = _first_per(last.where(F.col("own") & (F.col("begin") >= F.col("timestamp") - _seconds(config.window_seconds))), "user")
    n = F.size("ids")
    return _shaped(
        hits,
        id=F.concat(F.lit("brute-force-"), "user", F.lit("-"), _text(epoch_seconds(F.col("timestamp")))),
        kind=F.lit("brute-force"),
        severity=F.lit("high"),
        started_at=F.col("begin"),
        ended_at=F.col("timestamp"),
        entities=F.array(F.concat(F.lit("user:"), "user")),
        event_ids=F.col("ids"),
        explanation=_explained("brute-force", _text(n), config.window_seconds),
        evidence=F.create_map(F.lit("failures"), _text(n), F.lit("window_seconds"), F.lit(str(config.window_seconds))),
    )


def _distinct_in_window(rows: DataFrame, key: str, value: str, seconds: int, least: int) -> DataFrame:
    """The first row per key whose window holds ``least`` distinct non-null values: with ``win`` and ``kinds``.

    Pieces of time are streamed in order, with the times of the ``least``
    values seen last as all state; windows are made for the winners alone.
    """
    least, span = max(1, least), int(seconds) * 1_000_000
    rows = rows.select(F.col(key).alias("k"), F.col(value).alias("v"), "timestamp", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, done = None, {}, False
        for b in batches:
            out = []
            for k, piece, own, t, i, v in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (k, piece) != now:
                    now, seen, done = (k, piece), {}, False
                if done:
                    continue
                seen.pop(v, None)
                seen[v] = t  # the latest stands last
                if len(seen) > least:
                    del seen[next(iter(seen))]
                if own and len(seen) == least and next(iter(seen.values())) >= t - span:
                    out.append((k, t, i))
                    done = True
            cols = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["k", "t1", "id1"])

    ordered = _pieces(rows.where("v IS NOT NULL"), seconds).select("k", "piece", "own", "t", "id", "v")
    ordered = ordered.repartition("k", "piece").sortWithinPartitions("k", "piece", "t", "id")
    hits = ordered.mapInArrow(run, "k string, t1 long, id1 string").groupBy("k").agg(F.min(F.struct("t1", "id1")).alias("h")).select("k", "h.*")
    # all that the winner's window holds is in its piece and the one before
    hits = hits.withColumn("t", F.col("t1")).withColumn("p", _piece(seconds)).drop("t").withColumn("piece", F.explode(F.array(F.col("p"), F.col("p") - 1))).drop("p")
    rows = rows.withColumn("t", _micros(F.col("timestamp"))).withColumn("piece", _piece(seconds))
    inside = (F.col("t") >= F.col("t1") - span) & (F.struct("t", "id") <= F.struct("t1", "id1"))
    rows = rows.join(hits, ["k", "piece"]).where(inside)
    win = rows.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("timestamp", "id", "v"))).alias("win"))
    kinds = F.array_sort(F.array_distinct(F.filter(F.transform("win", lambda x: x["v"]), lambda v: v.isNotNull())))
    return win.select(F.col("k").alias(key), F.element_at("win", -1)["timestamp"].alias("timestamp"), "win", kinds.alias("kinds"))


def password_spray(events: DataFrame, config: DetectorConfig | None = None) -> DataFrame:
    """The first time that an address fails against so many accounts in a window."""
    config = config or DetectorConfig()
    failed = events.where((F.col("outcome") == "failure") & F.col("source_ip").isNotNull()).select("timestamp", "id", "source_ip", "user")
    hits = _distinct_in_window(failed, "source_ip", "user", config.window_seconds, config.spray_accounts)
    n = _text(F.size("kinds"))
    return _shaped(
        hits,
        id=F.concat(F.lit("password-spray-"), F.replace("source_ip", F.lit("."), F.lit("-")), F.lit("-"), _text(epoch_seconds(F.col("timestamp")))),
        kind=F.lit("password-spray"),
        severity=F.lit("high"),
        started_at=F.col("win")[0]["timestamp"],
        ended_at=F.col("timestamp"),
        entities=F.concat(F.array(F.concat(F.lit("ip:"), "source_ip")), F.transform("kinds", lambda u: F.concat(F.lit("user:"), u))),
        event_ids=F.transform("win", lambda x: x["id"]),
        explanation=_explained("password-spray", n, config.window_seconds),
        evidence=F.create_map(F.lit("distinct_accounts"), n, F.lit("window_seconds"), F.lit(str(config.window_seconds))),
    )


def lateral_movement(events: DataFrame, config: DetectorConfig | None = None) -> DataFrame:
    """The first time that a user succeeds, at high severity, on so many hosts in three windows."""
    config = config or DetectorConfig()
    high = [s for s, n in SEVERITY_SCORE.items() if n >= SEVERITY_SCORE["high"]]
    rows = events.where((F.col("outcome") == "success") & F.col("severity").isin(high) & F.col("user").isNotNull() & F.col("host").isNotNull())
    hits = _distinct_in_window(rows.select("timestamp", "id", "user", "host"), "user", "host", 3 * config.window_seconds, config.lateral_hosts)
    n = _text(F.size("kinds"))
    return _shaped(
        hits,
        id=F.concat(F.lit("lateral-"), "user", F.lit("-"), _text(epoch_seconds(F.col("timestamp")))),
        kind=F.lit("lateral-movement"),
        severity=F.lit("high"),
        started_at=F.col("win")[0]["timestamp"],
        ended_at=F.col("timestamp"),
        entities=F.concat(F.array(F.concat(F.lit("user:"), "user")), F.transform("kinds", lambda h: F.concat(F.lit("host:"), h))),
        event_ids=F.transform("win", lambda x: x["id"]),
        explanation=_explained("lateral-movement", n),
        evidence=F.create_map(F.lit("distinct_hosts"), n),
    )


def _stretches(rows: DataFrame, key: list[str], seconds: int, least: int) -> DataFrame:
    """The successes that may fire and the failures near them, each with the number of its stretch of its key.

    A success may fire if enough failures stand in its window, whatever was
    cleared before. It is sure to if the last of them all come after the last
    success that may have cleared some; then nothing is held after it, and the
    next event begins a stretch of its own. Both are told by pieces of time, and
    a key's stretches are counted by its pieces, so a hot key is cut wherever a
    hit is sure. Only a key that fires for so long without such a hit is one
    stretch, since a clearing then may bear on all that follows.
    """
    here = Window.partitionBy(*key, "piece").orderBy("t", "id")
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    each = _pieces(rows, seconds).drop("timestamp").withColumn("r", F.row_number().over(here))
    spot = F.struct("t", "r")
    begin = F.lag(spot, least - 1).over(Window.partitionBy(*key, "piece", "bad").orderBy("t", "id")) if least > 1 else spot
    each = each.withColumn("begin", F.when(F.col("bad"), begin))
    each = each.withColumn("near", F.last("begin", ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, 0)))
    fires = ~F.col("bad") & F.coalesce(F.col("near.t") >= F.col("t") - seconds * 1_000_000, F.lit(False))
    # of the piece before not all is here that its successes see, so any of them may have cleared
    each = each.withColumn("fires", F.when(F.col("own"), fires).otherwise(~F.col("bad")))
    each = each.withColumn("cleared", F.max(F.when(F.col("fires"), F.col("r"))).over(before))
    sure = (F.col("near.r") > F.coalesce("cleared", F.lit(0))).cast("int")
    may = written(each.where("own AND fires").select(*key, "piece", "t", "id", "bad", sure.alias("sure")), "may-fire")
    hot = may.select(*key, F.inline(F.array(F.struct("piece", "sure"), F.struct((F.col("piece") - 1).alias("piece"), F.lit(0).alias("sure")))))
    hot = hot.groupBy(*key, "piece").agg(F.sum("sure").alias("hits"))
    past = Window.partitionBy(*key).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    hot = hot.select(*key, "piece", F.coalesce(F.sum("hits").over(past), F.lit(0)).alias("past"))
    failed = rows.where("bad").withColumn("t", _micros(F.col("timestamp"))).withColumn("piece", _piece(seconds))
    both = failed.select(*key, "piece", "t", "id", "bad", F.lit(0).alias("sure")).unionByName(may).join(hot, [*key, "piece"])
    return both.withColumn("stretch", F.col("past") + F.coalesce(F.sum("sure").over(before), F.lit(0)))


def failure_then_success(events: DataFrame, config: DetectorConfig | None = None) -> DataFrame:
    """Every success after enough failures of the same user and address in two windows; a hit clears them.

    What may fire is streamed by stretch (``_stretches``) and time with the
    window's failures as state. Unknown outcomes only evict, which the next
    event does as well.
    """
    config = config or DetectorConfig()
    seconds, least = 2 * config.window_seconds, max(1, config.brute_force_failures)
    span, key = seconds * 1_000_000, ["user", "source_ip"]
    rows = events.where(F.col("user").isNotNull() & F.col("source_ip").isNotNull() & F.col("outcome").isin("failure", "success"))
    kind = dict(rows.dtypes)["timestamp"]
    rows = rows.select("timestamp", "id", *key, (F.col("outcome") == "failure").alias("bad"))
    ordered = _stretches(rows, key, seconds, least).select(*key, "stretch", "t", "id", "bad")
    ordered = ordered.repartition(*key, "stretch").sortWithinPartitions(*key, "stretch", "t", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, deque()
        for b in batches:
            out = []
            for user, ip, part, t, i, bad in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (user, ip, part) != now:
                    now, held = (user, ip, part), deque()
                while held and held[0][0] < t - span:
                    held.popleft()
                if bad:
                    held.append((t, i))
                elif len(held) >= least:
                    out.append((user, ip, held[0][0], t, [x for _, x in held] + [i]))
                    held = deque()
            cols = zip(*out, strict=True) if out else [()] * 5
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, kinds, strict=True)], names=["user", "source_ip", "started", "ended", "ids"])

    folded = ordered.mapInArrow(run, "user string, source_ip string, started long, ended long, ids array<string>")
    started, ended = (F.timestamp_micros(c).cast(kind) for c in ("started", "ended"))
    folded = folded.select(*key, F.struct(started.alias("started"), ended.alias("ended"), "ids").alias("h"))
    n = _text(F.size("h.ids") - 1)
    return _shaped(
        folded,
        id=F.concat(F.lit("failure-success-"), "user", F.lit("-"), _text(epoch_seconds(F.col("h.ended")))),
        kind=F.lit("failure-then-success"),
        severity=F.lit("critical"),
        started_at=F.col("h.started"),
        ended_at=F.col("h.ended"),
        entities=F.array(F.concat(F.lit("user:"), "user"), F.concat(F.lit("ip:"), "source_ip")),
        event_ids=F.col("h.ids"),
        explanation=_explained("failure-then-success", n),
        evidence=F.create_map(F.lit("preceding_failures"), n),
    )


RULES = (brute_force, password_spray, failure_then_success, lateral_movement)


def detect_all(events: DataFrame, config: DetectorConfig | None = None) -> DataFrame:
    """All rules' detections by (started_at, id)."""
    parts = [rule(events, config) for rule in RULES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("started_at", "id")
