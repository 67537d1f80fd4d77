"""Deterministic made-up events."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EVENT

# The cast, the clock and the offsets of injected scenarios.
BASE = datetime(2026, 7, 30, 8, 0, 0, tzinfo=timezone.utc)
USERS = ("ana", "marcos", "lucia", "diego", "svc-backup", "ines")
HOSTS = ("ws-014", "ws-022", "ws-031", "srv-files", "dc-01", "vpn-01")
IPS = ("10.20.4.17", "10.20.4.22", "10.20.8.9", "198.51.100.42", "203.0.113.77")
SPRAYED = ("ana", "marcos", "lucia", "diego", "ines", "svc-backup")
LATERAL_HOSTS = ("ws-022", "srv-files", "dc-01")
SCENARIOS = ("baseline", "brute-force", "password-spray", "lateral-movement", "mixed")
MASK = (1 << 64) - 1
DRAWS = 5
#: Counts up to this are made on the driver, larger ones by tasks of so many rows.
DRIVER_ROWS = 20_000
ROWS_PER_TASK = 100_000


def _next(v: int) -> int:
    v ^= (v << 13) & MASK
    v ^= v >> 7
    return v ^ ((v << 17) & MASK)


def _apply(columns: list[int], v: int) -> int:
    out = 0
    for bit, column in enumerate(columns):
        if v >> bit & 1:
            out ^= column
    return out


class XorShift:
    def __init__(self, seed: int):
        self.state = max(seed, 1) & MASK

    def draw(self, n: int) -> int:
        self.state = _next(self.state)
        return self.state % n

    def jump(self, steps: int) -> XorShift:
        """As after so many draws: a step is linear in the bits, so its powers are matrices."""
        power = [_next(1 << bit) for bit in range(64)]
        while steps:
            if steps & 1:
                self.state = _apply(power, self.state)
            power = [_apply(power, column) for column in power]
            steps >>= 1
        return self


def _row(id_: str, at: datetime, source: str, user: str, host: str, ip: str, good: bool, severity: str, message: str, marked: bool) -> tuple:
    attributes = {"synthetic": "true"} | ({"scenario_marker": "true"} if marked else {})
    return (id_, at, source, "authentication", user, host, ip, "success" if good else "failure", severity, message, attributes)


def _marked(id_: str, at: datetime, user: str, host: str, ip: str, good: bool, severity: str) -> tuple:
    return _row(id_, at, "windows-security", user, host, ip, good, severity, "Sign-in accepted after failures" if good else "Invalid password", True)


def _after(start: datetime, seconds: int) -> datetime:
    return start + timedelta(seconds=seconds)


def _injected(seed: int, scenario: str) -> list[tuple]:
    mixed, out = scenario == "mixed", []
    tag = f"scenario-{seed}"
    if mixed or scenario == "brute-force":
        out += [_marked(f"{tag}-brute-{a}", _after(BASE, 30 + 18 * a), "ana", "ws-014", "198.51.100.42", False, "high") for a in range(7)]
        out.append(_marked(f"{tag}-brute-success", _after(BASE, 180), "ana", "ws-014", "198.51.100.42", True, "critical"))
    if mixed or scenario == "password-spray":
        start = _after(BASE, 1500 * mixed)
        out += [_marked(f"{tag}-spray-{a}", _after(start, 25 * a), u, "vpn-01", "203.0.113.77", False, "high") for a, u in enumerate(SPRAYED)]
    if mixed or scenario == "lateral-movement":
        start = _after(BASE, 3000 * mixed)
        out += [_marked(f"{tag}-lateral-{a}", _after(start, 90 * a), "svc-backup", h, "10.20.8.9", True, "high") for a, h in enumerate(LATERAL_HOSTS)]
    return out


def _background(rng: XorShift, seed: int, first: int, last: int) -> Iterator[tuple]:
    """Rows first to last - 1; the generator stands before the first's draws."""
    for i in range(first, last):
        at = _after(BASE, 13 * i + rng.draw(7))
        user, host, ip = USERS[rng.draw(6)], HOSTS[rng.draw(6)], IPS[rng.draw(5)]
        good = rng.draw(8) != 0
        source = "vpn" if i % 5 == 0 else "windows-security"
        message = "Interactive sign-in accepted" if good else "Invalid password"
        yield _row(f"evt-{seed:08x}-{i:08}", at, source, user, host, ip, good, "info" if good else "low", message, False)


def generate_rows(count: int, seed: int = 42, scenario: str = "mixed") -> list[tuple]:
    """Background rows and the scenario's; in order, and cut to count."""
    if scenario not in SCENARIOS:
        raise ValueError("unknown scenario")
    rows = [*_background(XorShift(seed), seed, 0, count), *_injected(seed, scenario)]
    rows.sort(key=lambda r: (r[1], r[0]))
    return rows[:count]


def generate_events(spark: SparkSession, count: int, seed: int = 42, scenario: str = "mixed") -> DataFrame:
    """The rows of ``generate_rows``; large counts are made by tasks, each of which jumps to its draws."""
    if count <= DRIVER_ROWS:
        return spark.createDataFrame(generate_rows(count, seed, scenario), EVENT)
    if scenario not in SCENARIOS:
        raise ValueError("unknown scenario")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = None
        for b in batches:
            if not b.num_rows:
                continue
            first = b.column(0)[0].as_py()  # ranges are in order within a task
            rng = rng or XorShift(seed).jump(DRAWS * first)
            cols = list(zip(*_background(rng, seed, first, first + b.num_rows), strict=True))
            kinds = [pa.string(), pa.timestamp("us", "UTC"), *[pa.string()] * 8, pa.map_(pa.string(), pa.string())]
            cols[-1] = [list(m.items()) for m in cols[-1]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=EVENT.fieldNames())

    made = spark.range(0, count, 1, -(-count // ROWS_PER_TASK)).mapInArrow(run, EVENT)
    extra = _injected(seed, scenario)
    if not extra:
        return made
    # injected rows push out the latest rows; none of the others can be among those
    last = BASE + timedelta(seconds=13 * (count - len(extra) - 2))
    head, tail = made.where(F.col("timestamp") < last), made.where(F.col("timestamp") >= last)
    early = [r for r in extra if r[1] < last]
    late = [r for r in extra if r[1] >= last]
    rows = head.unionByName(spark.createDataFrame(early, EVENT)) if early else head
    rest = tail.unionByName(spark.createDataFrame(late, EVENT)) if late else tail
    return rows.unionByName(rest.orderBy("timestamp", "id").limit(count - rows.count()))
