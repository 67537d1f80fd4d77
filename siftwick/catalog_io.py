"""Registered queries that write the events and read them back, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import rank
from .sources import adapters, sinks
from .sources.ingest import ingest, read_csv, read_jsonl
from .storage import new_path, passing

EV = adapters.EVENTS_SQL
PLAIN = ("id", "source", "event_type", "user", "host", "source_ip", "outcome", "severity", "message")
PLAIN_SQL = ", ".join(f'"{c}"' for c in PLAIN)


def place(spark: SparkSession, name: str) -> str:
    """A folder that goes with the application."""
    path = new_path(spark, name)
    passing(spark, path)
    return path


def shown(events: DataFrame) -> DataFrame:
    """Times as microseconds, which no time zone bears on."""
    return events.select(*PLAIN, F.unix_micros("timestamp").alias("micros"), F.col("attributes")["k"].alias("k"))


def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, "events-jsonl")
    sinks.write_jsonl(adapters.events(spark, sf_dir), path)
    return shown(read_jsonl(spark, path).events)


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, "events-csv")
    sinks.write_csv(adapters.events(spark, sf_dir), path)
    return shown(read_csv(spark, path).events)


def snapshot_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, "events-snapshot")
    sinks.save_snapshot(adapters.events(spark, sf_dir), path)
    return sinks.load_snapshot(spark, path).select(*PLAIN, "timestamp", F.col("attributes")["k"].alias("k"))


def jsonl_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, "lines-jsonl")
    sinks.write_jsonl(adapters.events(spark, sf_dir), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, line): of eight lines six are refused, skipped, or twice there."""
    ev = adapters.events(spark, sf_dir)
    line, n = sinks.json_row(), F.col("id").cast("long")
    changes = {
        0: F.concat(F.lit("{not-json "), "id"),
        1: F.concat(F.lit('["'), "id", F.lit('"]')),
        2: F.regexp_replace(line, '"outcome":"[a-z]*"', '"outcome":"Failure"'),
        3: F.regexp_replace(line, '"k":"([0-9]*)"', '"k":$1'),
        4: F.regexp_replace(line, 'Z","source"', '","source"'),
        5: F.lit(" "),
    }
    made = line
    for k, value in changes.items():
        made = F.when(n % 8 == k, value).otherwise(made)
    return ev.select(n.alias("event_id"), F.explode(F.array_repeat(made, F.when(n % 8 == 7, 2).otherwise(1))).alias("value"))


def _ingested(spark: SparkSession, sf_dir: str):
    path = f"{place(spark, 'mixed')}/lines.jsonl"
    _lines(spark, sf_dir).select("value").write.text(path)
    return ingest(spark, path)


def jsonl_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir).invalid.groupBy("code", "message", "raw").agg(F.count("*").alias("n"))


def jsonl_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.duplicate_ids(_ingested(spark, sf_dir).events)


def ingest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _ingested(spark, sf_dir).counts()
    return spark.createDataFrame([(c["total_rows"], c["valid"], c["invalid"], c["duplicates"])], "total_rows long, valid long, invalid long, duplicates long")


def csv_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of four rows one has an unknown outcome and one attributes that are no object."""
    path = place(spark, "mixed-csv")
    ev, n = adapters.events(spark, sf_dir), F.col("id").cast("long")
    cells: dict[str, Column] = {c: F.col(c) for c in PLAIN}
    cells["outcome"] = F.when(n % 4 == 1, F.lit("Failure")).otherwise(F.col("outcome"))
    cells["timestamp"] = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    cells["attributes_json"] = F.when(n % 4 == 2, F.lit("[1]")).otherwise(F.lit("{}"))
    ev.select(*[v.alias(k) for k, v in cells.items()]).write.options(header=True, escape='"').csv(path)
    got = read_csv(spark, path)
    bad = got.invalid.groupBy("code").agg(F.count("*").alias("n"))
    return bad.unionByName(got.events.agg(F.lit("valid").alias("code"), F.count("*").alias("n")))


QUERIES = (jsonl_round_trip, csv_round_trip, snapshot_round_trip, jsonl_lines, jsonl_refused, jsonl_duplicates, ingest_totals, csv_refused)

SECONDS_SQL = """strftime(timestamp, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(timestamp) % 1000000 = 0 THEN ''
  WHEN epoch_us(timestamp) % 1000 = 0 THEN strftime(timestamp, '.%g') ELSE strftime(timestamp, '.%f') END"""


def _line_sql(outcome: str = "outcome", end: str = "Z", k: str = "'\"' || k || '\"'") -> str:
    cells = [("id", "id"), ("timestamp", f"{SECONDS_SQL} || '{end}'"), *[(c, f'"{c}"') for c in PLAIN[1:]]]
    cells = [(c, outcome if c == "outcome" else x) for c, x in cells]
    return "'{' || " + " || ',' || ".join(f"'\"{c}\":\"' || ({x}) || '\"'" for c, x in cells) + f" || ',\"attributes\":{{\"k\":' || {k} || '}}}}'"


def oracle_sql() -> dict[str, str]:
    whole = f"WITH {EV} SELECT {PLAIN_SQL}, epoch_us(timestamp) AS micros, k FROM ev"
    lines = f"""WITH {EV}, l AS (SELECT CASE id::BIGINT % 8 WHEN 0 THEN '{{not-json ' || id WHEN 1 THEN '["' || id || '"]' WHEN 2 THEN {_line_sql("'Failure'")}
  WHEN 3 THEN {_line_sql(k='k')} WHEN 4 THEN {_line_sql(end='')} END AS line, id::BIGINT % 8 AS m, id FROM ev)"""
    return {
        "jsonl_round_trip": whole,
        "csv_round_trip": whole,
        "snapshot_round_trip": f"WITH {EV} SELECT {PLAIN_SQL}, timestamp, k FROM ev",
        "jsonl_lines": f"WITH {EV} SELECT {_line_sql()} AS line FROM ev",
        "jsonl_refused": f"{lines} SELECT 'invalid_json' AS code, CASE m WHEN 0 THEN 'not JSON' ELSE 'not an event' END AS message, substring(line, 1, 240) AS raw, count(*) AS n FROM l WHERE m < 5 GROUP BY ALL",
        "jsonl_duplicates": f"WITH {EV} SELECT id, 2::BIGINT AS n FROM ev WHERE id::BIGINT % 8 = 7",
        "ingest_totals": f"""WITH {EV}, m AS (SELECT id::BIGINT % 8 AS m FROM ev)
SELECT (count(*) FILTER (m <> 5) + count(*) FILTER (m = 7))::BIGINT AS total_rows, (count(*) FILTER (m = 6) + 2 * count(*) FILTER (m = 7))::BIGINT AS valid,
       count(*) FILTER (m < 5) AS invalid, count(*) FILTER (m = 7) AS duplicates FROM m""",
        "csv_refused": f"WITH {EV} SELECT CASE id::BIGINT % 4 WHEN 1 THEN 'invalid_csv' WHEN 2 THEN 'invalid_attributes' ELSE 'valid' END AS code, count(*) AS n FROM ev GROUP BY 1",
    }
