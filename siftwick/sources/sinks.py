"""Writers: JSONL, CSV, and snapshots that know whether they are whole."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import rfc3339
from ..schema import EVENT

FORMAT, VERSION = "siftwick-index", 1
ORDER = EVENT.fieldNames()


class SnapshotError(ValueError):
    pass


def json_row(utc: str = "Z") -> Column:
    """An event as one JSON object, fields in order, nulls written, attributes by key."""
    attributes = F.map_from_entries(F.array_sort(F.map_entries("attributes")))
    cells = {c: F.col(c) for c in ORDER} | {"timestamp": rfc3339(F.col("timestamp"), utc), "attributes": attributes}
    return F.to_json(F.struct(*[cells[c].alias(c) for c in ORDER]), {"ignoreNullFields": "false"})


def write_jsonl(events: DataFrame, path: str) -> None:
    """A folder of text files, rows by (timestamp, id) throughout."""
    events.orderBy("timestamp", "id").select(json_row().alias("value")).write.mode("overwrite").text(path)


def write_csv(events: DataFrame, path: str) -> None:
    attributes = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("attributes"))))
    out = events.orderBy("timestamp", "id").select("id", rfc3339(F.col("timestamp"), "+00:00").alias("timestamp"), *ORDER[2:10], attributes.alias("attributes_json"))
    out.write.mode("overwrite").options(header=True, escape='"', emptyValue="").csv(path)


def checksum(events: DataFrame) -> tuple[int, str]:
    """(rows, hash) of the events as a multiset: sums of the parts of each row's sha256, in one pass."""
    row = F.sha2(json_row(), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(8)]
    got = events.agg(F.count("*").alias("n"), *parts).first()
    return got["n"], hashlib.sha256(",".join(str(x or 0) for x in got).encode()).hexdigest()


def save_snapshot(events: DataFrame, path: str) -> dict:
    """Events sorted by time as Parquet, and a manifest with their checksum."""
    spark = events.sparkSession
    events.select(*ORDER).orderBy("timestamp", "id").write.mode("overwrite").parquet(f"{path}/events")
    rows, digest = checksum(spark.read.parquet(f"{path}/events"))
    manifest = {"format": FORMAT, "version": VERSION, "created_at": datetime.now(timezone.utc).isoformat(), "rows": rows, "sha256": digest}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])  # one line
    if (manifest.get("format"), manifest.get("version")) != (FORMAT, VERSION):
        raise SnapshotError("unsupported index format or version")
    events = spark.read.parquet(f"{path}/events")
    if checksum(events) != (manifest["rows"], manifest["sha256"]):
        raise SnapshotError("index checksum mismatch")
    return events
