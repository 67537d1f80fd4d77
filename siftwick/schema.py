"""The event row and its severities."""

from __future__ import annotations

from pyspark.sql.types import MapType, StringType, StructField, StructType, TimestampType

EVENT = StructType(
    [
        StructField("id", StringType(), False),
        StructField("timestamp", TimestampType(), False),
        StructField("source", StringType(), False),
        StructField("event_type", StringType(), False),
        StructField("user", StringType()),
        StructField("host", StringType()),
        StructField("source_ip", StringType()),
        StructField("outcome", StringType(), False),
        StructField("severity", StringType(), False),
        StructField("message", StringType(), False),
        StructField("attributes", MapType(StringType(), StringType()), False),
    ]
)
# Enumerations of the event contract, and the score of each severity.
OUTCOMES = ("success", "failure", "unknown")
SEVERITY_SCORE = {"info": 1, "low": 3, "medium": 5, "high": 8, "critical": 10}
#: Fields that the search index knows, with the columns that they stand for.
INDEXED = {"id": "id", "source": "source", "type": "event_type", "outcome": "outcome", "severity": "severity", "user": "user", "host": "host", "ip": "source_ip"}
#: Other names of fields; direct access knows them, the index does not.
ALIASES = {"event_type": "type", "source_ip": "ip", "result": "outcome"}
