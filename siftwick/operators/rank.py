"""Rankings and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.compile import field_column


def top_entities(events: DataFrame, field: str, limit: int) -> DataFrame:
    """(value, n): the most frequent values of a field, under any of its names, or of an attribute.

    Values are case-sensitive; nulls do not count. Of values that tie at the
    limit the largest stay; the result is by count downwards, then value.
    """
    counts = events.select(field_column(field).alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), F.desc("value")).limit(max(0, limit))
    return top.orderBy(F.desc("n"), "value")


def duplicate_ids(events: DataFrame) -> DataFrame:
    """Ids that come more than once; their rows are kept."""
    return events.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def stats(events: DataFrame, nodes: DataFrame, edges: DataFrame) -> dict[str, int]:
    return {"events": events.count(), "nodes": nodes.count(), "edges": edges.count()}
