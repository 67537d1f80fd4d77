"""Events made of tables that are not events, by fixed formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OUTCOME_OF = {"error": "failure", "purchase": "success", "signup": "success"}
MESSAGE_OF = {"failure": "Invalid password", "success": "Interactive sign-in accepted"}
#: Upper bounds of ``value`` for each severity but the last.
SEVERITY_BELOW = (("info", 10), ("low", 25), ("medium", 50), ("high", 100))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as security events."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("bigint")
    user, kind = F.col("user_id"), F.col("event_type")
    outcome = F.when(kind == "error", "failure").when(kind.isin("purchase", "signup"), "success").otherwise("unknown")
    severity = None
    for name, bound in SEVERITY_BELOW:
        test = F.col("value") < bound
        severity = F.when(test, name) if severity is None else severity.when(test, name)
    floor = F.floor(user / 4).cast("bigint")
    return t.select(
        F.col("event_id").cast("string").alias("id"),
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("src-"), (F.col("event_id") % 5).cast("string")).alias("source"),
        kind.alias("event_type"),
        F.concat(F.lit("u"), user.cast("string")).alias("user"),
        F.concat(F.lit("ws-"), (user % 4).cast("string"), F.lit("-"), ((floor + k % 4) % 10).cast("string")).alias("host"),
        F.concat(F.lit("10."), (user % 4).cast("string"), F.lit(".0."), (user % 20).cast("string")).alias("source_ip"),
        outcome.alias("outcome"),
        severity.otherwise("critical").alias("severity"),
        F.when(outcome == "failure", MESSAGE_OF["failure"]).when(outcome == "success", MESSAGE_OF["success"]).otherwise(kind).alias("message"),
        F.create_map(F.lit("k"), k.cast("string")).alias("attributes"),
    )


#: The same in DuckDB's SQL, as a common table expression ``ev``.
EVENTS_SQL = """ev AS (
  SELECT CAST(event_id AS VARCHAR) AS id, ts AS timestamp, 'src-' || (event_id % 5) AS source, event_type,
    'u' || user_id AS user, 'ws-' || (user_id % 4) || '-' || (((user_id // 4) + json_extract(props, '$.k')::BIGINT % 4) % 10) AS host,
    '10.' || (user_id % 4) || '.0.' || (user_id % 20) AS source_ip,
    CASE WHEN event_type = 'error' THEN 'failure' WHEN event_type IN ('purchase', 'signup') THEN 'success' ELSE 'unknown' END AS outcome,
    CASE WHEN value < 10 THEN 'info' WHEN value < 25 THEN 'low' WHEN value < 50 THEN 'medium' WHEN value < 100 THEN 'high' ELSE 'critical' END AS severity,
    CASE WHEN value < 10 THEN 1 WHEN value < 25 THEN 3 WHEN value < 50 THEN 5 WHEN value < 100 THEN 8 ELSE 10 END AS score,
    CASE WHEN event_type = 'error' THEN 'Invalid password' WHEN event_type IN ('purchase', 'signup') THEN 'Interactive sign-in accepted' ELSE event_type END AS message,
    json_extract(props, '$.k')::BIGINT::VARCHAR AS k
  FROM events)"""


def document_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table as events whose messages are its texts, for text operators."""
    t = spark.read.parquet(f"{sf_dir}/documents.parquet")
    none = F.lit(None).cast("string")
    return t.select(
        F.col("doc_id").cast("string").alias("id"),
        F.timestamp_seconds(F.col("doc_id")).alias("timestamp"),
        "source",
        F.col("lang").alias("event_type"),
        *[none.alias(c) for c in ("user", "host", "source_ip")],
        F.lit("unknown").alias("outcome"),
        F.lit("info").alias("severity"),
        F.col("text").alias("message"),
        F.create_map().cast("map<string,string>").alias("attributes"),
    )
