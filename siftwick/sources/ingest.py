"""Strict readers of JSONL and CSV event files, with a report of what was refused."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fingerprint, to_instant
from ..operators.rank import duplicate_ids
from ..schema import OUTCOMES, SEVERITY_SCORE
from ..storage import written

REQUIRED = ("source", "event_type", "message")
OPTIONAL = ("user", "host", "source_ip")
CSV_COLUMNS = ("id", "timestamp", "source", "event_type", "user", "host", "source_ip", "outcome", "severity", "message", "attributes_json")
RAW_CHARS = 240
MAX_BYTES = 50 * 1024 * 1024
MAX_EVENTS = 100_000


class IngestError(ValueError):
    pass


@dataclass
class IngestResult:
    """events by the event schema; invalid(row, code, message, raw); all lazy but for the written lines."""

    events: DataFrame
    invalid: DataFrame

    def duplicate_ids(self) -> DataFrame:
        """Ids that come more than once. They are reported; their rows stay."""
        return duplicate_ids(self.events)

    def counts(self) -> dict[str, int]:
        valid, bad = self.events.count(), self.invalid.count()
        return {"total_rows": valid + bad, "valid": valid, "invalid": bad, "duplicates": self.duplicate_ids().count()}


def infer_format(path: str) -> str:
    return "csv" if path.lower().endswith(".csv") else "jsonl"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): lines by their place in their file, from 1, blank ones counted.

    Bytes that are not UTF-8 become U+FFFD. Lines keep their order inside a split, and splits of a file are put in a
    row by where they begin, so only a count per split is sorted.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    raw = raw.select(
        F.regexp_replace(F.make_valid_utf8("value"), r"\r$", "").alias("value"),
        F.col("_metadata.file_path").alias("f"),
        F.col("_metadata.file_block_start").alias("b"),
        F.monotonically_increasing_id().alias("at"),
    )
    raw = written(raw, "lines")
    splits = raw.groupBy("f", "b").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    w = Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return raw.join(splits, ["f", "b"]).select((F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def finished(df: DataFrame) -> DataFrame:
    """Blank ids become fingerprints; columns in order."""
    blank = F.trim(F.coalesce("id", F.lit(""))) == ""
    made = fingerprint(F.col("timestamp"), *[F.col(c) for c in ("source", "event_type", "user", "host", "source_ip", "message")])
    attributes = F.coalesce("attributes", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    return df.select(F.when(blank, made).otherwise(F.col("id")).alias("id"), "timestamp", *REQUIRED[:2], *OPTIONAL, "outcome", "severity", "message", attributes.alias("attributes"))


def _kind(field: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get("v", f"$.{field}", "variant")), F.lit("ABSENT"))


def _string_map(v: Column) -> Column:
    """Whether a variant is an object with string values only."""
    values = F.map_values(F.try_variant_get(v, "$", "map<string,variant>"))
    return F.coalesce(F.forall(values, lambda x: F.schema_of_variant(x) == "STRING"), F.lit(False))


def read_jsonl(spark: SparkSession, path: str) -> IngestResult:
    """One event per line. Lines of white space are skipped and not counted.

    A line is refused, as ``invalid_json``, unless it is an object with all
    required fields, strings where strings belong, a known outcome and
    severity, a time with an offset, and attributes that map strings to
    strings. Duplicate keys are refused anywhere.
    """
    lines = numbered_lines(spark, path).where(F.trim(F.regexp_replace("value", r"\s", "")) != "")
    parsed = lines.withColumn("v", F.try_parse_json("value"))
    ok = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    for f in (*REQUIRED, "timestamp", "outcome", "severity"):
        ok &= _kind(f) == "STRING"
    for f in OPTIONAL:
        ok &= _kind(f).isin("STRING", "VOID", "ABSENT")
    ok &= _kind("id").isin("STRING", "ABSENT")
    ok &= (_kind("attributes") == "ABSENT") | _string_map(F.try_variant_get("v", "$.attributes", "variant"))
    text = {f: F.try_variant_get("v", f"$.{f}", "string") for f in ("id", "timestamp", "outcome", "severity", *REQUIRED, *OPTIONAL)}
    ok &= F.coalesce(text["outcome"].isin(*OUTCOMES) & text["severity"].isin(*SEVERITY_SCORE), F.lit(False))
    ok &= to_instant(text["timestamp"]).isNotNull()
    checked = parsed.withColumn("ok", F.coalesce(ok, F.lit(False)))
    fields = {f: c for f, c in text.items() if f != "timestamp"}
    attributes = F.try_variant_get("v", "$.attributes", "map<string,string>")
    good = checked.where("ok").select(*[c.alias(f) for f, c in fields.items()], to_instant(text["timestamp"]).alias("timestamp"), attributes.alias("attributes"))
    why = F.when(F.col("v").isNull(), "not JSON").otherwise("not an event")
    bad = checked.where("NOT ok").select(F.col("line").alias("row"), F.lit("invalid_json").alias("code"), why.alias("message"), F.substring("value", 1, RAW_CHARS).alias("raw"))
    return IngestResult(finished(good), bad)


def read_csv(spark: SparkSession, path: str) -> IngestResult:
    """Columns by the names of the header, rows of any width.

    Rows that do not make an event are refused as ``invalid_csv``, or as
    ``invalid_attributes`` if only attributes_json is not an object of
    strings. Empty user, host and source_ip are null. Spark reads an empty
    cell as null, so required text fields take it as empty text, but for rows
    that are too short.
    """
    options = {"header": True, "escape": '"', "multiLine": True}
    names = spark.read.options(**options).csv(path).columns
    schema = ", ".join(f"`{n}` string" for n in [*names, "__short"])
    raw = spark.read.options(**options, columnNameOfCorruptRecord="__short").schema(schema).csv(path)
    cells = [F.col(f"`{n}`").alias(n) if n in names else F.lit(None).cast("string").alias(n) for n in CSV_COLUMNS]
    rows = raw.select(*cells, F.col("__short"), F.col("_metadata.file_path").alias("__f"), F.monotonically_increasing_id().alias("__at"))
    rows = written(rows, "csv-rows")
    first = rows.groupBy("__f").agg(F.min("__at").alias("__first"))
    rows = rows.join(first, "__f").withColumn("row", F.col("__at") - F.col("__first") + 2)
    present = F.lit(all(n in names for n in (*REQUIRED, "timestamp", "outcome", "severity")))
    short = F.col("__short").isNotNull() & F.col("message").isNull()
    fine = present & ~short & F.coalesce(F.col("outcome").isin(*OUTCOMES) & F.col("severity").isin(*SEVERITY_SCORE), F.lit(False))
    fine &= to_instant(F.col("timestamp")).isNotNull()
    blank = F.trim(F.coalesce("attributes_json", F.lit(""))) == ""
    v = F.try_parse_json("attributes_json")
    code = F.when(~F.coalesce(fine, F.lit(False)), "invalid_csv").when(~blank & ~_string_map(v), "invalid_attributes")
    rows = rows.withColumn("code", code)
    good = rows.where("code IS NULL").select(
        "id",
        to_instant(F.col("timestamp")).alias("timestamp"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in REQUIRED],
        *[F.nullif(F.col(c), F.lit("")).alias(c) for c in OPTIONAL],
        "outcome",
        "severity",
        F.when(~blank, F.try_variant_get(v, "$", "map<string,string>")).alias("attributes"),
    )
    bad = rows.where("code IS NOT NULL").select("row", "code", F.when(F.col("code") == "invalid_csv", "not an event").otherwise("attributes_json is not an object of strings").alias("message"), F.lit("").alias("raw"))
    return IngestResult(finished(good), bad)


def ingest(spark: SparkSession, path: str, kind: str | None = None, limits: bool = False) -> IngestResult:
    """Read a file or folder; with limits, refuse more than 50 MB or 100,000 valid events, and unless the kind is said, names that do not end in .jsonl or .csv."""
    if limits:
        if kind is None and path.lower().rsplit(".", 1)[-1] not in ("jsonl", "csv"):
            raise IngestError("only .jsonl and .csv files are loaded")
        size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
        if size > MAX_BYTES:
            raise IngestError("file limit is 50 MB")
    result = (read_csv if (kind or infer_format(path)) == "csv" else read_jsonl)(spark, path)
    if limits and result.events.limit(MAX_EVENTS + 1).count() > MAX_EVENTS:
        raise IngestError("event limit is 100000")
    return result
