from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and a column that operators use themselves."""
    long = " ".join(f"w{i % 9000}" for i in range(30_000))
    rows = [
        (1, None, "x"),
        (2, "", "x"),
        (3, "Hello World", "y"),
        (4, "hello WORLD", None),
        (4, "hello WORLD", None),
        (5, long, "y"),
        (6, long, "z"),
        (7, " \t\n", "z"),
        (None, "hello world", "z"),
        (8, "1234 ... ###", "z"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, digest string")


#: Names that operators once used, or use, for columns of their own.
CLASHING = ("__n", "__c", "__m", "__lang", "__sha", "__id", "told", "sha", "tid", "number", "row", "m", "n", "x", "key", "rid", "digest", "group", "license_id")


@pytest.fixture(scope="session")
def clashing(odd):
    from pyspark.sql import functions as F

    return odd.select("doc_id", "text", F.lit("en").alias("lang"), *[F.concat(F.lit(f"{c}-"), F.coalesce("doc_id", F.lit(-1))).alias(c) for c in CLASHING])


def untouched(kept, docs):
    """Rows of ``kept`` are rows of ``docs``, columns and all."""
    assert kept.columns == docs.columns
    assert not {str(r) for r in kept.collect()} - {str(r) for r in docs.collect()}


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
