"""The corpus pipeline: documents -> told by language, deduplicated, mixed, packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwick.llm import exact_dedup, langid, mixing, ngram_join, packing
from siftwick.llm.common import spread, tables, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, tables(spark, sf_dir, "labels"), keep="clean")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("ngram_join", near),
    ("mixing", mixed),
    ("packing", packed),
]

#: Models and tokens are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each reads what the one before has written.

    Gives a row per piece of a packed document. Texts that are null, empty or
    without a letter go at the first stage; of copies and near copies one stays,
    also where ids are null or repeat; long texts are read whole; columns of any
    name go through to packing. An empty table gives an empty one.
    """
    docs = spread(tables(spark, sf_dir, "documents"))
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
