"""Helpers the training-data operators share: tables, folds, hashes."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_lower
from ..storage import counted, file_system, new_path, passing, remove, shared_dir, spare, written

__all__ = ["SPACE", "ascii_lower", "by_ids", "columns_of", "counted", "file_system", "id_fold", "new_path", "passing", "remove", "shared_dir", "small_batches", "spare", "spread", "tables", "unit_hash", "written"]

# ASCII white space that separates words, as a Java and RE2 class.
SPACE = r"\x20\x09-\x0D"


def id_fold(c: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids fall in fold 0."""
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % n, F.lit(0))


def unit_hash(*cols: Column) -> Column:
    """A number in [0, 1) fixed by the values, for samples that do not change."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


BATCH_BYTES = ("67108864b", "8388608b")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB for functions over whole texts, unless the session says otherwise than Spark's default."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == BATCH_BYTES[0]:
        spark.conf.set(name, BATCH_BYTES[1])


def columns_of(df: DataFrame) -> list[Column]:
    """All columns by name, whatever the names are made of."""
    return [F.col("`{}`".format(c.replace("`", "``"))) for c in df.columns]


#: Ids that a broadcast may hold.
IDS_SENT = 1_000_000


def by_ids(docs: DataFrame, ids: DataFrame, how: str, id_col: str = "doc_id") -> DataFrame:
    """Rows whose id is (left_semi) or is not (left_anti) in a written one-column table: up to IDS_SENT ids go to the rows, so that no texts are moved; above that both are shuffled."""
    (name,) = ids.columns
    few = ids.limit(IDS_SENT + 1).count() <= IDS_SENT
    return docs.join(F.broadcast(ids) if few else ids, docs[id_col].cast("long") == ids[name], how)


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Python workers started from now on find this package as the driver does
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if its files are too few to keep them busy; larger inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
