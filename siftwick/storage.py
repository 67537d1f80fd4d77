"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master may do without the setting; it then gets a temporary
    folder, which goes when the process ends.
    """
    global _own_dir
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="siftwick-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str) -> tuple:
    """(file system, path) as Hadoop knows them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def passing(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when the application ends."""
    fs, at = file_system(spark, path)
    fs.deleteOnExit(at)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder; cuts lineage, outlives executors, goes with the application."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    passing(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, **sums: Column) -> tuple[DataFrame, dict]:
    """``written``, and aggregates of its rows that come with the write, so that no job is spent on them."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    out = written(df.observe(seen, *[c.alias(k) for k, c in sums.items()]), name)
    return out, seen.get


def remove(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``written``, once what was made of them is written."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            fs, at = file_system(df.sparkSession, path)
            fs.delete(at, True)


def spare(names: list[str], *stems: str) -> list[str]:
    """Helper names that no column has, whatever its case."""
    held = {n.lower() for n in names}
    out = []
    for stem in stems:
        while stem.lower() in held:
            stem += "_"
        held.add(stem.lower())
        out.append(stem)
    return out


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with a gapless number from 0 in the given order, without a task that sees all rows.

    Rows are sorted over range partitions and written with their place inside
    their partition; partitions are counted, and each starts where the ones
    before it end. The table of starts has one row per partition, of which
    Spark has a few hundred thousand at most.
    """
    spark = df.sparkSession
    at, p, start = spare([*df.columns, name], "__at", "__p", "__start")
    placed = written(df.orderBy(*order).withColumn(at, F.monotonically_increasing_id()), f"sorted-{name}")
    part = F.shiftright(at, 33)
    counts = {r[0]: r[1] for r in placed.groupBy(part.alias("p")).count().collect()}  # a row per partition
    starts, total = [], 0
    for k in sorted(counts):
        starts.append((k, total))
        total += counts[k]
    table = spark.createDataFrame(starts, f"`{p}` long, `{start}` long")
    out = placed.withColumn(p, part).join(F.broadcast(table), p)
    return out.withColumn(name, F.col(start) + F.col(at).bitwiseAND((1 << 33) - 1)).drop(p, at, start)
