"""Exact dedup against a persistent digest index, bucketed and sorted by digest."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, by_ids, columns_of, file_system, new_path, remove, spare, written

#: Batches in which a table meets the index.
BATCHES = 2
#: Buckets of an index at least, and texts that one more bucket is for.
BUCKETS, TEXTS_PER_BUCKET = 64, 2_000_000


def text_digest(text: Column) -> Column:
    """sha256 of the text with A-Z lowered; null counts as empty."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256)


class DigestIndex:
    """Digests seen so far, with the id that stays for each.

    A table of the session's catalog whose files lie in the shared folder,
    bucketed and sorted by digest, so that an anti-join with a new batch moves
    and sorts the batch alone. ``append`` adds a file to each bucket and makes
    nothing else anew. ``attach`` finds an index again from its path, ``close``
    takes it out of the catalog and ``drop`` deletes its files too.
    """

    schema = "digest binary, keep_id bigint"

    def __init__(self, spark: SparkSession, buckets: int = BUCKETS, path: str | None = None):
        self.spark, self.buckets = spark, buckets
        self.path = path or new_path(spark, "digest-index")
        self.name = f"digest_index_{uuid.uuid4().hex}"
        self.empty = True

    @classmethod
    def attach(cls, spark: SparkSession, path: str, buckets: int) -> DigestIndex:
        """``buckets`` must be the number that the index was written with."""
        index = cls(spark, buckets, path)
        spark.sql(
            f"CREATE TABLE {index.name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"OPTIONS (path '{path}') CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS"
        )
        index.empty = False
        return index

    def rows(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema) if self.empty else self.spark.table(self.name)

    def append(self, fresh: DataFrame) -> None:
        """Add digests that the index does not hold yet."""
        out = fresh.select("digest", "keep_id").repartition(self.buckets, "digest")
        out = out.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
        out.mode("append").option("path", self.path).saveAsTable(self.name)
        self.empty = False

    def close(self) -> None:
        """The table is external, so its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def drop(self) -> None:
        self.close()
        fs, at = file_system(self.spark, self.path)
        fs.delete(at, True)


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, doc_id, digest), written, so that texts are read and hashed once."""
    ids = df.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.unhex(text_digest(F.col(text_col))).alias("digest"),
    )
    return written(ids, "digests")


def falling(ids: DataFrame, batches: int) -> Iterator[DataFrame]:
    """The rows in batches of about equal size, larger ids first and null ids last."""
    doc = F.col("doc_id")
    cuts = ids.select(F.percentile_approx("doc_id", [k / batches for k in range(batches - 1, 0, -1)], 1000)).first()[0] if batches > 1 else []
    above = None
    for cut in sorted(set(cuts or []), reverse=True):
        yield ids.where(doc >= cut if above is None else (doc >= cut) & (doc < above))
        above = cut
    yield ids if above is None else ids.where(doc.isNull() | (doc < above))


def exact_dedup(df: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """One row per input row: which row of its equal texts stays, and whether it is this one.

    Texts are equal when identical after lowering A-Z, however long; null
    counts as empty. Rows meet the index in batches of falling ids: of a
    batch's equal texts the row with the largest id stays (of repeated rows
    with that id, one; null ids come last), unless the index already holds the
    text, from an earlier batch or an earlier call. Then none stays, and
    ``keep_id`` is the indexed id. What a batch brings is appended.
    ``group_size`` counts the table's rows. Empty tables give empty tables;
    other columns are not read. Without an index of the caller's, one is made,
    with as many buckets as the texts need, and deleted.

    Groups are summed before the shuffle, so a digest that holds a third of
    all rows is one row a task there. The only join with a row per document
    carries id and digest, and Spark may split its hot digests.
    """
    own = index is None
    ids = digests(df, id_col, text_col)
    index = index or DigestIndex(df.sparkSession, max(BUCKETS, ids.count() // TEXTS_PER_BUCKET))
    parts = []
    for part in falling(ids, batches):
        groups = part.groupBy("digest").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "rid")).alias("top"))
        groups = groups.select("digest", F.col("top.doc_id").alias("keep_id"), F.col("top.rid").alias("keep_rid"))
        fresh = written(groups.hint("merge").join(index.rows().select("digest").hint("merge"), "digest", "left_anti"), "fresh")
        index.append(fresh)
        parts.append(fresh)
    new = parts[0]
    for fresh in parts[1:]:
        new = new.unionByName(fresh)
    sizes = ids.groupBy("digest").agg(F.count("*").alias("group_size"))
    win = sizes.hint("merge").join(index.rows().hint("merge"), "digest").join(new.select("digest", "keep_rid").hint("merge"), "digest", "left")
    win = written(win, "groups")
    remove(*parts)
    if own:
        index.drop()
    out = ids.hint("merge").join(win.hint("merge"), "digest")
    return out.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("keep_rid").isNotNull() & (F.col("rid") == F.col("keep_rid"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first_copies(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns, whatever the names.

    The ids of dropped rows go to the texts while they are few; else whole rows
    are moved by id, which no group of copies can make hot. Rows that repeat in
    both id and text count as one, null ids and texts included; which of them
    stays is not defined. Ties of ids over different texts keep a row each. An
    empty table gives an empty one.
    """
    every = written(exact_dedup(docs, index).select("doc_id", "text_sha256", "kept"), "verdicts")
    unique = every.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count() == 0
    if unique:
        drop = written(every.where("NOT kept").select(F.col("doc_id").alias("drop")), "drop")
        return by_ids(docs, drop, "left_anti").select(*columns_of(docs))
    sha, told, number = spare(docs.columns, "sha", "told", "number")
    key = docs.withColumn(sha, text_digest(F.col("text")))
    kept = every.where("kept").select(F.col("text_sha256").alias(told), F.col("doc_id").alias(number))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(number)) & (F.col(sha) == F.col(told))
    return key.join(kept, on, "left_semi").dropDuplicates(["doc_id", sha]).select(*columns_of(docs))


EXACT_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h)
"""
