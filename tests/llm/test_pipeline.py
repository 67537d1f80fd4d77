from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from siftwick.llm import queries
from tests_support import brute_near, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_their_sql(spark, duck, name):
    same(queries.queries()[name](spark, SF), duck.sql(queries.oracle_sql()[name]).df())


def test_registered():
    names = __spark_entry__.queries()
    assert {"pipeline", "license_lines"} <= set(names) and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_stages(spark, docs):
    from siftwick.llm.common import written

    kept, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        now = written(stage(spark, now, SF), name)
        kept[name] = now
        if name != "packing":
            assert now.columns == docs.columns
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert kept["language_id"].count() == sum(any(c.isalpha() for c in t or "") for _, t in rows)
    best = {}
    for i, t in ((r["doc_id"], r["text"]) for r in kept["language_id"].collect()):
        best[t] = max(i, best.get(t, i))
    exact = {r["doc_id"]: r["text"] for r in kept["exact_dedup"].collect()}
    assert set(exact) <= set(best.values())
    assert sorted(r["doc_id"] for r in kept["ngram_join"].collect()) == brute_near(exact)
    assert kept["mixing"].where("lang IS NULL AND source IS NULL").count() == 0
    mixed = {r["doc_id"] for r in kept["mixing"].select("doc_id").distinct().collect()}
    assert mixed <= {r["doc_id"] for r in kept["ngram_join"].collect()}
    assert {r["doc_id"] for r in kept["packing"].select("doc_id").distinct().collect()} == mixed


def run_on(spark, tmp_path, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(r[0], i % 2, int(i % 5 == 0)) for i, r in enumerate(rows)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return corpus_pipeline.run(spark, str(tmp_path))


def test_run_on_odd_tables(spark, tmp_path):
    long = " ".join(f"w{i % 7000}" for i in range(20_000))
    rows = [(1, None, None, "a", 0), (2, "", "en", "a", 0), (3, "Hello there World", "en", None, 5), (3, "Hello there World", "en", None, 5), (None, "hello THERE world", "en", "b", 5)]
    rows += [(None, None, None, None, None), (5, long, "en", "c", None), (6, long + " end", "fr", "c", 9), (7, "1 2 3", "en", "a", 1), (8, "quite another text", "fr", "a", 1)]
    got = run_on(spark, tmp_path / "odd", rows)
    assert got.columns[0] == "doc_id" and {r["doc_id"] for r in got.select("doc_id").distinct().collect()} <= {3, 5, 8}
    assert run_on(spark, tmp_path / "none", []).count() == 0


def test_run_with_clashing_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, __n string, __c string, __m string, __lang string, __sha string, __id string, `a b.c` string, row string"
    rows = [(i, f"text number {i} of the table in which columns clash", "en", *["kept"] * 8) for i in range(12)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, i % 2, 0) for i in range(12)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
        assert {tuple(r)[3:] for r in now.collect()} == {("kept",) * 8}
