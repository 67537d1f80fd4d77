from __future__ import annotations

import hashlib

import pytest

from conftest import untouched
from siftwick.llm import exact_dedup as ed
from siftwick.llm.exact_dedup import DigestIndex, exact_dedup, keep_first_copies

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def norm(t):
    return (t or "").translate(LOWER)


def test_groups(docs):
    rows = docs.select("doc_id", "text").collect()
    best, size = {}, {}
    for i, t in rows:
        best[norm(t)] = max(best.get(norm(t), -1), i)
        size[norm(t)] = size.get(norm(t), 0) + 1
    want = {(i, best[norm(t)], size[norm(t)], best[norm(t)] == i, hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows}
    assert {tuple(r) for r in exact_dedup(docs).collect()} == want


def test_odd_rows(odd, none):
    got = exact_dedup(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r["text_sha256"], []).append(r)
    assert all(sum(r["kept"] for r in g) == 1 and {r["group_size"] for r in g} == {len(g)} for g in by.values())
    assert {r["keep_id"] for r in got if r["doc_id"] in (3, 4, None)} == {4}
    assert {r["keep_id"] for r in got if r["doc_id"] in (1, 2)} == {2}
    assert exact_dedup(none).count() == 0
    kept = keep_first_copies(odd)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "4", "6", "7", "8"]
    assert keep_first_copies(none).count() == 0


def test_case_is_ascii_only(spark):
    df = spark.createDataFrame([(1, "Áb"), (2, "áB"), (3, "áb"), (4, "ÁB")], "doc_id long, text string")
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup(df).collect()} == {1: 4, 2: 3, 3: 3, 4: 4}


def test_the_index_outlives_batches(spark):
    def batch(*rows):
        return spark.createDataFrame(list(rows), "doc_id long, text string")

    index = DigestIndex(spark, buckets=4)
    assert exact_dedup(batch((1, "a"), (2, "A"), (3, "b")), index).where("kept").count() == 2
    again = DigestIndex.attach(spark, index.path, 4)
    got = {r["doc_id"]: (r["keep_id"], r["kept"], r["group_size"]) for r in exact_dedup(batch((9, "B"), (10, "c"), (11, "b")), again).collect()}
    assert got == {9: (3, False, 2), 10: (10, True, 1), 11: (3, False, 2)}
    assert sorted(r["keep_id"] for r in again.rows().collect()) == [2, 3, 10]
    # what a batch of smaller ids holds is dropped for the larger ids of an earlier one
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup(batch((1, "q"), (2, "Q"), (3, "q"), (4, "r")), again, batches=3).collect()} == {1: 3, 2: 3, 3: 3, 4: 4}
    index.close()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = batch((1, "a")).selectExpr("cast(text as binary) digest").groupBy("digest").count().join(again.rows(), "digest", "left_anti")
    text = plan._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in text and text.count("Exchange hashpartitioning") == 1


def test_stage(spark, clashing, docs):
    untouched(keep_first_copies(clashing), clashing)
    assert sorted(str(r["doc_id"]) for r in keep_first_copies(clashing).collect()) == ["2", "4", "6", "7", "8"]
    untouched(keep_first_copies(docs), docs)
    null = spark.createDataFrame([(None, "a"), (None, "A"), (None, "b"), (None, None), (5, "b")], "doc_id long, text string")
    assert sorted(str(tuple(r)) for r in keep_first_copies(null).collect()) in (["(5, 'b')", "(None, 'A')", "(None, None)"], ["(5, 'b')", "(None, 'a')", "(None, None)"])


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_batches_change_nothing(odd, docs, batches):
    for df in (odd, docs):
        got, want = (sorted(str((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"])) for r in exact_dedup(df, batches=b).collect()) for b in (batches, 1))
        assert got == want


def test_the_query_joins_the_bucketed_index(spark, docs, monkeypatch):
    plans, write = [], ed.written

    def seen(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name)

    monkeypatch.setattr(ed, "written", seen)
    before = spark.sql("SHOW TABLES").count()
    exact_dedup(docs).count()
    second = [p for name, p in plans if name == "fresh"][1]
    assert "LeftAnti" in second and "SortMergeJoin" in second and "Bucketed: true" in second
    assert spark.sql("SHOW TABLES").count() == before
