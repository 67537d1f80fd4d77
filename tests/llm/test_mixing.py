from __future__ import annotations

import numpy as np
import pytest

from conftest import untouched
from siftwick.llm import mixing


def test_totals_meet_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = mixing.mix(docs, labels).collect()
    total = sum(r["tokens"] for r in rows)
    assert len(rows) == 1000 and min(r["rate"] for r in rows) == 0
    for d, share in mixing.TARGETS.items():
        assert sum(r["posteriors"][d] * r["tokens"] * r["rate"] for r in rows) / total == pytest.approx(share, abs=1e-3)
    assert all(r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) for r in rows)
    assert sum(r["copies"] for r in rows) == pytest.approx(sum(r["rate"] for r in rows), rel=0.1)
    got = mixing.mixed_documents(docs, labels)
    assert got.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert counts == {r["doc_id"]: r["copies"] for r in rows if r["copies"]}


def test_solver_with_known_answer(spark):
    rows = [(10, [1.0, 0.0])] * 6 + [(10, [0.0, 1.0])] * 4
    members = spark.createDataFrame(rows, "tokens long, p array<double>")
    steps, now, want = mixing.solve(members, ["a", "b"], {"a": 0.2, "b": 0.8})
    assert now == pytest.approx(want, abs=0.1) and want == pytest.approx([20, 80])
    rates = {tuple(r["p"]): r["r"] for r in members.select("p", mixing.rate(members["p"], steps).alias("r")).collect()}
    assert rates[(1.0, 0.0)] == pytest.approx(1 / 3, abs=0.01) and rates[(0.0, 1.0)] == pytest.approx(2, abs=0.01)


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(3, 1, 0), (5, 0, 0), (6, 1, 1), (8, None, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        got = mixing.mix(odd, known).collect()
        assert len(got) == odd.count() and all(r["rate"] >= 0 for r in got)
        assert {r["tokens"] for r in got if r["doc_id"] in (1, 2, 7)} == {0}
    assert mixing.mix(none, labels).count() == 0
    assert mixing.mixed_documents(odd, labels.limit(0)).count() == odd.count()
    assert mixing.mixed_documents(none, labels).count() == 0


LABELS = [(3, 1, 0), (5, 0, 0), (6, 1, 1), (8, None, 1), (1, 1, 0)]


def test_stage(spark, clashing):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    untouched(mixing.mixed_documents(clashing, labels, keep="clean"), clashing)


def test_kept_domain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    clean = {r["doc_id"] for r in mixing.mix(docs, labels).collect() if r["posteriors"]["clean"] == max(r["posteriors"].values())}
    kept = {r["doc_id"] for r in mixing.mixed_documents(docs, labels, keep="clean").select("doc_id").collect()}
    assert clean <= kept and len(kept) < docs.count()


def test_unmet_targets_are_told(spark):
    docs = spark.createDataFrame([(i, "good text here" if i % 2 else "bad words there") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    with pytest.warns(UserWarning, match="toxic: no labelled text"):
        mixing.mix(docs, labels, {"clean": 0.5, "low_quality": 0.3, "toxic": 0.2})
    one = labels.where("quality = 1")
    with pytest.warns(UserWarning, match="low_quality"):
        mixing.mix(docs, one, {"clean": 0.5, "low_quality": 0.5})
    assert not mixing.unmet(["a"], {"a": 1.0}, [10.0], [10.0]) and "a share of 0.5000" in mixing.unmet(["a"], {"a": 1.0}, [5.0], [10.0])[0]


def test_classifier_on_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(8)
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = mixing.fit(docs.where("doc_id % 3 <> 0"), labels)
    held = docs.where("doc_id % 3 = 0").join(labels.select("doc_id", mixing.domain_of().alias("d")), "doc_id")
    rows = held.select("d", mixing.membership(model, held["text"]).alias("m")).select("d", "m.p").collect()
    assert sum(r["d"] == model.domains[int(np.argmax(r["p"]))] for r in rows) / len(rows) > 0.93


def test_a_domain_of_long_texts_is_learnt(spark):
    docs = spark.createDataFrame([(i, "good text here " * 20) for i in range(20)] + [(50 + i, "bad words there " * 3_000) for i in range(6)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(50 + i, 0, 0) for i in range(6)], "doc_id long, quality int, toxic int")
    assert mixing.fit(docs, labels).domains == ["clean", "low_quality"]


def test_query_against_plain_gradient(docs, spark):
    """All rates at once, a vector instead of a column."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    got = sorted((r["doc_id"], r["tokens"], r["rate"], r["posteriors"]) for r in mixing.mix(docs, labels).collect())
    tokens, p = np.array([r[1] for r in got], float), np.array([[r[3][d] for d in sorted(mixing.TARGETS)] for r in got])
    want = tokens.sum() * np.array([mixing.TARGETS[d] for d in sorted(mixing.TARGETS)])
    rate, size = np.ones(len(got)), 1.0
    for _ in range(mixing.MAX_STEPS):
        now = (tokens * rate) @ p
        if np.abs(now - want).max() <= mixing.CLOSE * tokens.sum() or size < 1e-3:
            break
        gram = (p * (tokens * (rate > 0))[:, None]).T @ p
        g = size * np.linalg.solve(gram + 1e-6 * tokens.sum() * np.eye(len(want)), now - want)
        then = np.maximum(0, rate - p @ g)
        if np.abs((tokens * then) @ p - want).sum() < np.abs(now - want).sum():
            rate, size = then, min(1.0, 2 * size)
        else:
            size /= 2
    assert np.allclose([r[2] for r in got], rate, atol=1e-6)


def test_an_id_of_many_rows_sends_one(spark, monkeypatch):
    rows = [(1, f"good plain words number {i}") for i in range(400)] + [(i, f"some other text {i}") for i in range(2, 30)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 30)], "doc_id long, quality int, toxic int")
    seen, softmax = [], mixing.softmax
    monkeypatch.setattr(mixing, "softmax", lambda x, y: seen.append(len(x)) or softmax(x, y))
    assert mixing.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert 0 < seen[0] <= 29
