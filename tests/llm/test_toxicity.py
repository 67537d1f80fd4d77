from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwick.llm import toxicity as tox


def kneser_ney(texts, discount=0.75):
    """log P(x | h, toxic) - log P(x | h, ordinary) of seen n-grams, by the formula."""
    n = (Counter(), Counter())
    for t, y in texts:
        for w in tox.WORD.findall(t.lower()):
            n[y].update(tox.events(w))
    tails = {g[i:] for c in n for g in c for i in range(len(g) - 1)}
    cont = Counter(t[1:] for t in tails)
    heads = defaultdict(list)
    for s, k in cont.items():
        heads[s[:-1]].append(k)
    kinds = sum(len(s) == 1 for s in cont)

    def shared(s):
        back = 1 / kinds if len(s) == 1 else shared(s[1:])
        return (max(cont[s] - discount, 0) + discount * len(heads[s[:-1]]) * back) / sum(heads[s[:-1]])

    out = {}
    for g in n[0] | n[1]:
        p = []
        for c in n:
            seen = [k for x, k in c.items() if x[:-1] == g[:-1]]
            low = shared(g[1:])
            p.append((max(c[g] - discount, 0) + discount * len(seen) * low) / sum(seen) if seen else low)
        out[g] = math.log(p[1] / p[0])
    return out


def test_ratios_are_those_of_the_formula(spark):
    texts = [("you fool fool", 1), ("a foolish fox", 1), ("the fox and the food", 0), ("you are kind, Kind", 0), (None, 0)]
    grams = tox.gram_counts(spark.createDataFrame(texts, "text string, toxic int"))
    ratios = tox.slots(tox.log_ratios(grams), 1 << 20)
    want = kneser_ney([(t or "", y) for t, y in texts])
    for w in ("fool", "the", "kind", "fox"):
        got, size = tox.word_ratios(ratios, [w])[0]
        assert size == len(w) + 1
        assert got == pytest.approx(sum(want[g] for g in tox.events(w)), abs=1e-4)


def test_held_out_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = tox.fit(docs, labels)
    rows = tox.toxicity(docs, model).where("held_out").join(labels, "doc_id").select("score", "toxic").collect()
    pos, neg = [np.array([r[0] for r in rows if r[1] == y]) for y in (1, 0)]
    assert (pos[:, None] > neg[None]).mean() > 0.93
    assert (pos >= 0.5).mean() > 0.7 and (neg >= 0.5).mean() < 0.01


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(3, 1, 1), (5, 1, 0), (8, 1, None), (None, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        got = tox.toxicity(odd, tox.fit(odd, known)).collect()
        assert len(got) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert tox.toxicity(none, tox.fit(none, labels)).count() == 0


def test_counts_leave_out_only_the_calibration_sample(spark, monkeypatch):
    labels = spark.range(400).selectExpr("id AS doc_id", "1 AS quality", "int(id % 4 = 0) AS toxic")
    docs = labels.selectExpr("doc_id", "IF(toxic = 1, 'you fool', 'kind fox') AS text")
    seen, count = [], tox.gram_counts

    def counted(labelled):
        seen.append(labelled.count())
        return count(labelled)

    monkeypatch.setattr(tox, "gram_counts", counted)
    monkeypatch.setattr(tox, "CALIBRATION_ROWS", 10)
    tox.fit(docs, labels)
    known = tox.known_labels(labels).count()
    assert known - 20 <= seen[0] < known


def test_ratios_do_not_meet_in_slots(spark):
    texts = [("you fool fool", 1), ("a foolish fox", 1), ("the fox and the food", 0), ("you are kind, Kind", 0)]
    ratios = tox.log_ratios(tox.gram_counts(spark.createDataFrame(texts, "text string, toxic int")))
    want, held = kneser_ney(texts), tox.slots(ratios, 16)
    for w in ("fool", "the", "kind", "fox"):
        assert tox.word_ratios(held, [w])[0][0] == pytest.approx(sum(want[g] for g in tox.events(w)), abs=1e-4)
    assert len(held.key) == ratios.count()
    # a word of which nothing was seen but the start has the ratio of that context alone
    alone = ratios.where("key = xxhash64('^\x00')").first()["value"]
    assert tox.word_ratios(held, ["zzz"])[0][0] == pytest.approx(alone, abs=1e-4)


def test_scores_against_plain_python(docs, spark):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = tox.fit(docs, labels)
    held = model.sent.value
    got = {r["doc_id"]: r["score"] for r in tox.toxicity(docs, model).collect()}
    for i, text in docs.select("doc_id", "text").collect():
        ratio = sorted((tox.word_ratios(held, [w])[0][0] for w in tox.words_of(text or "")), reverse=True)
        k = max(3, math.ceil(0.02 * len(ratio)))
        z = model.base + model.slopes[0] * sum(ratio[:3]) / 3 + model.slopes[1] * sum(ratio[:k]) / k
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
    model.release()


def test_joined_ratios_give_the_same_scores(docs, spark, odd, monkeypatch):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    want = sorted(str(tuple(r)) for r in tox.toxicity(both, tox.fit(docs, labels)).select("doc_id", "predicted", F.round("score", 9)).collect())
    monkeypatch.setattr(tox, "RATIOS_SENT", 0)
    monkeypatch.setattr(tox, "COMMON_WORDS", 50)
    model = tox.fit(docs, labels)
    assert model.sent is None
    assert sorted(str(tuple(r)) for r in tox.toxicity(both, model).select("doc_id", "predicted", F.round("score", 9)).collect()) == want


def test_what_stands_late_in_a_word_counts(spark):
    rows = [(i, "x" * 60 + ("idiot" if i % 2 else "lovely"), i % 2) for i in range(40)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in tox.toxicity(docs, tox.fit(docs, labels)).where("doc_id % 2 = 1").collect()} == {1}
    assert {r["predicted"] for r in tox.toxicity(docs, tox.fit(docs, labels)).where("doc_id % 2 = 0").collect()} == {0}


@pytest.mark.parametrize("n", [40, 41, 80, 81, 119, 1000])
def test_long_words_are_read_to_their_end(n):
    word = "".join(chr(97 + i * i % 23) for i in range(n))
    got = [g for w in tox.words_of(f"a {word.upper()} b") for g in tox.events(w)]
    w = f"^{word}$"
    assert got == ["^a", "^a$", *[w[max(0, i - 5) : i + 1] for i in range(1, len(w))], "^b", "^b$"]
    assert all(len(x) <= 46 for x in tox.words_of(word))


def test_an_id_of_many_rows_sends_one(spark, monkeypatch):
    ids = list(range(1, 60))
    rows = [(i, f"text {i} of plain words") for i in ids] + [(i, f"copy {k} of an id") for i in ids for k in range(20)]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    seen, logistic = [], tox.logistic
    monkeypatch.setattr(tox, "logistic", lambda x, y: seen.append(len(x)) or logistic(x, y))
    assert tox.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert 1 < seen[0] < len(ids)
