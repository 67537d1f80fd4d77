from __future__ import annotations

import itertools

import numpy as np
import pytest

from conftest import untouched
from siftwick.llm import langid


def naive(emit, starts, trans, first):
    out = np.empty_like(emit)
    begin = [*np.flatnonzero(starts), len(emit)]
    for a, z in zip(begin[:-1], begin[1:], strict=True):
        f, b = np.empty((z - a, emit.shape[1])), np.ones((z - a, emit.shape[1]))
        f[0] = first * emit[a]
        for t in range(1, z - a):
            f[t] = (f[t - 1] @ trans) * emit[a + t]
            f[t] /= f[t].sum()
        for t in range(z - a - 2, -1, -1):
            b[t] = trans @ (emit[a + t + 1] * b[t + 1])
            b[t] /= b[t].sum()
        p = f * b
        out[a:z] = p / p.sum(1, keepdims=True)
    return out


@pytest.mark.parametrize("width", [1, 4, 256])
def test_scan_is_forward_backward(width):
    rng = np.random.default_rng(3)
    emit, starts = rng.random((700, 3)) + 1e-3, rng.random(700) < 0.05
    starts[0] = True
    trans, first = rng.random((3, 3)), np.full(3, 1 / 3)
    assert np.allclose(langid.scan(emit, starts, trans, first, width), naive(emit, starts, trans, first))


def test_held_out_accuracy_and_switching(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    rows = langid.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and held
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)
    # a text half in one language and half in another has shares that say so
    texts = {r["lang"]: r["text"] for r in docs.where("length(text) BETWEEN 600 AND 2000").collect()}
    import pyarrow as pa

    shares = langid.labeller(model)(pa.array([texts["en"][:600] + " " + texts["de"][:600]]))[0]
    by = dict(zip(model.languages, shares, strict=True))
    assert by["en"] > 0.25 and by["de"] > 0.25


def test_odd_rows(spark, odd, none):
    docs = odd.selectExpr("doc_id", "text", "'en' AS lang", "digest")
    got = {r["doc_id"]: r for r in langid.language_id(docs).collect()}
    assert len(langid.language_id(docs).collect()) == docs.count()
    assert [got[i]["lang_pred"] for i in (1, 2, 7)] == ["und"] * 3 and got[1]["score"] == 0.0
    assert got[3]["lang_pred"] == "en"
    assert got[8]["lang_pred"] == "und"
    assert langid.language_id(none).count() == 0
    bare = docs.selectExpr("doc_id", "text", "cast(null AS string) AS lang")
    assert {r["lang_pred"] for r in langid.language_id(bare).collect()} == {"und"}


def test_stage(clashing, none, spark):
    kept = langid.keep_identified(clashing)
    untouched(kept, clashing)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "4", "4", "5", "6", "None"]
    assert langid.keep_identified(none).count() == 0
    even = spark.createDataFrame([(i, f"{w} " * 30, w[:2]) for i, w in enumerate(("enan", "dede", "frfr", "eses") * 20)] + [(99, "enan dede frfr eses " * 9, None)], "doc_id long, text string, lang string")
    assert langid.keep_identified(even).count() == 81  # even shares are no reason to reject


def test_words_are_read_whole():
    a, b = "x" * 20 + "q" * 20 + "y" * 20, "x" * 20 + "k" * 20 + "y" * 20
    assert set(langid.features(a)) != set(langid.features(b))
    assert "qqq" in set(langid.features(a)) and len(list(langid.features("z" * 100_000))) == 200_005


def test_the_sample_draws_from_all_over_a_text(spark):
    long = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}" for i in range(17_576))
    runs = langid.runs_of(long)
    assert len(runs) == langid.RUNS and all(len(r) == langid.CHAIN_WORDS for r in runs)
    assert runs[0][0] == "waaa" and runs[-1][-1] == "wzzz"
    unspaced = langid.runs_of("a" * 50_000 + "b" * 50_000)
    assert sum(map(len, unspaced[0])) <= langid.RUN_LETTERS and {"a", "b"} <= set("".join(unspaced[0]))
    # a language that has long texts only is learnt
    rows = [(i, "the cat and the dog " * 40, "en") for i in range(30)] + [(100 + i, "kala maja puu vesi " * 6_000, "xx") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.language_id(df).collect()}
    assert got[1] == "en" and got[100] == "xx"


def test_every_language_is_learnt(spark, monkeypatch):
    monkeypatch.setattr(langid, "CHAINS_PER_LANGUAGE", 8)
    letters = "abcdefghijklmnopqrst"

    def word(k, j):
        return letters[k % 20] + letters[k // 20 % 20] + "u" + letters[(k + j) % 20] + letters[j]

    rows = [(k * 3 + d, " ".join(word(k, (d + i) % 6) for i in range(30)), f"l{k:03}") for k in range(300) for d in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(langid.sample(df), rounds=12)
    assert len(model.languages) == 300
    got = langid.identify(df, model).join(df, "doc_id").selectExpr("avg(int(lang = lang_pred))").first()[0]
    assert got > 0.95


@pytest.mark.parametrize("states", [3, 40])
def test_both_scans_agree(states):
    rng = np.random.default_rng(4)
    emit, starts = rng.random((900, states)) + 1e-3, rng.random(900) < 0.03
    starts[0] = True
    trans, first = rng.random((states, states)), np.full(states, 1 / states)
    assert np.allclose(langid.scan(emit, starts, trans, first), langid.scan_abreast(emit, starts, trans, first))


def test_training_counts_are_those_of_all_paths():
    rng = np.random.default_rng(5)
    e, t, first = rng.random((2, 4, 3)) + 0.1, rng.random((3, 3)) + 0.1, np.full(3, 1 / 3)
    words, pairs = np.zeros((2, 4, 3)), np.zeros((3, 3))
    for c in range(2):
        weight = {}
        for path in itertools.product(range(3), repeat=4):
            p = first[path[0]] * e[c, 0, path[0]]
            for k in range(1, 4):
                p *= t[path[k - 1], path[k]] * e[c, k, path[k]]
            weight[path] = p
        whole = sum(weight.values())
        for path, p in weight.items():
            for k in range(4):
                words[c, k, path[k]] += p / whole
                if k:
                    pairs[path[k - 1], path[k]] += p / whole
    got = langid.expected(e, t, first)
    assert np.allclose(got[0], words) and np.allclose(got[1], pairs)


def test_query_against_plain_decoding(docs):
    model = langid.fit(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.language_id(docs).collect()}
    for i, text in docs.select("doc_id", "text").collect():
        words = langid.WORD.findall((text or "").lower())
        if not words:
            assert got[i] == ("und", 0.0)
            continue
        emit = np.concatenate([model.emissions([w]) for w in words])
        share = naive(emit, np.arange(len(words)) == 0, model.trans, model.first).mean(0)
        assert got[i][0] == model.languages[int(share.argmax())] and got[i][1] == pytest.approx(share.max(), abs=1e-9)
