from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from conftest import untouched
from siftwick.llm import ngram_join as nj


def shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    n = min(5, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def brute(rows):
    """{row: (class, links)} of (id, text) rows by comparing all that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    by = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            by[g].append(i)
    links, up = Counter(), list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in by[g] if j != i).items():
            if 10 * n >= 8 * (len(s) + len(sets[j]) - n):
                links[i] += 1
                up[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), 1 << 60), d)
    return sorted((d, low[find(i)], links[i]) for i, (d, _) in enumerate(rows))


def got(df):
    return sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in nj.ngram_join(df).collect())


def test_documents(docs):
    assert got(docs) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


@pytest.fixture(scope="module")
def crowd():
    rng = random.Random(5)
    base = [f"w{rng.randrange(10_000)}" for _ in range(120)]
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10_000)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, rows[0][1]) for i in range(40)]
    return rows


def test_a_large_group_cut_into_blocks(spark, crowd, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK", 16)
    monkeypatch.setattr(nj, "BLOCK_SHINGLES", 3_000)
    df = spark.createDataFrame(crowd, "doc_id long, text string").repartition(3)
    assert got(df) == brute(crowd)


def test_odd_rows(odd, none):
    rows = {r["doc_id"]: r for r in nj.ngram_join(odd).collect() if r["doc_id"] != 4}
    assert rows[1]["class_id"] == 1 and rows[1]["n_links"] == 0 and rows[7]["n_links"] == 0
    assert rows[3]["class_id"] == 3 and rows[3]["n_links"] == 3
    assert rows[6]["class_id"] == 5 and rows[6]["n_links"] == 1
    assert nj.ngram_join(none).count() == 0


def test_stage(spark, clashing, none):
    kept = nj.keep_one_of_each(clashing)
    untouched(kept, clashing)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 5, 7, 8]
    assert nj.keep_one_of_each(none).count() == 0
    # ids that repeat over unlike texts, and null ones, keep a row of each class
    a, b, c = ("one two three four five six", "red blue green white black", "la le li lo lu")
    rows = [(5, a), (3, a + "."), (5, b), (None, c), (None, c + "!"), (None, b), (7, a), (5, a)]
    got = [tuple(r) for r in nj.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(map(str, got)) in (sorted(map(str, [(3, a + "."), (5, b), (None, c)])), sorted(map(str, [(3, a + "."), (5, b), (None, c + "!")])))


def test_no_pair_is_written(spark, crowd, monkeypatch):
    """A group's candidates are a row for each text and bucket, and its sets are moved once a block."""
    monkeypatch.setattr(nj, "SPREAD_SHINGLES", 3_000)
    rows, write = {}, nj.written

    def seen(df, name):
        out = write(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(nj, "written", seen)
    df = spark.createDataFrame(crowd, "doc_id long, text string")
    assert got(df) == brute(crowd)
    assert rows["candidates"] <= 300 * nj.NEAR.bands and rows["links"] <= 300 * nj.SPREAD_BLOCKS


def test_other_rules(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(500)}" for _ in range(60)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(12)):
            words[rng.randrange(60)] = f"n{rng.randrange(500)}"
        rows.append((i, " ".join(words)))
    rule = nj.Alike(words=2, similarity=0.6, bands=40, rows=3)
    assert rule.missed(0.6) < 1e-4
    sets = [frozenset(zip(t.split(), t.split()[1:], strict=False)) for _, t in rows]
    want = [sum(5 * len(a & b) >= 3 * len(a | b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]
    found = nj.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), rule).collect()
    assert [r["n_links"] for r in sorted(found)] == want


def test_pruning_rule():
    least = nj.least_matches()
    assert len(least) == nj.NEAR.hashes // nj.NEAR.stride and list(least) == sorted(least)
    # a pair at the threshold is dropped about as seldom as the tolerance says
    rng = np.random.default_rng(1)
    hits = rng.random((200_000, nj.NEAR.hashes)) < 0.8
    seen = hits.cumsum(1)[:, nj.NEAR.stride - 1 :: nj.NEAR.stride]
    assert (seen < np.array(least)).any(1).mean() < 1e-4
    # and unlike pairs seldom get through
    assert ((rng.random((20_000, nj.NEAR.hashes)) < 0.3).cumsum(1)[:, nj.NEAR.stride - 1 :: nj.NEAR.stride] >= np.array(least)).all(1).mean() < 0.01


def test_shingles_are_those_of_plain_python():
    s = nj.Shingler()
    for text in ("", None, "a", "a b c d", "a b c d e", "A b, c d e f!", "x " * 50, "é ü ñ ß å ø"):
        assert len(s(text)) == len(shingles(text))
    a, b = "the quick brown fox jumps over the dog", "a quick brown fox jumps over the dog"
    assert len(np.intersect1d(s(a), s(b))) == len(shingles(a) & shingles(b))
