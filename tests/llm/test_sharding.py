from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import pytest

from siftwick.llm.sharding import capacities, settle, shard_rows


def laws(rows, shards):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    n = [len(by.get(s, [])) for s in range(shards)]
    assert max(n) - min(n) <= 1
    assert {r["law"] for r in rows} <= {"rows"} and {r["grown_shard"] for r in rows} <= {None}


def test_documents(docs):
    rows = shard_rows(docs).collect()
    laws(rows, 40)
    text = dict(docs.select("doc_id", "text").collect())
    for r in rows:
        assert r["size"] == len(text[r["doc_id"]].encode()) + 16
        assert r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode())
    assert sorted(r["doc_id"] for r in rows) == sorted(text)


def test_groups_stay_together(spark):
    rows = [(i, f"t{i % 60}") for i in range(240)] + [(1000 + i, "hot") for i in range(200)] + [(2000 + i, f"single{i}") for i in range(160)]
    got = shard_rows(spark.createDataFrame(rows, "doc_id long, text string"), 10, rounds=8).collect()
    laws(got, 10)
    by = defaultdict(Counter)
    text = dict(rows)
    for r in got:
        by[text[r["doc_id"]]][r["shard"]] += 1
    apart = sum(sum(c.values()) - max(c.values()) for t, c in by.items() if t.startswith("t"))
    assert apart <= 24  # of 240, random shards would leave about 150 apart
    assert len(by["hot"]) <= 8


@pytest.mark.parametrize("size, share", [(2, 1.0), (3, 0.8)])
def test_copy_heavy_groups_are_whole(spark, size, share):
    n = int(4000 * share) // size * size
    rows = [(i, f"t{i // size}" if i < n else f"single{i}") for i in range(4000)]
    got = shard_rows(spark.createDataFrame(rows, "doc_id long, text string"), 40).collect()
    laws(got, 40)
    by = defaultdict(set)
    for r in got:
        by[dict(rows)[r["doc_id"]] if r["doc_id"] >= n else r["doc_id"] // size].add(r["shard"])
    assert sum(len(s) > 1 for s in by.values()) == 0


def test_settle_swaps_and_cuts_least():
    # whole in 40 shards of 500 only if each mixes both sizes
    runs, cuts = settle({(4, -1): 2500, (3, -1): 3332}, capacities(20_000, 40))
    assert not cuts
    load = Counter()
    for (m, _), r in runs.items():
        for k, s in r:
            load[s] += k * m
    assert max(load.values()) <= 500 and sum(load.values()) == 2500 * 4 + 3332 * 3
    # one larger than a shard spans three; three of 60 cannot be in two shards of 100
    _, cuts = settle({(250, -1): 1, (2, 0): 10}, [100] * 4)
    assert [len(p) for _, p in cuts] == [3]
    _, cuts = settle({(60, -1): 3}, [100, 100])
    assert [m for m, _ in cuts] == [60] and sum(k for k, _ in cuts[0][1]) == 60


def test_odd_rows(odd, none):
    rows = shard_rows(odd).collect()
    laws(rows, 40)
    assert len(rows) == odd.count()
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] in (1, 2)} == {(16, 0)}
    assert shard_rows(none).count() == 0
    assert sum(capacities(103, 10)) == 103


def cut_least(sizes, quota):
    """Rows of the groups that must be cut, by trying all ways."""
    best = [sum(sizes)]

    def put(i, free, lost):
        if lost >= best[0]:
            return
        if i == len(sizes):
            best[0] = lost
            return
        for s in {f: k for k, f in enumerate(free) if f >= sizes[i]}.values():
            free[s] -= sizes[i]
            put(i + 1, free, lost)
            free[s] += sizes[i]
        put(i + 1, free, lost + sizes[i])  # cut: takes what is left over, which is enough

    put(0, list(quota), 0)
    return best[0]


def test_settle_against_all_ways():
    rng, extra = random.Random(2), []
    for _ in range(60):
        shards = rng.randrange(2, 5)
        sizes = [rng.randrange(2, 7) for _ in range(rng.randrange(4, 9))]
        quota = capacities(sum(sizes) + rng.randrange(0, 4), shards)
        _, cuts = settle({(m, -1): n for m, n in Counter(sizes).items()}, quota)
        got, least = sum(m for m, _ in cuts), cut_least(sorted(sizes, reverse=True), quota)
        assert got >= least
        extra.append(got - least)
    # a heuristic: seldom more than what must be cut, and then by a group
    assert sum(x > 0 for x in extra) <= 6


def test_ties_and_repeats(spark):
    rows = [(1, "a")] * 30 + [(None, "a")] * 10 + [(2, None)] * 20 + [(2, "")] * 20
    got = shard_rows(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    laws(got, 4)
    assert Counter((r["doc_id"], r["size"]) for r in got) == {(1, 17): 30, (None, 17): 10, (2, 16): 40}
