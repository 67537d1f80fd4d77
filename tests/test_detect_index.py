"""Rules against plain Python, busy keys, the index against search, and words beyond Latin."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from siftwick.functions.text import is_space, tokenize, tokens_of
from siftwick.operators import detect, graph, postings
from siftwick.operators.search import plan_trace, save_prepared, search
from siftwick.plans.querylang import QueryParseError, parse_query
from siftwick.sources.ingest import IngestError, ingest, read_jsonl
from siftwick.sources.synthetic import generate_events
from test_events import GOOD, event, ids, made

CONFIG = detect.DetectorConfig(brute_force_failures=3, spray_accounts=3, window_seconds=40, lateral_hosts=2)


def plain(rows, config):
    """(kind, key, started, ended, ids) by walking over the events of each key in order."""
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    span, k, out = config.window_seconds, config.brute_force_failures, []
    seconds = {r[0]: r[1].timestamp() for r in rows}

    def held(key, keep):
        by = defaultdict(list)
        for r in rows:
            if keep(r) and key(r) is not None:
                by[key(r)].append(r)
        return by.items()

    for user, rs in held(lambda r: r[4], lambda r: r[7] == "failure"):
        for i, r in enumerate(rs):
            if i + 1 >= k and seconds[rs[i + 1 - k][0]] >= seconds[r[0]] - span:
                out.append(("brute-force", user, rs[i + 1 - k][0], r[0], [x[0] for x in rs[i + 1 - k : i + 1]]))
                break
    high = ("high", "critical")
    for kind, key, value, keep, w, least in (
        ("password-spray", 6, 4, lambda r: r[7] == "failure", span, config.spray_accounts),
        ("lateral-movement", 4, 5, lambda r: r[7] == "success" and r[8] in high and r[5] is not None, 3 * span, config.lateral_hosts),
    ):
        for name, rs in held(lambda r, key=key: r[key], keep):
            for i, r in enumerate(rs):
                win = [x for x in rs[: i + 1] if seconds[x[0]] >= seconds[r[0]] - w]
                if len({x[value] for x in win} - {None}) >= least:
                    out.append((kind, name, win[0][0], r[0], [x[0] for x in win]))
                    break
    for (user, _), rs in held(lambda r: (r[4], r[6]) if r[4] and r[6] else None, lambda r: True):
        live = []
        for r in rs:
            live = [x for x in live if seconds[x[0]] >= seconds[r[0]] - 2 * span]
            if r[7] == "failure":
                live.append(r)
            elif r[7] == "success" and len(live) >= k:
                out.append(("failure-then-success", user, live[0][0], r[0], [x[0] for x in live] + [r[0]]))
                live = []
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_rules_against_plain_python(spark, seed):
    rng = random.Random(seed)
    pick = rng.choice
    rows = [
        event(
            f"e{i:03}",
            rng.randrange(0, 900) + pick([0, 0, 0.25]),
            user=pick(["ana", "bo", "cy", None]),
            host=pick(["h1", "h2", "h3", None]),
            ip=pick(["10.0.0.1", "10.0.0.2", None]),
            outcome=pick(["failure", "failure", "success", "unknown"]),
            severity=pick(["low", "high", "critical"]),
        )
        for i in range(260)
    ]
    when = {r[0]: r[1].replace(tzinfo=None) for r in rows}
    got = detect.detect_all(made(spark, *rows), CONFIG).collect()
    want = plain(rows, CONFIG)
    assert sorted((r["kind"], r["entities"][0].split(":", 1)[1], r["event_ids"]) for r in got) == sorted((k, key, i) for k, key, _, _, i in want)
    assert sorted((r["started_at"], r["ended_at"]) for r in got) == sorted((when[a], when[z]) for _, _, a, z, _ in want)


@pytest.mark.parametrize(("seed", "share", "least"), [(0, 0.8, 3), (1, 0.6, 3), (2, 0.5, 1), (3, 0.4, 4), (4, 0.7, 2)])
def test_stretches_of_one_key(spark, seed, share, least):
    """One account under attack without a pause: a hit clears what later ones would need."""
    rng = random.Random(seed)
    rows = [event(f"e{i:03}", rng.randrange(0, 2500), user="ana", host="h1", ip="10.0.0.1", outcome="failure" if rng.random() < share else "success", severity="low") for i in range(300)]
    config = detect.DetectorConfig(brute_force_failures=least, window_seconds=40)
    got = sorted(r["event_ids"] for r in detect.failure_then_success(made(spark, *rows), config).collect())
    assert got == sorted(i for k, _, _, _, i in plain(rows, config) if k == "failure-then-success")
    assert len(got) > 5


def test_a_busy_key_is_cut_by_time(spark):
    """A third of all events are one address's and one account's; no task gets them all."""
    n = 30_000
    rows = spark.range(n).select(
        F.concat(F.lit("e"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("id"),
        F.timestamp_seconds(F.lit(1_767_225_600) + F.col("id") * 20).alias("timestamp"),
        F.lit("s").alias("source"),
        F.lit("authentication").alias("event_type"),
        F.when(F.col("id") % 3 == 0, "svc").otherwise(F.concat(F.lit("u"), F.col("id").cast("string"))).alias("user"),
        F.lit("h").alias("host"),
        F.when(F.col("id") % 3 == 0, "10.9.9.9").otherwise(F.concat(F.lit("10.0."), (F.col("id") % 250).cast("string"), F.lit(".1"))).alias("source_ip"),
        F.when(F.col("id") % 30 == 0, "success").otherwise("failure").alias("outcome"),
        F.lit("high").alias("severity"),
        F.lit("m").alias("message"),
        F.create_map().cast("map<string,string>").alias("attributes"),
    )
    pieces = detect._pieces(rows.select("timestamp", "id", "user"), 300).groupBy("user", "piece").count()
    assert pieces.agg(F.max("count")).first()[0] <= 10
    got = detect.detect_all(rows, detect.DetectorConfig(brute_force_failures=5, window_seconds=300)).collect()
    kinds = [r["kind"] for r in got]
    assert kinds.count("brute-force") == 1 and kinds.count("failure-then-success") == n // 30 - 1
    assert all(len(r["event_ids"]) == 10 for r in got if r["kind"] == "failure-then-success")
    # an attack without a pause is cut at every hit that is sure
    logins = rows.where("user = 'svc'").select("timestamp", "id", "user", "source_ip", (F.col("outcome") == "failure").alias("bad"))
    parts = detect._stretches(logins, ["user", "source_ip"], 600, 5).groupBy("user", "source_ip", "stretch").count()
    assert parts.count() > n // 30 - 2 and parts.agg(F.max("count")).first()[0] <= 20
    # failures once in ten minutes are nothing that is streamed
    slow = rows.where("int(substring(id, 2)) % 30 IN (0, 3)")
    assert detect.failure_then_success(slow, detect.DetectorConfig()).count() == 0


QUERIES = [
    "outcome:failure AND user:ana",
    "host:ws-* OR severity:critical",
    "NOT outcome:success AND type:authentication",
    'message:"invalid password" NOT user:ana',
    "inv* OR NOT *",
    "user:* (host:dc-01 OR text:accepted)",
    "nowhere:x OR NOT nowhere:x",
    "timestamp:[2026-07-30T08:00:00Z TO 2026-07-30T08:10:00Z] OR user:svc-backup",
    "message:inv* OR event_type:authentication",
    '" " OR "nvalid passwor"',
]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    events = generate_events(spark, 500).cache()
    path = f"file://{tmp_path_factory.mktemp('index')}/i"
    postings.Index.build(events, path)
    return events, postings.Index.load(spark, path)


@pytest.mark.parametrize("query", QUERIES)
def test_index_answers_like_search(indexed, query):
    events, index = indexed
    got = index.search(query)
    assert ids(got) == ids(search(events, query)) and set(got.columns) == {*events.columns, "event_seq"}
    assert ids(index.search(query, limit=3)) == ids(search(events, query, limit=3))


def test_postings_skip_by_term(indexed):
    _, index = indexed
    plan = postings.lookup(index.postings, "user=ana")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,user=ana)" in plan


def test_prepared_files_answer_alike(spark, indexed, tmp_path):
    events, _ = indexed
    table = save_prepared(events, f"file://{tmp_path}/p")
    for query in QUERIES:
        assert ids(search(table, query)) == ids(search(events, query))


ALPHABET = [*"ab1_- .\"'é", "ⓐ", "ि", "ह", "न", "्", "द", "́", "²", "Ⅷ", "٣", "中", "文", "؀", "ª", "😀", "‍", "ß", "İ", "\x1c", " "]


def test_literals_are_cut_like_messages(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(12))) for _ in range(300)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokenize(F.col("t")).alias("k")).collect()
    for r in got:
        assert tokens_of(r["t"]) == r["k"], repr(r["t"])


def test_phrases_beyond_latin(spark):
    ev = made(spark, event("a", 0, message="यह हिन्दी भाषा है"), event("b", 1, message="xⓐ b"), event("c", 2, message="ⓐ b"), event("d", 3, message="हिन्दी"))
    for mode in ("indexed", "scan"):
        assert ids(search(ev, '"हिन्दी भाषा"', mode=mode)) == ["a"]
    assert ids(search(ev, '"ⓐ b"')) == ["c"]
    assert plan_trace(ev, '"हिन्दी भाषा"').steps[0].detail == "intersect 3 token lists, then verify phrase"  # the virama is no letter


def test_separators_are_no_blanks():
    assert [is_space(c) for c in " \t\n  \u0085\x1c\x1d\x1e\x1f"] == [True] * 6 + [False] * 4
    assert parse_query("user:a\x1cb").match.value == "a\x1cb"
    with pytest.raises(QueryParseError):
        parse_query("  ")
    assert parse_query("\x1c").match.value == "\x1c"


def test_values_with_blanks(spark):
    ev = made(spark, event("a", 0, user="Ana Maria"), event("b", 1, user="ana"), event("c", 2, user="ana maria lopez"))
    for mode in ("indexed", "scan"):
        assert ids(search(ev, 'user:"ana maria"', mode=mode)) == ["a"]


def test_bytes_that_are_not_utf8(spark, tmp_path):
    f = tmp_path / "e.jsonl"
    f.write_bytes((GOOD + ',"user":"a').encode() + b"\xff\xfe" + b'b"}\n' + b"\xc3(\n" + (GOOD + "}").encode() + b"\n")
    got = read_jsonl(spark, str(f))
    assert sorted(str(r["user"]) for r in got.events.collect()) == ["None", "a��b"]
    assert [(r["row"], r["raw"]) for r in got.invalid.collect()] == [(2, "�(")]


def test_limits_of_a_load(spark, tmp_path, monkeypatch):
    f = tmp_path / "e.txt"
    f.write_text(GOOD + "}\n" + GOOD + ',"id":"x"}\n')
    with pytest.raises(IngestError, match="jsonl and .csv"):
        ingest(spark, str(f), limits=True)
    assert ingest(spark, str(f)).events.count() == 2 and ingest(spark, str(f), "jsonl", limits=True).events.count() == 2
    monkeypatch.setattr("siftwick.sources.ingest.MAX_EVENTS", 1)
    with pytest.raises(IngestError, match="event limit"):
        ingest(spark, str(f), "jsonl", limits=True)
    monkeypatch.setattr("siftwick.sources.ingest.MAX_BYTES", 10)
    with pytest.raises(IngestError, match="file limit"):
        ingest(spark, str(f), "jsonl", limits=True)


def test_distances_against_plain_search(spark):
    rng = random.Random(3)
    pairs = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)}
    edges = [(a, b, rng.choice([1, 3, 5, 8, 10])) for a, b in pairs]
    df = spark.createDataFrame([(a, b, 1, r) for a, b, r in edges], "source long, target long, observations long, risk int")
    for weighted in (False, True):
        cost = {edges[0][0]: 0}
        for _ in range(60):
            for a, b, r in edges:
                c = max(1, 11 - r) if weighted else 1
                for x, y in ((a, b), (b, a)):
                    if x in cost:
                        cost[y] = min(cost.get(y, 1 << 30), cost[x] + c)
        got = {r["ord"]: r["cost"] for r in graph.distances(df, edges[0][0], weighted).collect()}
        assert got == cost


def test_visited_of_risk_paths(spark):
    """Both ways of finding count those that are settled no later than the goal."""
    nodes, edges = graph.build(generate_events(spark, 120, 5).withColumn("event_seq", F.monotonically_increasing_id()))
    labels = [r["label"] for r in nodes.orderBy("ord").collect()]
    a, b = (graph.path(nodes, edges, labels[1], labels[-2], "risk", driver_edges=n) for n in (20_000, 0))
    assert (a.found, a.cost, a.visited) == (b.found, b.cost, b.visited)
