from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from siftwick.engine import Engine
from siftwick.operators import detect, graph, postings, rank
from siftwick.operators.search import page_count, plan_trace, prepare, search, timeline
from siftwick.schema import EVENT
from siftwick.sources import sinks, synthetic
from siftwick.sources.ingest import IngestError, infer_format, ingest, read_csv, read_jsonl
from siftwick.sources.synthetic import BASE, generate_events, generate_rows
from siftwick.storage import numbered

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)


def event(id_, s=0.0, user="ana", host="ws-1", ip="10.0.0.1", outcome="failure", severity="high", message="Invalid password", **attributes):
    return (id_, T0 + timedelta(seconds=s), "windows", "authentication", user, host, ip, outcome, severity, message, attributes)


def made(spark, *rows):
    return spark.createDataFrame(list(rows), EVENT)


def ids(df):
    return [r["id"] for r in df.collect()]


@pytest.fixture(scope="module")
def mixed(spark):
    return generate_events(spark, 600).cache()


def test_generator_counts_and_determinism():
    assert generate_rows(100, 77) == generate_rows(100, 77)
    rows = generate_rows(10_000)
    assert rows == sorted(rows, key=lambda r: (r[1], r[0]))
    for n, found in ((1_000, 26), (10_000, 221)):
        assert sum(r[4] == "ana" and r[7] == "failure" for r in generate_rows(n)) == found
    with pytest.raises(ValueError, match="unknown scenario"):
        generate_rows(1, scenario="x")


def test_tasks_make_the_same_rows(spark, monkeypatch):
    monkeypatch.setattr(synthetic, "DRIVER_ROWS", 0)
    monkeypatch.setattr(synthetic, "ROWS_PER_TASK", 130)
    for count, scenario in ((1_000, "mixed"), (300, "mixed"), (400, "baseline")):
        got = synthetic.generate_events(spark, count, 9, scenario)
        assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame(generate_rows(count, 9, scenario), EVENT).collect()))


def test_published_match_counts(spark):
    assert search(generate_events(spark, 100_000), "outcome:failure AND user:ana", ordered=False).count() == 2_149


@pytest.mark.parametrize("query", ["outcome:failure AND user:ana", "host:ws-* OR severity:critical", "NOT outcome:success AND type:authentication", 'message:"invalid password"'])
def test_modes_agree_on_plain_queries(mixed, query):
    table = prepare(mixed)
    one = ids(search(mixed, query))
    assert one and one == ids(search(mixed, query, mode="scan")) == ids(search(table, query))
    assert plan_trace(mixed, query).candidates == len(one)


def test_modes_differ_where_documented(spark):
    ev = made(spark, event("a", 0.0004, synthetic="true"), event("b", 1, user=None, message="  "), event("c", 2, outcome="success", message="Á ⓐ x-1_y"))

    def both(q, **o):
        return ids(search(ev, q, **o)), ids(search(ev, q, mode="scan"))

    assert both("event_type:authentication") == ([], ["a", "b", "c"])
    assert ids(search(ev, "event_type:authentication", aliases=True)) == ["a", "b", "c"]
    assert both("synthetic:true") == ([], ["a"])
    assert both("message:inv*") == ([], ["a"])
    assert both("user:invalid OR foo:invalid") == ([], ["a"])
    assert both('"nvalid passwor"') == ([], ["a"])
    assert both('" "') == ([], ["a", "b", "c"])
    assert both("time:[2026-01-01T00:00:00.0001Z TO 2026-01-01T00:00:00.0002Z]") == (["a"], [])
    assert both("NOT user:ana")[0] == ["b"]
    assert both("user:*")[0] == ["a", "c"]
    assert both("*")[0] == ["a", "c"]
    assert both("ⓐ")[0] == ["c"]
    assert both("Á")[0] == ["c"]
    assert both("x-1*")[0] == ["c"]
    assert both("á")[0] == []


def test_limits_pages_and_timeline(mixed):
    all_ = ids(search(mixed, "outcome:failure"))
    assert ids(search(mixed, "outcome:failure", limit=5)) == all_[:5]
    assert ids(search(mixed, "outcome:failure", limit=0)) == []
    assert page_count(0) == 1 and page_count(13) == 2
    bars = {r["bucket"]: r["n"] for r in timeline(search(mixed, "outcome:failure", ordered=False)).collect()}
    assert bars == {b: len(all_[b::32]) for b in range(32) if all_[b::32]}


def test_plan_steps(spark):
    ev = made(spark, *[event(f"e{i}", i, user="ana" if i % 2 else "bo", severity="low") for i in range(9)])
    plan = plan_trace(ev, 'time:[2026-01-01T00:00:02Z TO 2026-01-01T00:00:04Z] OR "invalid password"')
    assert [(s.operator, s.detail, s.input_candidates, s.output_candidates, s.operations) for s in plan.steps] == [
        ("TIME_RANGE", "binary search temporal index [2, 5)", 9, 3, 11),
        ("PHRASE_VERIFY", "intersect 2 token lists, then verify phrase", 9, 9, 11),
        ("UNION", "deduplicating merge of ordered posting lists", 12, 9, 12),
    ]
    assert plan.operations == 34 and plan.strategy == "indexed-posting-lists"


numbers = st.lists(st.integers(0, 199), max_size=100)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(numbers, numbers)
def test_posting_sets(spark, a, b):
    x, y = (spark.createDataFrame([(i,) for i in sorted(set(v))], "event_seq long") for v in (a, b))
    for op, want in ((postings.intersect, set(a) & set(b)), (postings.union, set(a) | set(b)), (postings.difference, set(a) - set(b))):
        got = [r[0] for r in op(x, y).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_postings_answer_like_search(mixed):
    ev = numbered(mixed, ["timestamp", "id"], "event_seq")
    table = postings.build_postings(ev)
    want = {r["event_seq"] for r in ev.where("user = 'ana'").collect()}
    assert {r[0] for r in postings.lookup(table, "user=ana").collect()} == want
    assert postings.lookup_prefix(table, "text=inv").count() == mixed.where("message LIKE 'Inv%'").count()
    assert sorted(r["event_seq"] for r in ev.collect()) == list(range(600))


def test_detections_of_the_mixed_scenario(spark):
    got = {(r["kind"], r["entities"][0], (r["started_at"] - BASE.replace(tzinfo=None)).seconds, (r["ended_at"] - BASE.replace(tzinfo=None)).seconds, len(r["event_ids"])) for r in detect.detect_all(generate_events(spark, 800)).collect()}
    assert got == {
        ("brute-force", "user:ana", 30, 102, 5),
        ("password-spray", "ip:203.0.113.77", 1397, 1575, 5),
        ("failure-then-success", "user:ana", 30, 180, 8),
        ("lateral-movement", "user:svc-backup", 3000, 3180, 3),
    }


def test_failure_success_clears(spark):
    ev = made(
        spark,
        *[event(f"f{i}", i) for i in range(3)],
        event("weak", 3, outcome="success", ip="10.0.0.2"),
        event("hit", 4, outcome="success"),
        event("again", 5, outcome="success"),
        *[event(f"g{i}", 10 + i) for i in range(3)],
        event("u", 14, outcome="unknown"),
        event("hit2", 15, outcome="success"),
        *[event(f"h{i}", 5000 + i) for i in range(3)],
        event("late", 5000 + 700, outcome="success"),
    )
    got = detect.failure_then_success(ev, detect.DetectorConfig(brute_force_failures=3)).orderBy("ended_at").collect()
    assert [r["event_ids"] for r in got] == [["f0", "f1", "f2", "hit"], ["g0", "g1", "g2", "hit2"]]


def test_ties_enter_by_id(spark):
    ev = made(spark, *[event(i, 0, user=f"u{i}") for i in ("c", "b", "a")], event("d", 0, user=None))
    r = detect.password_spray(ev, detect.DetectorConfig(spray_accounts=2)).first()
    assert r["event_ids"] == ["a", "b"] and r["entities"] == ["ip:10.0.0.1", "user:ua", "user:ub"]
    assert r["id"] == "password-spray-10-0-0-1-1767225600"
    one = detect.brute_force(ev.where("id < 'd'").selectExpr(*[c for c in EVENT.fieldNames() if c != "user"], "'x' AS user"), detect.DetectorConfig(brute_force_failures=1)).first()
    assert one["event_ids"] == ["a"]


def test_graph_paths_both_ways_of_finding(spark):
    ev = numbered(generate_events(spark, 200, 7), ["timestamp", "id"], "event_seq")
    nodes, edges = graph.build(ev)
    labels = [r["label"] for r in nodes.orderBy("ord").collect()]
    for mode in ("hops", "risk"):
        a = graph.path(nodes, edges, labels[0], labels[-1], mode)
        b = graph.path(nodes, edges, labels[0], labels[-1], mode, driver_edges=0)
        assert a.found and (a.cost, a.nodes) == (b.cost, b.nodes)
        if mode == "hops":
            assert a.visited == b.visited
    assert graph.path(nodes, edges, labels[0], labels[0]).visited == 1
    missing = graph.path(nodes, edges, "user:nobody", "host:none")
    assert not missing.found and missing.explanation == "source entity does not exist"


def test_graph_of_few_events(spark):
    ev = made(spark, event("a", 0, host=None, ip=None), event("b", 1, user="x", host="h", ip=None), event("c", 2, user="y", host="k", ip=None), event("d", 3, user="x", host="h", ip=None, severity="critical"))
    nodes, edges = graph.build(numbered(ev, ["timestamp", "id"], "event_seq"))
    assert [(r["ord"], r["label"]) for r in nodes.orderBy("ord").collect()] == [(0, "user:x"), (1, "host:h"), (2, "user:y"), (3, "host:k")]
    assert [tuple(r) for r in edges.orderBy("source").collect()] == [(0, 1, 2, 10), (2, 3, 1, 8)]
    assert graph.path(nodes, edges, "user:x", "user:y").explanation == "entities are in disconnected components"
    assert {r["id"]: r["component"] for r in graph.node_table(nodes, edges).collect()} == {0: 0, 1: 0, 2: 2, 3: 2}


def test_command_line(spark, tmp_path, capsys):
    import json

    from siftwick import cli

    def run(*args):
        cli.parser().parse_args(args).run(cli.parser().parse_args(args), spark)
        return capsys.readouterr().out

    out = str(tmp_path / "e")
    assert "generated=900 seed=42" in run("generate", "-c", "900", "-o", out)
    assert "indexed=900 invalid=0 duplicates=0" in run("build-index", "-i", out, "-o", str(tmp_path / "ix"))
    got = json.loads(run("query", "-i", str(tmp_path / "ix"), "-l", "2", "user:ana"))
    assert len(got["matches"]) == 2 and got["plan"]["candidates"] > 2
    assert len(json.loads(run("detect", "-i", str(tmp_path / "ix")))) == 4
    assert json.loads(run("path", "-i", str(tmp_path / "ix"), "user:ana", "host:dc-01"))["found"]
    report = json.loads(run("benchmark", "--size", "1000", "--iterations", "1"))
    assert report["matches"] == 26 and report["indexed_mean_ns"] > 0
    assert graph.route_edges(["b", "a", "c"]) == {("a", "b"), ("a", "c")}


def test_top_keeps_the_largest_of_ties(spark):
    ev = made(spark, *[event(str(i), i, user=u) for i, u in enumerate(["a", "b", "c", "c", None])])
    assert [tuple(r) for r in rank.top_entities(ev, "USER", 2).collect()] == [("c", 2), ("b", 1)]
    assert rank.top_entities(ev, "user", 0).collect() == []


GOOD = '{"timestamp":"2026-01-01T00:00:00Z","source":"s","event_type":"t","outcome":"failure","severity":"high","message":"m"'


def test_jsonl_is_strict(spark, tmp_path):
    lines = [
        GOOD + "}",
        "",
        GOOD + ',"user":"","id":"x","attributes":{"a":"1"}}',
        GOOD.replace("failure", "Failure") + "}",
        GOOD + ',"user":1}',
        GOOD + ',"attributes":{"a":1}}',
        GOOD + ',"id":null}',
        GOOD.replace("00Z", "00") + "}",
        GOOD.replace("2026-01", "2026-13") + "}",
        "[1]",
        "{not-json}" + "y" * 300,
        GOOD.replace("00Z", "00+02:00") + ',"id":" "}\r',
    ]
    f = tmp_path / "e.jsonl"
    f.write_text("\n".join(lines) + "\n")
    got = read_jsonl(spark, str(f))
    rows = got.events.orderBy("timestamp", "id").collect()
    assert [r["timestamp"].isoformat() for r in rows] == ["2025-12-31T22:00:00", "2026-01-01T00:00:00", "2026-01-01T00:00:00"]
    assert {r["id"][:3] for r in rows} == {"tf-", "x"} and rows[2]["user"] == "" and rows[2]["attributes"] == {"a": "1"}
    bad = got.invalid.orderBy("row").collect()
    assert [r["row"] for r in bad] == [4, 5, 6, 7, 8, 9, 10, 11]
    assert {r["code"] for r in bad} == {"invalid_json"} and len(bad[-1]["raw"]) == 240
    assert got.counts() == {"total_rows": 11, "valid": 3, "invalid": 8, "duplicates": 0}


def test_csv(spark, tmp_path):
    head = "message,id,timestamp,source,event_type,user,host,source_ip,outcome,severity,attributes_json"
    f = tmp_path / "e.CSV"
    f.write_text(
        head
        + '\nInvalid password,,2026-01-01T00:00:00Z,windows,authentication,ana,,10.0.0.1,failure,high,"{""synthetic"":""true""}"\n'
        + '"two\nlines",b,2026-01-01T00:00:00Z,windows,authentication,ana,,,failure,high,\n'
        + "m,c,2026-01-01T00:00:00Z,windows,authentication,,,,failure,worse,\n"
        + "m,d,2026-01-01T00:00:00Z,windows,authentication,,,,failure,high,[1]\n"
    )
    got = ingest(spark, str(f))
    rows = {r["message"]: r for r in got.events.collect()}
    assert rows["Invalid password"]["id"].startswith("tf-") and rows["Invalid password"]["attributes"] == {"synthetic": "true"}
    assert rows["two\nlines"]["host"] is None and rows["two\nlines"]["attributes"] == {}
    assert [tuple(r)[:2] for r in got.invalid.orderBy("row").collect()] == [(4, "invalid_csv"), (5, "invalid_attributes")]
    assert infer_format("a.CSV") == "csv" and infer_format("a.txt") == "jsonl"


def test_round_trips_and_snapshot(spark, tmp_path):
    ev = generate_events(spark, 50)
    sinks.write_jsonl(ev, str(tmp_path / "j"))
    sinks.write_csv(ev, str(tmp_path / "c"))
    want = sorted(map(str, ev.collect()))
    assert sorted(map(str, read_jsonl(spark, str(tmp_path / "j")).events.collect())) == want
    assert sorted(map(str, read_csv(spark, str(tmp_path / "c")).events.collect())) == want
    sinks.save_snapshot(ev, str(tmp_path / "s"))
    assert sinks.load_snapshot(spark, str(tmp_path / "s")).count() == 50
    ev.limit(49).write.mode("overwrite").parquet(str(tmp_path / "s/events"))
    with pytest.raises(sinks.SnapshotError, match="index checksum mismatch"):
        sinks.load_snapshot(spark, str(tmp_path / "s"))


def test_engine(spark, tmp_path):
    e = Engine(spark, generate_events(spark, 300))
    assert e.query("user:ana", 3)["plan"]["candidates"] == e.events.where("user = 'ana'").count()
    with pytest.raises(IngestError, match="event limit is 100000"):
        e.generate(100_001)
    f = tmp_path / "bad.jsonl"
    f.write_text("{}\n")
    before = e.stats()
    assert before["events"] == 300 and before["nodes"] == 17
    assert e.path("user:ana", "host:dc-01").found
    assert e.load_jsonl(str(f))["invalid"] == 1
