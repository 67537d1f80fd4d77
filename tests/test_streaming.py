from __future__ import annotations

from siftwick.operators import detect
from siftwick.sources.synthetic import generate_events
from siftwick.streaming import detect as stream


def drained(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_streams_find_what_batches_find(spark, tmp_path):
    ev = generate_events(spark, 800)
    ev.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = stream.read_events(spark, str(tmp_path / "in"))
    got = drained(stream.failure_success_stream(source), "hits").collect()
    want = detect.failure_then_success(ev).collect()
    assert [(r["user"], r["ended_at"], r["failures"]) for r in got] == [("ana", w["ended_at"], len(w["event_ids"]) - 1) for w in want]
    assert drained(stream.search_stream(source, "user:ana"), "found").count() == ev.where("user = 'ana'").count()
    assert {r["user"] for r in drained(stream.failures_by_window(source), "windows").collect()} == {"ana"}
