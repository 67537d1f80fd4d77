from __future__ import annotations

import gzip
import zlib
from collections import Counter

import pytest

from siftwick.llm import warc


def arc(version, *blocks):
    return warc.filedesc(version, "t.arc") + b"\n" + b"".join(warc.arc_head(version, f"http://a/{i}", "1.2.3.4", "20200102030405", "text/html", len(b)) + b + b"\n" for i, b in enumerate(blocks))


@pytest.mark.parametrize("version", [1, 2])
def test_parse(version):
    rows = list(warc.parse_arc(arc(version, b"x\ny\n", b"", b"HTTP/1.1 200 OK\r\n\r\nbody")))
    assert [r.content for r in rows[1:]] == [b"x\ny\n", b"", b"HTTP/1.1 200 OK\r\n\r\nbody"]
    assert {r.version for r in rows} == {version} and rows[1].date == "20200102030405"
    record = warc.converted(rows[3], "t")
    heads, block = next(warc.parse_warc(record + b"\r\n\r\n"))
    assert heads["warc-type"] == "response" and heads["warc-date"] == "2020-01-02T03:04:05Z" and block == rows[3].content
    assert next(warc.parse_warc(warc.converted(rows[1], "t") + b"\r\n\r\n"))[0]["warc-type"] == "resource"


@pytest.mark.parametrize("bad", [b"http://a 1.2.3.4 x text/plain 0\n", arc(1, b"abc")[:-2], arc(1) + b"http://a 1.2.3.4 2020 text/html x\n", arc(2) + b"http://a 1 2 3 4\nabcd\n", arc(1).replace(b"1 0 ", b"9 0 ")])
def test_broken_archives(bad):
    with pytest.raises(warc.ArchiveError):
        list(warc.parse_arc(bad))


def test_round_trip(spark, monkeypatch):
    long = "é" * 80
    rows = [(5, "http://a/ b", long), (3, "http://a", long), (3, "http://a", long), (9, None, None), (None, "u", long), (7, "u", "short"), (8, "u", "short"), (2, "u", "\r\n\r\nWARC/1.1\r\n" + long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for versions in ((1,), (2,), (1, 2)):
        got = warc.round_trip(pages, versions).collect()
        assert len(got) == len(rows)
        same = [r for r in got if r["payload_bytes"] == 160]
        assert sorted(str((r["page_id"], r["record_type"], r["refers_to"])) for r in same) == sorted(["(3, 'response', None)", "(3, 'revisit', 3)", "(5, 'revisit', 3)", "(None, 'revisit', 3)"])
        assert {r["record_type"] for r in got if r["payload_bytes"] != 160} == {"response"}
        assert sorted(str(r["page_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    monkeypatch.setattr(warc, "MARKS_SENT", 0)
    assert sorted(map(str, warc.round_trip(pages).collect())) == sorted(map(str, got))
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_files_are_archives(spark, tmp_path):
    pages = [(i % 5, f"http://a/{i}", f"<p>{i % 9}</p>" * 30) for i in range(23)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    warc.write_arc(df, f"file://{tmp_path}/arc", 2, df["page_id"] * 100_000_000, file=(3, 200))
    warc.arc_to_warc(spark, f"file://{tmp_path}/arc", f"file://{tmp_path}/warc", file=(3, 200))
    files = sorted((tmp_path / "warc").glob("part-*"))
    assert len(files) > 2  # cut by bytes
    ids, refers, kinds, members = [], [], Counter(), []
    for f in files:
        data = f.read_bytes()
        assert gzip.decompress(data)  # any reader of gzip can
        every = list(warc.parse_warc(data))
        assert every[0][0]["warc-type"] == "warcinfo"
        # each record is a member of its own, that can be read from where it begins
        at = 0
        while at < len(data):
            d = zlib.decompressobj(31)
            if one := d.decompress(data[at:]):
                members.append(len(list(warc.parse_warc(one))))
            at = len(data) - len(d.unused_data)
        ids += [h["warc-record-id"] for h, _ in every]
        refers += [h for h, _ in every if h["warc-type"] == "revisit"]
        kinds.update(h["warc-type"] for h, _ in every)
        assert {h["warc-date"] for h, _ in every if h["warc-type"] != "warcinfo"} <= {"1970-01-01T00:00:00Z", "1973-03-03T09:46:40Z", "1976-05-03T19:33:20Z", "1979-07-05T05:20:00Z", "1982-09-04T15:06:40Z"}
    assert set(members) == {1} and len(members) == sum(kinds.values())
    assert len(set(ids)) == len(ids) and kinds["response"] == 9 and kinds["revisit"] == 14
    assert all(h["warc-refers-to"] in ids and h["warc-refers-to-target-uri"].startswith("http://a/") and h["warc-refers-to-date"] for h in refers)


def test_a_long_page_is_a_record_that_is_read_alone(spark):
    long = "z" * 30_000_000
    rows = [(i, f"http://a/{i}", f"{i % 2}{long}" if i < 4 else "small") for i in range(8)]
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == (30_000_001, "response", None) and got[2] == (30_000_001, "revisit", 0) and got[3][2] == 1 and got[7] == (5, "response", None)


def test_a_reader_holds_a_piece_not_the_file():
    record = warc.converted(warc.ArcRecord(0, 1, "http://a", "1.2.3.4", "20200102030405", "text/plain", b"q" * 100_000), "t") + b"\r\n\r\n"
    data, most = b"".join([warc.member(record)] * 2_000), 0  # 200 MB unpacked
    reader = warc.Reader(data)
    n = 0
    while not reader.done():
        head = reader.through(b"\r\n\r\n")
        reader.take(100_000 + 4)
        n, most = n + head.startswith(b"WARC"), max(most, len(reader.held))
    assert n == 2_000 and most < 20_000_000


@pytest.mark.parametrize("digits, want", [("20200102030405", "2020-01-02T03:04:05Z"), ("202001020304", "2020-01-02T03:04:00Z"), ("20209902030405", "1970-01-01T00:00:00Z"), ("", "1970-01-01T00:00:00Z")])
def test_dates(digits, want):
    assert warc.warc_date(digits) == want


def test_broken_packed_files():
    whole = warc.member(arc(1, b"abc"))
    assert [r.content for r in warc.parse_arc(whole)][1] == b"abc"
    for bad in (whole[:-9], whole + b"rubbish"):
        with pytest.raises(warc.ArchiveError):
            list(warc.parse_arc(bad))
