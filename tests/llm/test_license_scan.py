from __future__ import annotations

import re
from pathlib import Path

import pytest

from siftwick.llm import license_scan as ls


def test_variants(spark, none):
    rows = [
        (1, ls.MIT),
        (2, "MIT LICENCE\n\nCopyright (c) 2020 A. Person\n© 2021 B\n\n" + ls.MIT.upper().replace(",", " ,")),
        (3, ls.MIT + " And more."),
        (4, "text\nreleased under the mit licence\nmore"),
        (5, None),
        (6, ""),
        (7, "Licensed under the Apache License, Version 2.0.\nAll rights reserved."),
        (8, "the licence of " * 3000),
        (1, ls.MIT),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, license_id string")
    got = {r["doc_id"]: (r["license_id"], r["notice_ids"], r["n_notices"]) for r in ls.license_scan(df).collect()}
    assert ls.license_scan(df).count() == len(rows)
    assert got[1][0] == got[2][0] == "MIT" and got[3][0] is None
    assert got[4] == (None, "MIT", 1) and got[5] == got[6] == (None, "", 0)
    assert got[7] == (None, "Apache-2.0,Proprietary", 2) and got[8] == (None, "", 0)
    assert ls.license_scan(none).count() == 0
    plan = ls.license_scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_known_texts_are_told_apart(spark):
    n = sum(len(t) for t in ls.KNOWN.values())
    assert ls.known_digests(spark).count() == n + len(ls.LONG)


def test_embedded_texts(spark, tmp_path):
    wrapped = ls.BSD3.replace(" ", "\n", 40)
    rows = [(1, f"my tool\n\n{ls.MPL_NOTICE}\n\nenjoy"), (2, wrapped), (3, f"x\n\n{ls.GNU_NOTICE.format('This program', '', 3).replace(' it', chr(10) + 'it')}\n \ny"), (4, "All  rights-reserved"), (5, "ALL RIGHTS\tRESERVED!\nz"), (6, ls.ISC.replace("WHATSOEVER", "OF ANY SORT"))]
    got = {r["doc_id"]: (r["license_id"], r["notice_ids"], r["n_notices"]) for r in ls.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (None, "MPL-2.0", 1) and got[2][0] == "BSD-3-Clause" and got[3] == (None, "GPL-3.0", 1)
    assert got[4][0] == "Proprietary" and got[5] == (None, "Proprietary", 1) and got[6] == (None, "", 0)


def test_a_line_of_a_given_table_is_found_whatever_its_words(spark):
    df = spark.createDataFrame([(1, "a\nDo as you like, please.\nb"), (2, "do as you like please")], "doc_id long, text string")
    got = {r["doc_id"]: (r["license_id"], r["n_notices"]) for r in ls.license_scan(df, {"X": ["Do as you like - please"]}).collect()}
    assert got == {1: (None, 1), 2: ("X", 1)}
    assert {r["license_id"] for r in ls.license_scan(df, {}).collect()} == {None}


@pytest.mark.parametrize("name, file", [("GPL-3.0", "GPL-3"), ("Apache-2.0", "Apache-2.0"), ("MPL-2.0", "MPL-2.0"), ("LGPL-2.1", "LGPL-2.1")])
def test_digests_of_longer_licences(spark, name, file):
    path = Path("/usr/share/common-licenses", file)
    if not path.exists():
        pytest.skip("no copy of the licence here")
    text = path.read_text()
    df = spark.createDataFrame([(1, text), (2, re.sub(r"\blicense\b", "licence", text).upper()), (3, text + "x")], "doc_id long, text string")
    assert [r["license_id"] for r in sorted(ls.license_scan(df).collect())] == [name, name, None]
