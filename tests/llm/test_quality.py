from __future__ import annotations

import re
from collections import Counter

from siftwick.llm.quality import Rule, quality_rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {p for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit), failed


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def rows(df):
    return sorted(((r["doc_id"] is None, r["doc_id"], *[r[c] for c in COLUMNS]) for r in df.collect()), key=str)


def want(df):
    return sorted(((r["doc_id"] is None, r["doc_id"], *brute(r["text"])) for r in df.collect()), key=str)


def test_counts(docs, odd):
    assert rows(quality_rules(docs)) == want(docs)
    assert rows(quality_rules(odd)) == want(odd)


def test_edges(spark):
    texts = ["a\x0bb\x1cc d", "x y z x y z", "a\n\na\n \n \nb", "é" * 10 + " 👍", "a b c d a b c", "\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows(quality_rules(df)) == want(df)


def test_rules(spark, none):
    good = "the cat and the dog are in a house of " * 3 + " ".join(f"word{i}x" for i in range(60))
    junk = " ".join(f"ab{i}###$$$" for i in range(80))
    df = spark.createDataFrame([(1, good), (2, junk)], "doc_id long, text string")
    got = {r["doc_id"]: (r["kept"], r["broken_rules"]) for r in quality_rules(df).collect()}
    assert got == {1: (True, ""), 2: (False, "symbol_ratio,stop_ratio")}
    assert quality_rules(df, (Rule("stop_ratio", None, 0.01),)).where("kept").count() == 1
    assert quality_rules(df).where("kept").count() == 1  # a filter above leaves the work below as it is
    assert quality_rules(none).count() == 0


def test_no_python_in_the_plan(docs):
    plan = quality_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
