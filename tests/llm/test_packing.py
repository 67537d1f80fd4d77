from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siftwick.llm import packing


@given(st.integers(1, 9000), st.sampled_from([2048, 512, 100]))
def test_cuts(n, capacity):
    pieces = packing.cuts(n, capacity)
    assert sum(size for size, _ in pieces) == n
    for size, k in pieces:
        assert 0 < size <= capacity
        assert k == 0 and size < packing.SMALL or k * size <= capacity
    assert len(pieces) <= n // capacity + 5


def held_against(df, rows, capacity):
    """Every id in one piece, gapless offsets, right checksums."""
    slow = Tokenizer.from_file(packing.default_files()[0])
    want = defaultdict(list)
    for i, text in rows:
        want[i].append(np.array([*slow.encode(text or "", add_special_tokens=False).ids, 1], "<u4"))
    bins, docs = defaultdict(list), defaultdict(list)
    for r in df.collect():
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"]].append(r)
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= capacity
    assert docs.keys() == want.keys()
    for i, pieces in docs.items():
        ids = want[i][0]
        assert sum(p["length"] for p in pieces) == len(ids) * len(want[i])
        for p in pieces:
            assert p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
    return sum(n for b in bins.values() for _, n in b) / (capacity * len(bins))


def test_documents(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert held_against(packing.pack(docs), rows, 2048) > 0.98
    assert held_against(packing.pack(docs.repartition(5), 256), rows, 256) > 0.97


def test_odd_rows(spark, odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    held_against(packing.pack(odd), rows, 2048)
    assert packing.pack(none).count() == 0
    special = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string")
    held_against(packing.pack(special), [(1, "a <|endoftext|> b")], 2048)


@pytest.mark.parametrize("text", ["", " ", "\n\n  x", "it's 'S we'll", "日本語 👍🏽 é́", "a b c", "x" * 5000, "\u0000�", "12 345,67.8"])
def test_both_coders_agree(text):
    fast, slow = packing.coder(*packing.default_files()), Tokenizer.from_file(packing.default_files()[0])
    assert fast(text).tolist() == slow.encode(text, add_special_tokens=False).ids
