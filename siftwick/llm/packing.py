"""Harmonic packing of token sequences into bins of a fixed capacity."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import small_batches

END_ID = 1
SPECIAL = "<|endoftext|>"
SMALL = 16

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bin_class int"
)
_coders: dict[tuple[str, str], list] = {}


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def coder(json_path: str, ranks_path: str | None):
    """text -> ids as ``tokenizers`` gives them for the JSON file.

    The ranks file holds the same vocabulary and its library gives the same
    ids about four times faster; only texts that hold the special token's
    string, which the JSON file reads as one id, go through ``tokenizers``.
    """
    key = (json_path, ranks_path or "")
    if key not in _coders:
        fast = None
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _coders.clear()  # one vocabulary at a time
        _coders[key] = [None, fast]
    held = _coders[key]
    fast = held[1]

    def encode(text: str) -> np.ndarray:
        if fast is None or SPECIAL in text:
            if held[0] is None:  # seldom needed, and it takes memory
                from tokenizers import Tokenizer

                held[0] = Tokenizer.from_file(json_path)
            return np.array(held[0].encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.asarray(fast.encode_ordinary(text), dtype="<u4")

    return encode


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """Cut a length into (length, class) pieces.

    A length in (capacity / (k + 1), capacity / k] is of class k, of which k
    fill a bin. Whole bins are class 1. A rest stays whole if k of it leave no
    more than a hundredth of a bin; else it is cut at capacity / (k + 1), and
    what remains shrinks with the square of k, so two or three pieces do. Class
    0 takes pieces under SMALL tokens, which fill gaps.
    """
    out = [(capacity, 1)] * (n // capacity)
    left = n % capacity
    while left:
        k = capacity // left  # so many pieces of this length fill a bin: its reciprocal class
        if left < SMALL:
            out.append((left, 0))
            break
        if k * left * 100 >= capacity * 99:
            out.append((left, k))
            break
        out.append((capacity // (k + 1), k + 1))
        left -= capacity // (k + 1)
    return out


class HarmonicPacker:
    """Fills bins of one worker; each class k has one open bin that takes k pieces."""

    def __init__(self, capacity: int, first_bin: int):
        self.capacity, self.next_bin = capacity, first_bin
        self.open: dict[int, list] = {}

    def _close(self, pieces: list, k: int) -> list[tuple]:
        offset, rows = 0, []
        for p in pieces:
            rows.append((*p, self.next_bin, offset, k))
            offset += p[2]
        self.next_bin += 1
        return rows

    def add(self, piece: tuple, k: int) -> list[tuple]:
        """A piece (doc_id, start, length, ...); rows of the bin that it fills, if any."""
        waiting = self.open.setdefault(k, [])
        waiting.append(piece)
        if k == 0:
            return self._spill() if sum(p[2] for p in waiting) >= 8 * self.capacity else []
        if len(waiting) < k:
            return []
        self.open[k] = []
        return self._close(waiting, k)

    def _spill(self) -> list[tuple]:
        rows, left = self._fit(self.open.pop(0, []), last=False)
        self.open[0] = left
        return rows

    def _fit(self, pieces: list, last: bool) -> tuple[list[tuple], list]:
        """First fit by decreasing length; unless last, half-full bins wait."""
        bins: list[tuple[int, list]] = []
        for p in sorted(pieces, key=lambda p: -p[2]):
            for i, (room, held) in enumerate(bins):
                if p[2] <= room:
                    held.append(p)
                    bins[i] = (room - p[2], held)
                    break
            else:
                bins.append((self.capacity - p[2], [p]))
        rows, left = [], []
        for room, held in bins:
            if last or room == 0 or room < self.capacity // 64:
                rows += self._close(held, 0)
            else:
                left += held
        return rows, left

    def finish(self) -> list[tuple]:
        """Bins for what the open classes hold: at most one bin's worth a class."""
        rest = [p for waiting in self.open.values() for p in waiting]
        self.open = {}
        return self._fit(rest, last=True)[0]


def pack(df: DataFrame, capacity: int = 2048, json_path: str | None = None, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise whole texts and pack them; one row per piece.

    Every partition of the input is packed by itself, without a shuffle and
    with memory for one open bin a class, so workers share nothing; bins are
    numbered by partition (sequence_id = partition << 32 | bin). A lost task
    reads the same split again and gives the same rows. Texts of any length
    are cut into as many sequences as they fill; one text is what a task holds.
    Null texts are empty: one piece that holds the end id. Repeated rows are
    packed each, null ids too, and pieces of one length go into bins as they
    come. Empty partitions and tables give no rows; other columns are not read.
    """
    if json_path is None:
        json_path, ranks_path = default_files()
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bin_class"]
    kinds = [pa.int64()] * 7 + [pa.int32()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coder(json_path, ranks_path)
        packer = HarmonicPacker(capacity, TaskContext.get().partitionId() << 32)
        rows: list[tuple] = []
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                start = 0
                for n, k in cuts(len(ids), capacity):
                    crc = zlib.crc32(ids[start : start + n].tobytes())
                    rows += packer.add((doc, start, n, crc, len(ids)), k)
                    start += n
                if len(rows) >= 20000:
                    yield batch(rows)
                    rows = []
        rows += packer.finish()
        if rows:
            yield batch(rows)

    small_batches(df.sparkSession)
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, PIECES)
