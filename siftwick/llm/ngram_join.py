"""Near-duplicates: a Jaccard join of word n-grams with Bayesian candidate pruning."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import by_ids, columns_of, remove, small_batches, spare, written

WORD = re.compile(r"\w+")
BLOCK = 512
BLOCK_SHINGLES = 400_000
#: Smaller groups are cut too, in up to so many blocks, so that tasks share them.
SPREAD_SHINGLES, SPREAD_BLOCKS = 20_000, 16
CACHED_WORDS = 100_000


@dataclass(frozen=True)
class Alike:
    """When two texts are alike, and how candidates are found and dropped.

    MinHash values come in ``bands`` of ``rows``; a pair right at the
    similarity of 0.8 meets in one of 24 bands of 4 but for 3 in a million. A
    pair is dropped once the chance that it reaches the similarity falls below
    ``tolerance``, looked at after every ``stride`` values.
    """

    words: int = 5
    similarity: float = 0.8
    bands: int = 24
    rows: int = 4
    tolerance: float = 1e-6
    stride: int = 16

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    def missed(self, similarity: float) -> float:
        """The chance that a pair of a similarity meets in no band."""
        return (1 - similarity**self.rows) ** self.bands


NEAR = Alike()
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache
def family(rule: Alike) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odd factors: of the MinHash functions, of a word's place in its run, of a value's place in its band."""
    rng = np.random.default_rng(20240229)

    def odd(*shape: int) -> np.ndarray:
        return rng.integers(1, 2**63, shape, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    return odd(rule.hashes), odd(rule.words), odd(rule.bands, rule.rows)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all hang on all bits."""
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Texts -> sorted distinct 64-bit hashes of their runs of n lower-case words."""

    def __init__(self, rule: Alike = NEAR):
        import xxhash

        self.n, self.place, self.hash, self.known = rule.words, family(rule)[1], xxhash.xxh64_intdigest, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = WORD.findall(text.lower()) if text else []
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if new := set(words).difference(known):
            if len(known) > CACHED_WORDS:
                known.clear()
                new = set(words)
            for w in new:
                known[w] = self.hash(w.encode())
        ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(ids))  # a shorter text is one shingle
        h = np.zeros(len(ids) - n + 1, np.uint64)
        for k in range(n):
            h += mixed(ids[k : k + len(h)]) * self.place[k]
        return np.unique(mixed(h + np.uint64(n)))


def minhashes(shingles: np.ndarray, rule: Alike = NEAR) -> np.ndarray:
    mult = family(rule)[0][:, None]
    low = np.full(rule.hashes, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(low, (mult * shingles[None, at : at + 1024]).min(1), out=low)
    return low


SIGNED = "rid long, doc_id long, tid binary, n int, digest binary, sig binary, bands array<long>"


def signatures(df: DataFrame, rule: Alike = NEAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: an id of its text, number of shingles, digest of their set, a byte of each MinHash value, and a hash of each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, factors = Shingler(rule), family(rule)[2]
        for b in batches:
            n, digest, sig, bands = [], [], [], []
            for rid, text in zip(b.column(0).to_pylist(), b.column(3), strict=True):
                s = shingler(text.as_py())
                n.append(len(s))
                if not len(s):  # without words there is nothing to be like
                    digest.append(b"rid" + int(rid).to_bytes(8, "little"))
                    sig.append(None)
                    bands.append(None)
                    continue
                m = mixed(minhashes(s, rule))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sig.append((m >> np.uint64(56)).astype(np.uint8).tobytes())
                bands.append(mixed((m.reshape(rule.bands, rule.rows) * factors).sum(1)).astype(np.int64))
            cols = [b.column(0), b.column(1), b.column(2), pa.array(n, pa.int32()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["rid", "doc_id", "tid", "n", "digest", "sig", "bands"])

    small_batches(df.sparkSession)
    text = F.col(text_col)
    rows = df.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), text_id(text).alias("tid"), text.alias("text"))
    return rows.mapInArrow(run, SIGNED)


def text_id(text: Column) -> Column:
    """128 bits of a text; null is like no text."""
    return F.coalesce(F.unhex(F.md5(text.cast("binary"))), F.lit(b""))


@lru_cache
def least_matches(rule: Alike = NEAR) -> tuple[int, ...]:
    """For each number of compared values, the fewest matches with which a pair still may reach the similarity.

    Under a uniform prior the similarity s has a likelihood of q^m (1 - q)^(k - m)
    after m matches of k, where q = s + (1 - s) / 256 as one byte of a value is
    kept; the posterior mass above the threshold is summed on a grid.
    """
    s = (np.arange(4000) + 0.5) / 4000
    q = s + (1 - s) / 256
    above = s >= rule.similarity
    out = []
    for k in range(rule.stride, rule.hashes + 1, rule.stride):
        for m in range(k + 1):
            log = m * np.log(q) + (k - m) * np.log1p(-q)
            p = np.exp(log - log.max())
            if p[above].sum() / p.sum() >= rule.tolerance:
                out.append(m)
                break
    return tuple(out)


def surviving(sig: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray, rule: Alike = NEAR) -> np.ndarray:
    """Which of the pairs (x[i], y[i]) of rows pass: their sizes allow it, and no look at the posterior drops them."""
    small, large = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
    keep = np.flatnonzero(small >= rule.similarity * large * (1 - 1e-9))
    for j, least in enumerate(least_matches(rule)):
        if not len(keep):
            return keep
        cut = slice(j * rule.stride, (j + 1) * rule.stride)
        more = (sig[x[keep], cut] == sig[y[keep], cut]).sum(1)
        got = more if j == 0 else got[ok] + more
        ok = got >= least
        keep = keep[ok]
    return keep


def roots(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest linked index for each, given those so far and more pairs, by repeated minima."""
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for at in (x, y, label[x], label[y]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Join sorted batches so that none cuts a run of equal key columns, the first ``keys`` ones."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        last = [b.column(i)[b.num_rows - 1] for i in range(keys)]
        change = np.zeros(b.num_rows, bool)
        for i in range(keys):
            c = b.column(i).to_numpy(zero_copy_only=False)
            change |= c != last[i].as_py()
        at = int(np.flatnonzero(change)[-1]) + 1 if change.any() else 0
        if at == 0 and held:
            first = held[-1]
            if any(first.column(i)[first.num_rows - 1] != last[i] for i in range(keys)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(b)
            continue
        if at:
            yield pa.Table.from_batches([*held, b.slice(0, at)])
            held = []
        held.append(b.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def group_ends(columns: list[np.ndarray]) -> np.ndarray:
    """Starts of the runs of equal keys, and the end."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def pairs_within(ends: np.ndarray, side: np.ndarray, own: np.ndarray, most: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows inside each run, a bounded number at a time.

    Rows of a run that stands for two blocks (own false) are paired across
    ``side`` 0 and 1 only.
    """
    xs, ys, size = [], [], 0
    for a, z in zip(ends[:-1], ends[1:], strict=True):
        if own[a]:
            todo = ((np.repeat(i, z - i - 1), np.arange(i + 1, z)) for i in range(a, z - 1))
        else:
            right = np.flatnonzero(side[a:z] == 1) + a
            todo = ((np.repeat(i, len(right)), right) for i in np.flatnonzero(side[a:z] == 0) + a)
        for x, y in todo:
            xs.append(x)
            ys.append(y)
            size += len(x)
            if size >= most:
                yield np.concatenate(xs), np.concatenate(ys)
                xs, ys, size = [], [], 0
    if size:
        yield np.concatenate(xs), np.concatenate(ys)


def matrix(column: pa.ChunkedArray, width: int, kind: type) -> np.ndarray:
    """A binary column of equal lengths as rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def candidates(reps: DataFrame, rule: Alike = NEAR) -> DataFrame:
    """(cid, root): texts linked, in some bucket, by pairs that no look at the posterior dropped.

    root is the smallest cid that it is linked with there, so a bucket gives a
    row for each of its texts, however many pairs it holds. Buckets larger
    than BLOCK are cut into blocks that are compared two and two, by tasks of
    their own, so none holds a bucket whole.
    """
    rows = reps.where("n > 0").select("cid", F.posexplode("bands").alias("band", "h"))
    rows = rows.select(F.xxhash64("band", "h").alias("key"), "cid")
    shared = rows.groupBy("key").agg(F.count("*").alias("k")).where("k > 1")
    held = rows.hint("merge").join(shared.hint("merge"), "key")
    held = in_blocks(held, F.ceil(F.col("k") / BLOCK).cast("int")).select("key", "lo", "hi", "side", "cid")
    full = held.hint("merge").join(reps.select("cid", "n", "sig").hint("merge"), "cid").select("key", "lo", "hi", "cid", "side", "n", "sig")
    full = full.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 3):
            key, lo, hi, cid, side, size = (t.column(i).to_numpy() for i in range(6))
            sig = matrix(t.column(6), rule.hashes, np.uint8)
            label = np.arange(len(cid))
            for x, y in pairs_within(group_ends([key, lo, hi]), side, lo == hi):
                ok = surviving(sig, size, x, y, rule)
                label = roots(label, x[ok], y[ok])
            at = linked_rows(label)
            # rows of a run are sorted by cid, so the smallest index is the smallest cid
            yield pa.RecordBatch.from_arrays([pa.array(cid[at]), pa.array(cid[label[at]])], names=["cid", "root"])

    return full.mapInArrow(run, "cid long, root long")


def in_blocks(rows: DataFrame, blocks: Column) -> DataFrame:
    """Rows dealt to blocks by cid, and copied to the tasks (lo, hi) that compare two blocks, or one with itself; side says which block a row is of."""
    rows = rows.withColumn("nb", blocks)
    rows = rows.withColumn("b", F.pmod(F.xxhash64("cid"), F.col("nb").cast("long")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return rows.withColumns({"lo": F.least("b", "j"), "hi": F.greatest("b", "j"), "side": (F.col("b") > F.col("j")).cast("int")})


def linked_rows(label: np.ndarray) -> np.ndarray:
    """Those that have a root other than themselves, or are one."""
    moved = label != np.arange(len(label))
    moved[label[moved]] = True
    return np.flatnonzero(moved)


def shingle_sets(docs: DataFrame, wanted: DataFrame, rule: Alike, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(digest, shingles) of the texts whose ids are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(rule)
        for b in batches:
            sets = [shingler(t.as_py()).tobytes() for t in b.column(0)]
            digest = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(sets, pa.binary())], names=["digest", "shingles"])

    ids = written(wanted.select("class_doc").distinct(), "wanted")
    texts = by_ids(docs, ids.where("class_doc IS NOT NULL"), "left_semi", id_col).select(F.col(text_col).alias("text"))
    if ids.where("class_doc IS NULL").limit(1).count():  # classes without any id
        texts = texts.unionByName(docs.where(F.col(id_col).isNull()).select(F.col(text_col).alias("text")))
    return texts.mapInArrow(run, "digest binary, shingles binary")


def verified(docs: DataFrame, reps: DataFrame, found: DataFrame, rule: Alike, id_col: str, text_col: str) -> DataFrame:
    """(cid, root, links) by exact Jaccard similarity of the pairs that survive.

    Groups that candidates link are gathered with their shingle sets, in
    blocks of about BLOCK_SHINGLES at most (or one text), compared two and two
    by tasks of their own. A task prunes the pairs of its blocks by the
    posterior and checks the rest, so no pair is ever written or moved: what is
    shuffled is a text's set once for each block of its group. links counts
    the rows of all texts that a text is linked with.
    """
    groups = components(found, "cid", "root")
    member = reps.select("cid", "class_doc", "digest", "m", "n", "sig").join(groups.withColumnRenamed("id", "cid"), "cid")
    member = written(member, "members")
    sizes = member.groupBy("comp").agg(F.sum("n").alias("all"))
    sets = shingle_sets(docs, member, rule, id_col, text_col).groupBy("digest").agg(F.any_value("shingles").alias("shingles"))
    full = member.join(sizes, "comp").join(sets, "digest")
    few = F.least(F.ceil(F.col("all") / SPREAD_SHINGLES), F.lit(SPREAD_BLOCKS))
    full = in_blocks(full, F.greatest(few, F.ceil(F.col("all") / BLOCK_SHINGLES)).cast("int"))
    full = full.select("comp", "lo", "hi", "cid", "side", "m", "n", "sig", "shingles")
    full = full.repartition("comp", "lo", "hi").sortWithinPartitions("comp", "lo", "hi", "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 3):
            comp, lo, hi, cid, side, m, size = (t.column(i).to_numpy() for i in range(7))
            sig, sets = matrix(t.column(7), rule.hashes, np.uint8), [np.frombuffer(s.as_py(), np.uint64) for s in t.column(8)]
            label, links = np.arange(len(cid)), np.zeros(len(cid), np.int64)
            for x, y in pairs_within(group_ends([comp, lo, hi]), side, lo == hi):
                ok = surviving(sig, size, x, y, rule)
                x, y = alike(sets, size, x[ok], y[ok], rule)
                np.add.at(links, x, m[y])
                np.add.at(links, y, m[x])
                label = roots(label, x, y)
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (cid[at], cid[label[at]], links[at])], names=["cid", "root", "links"])

    return full.mapInArrow(run, "cid long, root long, links long")


def alike(sets: list[np.ndarray], size: np.ndarray, x: np.ndarray, y: np.ndarray, rule: Alike) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose sets are similar enough, exactly; x must be in runs."""
    least = Fraction(str(rule.similarity))
    begin = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else []
    keep = []
    for a, z in zip(begin, [*begin[1:], len(x)], strict=True):
        mine, at = sets[x[a]], y[a:z]
        flat = np.concatenate([sets[j] for j in at])
        place = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
        both = np.add.reduceat((mine[place] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(size[at])[:-1]]))
        # as whole numbers, so that a pair right at the threshold is not lost to rounding
        keep.append(both * least.denominator >= least.numerator * (size[at] + len(mine) - both))
    ok = np.concatenate(keep) if keep else np.empty(0, bool)
    return x[ok], y[ok]


def classes(docs: DataFrame, rule: Alike = NEAR, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[DataFrame]]:
    """(rid, doc_id, tid, group, class_id, set_id, n_links) for each row, and the tables that it is read from.

    ``group`` tells classes apart even where ids repeat or are null.
    """
    signed = written(signatures(docs, rule, id_col, text_col), "signatures")
    facts = [F.any_value(c).alias(c) for c in ("n", "sig", "bands")]
    reps = written(signed.groupBy("digest").agg(F.min("rid").alias("cid"), F.min("doc_id").alias("class_doc"), F.count("*").alias("m"), *facts), "sets")
    found = written(candidates(reps, rule), "candidates")
    links = written(verified(docs, reps, found, rule, id_col, text_col), "links")
    comp = components(links, "cid", "root").withColumnRenamed("id", "cid")
    # only linked texts meet by component, so that the many others do not meet in one task as nulls
    named = written(comp.join(reps.select("cid", "class_doc"), "cid"), "named")
    low = written(named.groupBy("comp").agg(F.min("class_doc").alias("low")), "low")
    lows = named.select("cid", "comp").hint("merge").join(low.hint("merge"), "comp")
    total = links.groupBy("cid").agg(F.sum("links").alias("links"))
    sets = reps.select("digest", "cid", "class_doc", "m").join(lows, "cid", "left").join(total, "cid", "left")
    sets = written(sets, "classes")
    remove(found, comp, named, low, links, reps)
    out = signed.select("rid", "doc_id", "tid", "digest").hint("merge").join(sets.hint("merge"), "digest")
    out = out.select(
        "rid",
        "doc_id",
        "tid",
        F.coalesce("comp", "cid").alias("group"),
        F.when(F.col("comp").isNull(), F.col("class_doc")).otherwise(F.col("low")).alias("class_id"),
        F.col("class_doc").alias("set_id"),
        (F.coalesce("links", F.lit(0)) + F.col("m") - 1).cast("long").alias("n_links"),
    )
    return out, [signed, sets]


def ngram_join(docs: DataFrame, rule: Alike = NEAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its class, its group of copies, and its number of links.

    Two rows are linked when the sets of their five-word runs (lower-case
    ``\\w+`` words, of whole texts) have a Jaccard similarity of 0.8 or more;
    a text of one to four words is one run. ``set_id`` is the smallest doc_id
    with the same set, ``class_id`` the smallest doc_id that chains of links
    reach, and ``n_links`` the number of other rows linked, copies included,
    though copies are never expanded. Null and empty texts, and such without
    words, are linked with nothing and are classes of their own. Repeated rows
    are copies. An empty table gives an empty one. Other columns are not read.
    """
    out, _ = classes(docs, rule, id_col, text_col)
    return out.select("doc_id", "class_id", "set_id", "n_links")


def keep_one_of_each(docs: DataFrame, rule: Alike = NEAR) -> DataFrame:
    """One row of each class, the one with the smallest doc_id; columns as they are, whatever their names.

    Null ids come last; of equal ids any may stay. Classes whose ids repeat in
    other classes keep their row all the same. Rows that repeat in id and text
    are copies, of which any may stay. An empty table gives an empty one.
    """
    every, held = classes(docs, rule)
    every = written(every.select("rid", "doc_id", "tid", "group"), "rows")
    remove(*held)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "rid", "tid")).alias("top")
    kept = written(every.groupBy("group").agg(first).select("top.doc_id", "top.tid"), "kept")
    if every.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count() == 0:
        drop = written(every.select("doc_id").join(kept.select("doc_id"), "doc_id", "left_anti").select(F.col("doc_id").alias("drop")), "drop")
        remove(every, kept)
        return by_ids(docs, drop, "left_anti").select(*columns_of(docs))
    tid, told, number = spare(docs.columns, "tid", "told", "number")
    kept = kept.select(F.col("tid").alias(told), F.col("doc_id").alias(number))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(number)) & (F.col(tid) == F.col(told))
    key = docs.withColumn(tid, text_id(F.col("text")))
    return key.join(kept, on, "left_semi").dropDuplicates(["doc_id", tid]).select(*columns_of(docs))
