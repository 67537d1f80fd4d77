"""Toxicity by two class-conditional Kneser-Ney models that share their backoff."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import counted, id_fold, remove, small_batches, unit_hash, written

WORD = re.compile(r"[^\W\d_]+")
ORDER = 6
DISCOUNT = 0.75
#: Slots at least; there are as many as n-grams if those are more.
SLOTS = 1 << 21
#: Ratios (16 to 20 bytes each) that a broadcast may hold; more are joined.
RATIOS_SENT = 4_000_000
#: Words whose ratios are sent to the texts even then: those in the most texts.
COMMON_WORDS = 100_000
#: Toxic words are few among many: a text is judged by its most toxic words, so many and such a share of all.
WORST, SHARE = 3, 0.02
#: Bound of the labelled rows on which the score's three weights are fitted.
CALIBRATION_ROWS = 4_000
#: Labels (an id and a number each) that a broadcast may hold.
LABELS_SENT = 2_000_000
LONGEST_WORD = 40
CACHED_WORDS = 150_000


def events(word: str, order: int = ORDER) -> list[str]:
    """The character n-grams of a word with its ends, or of a slice of one; each ends in the character that it predicts."""
    sliced = word.startswith("~")
    w = word[1:] if sliced else f"^{word}$"
    first = order - 1 if sliced and not w.startswith("^") else 1
    return [w[max(0, i - order + 1) : i + 1] for i in range(first, len(w))]


def words_of(text: str) -> list[str]:
    """Lower-case words; long ones in slices, marked by ``~``, that have the word's n-grams between them once each."""
    out = []
    for word in WORD.findall(text.lower()):
        if len(word) <= LONGEST_WORD:
            out.append(word)
        else:
            w = f"^{word}$"
            out += ["~" + w[max(0, i - ORDER + 1) : i + LONGEST_WORD] for i in range(1, len(w), LONGEST_WORD)]
    return out


def gram_counts(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(g, n0, n1): how often each n-gram stands in ordinary and toxic texts, over all rows.

    Tasks count words, then n-grams of distinct words, and give out a table
    whenever it has grown to its bound; Spark adds up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            grams: dict[str, list[int]] = {}
            for c in (0, 1):
                for w, n in words[c].items():
                    for g in events(w):
                        grams.setdefault(g, [0, 0])[c] += n
                words[c].clear()
            n0, n1 = zip(*grams.values(), strict=True) if grams else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), pa.array(n0, pa.int64()), pa.array(n1, pa.int64())], names=["g", "n0", "n1"])

        for b in batches:
            for text, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                words[int(y)].update(words_of(text.as_py() or ""))
                if len(words[0]) + len(words[1]) > CACHED_WORDS:
                    yield out()
        yield out()

    small_batches(labelled.sparkSession)
    rows = labelled.select(F.col(text_col).alias("t"), F.col(label_col).cast("int").alias("y")).mapInArrow(run, "g string, n0 long, n1 long")
    return rows.groupBy("g").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def log_ratios(grams: DataFrame, discount: float = DISCOUNT, order: int = ORDER) -> DataFrame:
    """(key, value): log P(toxic) - log P(ordinary) for each n-gram, and for each context alone.

    P_c(x | h) = (max(n_c(hx) - D, 0) + D t_c(h) P(x | h')) / n_c(h), where P(x | h')
    is a Kneser-Ney model from the continuation counts of both classes
    together. An n-gram that no class has seen in a context differs by the
    weights of the backoff alone, which is the context's row.
    """
    tails = grams.select(F.explode(F.transform(F.sequence(F.lit(0), F.length("g") - 2), lambda i: F.substr("g", i + 1))).alias("t")).distinct()
    cont = tails.groupBy(F.substr("t", F.lit(2)).alias("s")).agg(F.count("*").alias("n"))
    cont = cont.withColumn("m", F.length("s"))
    cont = written(cont.withColumn("h", F.substr("s", F.lit(1), F.col("m") - 1)), "continuations")
    sizes = cont.groupBy("m", "h").agg(F.sum("n").alias("all"), F.count("*").alias("types"))
    cont = cont.join(sizes, ["m", "h"])
    kinds = max(1, cont.where("m = 1").count())
    lower = None
    for m in range(1, order):
        now = cont.where(F.col("m") == m)
        if lower is None:
            back = F.lit(1.0 / kinds)
        else:
            now = now.withColumn("s2", F.substr("s", F.lit(2))).join(lower.withColumnsRenamed({"s": "s2", "p": "p2"}), "s2")
            back = F.col("p2")
        p = (F.greatest(F.col("n") - discount, F.lit(0.0)) + discount * F.col("types") * back) / F.col("all")
        level = now.select("s", p.alias("p"))
        shared = level if lower is None else shared.unionByName(level)
        lower = level
    g = grams.withColumns({"h": F.substr("g", F.lit(1), F.length("g") - 1), "s": F.substr("g", F.lit(2))})
    heads = g.groupBy("h").agg(
        F.sum("n0").alias("a0"), F.sum("n1").alias("a1"), F.count_if(F.col("n0") > 0).alias("t0"), F.count_if(F.col("n1") > 0).alias("t1")
    )
    full = g.join(heads, "h").join(shared, "s")

    def prob(c: int) -> Column:
        seen = F.greatest(F.col(f"n{c}") - discount, F.lit(0.0)) + discount * F.col(f"t{c}") * F.col("p")
        return F.when(F.col(f"a{c}") > 0, seen / F.col(f"a{c}")).otherwise(F.col("p"))

    def backoff(c: int) -> Column:
        return F.when(F.col(f"a{c}") > 0, discount * F.col(f"t{c}") / F.col(f"a{c}")).otherwise(F.lit(1.0))

    def row(text: Column, value: Column) -> list[Column]:
        return [F.xxhash64(text).alias("key"), value.alias("value")]

    whole = full.select(*row(F.col("g"), F.log(prob(1) / prob(0))))
    alone = heads.select(*row(F.concat(F.col("h"), F.lit("\x00")), F.log(backoff(1) / backoff(0))))
    return whole.unionByName(alone)


@dataclass
class Ratios:
    """Log ratios under their whole keys."""

    key: np.ndarray  # uint64, in the order of slots
    value: np.ndarray  # float32 by key
    start: np.ndarray  # where the keys of each slot begin, and the end

    def find(self, key: np.ndarray) -> np.ndarray:
        """Where the keys are, -1 for those that were never seen."""
        slot = key % np.uint64(len(self.start) - 1)
        at, end = self.start[slot].astype(np.int64), self.start[slot + np.uint64(1)]
        out = np.full(len(key), -1)
        open_ = np.flatnonzero(at < end)
        while len(open_):
            i = at[open_]
            hit = self.key[i] == key[open_]
            out[open_[hit]] = i[hit]
            open_ = open_[~hit]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        return out


def slots(ratios: DataFrame, n: int = SLOTS) -> Ratios:
    """All ratios by slot, each under its own 64-bit key; there are ``n`` slots, doubled while keys are more."""
    got = ratios.select("key", F.col("value").cast("float").alias("value")).toArrow()  # a row per n-gram and context, RATIOS_SENT at most
    key = got.column("key").to_numpy().view(np.uint64)
    while n < len(key):
        n *= 2
    slot = key % np.uint64(n)
    order = np.argsort(slot)
    start = np.zeros(n + 1, np.int32 if len(key) < 1 << 31 else np.int64)
    np.cumsum(np.bincount(slot.astype(np.int64), minlength=n), out=start[1:])
    return Ratios(key[order], got.column("value").to_numpy()[order], start)


@dataclass
class Model:
    """Ratios, sent out or in a table (key, value) if they are too many, and the weights of a score.

    The weights given here hold where none can be fitted: five nats a word.
    """

    sent: Broadcast | None = None
    table: DataFrame | None = None
    slopes: tuple[float, float] = (1.0, 0.0)
    base: float = -5.0

    def release(self) -> None:
        """Free what tasks hold; to be called once all scores are written."""
        if self.sent:
            self.sent.unpersist()
        if self.table:
            remove(self.table)


def word_ratios(ratios: Ratios, words: list[str]) -> np.ndarray:
    """(log ratio, number of events) of each word, by the ratios in memory."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    grams = [events(w) for w in words]
    flat = [g for gs in grams for g in gs]
    if not flat:
        return np.empty((0, 2))
    llr = np.zeros(len(flat))
    # the same bits as Spark's hash, which is signed
    a = ratios.find(np.array([digest(g.encode(), 42) for g in flat], np.uint64))
    llr[a >= 0] = ratios.value[a[a >= 0]]
    out = np.flatnonzero(a < 0)
    b = ratios.find(np.array([digest(f"{flat[i][:-1]}\x00".encode(), 42) for i in out], np.uint64))
    llr[out[b >= 0]] = ratios.value[b[b >= 0]]
    size = np.array([len(gs) for gs in grams])
    begin = np.cumsum(np.concatenate([[0], size[:-1]]))
    return np.stack([np.add.reduceat(llr, begin), size], axis=1)


def worst(n: int) -> int:
    """How many words of n the second number is of."""
    return max(WORST, ceil(SHARE * n))


class Scorer:
    """Texts -> log ratios of their most toxic words, with those of words kept as long as they fit."""

    def __init__(self, look_up):
        self.look_up, self.row, self.table = look_up, {}, np.empty(0)

    def top(self, text: str | None) -> tuple[int, np.ndarray]:
        """The number of words, and the largest ratios, as many as are asked for; each time that a word stands there counts."""
        words = words_of(text) if text else []
        if not words:
            return 0, np.empty(0)
        if new := set(words).difference(self.row):
            if len(self.row) + len(new) > CACHED_WORDS:
                self.row, new, self.table = {}, set(words), np.empty(0)
            self._grow(sorted(new))
        got = self.table[np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))]
        k = worst(len(words))
        if len(got) > k:
            got = np.partition(got, len(got) - k)[-k:]
        return len(words), np.sort(got)[::-1]

    def _grow(self, fresh: list[str]) -> None:
        used = len(self.row)
        if used + len(fresh) > len(self.table):
            self.table = np.concatenate([self.table[:used], np.empty(max(len(fresh), 4096, used))])
        self.table[used : used + len(fresh)] = self.look_up(fresh)
        self.row.update(zip(fresh, range(used, used + len(fresh)), strict=True))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Slopes and base of a logistic curve by Newton's method; a ridge on the slopes."""
    shift, scale = x.mean(0), x.std(0) + 1e-9
    x = np.concatenate([(x - shift) / scale, np.ones((len(x), 1))], axis=1)
    w, pull = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    pull[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(h, x.T @ (y - p) - pull * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / scale, float(w[-1] - (w[:-1] * shift / scale).sum())


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) outside the held-out fold, an id once."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return known.where(id_fold(F.col("doc_id"), 5) != 0)


def labelled_texts(docs: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """Texts with their labels: up to LABELS_SENT labels go to the texts, above that both are shuffled."""
    return docs.select("doc_id", "text").join(F.broadcast(known) if n <= LABELS_SENT else known, "doc_id")


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Counts cover every labelled row outside the held-out fold but a bounded sample of another, on which the score's three weights are fitted.

    None if no text is labelled.
    """
    fold = id_fold(F.col("doc_id"), 5)
    known = written(known_labels(labels), "labels")
    shown = known.where(fold == 4)
    n, held = known.count(), shown.count()
    # written, so that counts leave out the same ids that weights are fitted on
    shown = written(shown.where(unit_hash(F.col("doc_id")) < CALIBRATION_ROWS / max(1, held)).limit(2 * CALIBRATION_ROWS), "calibration")
    learnt = known.join(F.broadcast(shown.select("doc_id")), "doc_id", "left_anti")
    grams = written(gram_counts(labelled_texts(docs, learnt, n)), "grams")
    if grams.agg(F.sum("n0")).first()[0] is None:
        return None
    ratios, seen = counted(log_ratios(grams), "ratios", n=F.count(F.lit(1)))
    remove(grams)
    if seen["n"] <= RATIOS_SENT:
        model = Model(sent=docs.sparkSession.sparkContext.broadcast(slots(ratios)))
        remove(ratios)
    else:
        model = Model(table=ratios)
    pairs = docs.select("doc_id", "text").join(F.broadcast(shown), "doc_id")
    # two numbers for each id of the sample come to the driver, however many rows share it
    each = scored(pairs, model, "toxic").groupBy("doc_id").agg(F.max(F.struct("x", F.col("toxic").cast("double").alias("y"))).alias("r"))
    got = each.select("r.*").toArrow()
    x, y = np.array(got.column("x").to_pylist(), np.float64).reshape(-1, 2), got.column("y").to_numpy()
    if len(set(y.tolist())) == 2:
        slopes, model.base = logistic(x, y)
        model.slopes = (float(slopes[0]), float(slopes[1]))
    remove(known, shown)
    return model


def scored(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """doc_id, the kept columns and the evidence ``x`` of each row: the mean log ratio of its WORST most toxic words, and of the SHARE of its words that are most toxic.

    A model in memory goes to the texts. Of one in a table, the ratios of the
    words that stand in the most texts do, COMMON_WORDS at most; the others
    meet the table by n-gram and their texts by row number; each of them is at
    most one of COMMON_WORDS of all pairs of a word and a text.
    """
    small_batches(docs.sparkSession)
    if model.table is not None:
        return _joined(docs, model.table, keep)
    shared = model.sent

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(lambda words: word_ratios(shared.value, words)[:, 0])
        for texts in arrays:
            rows = []
            for t in texts:
                n, top = scorer.top(t.as_py())
                rows.append([float(top[:WORST].sum()) / WORST, float(top.sum()) / worst(n)])
            yield pa.array(rows, pa.list_(pa.float64()))

    return docs.select("doc_id", *keep, F.arrow_udf(run, "array<double>")(F.col("text")).alias("x"))


def _words(texts: DataFrame) -> DataFrame:
    """(rid, w, n) for each distinct word of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rid, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = Counter(words_of(text.as_py() or ""))
                yield pa.RecordBatch.from_arrays([pa.array([rid] * len(words), pa.int64()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int32())], names=["rid", "w", "n"])

    return texts.select("rid", "text").mapInArrow(run, "rid long, w string, n int")


def _table_ratios(words: DataFrame, table: DataFrame) -> DataFrame:
    """(w, llr) of distinct words from a table of ratios: an n-gram's own, else its context's, else 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(w, g) for w in b.column(0).to_pylist() for g in events(w)]
            cols = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["w", "g"])

    grams = words.mapInArrow(run, "w string, g string")
    keys = grams.select("w", F.xxhash64("g").alias("key"), F.xxhash64(F.concat(F.expr("left(g, length(g) - 1)"), F.lit("\x00"))).alias("context"))
    own = table.select("key", F.col("value").alias("own"))
    back = table.select(F.col("key").alias("context"), F.col("value").alias("back"))
    found = keys.join(own, "key", "left")
    # only what is not found looks for its context; both sides of that join are without the rest
    seen, new = found.where("own IS NOT NULL").select("w", F.col("own").alias("v")), found.where("own IS NULL").join(back, "context", "left")
    every = seen.unionByName(new.select("w", F.coalesce("back", F.lit(0.0)).alias("v")))
    return every.groupBy("w").agg(F.sum(F.col("v").cast("float").cast("double")).alias("llr"))


def _joined(docs: DataFrame, table: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    # written, so that a row has one number wherever it is read
    texts = written(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", *keep, "text"), "texts")
    words = written(_words(texts), "words")
    spread_words = written(words.groupBy("w").agg(F.count("*").alias("df")), "spread")
    common = spread_words.orderBy(F.desc("df"), "w").limit(COMMON_WORDS).select("w")
    common = written(_table_ratios(common, table), "common")  # COMMON_WORDS at most
    rare = written(_table_ratios(spread_words.join(F.broadcast(common), "w", "left_anti").select("w"), table), "rare")
    near = words.join(F.broadcast(common), "w")
    far = words.join(F.broadcast(common), "w", "left_anti").join(rare, "w")
    # a row for each text, of which tasks send the most toxic words only
    value = F.struct("llr", "n")
    rows = near.select("rid", value.alias("v"), "n").unionByName(far.select("rid", value.alias("v"), "n"))
    rows = rows.groupBy("rid").agg(F.sum("n").alias("all"), F.sort_array(F.collect_list("v"), asc=False).alias("vs"))
    k = F.greatest(F.lit(WORST).cast("long"), F.ceil(F.col("all") * SHARE))

    def mean(of: Column) -> Column:
        none = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0.0).alias("sum"))
        step = F.aggregate("vs", none, lambda a, v: _take(a, v, of))
        return step["sum"] / of

    x = F.array(mean(F.lit(WORST).cast("long")), mean(k))
    rows = rows.select("rid", x.alias("x"))
    return texts.drop("text").join(rows, "rid", "left").select("doc_id", *keep, F.coalesce("x", F.array(F.lit(0.0), F.lit(0.0))).alias("x"))


def _take(a: Column, v: Column, most: Column) -> Column:
    """One more word's ratio, as often as it stands there and as there is room."""
    n = F.least(v["n"].cast("long"), most - a["used"])
    return F.struct((a["used"] + n).alias("used"), (a["sum"] + n * v["llr"]).alias("sum"))


def toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per input row: ``score`` in 0 to 1 and ``predicted``, 1 from 0.5 up.

    The score is a logistic curve of how much likelier, by the number of words,
    the most toxic words of the text are under the toxic model than under the
    ordinary one. Texts and words of any length are read to their end. Null and
    empty texts have no words and get the score of no evidence; without any
    labelled row all scores are 0. Repeated rows are each scored; ties of words
    do not matter; an empty table gives an empty one; other columns than id and
    text are not read.
    """
    if model is None:
        out = docs.select("doc_id", F.lit(0.0).alias("score"))
    else:
        z = F.lit(model.base) + F.col("x")[0] * F.lit(model.slopes[0]) + F.col("x")[1] * F.lit(model.slopes[1])
        out = scored(docs, model).select("doc_id", (1 / (1 + F.exp(-z))).alias("score"))
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (id_fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
