"""Language identification by a linear-chain conditional random field over words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of, id_fold, remove, small_batches, spare, unit_hash, written

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"

#: Bounds of the training sample: rows of a language, rows of all languages (but LEAST_DOCS of each),
#: runs of words that are drawn from all over a whole text, and letters of a word in a run.
DOCS_PER_LANGUAGE, SAMPLE_DOCS, LEAST_DOCS = 150, 12_000, 20
RUNS, CHAIN_WORDS, RUN_LETTERS = 12, 48, 200
#: Languages whose counts a broadcast may hold.
LABELS_SENT = 10_000
#: Bounds of the model.
MAX_FEATURES = 60_000
MAX_CHAINS, CHAINS_PER_LANGUAGE = 3_000, 20
#: Numbers (a word has one for each language) that are held at a time.
CACHED, BLOCK, FRESH = 560_000, 240_000, 200_000
#: Up to so many languages messages are carried by products of matrices.
FEW = 16


def features(word: str) -> list[str]:
    """Lexicon, affix and n-gram features of a whole lower-case word of any length."""
    b = f"<{word}>"
    own = ["=" + word, "^" + word[:1], "^" + word[:2], "$" + word[-1:], "$" + word[-2:], "$" + word[-4:]]
    return [*own, *[b[i : i + 3] for i in range(len(b) - 2)], *[word[i : i + 2] for i in range(len(word) - 1)]]


def scan(emit: np.ndarray, starts: np.ndarray, trans: np.ndarray, first: np.ndarray, width: int = 160) -> np.ndarray:
    """Word posteriors of many chains laid end to end, by forward-backward.

    emit: (n, L) positive; starts: marks each chain's first word. The words are
    dealt to columns of ``width``; products of each column's step matrices
    carry messages over columns, so a chain may be of any length, and cost is
    the same per word whatever the lengths are.
    """
    n, states = emit.shape
    cols = -(-n // width)
    pad = cols * width - n
    e = np.concatenate([emit, np.ones((pad, states))]).reshape(cols, width, states)
    s = np.concatenate([starts, np.ones(pad, bool)]).reshape(cols, width)
    m = np.broadcast_to(np.eye(states), (cols, states, states)).copy()
    for k in range(width):
        step = m @ trans
        new = s[:, k]
        if new.any():
            step[new] = m[new].sum(2, keepdims=True) * first
        m = step * e[:, k, None, :]
        m /= m.sum((1, 2), keepdims=True)
    into, back = np.empty((cols, states)), np.ones((cols, states))
    a = np.full(states, 1 / states)
    for c in range(cols):
        into[c] = a
        a = a @ m[c]
        a /= a.sum()
    r = np.ones(states)
    for c in range(cols - 1, -1, -1):
        back[c] = r
        r = m[c] @ r
        r /= r.sum()
    alpha = np.empty_like(e)
    a = into
    for k in range(width):
        a = np.where(s[:, k, None], first, a @ trans) * e[:, k]
        a = a / a.sum(1, keepdims=True)
        alpha[:, k] = a
    b = back
    for k in range(width - 1, -1, -1):
        p = alpha[:, k] * b
        nxt = (e[:, k] * b) @ trans.T
        nxt = np.where(s[:, k, None], 1.0, nxt / nxt.sum(1, keepdims=True))
        alpha[:, k] = p / p.sum(1, keepdims=True)
        b = nxt
    return alpha.reshape(-1, states)[:n]


def scan_abreast(emit: np.ndarray, starts: np.ndarray, trans: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``scan`` for many states: chains side by side, so that a word costs the square of the states and not the cube."""
    begin = np.flatnonzero(starts)
    size = np.diff(np.append(begin, len(emit)))
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    longer = [int(np.searchsorted(-size, -k)) for k in range(int(size[0]) + 1)]  # chains of more than k words
    alpha = np.empty_like(emit)
    a = np.empty((0, emit.shape[1]))
    for k in range(int(size[0])):
        at = begin[: longer[k]] + k
        a = (a[: len(at)] @ trans if k else first) * emit[at]
        a /= a.sum(1, keepdims=True)
        alpha[at] = a
    b = np.empty((0, emit.shape[1]))
    for k in range(int(size[0]) - 1, -1, -1):
        at = begin[: longer[k]] + k
        now = np.ones((len(at), emit.shape[1]))
        if n := longer[k + 1]:
            step = (emit[at[:n] + 1] * b) @ trans.T
            now[:n] = step / step.sum(1, keepdims=True)
        p = alpha[at] * now
        alpha[at] = p / p.sum(1, keepdims=True)
        b = now
    return alpha


@dataclass
class Crf:
    """Learned weights; small and of bounded size, so it travels with the tasks."""

    languages: list[str]
    index: dict[str, int]
    weights: np.ndarray  # (features + 1, L); the last row answers unknown features
    trans: np.ndarray
    first: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """A row for each word; a bounded number of features is looked up at a time, or those of one word."""
        parts, at, size = [], 0, 0
        for i, w in enumerate(words):
            size += 2 * len(w) + 5
            if size >= FRESH or i + 1 == len(words):
                parts.append(self._emissions(words[at : i + 1]))
                at, size = i + 1, 0
        return np.concatenate(parts) if parts else np.ones((0, len(self.languages)))

    def _emissions(self, words: list[str]) -> np.ndarray:
        get, none = self.index.get, len(self.index)
        flat, at = [], []
        for w in words:
            at.append(len(flat))
            flat += [get(f, none) for f in features(w)]
        x = np.add.reduceat(self.weights[flat], at, axis=0)
        return np.exp(np.clip(x - x.max(1, keepdims=True), -30, 0))


Runs = list[list[str]]


def chains_of(rows: list[tuple[Runs, str]], languages: list[str], seed: int) -> tuple[list[list[str]], np.ndarray]:
    """Training chains of CHAIN_WORDS words, and their tags.

    Half of the chains are words of one text; the others switch language every
    few words, so that transitions learn both that languages last and how
    words betray a switch.
    """
    rng = np.random.default_rng(seed)
    by: dict[str, list[Runs]] = {}
    for runs, lang in rows:
        by.setdefault(lang, []).append(runs)
    states, words_held = len(languages), sum(len(r) for runs, _ in rows for r in runs)
    chains, tags = [], []
    for c in range(min(max(MAX_CHAINS, CHAINS_PER_LANGUAGE * states), 40 * words_held)):
        words: list[str] = []
        tag: list[int] = []
        mixed = c % 2 and states > 1
        home = c // 2 % states  # each language in turn, so that rare ones are learnt too
        while len(words) < CHAIN_WORDS:
            k = int(rng.integers(states)) if mixed and tag else home
            docs = by[languages[k]]
            doc = docs[int(rng.integers(len(docs)))]
            run = doc[int(rng.integers(len(doc)))]
            n = int(rng.integers(2, 16)) if mixed else CHAIN_WORDS
            at = int(rng.integers(max(1, len(run) - n + 1)))
            words += run[at : at + n]
            tag += [k] * len(run[at : at + n])
        chains.append(words[:CHAIN_WORDS])
        tags.append(tag[:CHAIN_WORDS])
    return chains, np.array(tags)


def expected(e: np.ndarray, t: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of the words of chains of one length, and expected counts of transitions."""
    length = e.shape[1]
    alpha, beta = np.empty_like(e), np.ones_like(e)
    a = first * e[:, 0]
    alpha[:, 0] = a / a.sum(1, keepdims=True)
    for k in range(1, length):
        a = (alpha[:, k - 1] @ t) * e[:, k]
        alpha[:, k] = a / a.sum(1, keepdims=True)
    for k in range(length - 1, 0, -1):
        b = (e[:, k] * beta[:, k]) @ t.T
        beta[:, k - 1] = b / b.sum(1, keepdims=True)
    pairs = np.zeros_like(t)
    for k in range(1, length):
        b = e[:, k] * beta[:, k]
        whole = ((alpha[:, k - 1] @ t) * b).sum(1, keepdims=True)
        pairs += t * ((alpha[:, k - 1] / whole).T @ b)
    p = alpha * beta
    return p / p.sum(2, keepdims=True), pairs


def train(rows: list[tuple[Runs, str]], seed: int = 7, rounds: int = 60) -> Crf | None:
    """Fit a CRF to (runs of words, language) rows by gradient ascent on the log-likelihood."""
    rows = [(runs, lang) for runs, lang in rows if runs]
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return None
    states = len(languages)
    chains, y = chains_of(rows, languages, seed)
    counts = Counter(f for ws in chains for w in ws for f in features(w))
    chosen = [f for f, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])) if n > 1][:MAX_FEATURES]
    index = {f: i for i, f in enumerate(chosen)}
    vocab = {w: i for i, w in enumerate(sorted({w for ws in chains for w in ws}))}
    feats = [[index[f] for f in features(w) if f in index] or [len(index)] for w in vocab]
    flat = np.array([f for fs in feats for f in fs])
    at = np.cumsum([0] + [len(fs) for fs in feats[:-1]])
    owner = np.repeat(np.arange(len(feats)), [len(fs) for fs in feats])
    x = np.array([[vocab[w] for w in ws] for ws in chains])
    gold = np.zeros((len(vocab), states))
    np.add.at(gold, (x.ravel(), y.ravel()), 1)
    gold_t = np.full((states, states), 0.0)
    np.add.at(gold_t, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    weights = np.zeros((len(index) + 1, states))
    log_t = np.zeros((states, states))
    sums = [np.zeros_like(weights), np.zeros_like(log_t)]
    first = np.full(states, 1 / states)
    block = max(1, 4_000_000 // (CHAIN_WORDS * states))  # chains whose messages are held at a time
    for _ in range(rounds):
        score = np.add.reduceat(weights[flat], at, axis=0)
        word = np.exp(np.clip(score - score.max(1, keepdims=True), -30, 0))
        t = np.exp(log_t)
        diff, diff_t = gold.copy(), gold_t.copy()
        for i in range(0, len(x), block):
            p, pairs = expected(word[x[i : i + block]], t, first)
            diff_t -= pairs
            for k in range(states):
                diff[:, k] -= np.bincount(x[i : i + block].ravel(), p[..., k].ravel(), minlength=len(vocab))
        grad = np.stack([np.bincount(flat, diff[owner, k], minlength=len(weights)) for k in range(states)], axis=1)
        for value, g, q, decay in ((weights, grad, sums[0], 1.0), (log_t, diff_t, sums[1], 1.0)):
            g = g - decay * value
            q += g * g
            value += 0.5 * g / np.sqrt(q + 1e-9)
    return Crf(languages, index, weights, np.exp(log_t - log_t.max()), first)


def pieces(word: str) -> list[str]:
    """A word of the sample; of one beyond RUN_LETTERS letters, pieces from all over it."""
    if len(word) <= RUN_LETTERS:
        return [word]
    size = RUN_LETTERS // 5
    return [word[round(k * (len(word) - size) / 4) :][:size] for k in range(5)]


def runs_of(text: str) -> Runs:
    """Up to RUNS runs of words, evenly from all over a text."""
    words = WORD.findall(text.lower())
    if len(words) <= RUNS * CHAIN_WORDS:
        begin = range(0, len(words), CHAIN_WORDS)
    else:
        begin = [round(k * (len(words) - CHAIN_WORDS) / (RUNS - 1)) for k in range(RUNS)]
    return [[p for w in words[i : i + CHAIN_WORDS] for p in pieces(w)] for i in begin]


def drawn(text: Column) -> Column:
    """``runs_of`` by an Arrow function, so that no whole text of the sample leaves its task."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in arrays:
            yield pa.array([runs_of(t.as_py() or "") for t in texts], pa.list_(pa.list_(pa.string())))

    small_batches(SparkSession.active())
    return F.arrow_udf(run, "array<array<string>>")(text)


def sample(df: DataFrame, label_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> list[tuple[Runs, str]]:
    """About DOCS_PER_LANGUAGE rows for each label, fixed by their ids and texts, as runs of their words.

    Texts of any length are drawn from, and every label is, however rare.
    """
    ok = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(label_col).cast("string").alias("y")).where("y IS NOT NULL AND t IS NOT NULL")
    sizes = written(ok.groupBy("y").agg(F.count("*").alias("n")), "languages")
    labels = sizes.count()
    if not labels:
        return []
    each = max(LEAST_DOCS, min(DOCS_PER_LANGUAGE, SAMPLE_DOCS // labels))
    ok = ok.join(F.broadcast(sizes) if labels <= LABELS_SENT else sizes, "y").withColumn("u", unit_hash(F.col("i"), F.col("t")))
    rows = ok.where(F.col("u") * F.col("n") < each).select("u", "i", "y", drawn(F.col("t")).alias("r"))
    got = rows.orderBy("u", "i", "y").select("r", "y").limit(2 * each * labels).collect()
    remove(sizes)
    return [(r["r"], r["y"]) for r in got]


LABEL = "lang_pred string, score double, shares array<double>"


def labeller(model: Crf | None):
    """Arrow array of texts -> list of the languages' shares, None where there is no letter."""
    states = len(model.languages) if model else 1
    messages = scan if states <= FEW else scan_abreast
    row: dict[str, int] = {}
    table = np.empty((0, 0))

    def shares_of(texts: pa.Array) -> list[np.ndarray | None]:
        nonlocal row, table
        shares: list[np.ndarray | None] = [None] * len(texts)
        held: list[tuple[int, list[str]]] = []
        size = 0

        def flush() -> None:
            nonlocal row, table
            words = [w for _, ws in held for w in ws]
            new = set(words).difference(row)
            if (len(row) + len(new)) * states > CACHED:
                row, new = {}, set(words)
            fresh = sorted(new)
            more = model.emissions(fresh)
            table = np.concatenate([table, more]) if row else more
            row.update(zip(fresh, range(len(row), len(row) + len(fresh)), strict=True))
            at = np.fromiter(map(row.__getitem__, words), np.int64, len(words))
            starts = np.zeros(len(words), bool)
            begin = np.cumsum([0] + [len(ws) for _, ws in held[:-1]])
            starts[begin] = True
            p = np.add.reduceat(messages(table[at], starts, model.trans, model.first), begin, axis=0)
            for (i, ws), q in zip(held, p, strict=True):
                shares[i] = q / len(ws)

        for i, text in enumerate(texts):
            text = text.as_py()
            if model is None or not text:
                continue
            words = WORD.findall(text.lower())
            if any(ch.isalpha() for w in words for ch in w):
                held.append((i, words))
                size += len(words)
                if size * states >= BLOCK:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        return shares

    return shares_of


def label(model: Crf | None, text: Column) -> Column:
    """A struct of ``lang_pred``, ``score`` and the languages' ``shares``, by an Arrow function."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shares_of = labeller(model)
        names = model.languages if model else []
        for texts in arrays:
            shares = shares_of(texts)
            yield pa.StructArray.from_arrays(
                [
                    pa.array([UNKNOWN if q is None else names[int(np.argmax(q))] for q in shares], pa.string()),
                    pa.array([0.0 if q is None else min(1.0, float(q.max())) for q in shares], pa.float64()),
                    pa.array([None if q is None else q.tolist() for q in shares], pa.list_(pa.float64())),
                ],
                names=["lang_pred", "score", "shares"],
            )

    small_batches(SparkSession.active())
    return F.arrow_udf(run, LABEL)(text)


def identify(df: DataFrame, model: Crf | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Label every word of every whole text; one row per input row.

    ``shares`` holds the mean of the words' posteriors for each language of
    the model, ``lang_pred`` is the largest (ties: first by name) and ``score``
    its share. Null texts and texts without a letter, or all texts if nothing
    could be learned, are ``und`` with score 0. Words and texts of any length
    are read to their end. Repeated rows are each labelled; an empty table
    gives an empty one; other columns are not read.
    """
    out = df.select(F.col(id_col).cast("long").alias("doc_id"), label(model, F.col(text_col)).alias("x"))
    return out.select("doc_id", "x.lang_pred", "x.score", "x.shares")


def held_out(id_col: str = "doc_id") -> Column:
    return id_fold(F.col(id_col), 3) == 1


def fit(docs: DataFrame, rounds: int = 60) -> Crf | None:
    """Learn from a bounded sample of the rows that are not held out; None if none has a language and a word."""
    return train(sample(docs.where(~held_out())), rounds=rounds)


def language_id(docs: DataFrame) -> DataFrame:
    return identify(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows whose texts have a language; columns as they are, whatever their names.

    Rejected are null texts and texts without a letter, and all rows if nothing
    could be learned. A text in several languages is kept, however even its
    shares. Repeated rows are each judged; an empty table gives an empty one.
    """
    (x,) = spare(docs.columns, "told")
    out = docs.select("*", label(fit(docs), F.col("text"))["lang_pred"].alias(x))
    return out.where(F.col(x) != UNKNOWN).select(*columns_of(docs))
