"""Soft-membership mixing: document rates whose expected domain tokens meet target weights."""

from __future__ import annotations

import re
import warnings
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove, small_batches, unit_hash, written

#: Production weights of the domains that the labelled table tells apart.
TARGETS = {"clean": 0.96, "low_quality": 0.02, "toxic": 0.02}
#: Bound of the sample that the classifier learns from, and of its words.
ROWS_PER_DOMAIN = 1_200
LEXICON = 20_000
LEAST_TEXTS = 3
MAX_STEPS = 25
CLOSE = 1e-4

SYMBOL = re.compile(r"[#*$%&|<>!]")
UPPER = re.compile(r"[^\W\d_a-zß-ÿ]")


def shape(text: str, words: list[str], kinds: set[str]) -> list[float]:
    n = max(1, len(words))
    lines = text.split("\n")
    return [
        np.log1p(len(words)),
        len(kinds) / n,
        len(SYMBOL.findall(text)) / n,
        len(UPPER.findall(text)) / max(1, len(text)),
        len(text) / n / 10,
        1 - len(set(lines)) / len(lines),
    ]


@dataclass
class Classifier:
    """Domain posteriors from word log-odds and the shape of a text; of bounded size."""

    domains: list[str]
    row: dict[str, int]
    odds: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def raw(self, text: str) -> tuple[list[float], int]:
        words = text.lower().split()
        kinds = set(words)
        held = [self.row[w] for w in kinds if w in self.row]
        k = len(self.domains)
        got = self.odds[held] if held else np.zeros((1, k))
        return [*shape(text, words, kinds), *got.mean(0), *got.max(0)], len(words)

    def posteriors(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        rows = [self.raw(t) for t in texts]
        x = (np.array([r for r, _ in rows]) - self.mean) / self.scale
        z = np.concatenate([x, np.ones((len(x), 1))], axis=1) @ self.weights
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True), [n for _, n in rows]


def domain_of() -> Column:
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low_quality").when(F.col("toxic").isNotNull() & F.col("quality").isNotNull(), "clean")


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, u, text, domain) of about ROWS_PER_DOMAIN labelled ids for each domain, fixed by the ids; texts of any length.

    The sample is drawn from the labels, so that its ids, a bounded number, go
    to the texts, and no texts are moved.
    """
    known = labels.select("doc_id", domain_of().alias("domain")).where("domain IS NOT NULL AND doc_id IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.max("domain").alias("domain"))
    sizes = {r[0]: r[1] for r in known.groupBy("domain").count().collect()}  # a row per domain
    wanted = F.lit(False)
    for d, n in sizes.items():
        wanted |= (F.col("domain") == d) & (unit_hash(F.col("doc_id"), F.lit("sample")) < F.lit(ROWS_PER_DOMAIN / n))
    drawn = known.where(wanted).limit(2 * ROWS_PER_DOMAIN * max(1, len(sizes)))
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(drawn), "doc_id")
    return rows.select("doc_id", unit_hash(F.col("doc_id"), F.col("text"), F.lit("half")).alias("u"), "text", "domain")


def lexicon(rows: DataFrame, domains: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """The LEXICON words whose shares of texts differ most between domains, and their log-odds.

    Texts are counted in their tasks; the words chosen come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for text, d in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                seen.update((w, d) for w in set(text.as_py().lower().split()))
        rows = list(seen.items())
        yield pa.RecordBatch.from_arrays([pa.array([w for (w, _), _ in rows], pa.string()), pa.array([d for (_, d), _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["w", "d", "n"])

    size = {r[0]: r[1] for r in rows.groupBy("domain").count().collect()}  # a row per domain
    small_batches(rows.sparkSession)
    words = rows.select("text", "domain").mapInArrow(run, "w string, d string, n long").groupBy("w")
    words = words.agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col("d") == d, F.col("n")).otherwise(0)).alias(f"n{k}") for k, d in enumerate(domains)])
    share = [F.log((F.col(f"n{k}") + 0.5) / F.lit(size.get(d, 0) + 1.0)) for k, d in enumerate(domains)]
    mean = sum(share[1:], share[0]) / len(domains)
    words = words.where(F.col("n") >= LEAST_TEXTS).select("w", F.array(*[x - mean for x in share]).alias("odds"))
    far = F.aggregate("odds", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    best = words.orderBy(far.desc(), "w").limit(LEXICON).collect()
    return {r["w"]: i for i, r in enumerate(best)}, np.array([r["odds"] for r in best]).reshape(-1, len(domains))


def softmax(x: np.ndarray, y: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Weights of a softmax regression by gradient descent with momentum."""
    w = np.zeros((x.shape[1], y.shape[1]))
    moment = np.zeros_like(w)
    for _ in range(rounds):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        moment = 0.9 * moment + x.T @ (p - y) / len(x) + 1e-3 * w
        w -= 0.1 * moment
    return w


def fit(docs: DataFrame, labels: DataFrame) -> Classifier | None:
    """Learn the domains from the sample: word log-odds from one half of it, softmax weights from the other.

    Whole texts are read in tasks; words and a few numbers an id come to the
    driver, however many rows share the id. None if no text is labelled.
    """
    rows = written(sample(docs, labels), "sample")
    domains = [r[0] for r in rows.select("domain").distinct().orderBy("domain").collect()]  # a row per domain
    if not domains:
        return None
    halves = rows.where("u < 0.5"), rows.where("u >= 0.5")
    if halves[0].select("domain").distinct().count() < len(domains) or halves[1].select("domain").distinct().count() < len(domains):
        halves = rows, rows  # too few to be halved
    row, odds = lexicon(halves[0], domains)
    model = Classifier(domains, row, odds, np.zeros(1), np.ones(1), np.zeros(1))

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in arrays:
            yield pa.array([model.raw(t)[0] for t in texts.to_pylist()], pa.list_(pa.float64()))

    shapes = halves[1].select("doc_id", F.struct("u", "domain", F.arrow_udf(run, "array<double>")("text").alias("x")).alias("r"))
    got = shapes.groupBy("doc_id").agg(F.min("r").alias("r")).select("r.*").orderBy("u", "domain").collect()
    remove(rows)
    x = np.array([r["x"] for r in got])
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-6
    x = np.concatenate([(x - model.mean) / model.scale, np.ones((len(x), 1))], axis=1)
    model.weights = softmax(x, np.eye(len(domains))[[domains.index(r["domain"]) for r in got]])
    return model


def membership(model: Classifier, text: Column) -> Column:
    """A struct of ``tokens`` (words) and posteriors ``p``, by an Arrow function."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in arrays:
            if len(texts):
                p, n = model.posteriors([t or "" for t in texts.to_pylist()])
            else:
                p, n = np.zeros((0, len(model.domains))), []
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(p.tolist(), pa.list_(pa.float64()))], names=["tokens", "p"])

    small_batches(SparkSession.active())
    return F.arrow_udf(run, "tokens long, p array<double>")(text)


def rate(p: Column, steps: list[list[float]]) -> Column:
    """The rate after these gradient steps: rates start at 1 and are projected on the nonnegative at each."""
    r = F.lit(1.0)
    for g in steps:
        r = F.greatest(F.lit(0.0), r - sum((p[k] * F.lit(float(v)) for k, v in enumerate(g)), F.lit(0.0)))
    return r


def solve(members: DataFrame, domains: list[str], targets: dict[str, float], budget: float = 1.0, max_steps: int = MAX_STEPS) -> tuple[list[list[float]], list[float], list[float]]:
    """Projected gradient on (S - T)' C (S - T), S_k = sum_i tokens_i p_ik r_i.

    C is the inverse of the Gram matrix of the documents whose rate is above 0,
    so that domains of any size and overlap come near their totals T at the
    same pace. In the metric of token counts the step of a document is
    p_i . C (S - T), whatever its length; a step that does not bring S nearer
    is halved. A rate follows from the document's own posteriors and the steps
    so far, so an iteration is one pass that sums K + K (K + 1) / 2 numbers,
    and no rates are kept. Returns the steps, the totals reached, and those wanted.
    """
    p, k = F.col("p"), len(domains)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def measure(steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        rows = members.select("tokens", "p", rate(p, steps).alias("r"))
        sums = [F.sum(F.col("tokens") * p[i] * F.col("r")) for i in range(k)]
        live = F.when(F.col("r") > 0, F.col("tokens")).otherwise(F.lit(0))
        got = [float(x or 0.0) for x in rows.agg(*sums, *[F.sum(live * p[i] * p[j]) for i, j in pairs]).first()]
        gram = np.zeros((k, k))
        for (i, j), x in zip(pairs, got[k:], strict=True):
            gram[i, j] = gram[j, i] = x
        return np.array(got[:k]), gram

    now, gram = measure([])
    share = np.array([targets.get(d, 0.0) for d in domains])
    mass = max(1.0, now.sum())
    want = budget * now.sum() * share / (share.sum() or 1.0)
    steps: list[list[float]] = []
    size = 1.0
    for _ in range(max_steps):
        if np.abs(now - want).max() <= CLOSE * mass or size < 1e-3:
            break
        g = np.linalg.solve(gram + 1e-6 * mass * np.eye(k), now - want)
        then, bent = measure([*steps, (size * g).tolist()])
        if np.abs(then - want).sum() < np.abs(now - want).sum():
            steps.append((size * g).tolist())
            now, gram, size = then, bent, min(1.0, 2 * size)
        else:
            size /= 2
    return steps, now.tolist(), want.tolist()


def unmet(domains: list[str], targets: dict[str, float], now: list[float], want: list[float]) -> list[str]:
    """What the rates leave of the targets: domains that no label has, and totals that no nonnegative rates reach."""
    out = [f"{d}: no labelled text has this domain; its weight of {w} goes to the others in proportion" for d, w in targets.items() if w and d not in domains]
    mass = sum(want) or 1.0
    for d, a, b in zip(domains, now, want, strict=True):
        if abs(a - b) > 10 * CLOSE * mass:
            out.append(f"{d}: a share of {a / mass:.4f} was reached, {b / mass:.4f} was wanted")
    return out


def rates(members: DataFrame, domains: list[str], targets: dict[str, float] | None, budget: float) -> list[list[float]]:
    """The steps that ``rate`` takes; warns of targets that are not met."""
    targets = targets or TARGETS
    steps, now, want = solve(members, domains, targets, budget)
    for text in unmet(domains, targets, now, want):
        warnings.warn(f"mixing: {text}", stacklevel=3)
    return steps


def copies(r: Column, *by: Column) -> Column:
    """A whole number of copies with the rate as its mean, fixed by the row's values."""
    return (F.floor(r) + (unit_hash(*by, F.lit("copies")) < r - F.floor(r)).cast("long")).cast("long")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget: float = 1.0) -> DataFrame:
    """One row per input row: tokens, posteriors by domain, rate and copies.

    Tokens are words between white space, of whole texts. Null texts have none
    and do not bear on totals. Repeated rows get the same rate each, and ties
    of posteriors do not matter. Without labelled rows all rates are 1, and an
    empty table gives an empty one. Targets that cannot be met are come near
    to, with a warning that names them. Other columns than id and text are not
    read.
    """
    model = fit(docs, labels)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    if model is None:
        words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
        return base.select("doc_id", F.size(words).cast("long").alias("tokens"), F.lit(None).cast("map<string,double>").alias("posteriors"), F.lit(1.0).alias("rate"), F.lit(1).cast("long").alias("copies"))
    members = base.select("doc_id", F.xxhash64("text").alias("h"), membership(model, F.col("text")).alias("m"))
    members = written(members.select("doc_id", "h", "m.tokens", "m.p"), "members")
    steps = rates(members, model.domains, targets, budget)
    names = F.array(*[F.lit(d) for d in model.domains])
    out = members.withColumn("rate", rate(F.col("p"), steps))
    return out.select("doc_id", "tokens", F.map_from_arrays(names, "p").alias("posteriors"), "rate", copies(F.col("rate"), F.col("doc_id"), F.col("h")).alias("copies"))


def mixed_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget: float = 1.0, keep: str | None = None) -> DataFrame:
    """``docs`` with each row as often as its copies say; columns as they are, whatever their names.

    A row whose largest posterior is that of the domain ``keep`` stays at least
    once. Each text is classified once, beside its row, and written with it,
    since rates are known only after all texts are. Null texts are rows without
    tokens; repeated rows are copied alike; without labelled rows the table
    stays as it is, and an empty one gives an empty one.
    """
    model = fit(docs, labels)
    if model is None:
        return docs
    held = written(docs.select(F.struct("*").alias("row"), membership(model, F.col("text")).alias("m")), "members")
    steps = rates(held.select("m.tokens", "m.p"), model.domains, targets, budget)
    n = copies(rate(F.col("m.p"), steps), F.col("row.doc_id").cast("long"), F.xxhash64("row.text"))
    if keep in model.domains:
        most = F.col("m.p")[model.domains.index(keep)] >= F.array_max("m.p")
        n = F.when(most, F.greatest(n, F.lit(1))).otherwise(n)
    out = held.select("row", n.alias("n")).where("n > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")
