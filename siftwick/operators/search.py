"""Search over events: predicates, ordering, limits, pages and the plan trace."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, floor_ms, is_space, severity_score, tokenize, tokens_of
from ..plans.compile import Compiler
from ..plans.querylang import And, Exact, Expr, Not, Or, Prefix, Term, TimeRange, parse_query
from ..storage import numbered

LOWERED = ("id", "source", "event_type", "outcome", "severity", "user", "host", "source_ip", "message")
HELPERS = {*(f"{c}_lc" for c in LOWERED), "tokens", "severity_score"}
PAGE_SIZE = 12
TIMELINE_BUCKETS = 32


def prepare(events: DataFrame, sequence: bool = False) -> DataFrame:
    """Events with the lower-cased and tokenised columns that make predicates cheap.

    Meant to be written once, sorted by time: equality and prefix terms on
    ``*_lc`` columns and time ranges then reach the Parquet scan. sequence=True
    adds ``event_seq``, each event's place in the order by (timestamp, id).
    """
    out = events
    for c in LOWERED:
        out = out.withColumn(f"{c}_lc", ascii_lower(F.col(c)))
    out = out.withColumns({"tokens": tokenize(F.col("message")), "severity_score": severity_score(F.col("severity"))})
    return numbered(out, ["timestamp", "id"], "event_seq") if sequence else out


def save_prepared(events: DataFrame, path: str) -> DataFrame:
    """``prepare`` written so that queries read little: each file a stretch of time, in it rows by user and outcome.

    A time range skips files by their statistics, and a user's rows stand in
    a few pages of each.
    """
    out = prepare(events).repartitionByRange("timestamp", "id").sortWithinPartitions("user_lc", "outcome_lc", "timestamp", "id")
    out.write.parquet(path)
    return events.sparkSession.read.schema(out.schema).parquet(path)


def compiler(events: DataFrame, mode: str = "indexed", aliases: bool = False) -> Compiler:
    ntz = dict(events.dtypes)["timestamp"] == "timestamp_ntz"
    return Compiler(mode, aliases, prepared="tokens" in events.columns, ntz=ntz)


def predicate(events: DataFrame, query: str, mode: str = "indexed", aliases: bool = False) -> Column:
    return compiler(events, mode, aliases).compile(parse_query(query))


def search(events: DataFrame, query: str, limit: int | None = None, mode: str = "indexed", aliases: bool = False, ordered: bool = True) -> DataFrame:
    """Matching events by (timestamp, id); a limit becomes a top-k, not a sort.

    Of a prepared table the helper columns are left out, so that a scan reads
    only those that the predicate needs.
    """
    out = events.where(predicate(events, query, mode, aliases)).select(*[c for c in events.columns if c not in HELPERS])
    if ordered or limit is not None:
        out = out.orderBy("timestamp", "id")
    return out if limit is None else out.limit(limit)


def page(matches: DataFrame, number: int, size: int = PAGE_SIZE) -> DataFrame:
    """One page, counted from 1, of matches by (timestamp, id)."""
    return matches.orderBy("timestamp", "id").offset((max(1, number) - 1) * size).limit(size)


def page_count(n: int, size: int = PAGE_SIZE) -> int:
    return max(1, -(-n // size))


def timeline(matches: DataFrame, buckets: int = TIMELINE_BUCKETS) -> DataFrame:
    """Matches dealt to buckets by their place modulo ``buckets``, with bar heights of 5 to 100."""
    placed = numbered(matches.select("timestamp", "id"), ["timestamp", "id"], "__n")
    counts = placed.groupBy((F.col("__n") % buckets).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.lit(0)))  # over a row for each bucket
    return counts.select("bucket", "n", F.greatest(F.lit(5), F.round(100 * F.col("n") / most).cast("int")).alias("height"))


def time_histogram(matches: DataFrame, width: str = "1 hour") -> DataFrame:
    """Counts by real time, an extension."""
    return matches.groupBy(F.window("timestamp", width).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


@dataclass(frozen=True)
class PlanStep:
    operator: str
    detail: str
    input_candidates: int
    output_candidates: int
    operations: int
    complexity: str


@dataclass
class ExecutionPlan:
    total_events: int = 0
    candidates: int = 0
    operations: int = 0
    steps: list[PlanStep] = field(default_factory=list)
    strategy: str = "indexed-posting-lists"


def log2_steps(n: int) -> int:
    return 1 if n <= 1 else n.bit_length()


def plan_trace(events: DataFrame, query: str) -> ExecutionPlan:
    """What an evaluation over posting lists would do, from one pass that counts every sub-predicate."""
    tree, make = parse_query(query), compiler(events)
    nodes: list[Expr] = []

    def walk(node: Expr) -> None:
        for child in (node.left, node.right) if isinstance(node, And | Or) else (node.inner,) if isinstance(node, Not) else ():
            walk(child)
        nodes.append(node)

    walk(tree)
    counts: list[Column] = [F.count("*")]
    ts = F.col("timestamp")
    for n in nodes:
        counts.append(F.count_if(make.compile(n)))
        match n:
            case Term(_, TimeRange(start, end)):
                counts += [F.count_if(ts < make.instant(floor_ms(start))), F.count_if(make.time_range(TimeRange(start, end)))]
            case Term(_, Exact(value)) if n.field in (None, "text", "message") and any(map(is_space, value)):
                both = make.every_token(words) if (words := tokens_of(value)) else F.lit(False)
                counts += [F.count_if(both), F.lit(0)]
            case _:
                counts += [F.lit(0), F.lit(0)]
    got = list(events.agg(*[c.alias(f"c{i}") for i, c in enumerate(counts)]).first())
    total, rows = got[0], [got[i : i + 3] for i in range(1, len(got), 3)]
    plan = ExecutionPlan(total_events=total)
    done: list[int] = []  # outputs of finished children
    for n, (out, first, second) in zip(nodes, rows, strict=True):
        match n:
            case And() | Or():
                r, left = done.pop(), done.pop()
                name, text = ("INTERSECT", "linear merge of two ordered posting lists") if isinstance(n, And) else ("UNION", "deduplicating merge of ordered posting lists")
                step = PlanStep(name, text, left + r, out, left + r, "O(n + m)")
            case Not():
                inner = done.pop()
                step = PlanStep("DIFFERENCE", "subtract posting list from event universe", total + inner, out, total + inner, "O(n + m)")
            case Term(_, TimeRange()):
                step = PlanStep("TIME_RANGE", f"binary search temporal index [{first}, {first + second})", total, out, 2 * log2_steps(total) + out, "O(log n + k)")
            case Term(name, Exact(value)):
                name = "text" if name in (None, "message") else name
                if name == "text" and any(map(is_space, value)):
                    words = len(tokens_of(value))
                    step = PlanStep("PHRASE_VERIFY", f"intersect {words} token lists, then verify phrase", first, out, first + words, "O(sum postings + candidates)")
                else:
                    step = PlanStep("POSTING_LOOKUP", f"{name}={value}", total, out, 1, "O(1) average + O(k)")
            case Term(name, Prefix(value)):
                step = PlanStep("TRIE_PREFIX", f"{name or 'text'}={value}", total, out, len(value) + out, "O(p + k)")
        plan.steps.append(step)
        done.append(out)
    plan.candidates = done[-1]
    plan.operations = sum(s.operations for s in plan.steps)
    return plan
