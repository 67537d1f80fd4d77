"""A table of postings, set operations over event numbers, and search by postings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, is_space, tokenize, tokens_of
from ..plans.compile import TEXT_FIELDS
from ..plans.querylang import And, Exact, Expr, Not, Or, Term, TimeRange, parse_query
from ..schema import INDEXED
from ..storage import new_path, spare
from .search import HELPERS, compiler, prepare


def build_postings(events: DataFrame, seq: str = "event_seq") -> DataFrame:
    """(term, event_seq): ``field=value`` for each field an event has, ``text=token`` for each distinct token."""
    prepared = "tokens" in events.columns
    values = {name: F.col(f"{c}_lc") if prepared else ascii_lower(F.col(c)) for name, c in INDEXED.items()}
    fields = F.array(*[F.concat(F.lit(f"{name}="), value) for name, value in values.items()])
    tokens = F.col("tokens") if prepared else tokenize(F.col("message"))
    words = F.transform(F.array_distinct(tokens), lambda t: F.concat(F.lit("text="), t))
    terms = F.concat(F.filter(fields, lambda t: t.isNotNull()), words)
    return events.select(F.explode(terms).alias("term"), F.col(seq).alias("event_seq"))


def lookup(postings: DataFrame, term: str) -> DataFrame:
    """Event numbers of one term."""
    return postings.where(F.col("term") == term).select("event_seq")


def lookup_prefix(postings: DataFrame, prefix: str) -> DataFrame:
    """Event numbers of all terms that start so."""
    return postings.where(F.col("term").startswith(prefix)).select("event_seq").distinct()


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.intersect(right)


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.union(right).distinct()


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.subtract(right)


@dataclass
class _Leaves:
    """Conditions on a posting's term, and the flags that tell of each event which hold."""

    flags: dict[str, Column] = field(default_factory=dict)

    def flag(self, condition: Column) -> Column:
        name = f"term_{len(self.flags)}"
        self.flags[name] = condition
        return F.coalesce(F.col(name), F.lit(False))


class Index:
    """Numbered events and their postings as tables, made once and asked often.

    Every file of postings stands for a stretch of events and is sorted by
    term, so a lookup skips by the statistics of terms, no term is one task's
    however many events bear it, and what a query adds up by event number was
    next to each other before.
    """

    def __init__(self, events: DataFrame, postings: DataFrame):
        self.events, self.postings = events, postings

    @classmethod
    def build(cls, events: DataFrame, path: str | None = None) -> Index:
        spark = events.sparkSession
        path = path or new_path(spark, "index")
        prepare(events, sequence=True).write.parquet(f"{path}/events")
        rows = spark.read.parquet(f"{path}/events")
        build_postings(rows).sortWithinPartitions("term", "event_seq").write.parquet(f"{path}/postings")
        return cls.load(spark, path)

    @classmethod
    def load(cls, spark, path: str) -> Index:
        return cls(spark.read.parquet(f"{path}/events"), spark.read.parquet(f"{path}/postings"))

    def search(self, query: str, limit: int | None = None) -> DataFrame:
        """Matching events by (timestamp, id), from one pass over the postings of the query's terms.

        An event's flags say which terms it bears; the query is an expression
        of them. Only events that bear one are looked up, unless the query is
        true of events that bear none.
        """
        leaves, make = _Leaves(), compiler(self.events)
        tree = parse_query(query)
        wanted = self._compile(tree, leaves, make)
        out = self.events
        if leaves.flags:
            wide = dict(zip(leaves.flags, spare(out.columns, *leaves.flags), strict=True))
            any_ = F.lit(False)
            for condition in leaves.flags.values():
                any_ |= condition
            flags = self.postings.where(any_).groupBy("event_seq").agg(*[F.max(c).alias(wide[n]) for n, c in leaves.flags.items()])
            out = out.join(flags, "event_seq", "left" if _true_of_none(tree) else "inner")
        out = out.where(wanted).select(*[c for c in self.events.columns if c not in HELPERS])
        out = out.orderBy("timestamp", "id")
        return out if limit is None else out.limit(limit)

    def _compile(self, tree: Expr, leaves: _Leaves, make) -> Column:
        match tree:
            case And(left, right):
                return self._compile(left, leaves, make) & self._compile(right, leaves, make)
            case Or(left, right):
                return self._compile(left, leaves, make) | self._compile(right, leaves, make)
            case Not(inner):
                return ~self._compile(inner, leaves, make)
            case Term(_, TimeRange() as r):
                return make.time_range(r)
            case Term(name, Exact(value)) if name in TEXT_FIELDS:
                if not any(map(is_space, value)):
                    return leaves.flag(F.col("term") == f"text={value}")
                words = tokens_of(value)
                found = F.lit(bool(words))
                for w in words:
                    found &= leaves.flag(F.col("term") == f"text={w}")
                return found & F.col("message_lc").contains(value)
            case Term(name, match):
                name = "text" if name in (None, "text") else name
                if name != "text" and name not in INDEXED:
                    return F.lit(False)
                start = f"{name}={match.value}"
                return leaves.flag(F.col("term") == start if isinstance(match, Exact) else F.col("term").startswith(start))
        raise TypeError(tree)


def _true_of_none(tree: Expr) -> bool:
    """Whether an event that bears none of the terms may match."""
    match tree:
        case And(left, right):
            return _true_of_none(left) and _true_of_none(right)
        case Or(left, right):
            return _true_of_none(left) or _true_of_none(right)
        case Not(_):
            return True
        case Term(_, match):
            return isinstance(match, TimeRange)
    raise TypeError(tree)
