"""Expression tree -> one Boolean column for a filter, in a form that reaches the scan."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, floor_ms, is_space, tokenize, tokens_of
from ..schema import ALIASES, INDEXED
from .querylang import And, Exact, Expr, Not, Or, Prefix, Term, TimeRange

TEXT_FIELDS = (None, "text", "message")


class Compiler:
    """Turns terms into predicates over the event columns.

    mode ``indexed``: the product's search. Exact and prefix terms see eight
    fields under their own names; a field it does not know matches nothing.
    mode ``scan``: direct access. Fields go by all their names, attributes too;
    a term on a field that an event lacks looks at the message's tokens.
    aliases=True lets indexed mode know the other names as well (an extension).
    prepared: the table carries lower-cased ``*_lc`` columns and ``tokens``,
    so that predicates reach the Parquet scan.
    ntz: timestamps have no time zone (they are UTC).
    """

    def __init__(self, mode: str = "indexed", aliases: bool = False, prepared: bool = False, ntz: bool = False, columns: dict[str, str] | None = None):
        if mode not in ("indexed", "scan"):
            raise ValueError(f"unknown mode {mode}")
        self.mode, self.aliases, self.prepared, self.ntz = mode, aliases, prepared, ntz
        self.ts = (columns or {}).get("timestamp", "timestamp")

    # columns

    def lowered(self, column: str) -> Column:
        if self.prepared:
            return F.col(f"{column}_lc")
        return ascii_lower(F.col(column))

    def tokens(self) -> Column:
        return F.col("tokens") if self.prepared else tokenize(F.col("message"))

    def instant(self, t: datetime) -> Column:
        text = t.strftime("%Y-%m-%d %H:%M:%S.%f")
        return F.lit(text).cast("timestamp_ntz") if self.ntz else F.to_timestamp(F.lit(f"{text}+00:00"))

    # terms

    def compile(self, tree: Expr, negated: bool = False) -> Column:
        """A filter's condition: null counts as false.

        Only below NOT is that said outright, as ``NOT user:x`` keeps events
        without a user; elsewhere a bare comparison can go to the scan.
        """
        match tree:
            case And(left, right):
                return self.compile(left, negated) & self.compile(right, negated)
            case Or(left, right):
                return self.compile(left, negated) | self.compile(right, negated)
            case Not(inner):
                return ~self.compile(inner, True)
            case Term(field, match):
                leaf = self.term(field, match)
                return F.coalesce(leaf, F.lit(False)) if negated else leaf
        raise TypeError(tree)

    def term(self, field: str | None, match: Exact | Prefix | TimeRange) -> Column:
        if isinstance(match, TimeRange):
            return self.time_range(match)
        if self.mode == "indexed":
            return self.indexed(field, match)
        return self.scanned(field, match)

    def time_range(self, r: TimeRange) -> Column:
        ts = F.col(self.ts)
        if self.mode == "scan":
            return (ts >= self.instant(r.start)) & (ts <= self.instant(r.end))
        # whole milliseconds on both sides, as a range that a scan can skip by
        return (ts >= self.instant(floor_ms(r.start))) & (ts < self.instant(floor_ms(r.end) + timedelta(milliseconds=1)))

    def indexed(self, field: str | None, match: Exact | Prefix) -> Column:
        if isinstance(match, Exact) and field in TEXT_FIELDS:
            if any(map(is_space, match.value)):
                return self.phrase(match.value)
            return self.token(match.value)
        if isinstance(match, Prefix) and field in (None, "text"):
            return F.size(self.tokens()) > 0 if not match.value else self.token_prefix(match.value)
        if self.aliases:
            field = ALIASES.get(field, field)
        if field not in INDEXED:
            return F.lit(False)
        column = self.lowered(INDEXED[field])
        if isinstance(match, Exact):
            return column == match.value
        if not match.value:
            return F.col(INDEXED[field]).isNotNull()
        return column.startswith(match.value)

    def phrase(self, value: str) -> Column:
        words = tokens_of(value)
        if not words:
            return F.lit(False)
        message = F.col("message_lc") if self.prepared else ascii_lower(F.col("message"))
        # the cheap test first, and the message is cut into tokens once
        return message.contains(value) & self.every_token(words)

    def every_token(self, words: list[str]) -> Column:
        return F.size(F.array_except(F.array(*map(F.lit, words)), self.tokens())) == 0

    def token(self, value: str) -> Column:
        return F.array_contains(self.tokens(), value)

    def token_prefix(self, value: str) -> Column:
        return F.exists(self.tokens(), lambda t: t.startswith(value))

    def scanned(self, field: str | None, match: Exact | Prefix) -> Column:
        value = match.value
        if isinstance(match, Exact):
            spaced = any(map(is_space, value))
            on_message = ascii_lower(F.col("message")).contains(value) if spaced else self.token(value)
        else:
            on_message = self.token_prefix(value)
        if field is None or (field == "message" and isinstance(match, Exact)):
            return on_message
        column = ascii_lower(field_column(field))
        test = column == value if isinstance(match, Exact) else column.startswith(value)
        return F.when(column.isNotNull(), test).otherwise(on_message)


def field_column(name: str) -> Column:
    """An event's value under any of a field's names; other names are attributes."""
    name = name.lower()
    name = ALIASES.get(name, name)
    if name == "message":
        return F.col("message")
    return F.col(INDEXED[name]) if name in INDEXED else F.col("attributes")[name]


def compile_query(tree: Expr, **options) -> Column:
    return Compiler(**options).compile(tree)
