"""The search language: text -> tokens -> expression tree."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from ..functions.text import is_space, lower_text, parse_rfc3339

SINGLE = {":": "colon", "(": "open", ")": "close", "[": "left", "]": "right"}
KEYWORDS = {"AND": "and", "OR": "or", "NOT": "not", "TO": "to"}

# The parser's messages.
UNTERMINATED = "unterminated quoted value"
NO_CLOSE = "expected ')'"
NO_TERM = "expected a search term"
NO_VALUE = "expected a field value"
RANGE_FIELD = "ranges are supported only for timestamp"
BAD_RANGE = "invalid timestamp range"
OPEN_RANGE = "expected 'TO' and closing ']' in range"
BAD_START = "invalid RFC 3339 range start"
BAD_END = "invalid RFC 3339 range end"
REVERSED = "range start is after range end"
EMPTY = "query cannot be empty"
TRAILING = "unexpected token"


class QueryParseError(ValueError):
    """position counts bytes of the query's UTF-8 form."""

    def __init__(self, position: int, message: str):
        super().__init__(f"query error at character {position}: {message}")
        self.position, self.message = position, message


@dataclass(frozen=True)
class Exact:
    value: str


@dataclass(frozen=True)
class Prefix:
    value: str


@dataclass(frozen=True)
class TimeRange:
    start: datetime
    end: datetime


@dataclass(frozen=True)
class Term:
    field: str | None
    match: Exact | Prefix | TimeRange


@dataclass(frozen=True)
class And:
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Or:
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Not:
    inner: Expr


Expr = Term | And | Or | Not


@dataclass(frozen=True)
class Token:
    kind: str  # word, quoted, colon, open, close, left, right, and, or, not, to, end
    text: str
    at: int


def lex(query: str) -> list[Token]:
    starts, total = [], 0
    for ch in query:
        starts.append(total)
        total += len(ch.encode())
    out: list[Token] = []
    i = 0
    while i < len(query):
        ch = query[i]
        if is_space(ch):
            i += 1
        elif ch in SINGLE:
            out.append(Token(SINGLE[ch], ch, starts[i]))
            i += 1
        elif ch == '"':
            begin, value = i, []
            i += 1
            while i < len(query) and query[i] != '"':
                i += query[i] == "\\" and i + 1 < len(query)
                value.append(query[i])
                i += 1
            if i >= len(query):
                raise QueryParseError(starts[begin], UNTERMINATED)
            i += 1
            out.append(Token("quoted", "".join(value), starts[begin]))
        else:
            begin = i
            while i < len(query) and not is_space(query[i]) and query[i] not in SINGLE:
                i += 1
            word = query[begin:i]
            out.append(Token(KEYWORDS.get(word.upper(), "word"), word, starts[begin]))
    out.append(Token("end", "", total))
    return out


def classify(value: str) -> Exact | Prefix:
    """One trailing star makes a prefix, quoted or not."""
    low = lower_text(value)
    return Prefix(low[:-1]) if low.endswith("*") else Exact(low)


class _Parser:
    def __init__(self, tokens: list[Token]):
        self.tokens, self.at = tokens, 0

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def take(self, *kinds: str) -> Token | None:
        token = self.now
        if token.kind not in kinds:
            return None
        self.at += 1
        return token

    def fail(self, message: str) -> QueryParseError:
        return QueryParseError(self.now.at, message)

    def disjunction(self) -> Expr:
        left = self.conjunction()
        while self.take("or"):
            left = Or(left, self.conjunction())
        return left

    def conjunction(self) -> Expr:
        left = self.negation()
        while self.take("and") or self.now.kind in ("word", "quoted", "not", "open"):
            left = And(left, self.negation())
        return left

    def negation(self) -> Expr:
        if self.take("not"):
            return Not(self.negation())
        if self.take("open"):
            inner = self.disjunction()
            if not self.take("close"):
                raise self.fail(NO_CLOSE)
            return inner
        return self.term()

    def term(self) -> Expr:
        first = self.take("word", "quoted")
        if not first:
            raise self.fail(NO_TERM)
        if not self.take("colon"):
            return Term(None, classify(first.text))
        field = lower_text(first.text)
        if self.take("left"):
            return self.time_range(field)
        value = self.take("word", "quoted")
        if not value:
            raise self.fail(NO_VALUE)
        return Term(field, classify(value.text))

    def time_range(self, field: str) -> Expr:
        if field not in ("timestamp", "time"):
            raise self.fail(RANGE_FIELD)
        ends: list[list[str]] = [[], []]
        side = 0
        while True:
            token = self.now
            if token.kind in ("right", "end"):
                break
            self.at += 1
            if token.kind == "to" and side == 0:
                side = 1
            elif token.kind in ("word", "quoted", "colon"):
                ends[side].append(token.text)
            else:
                raise self.fail(BAD_RANGE)
        if self.now.kind != "right" or not side:
            raise self.fail(OPEN_RANGE)
        self.take("right")
        start = parse_rfc3339("".join(ends[0]))
        if start is None:
            raise self.fail(BAD_START)
        end = parse_rfc3339("".join(ends[1]))
        if end is None:
            raise self.fail(BAD_END)
        if start > end:
            raise self.fail(REVERSED)
        return Term("timestamp", TimeRange(start, end))


def parse_query(query: str) -> Expr:
    if all(map(is_space, query)):
        raise QueryParseError(0, EMPTY)
    parser = _Parser(lex(query))
    tree = parser.disjunction()
    if parser.now.kind != "end":
        raise parser.fail(TRAILING)
    return tree
