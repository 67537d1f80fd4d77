from __future__ import annotations

import pytest

from siftwick.functions.text import tokens_of
from siftwick.plans.querylang import And, Exact, Not, Or, Prefix, QueryParseError, Term, TimeRange, parse_query


def term(field, value):
    return Term(field, Exact(value))


def test_precedence_and_implicit_and():
    tree = parse_query("user:ana OR host:dc01 AND NOT outcome:success")
    assert tree == Or(term("user", "ana"), And(term("host", "dc01"), Not(term("outcome", "success"))))
    assert parse_query('message:"invalid password" severity:high') == And(term("message", "invalid password"), term("severity", "high"))
    assert parse_query("NOT NOT x") == Not(Not(term(None, "x")))


def test_values():
    assert parse_query('"ws-*"') == Term(None, Prefix("ws-"))
    assert parse_query("*") == Term(None, Prefix(""))
    assert parse_query('host:"TO"') == term("host", "to")
    assert parse_query(r'x:"a\"b"') == term("x", 'a"b')
    assert parse_query('FIELD:a"b') == term("field", 'a"b')
    assert tokens_of("Invalid pass_word, É-2!") == ["invalid", "pass_word", "É-2"]


def test_range_is_utc():
    tree = parse_query("time:[2026-01-01T00:00:00+02:00 TO 2026-01-01T01:00:00Z]")
    assert isinstance(tree.match, TimeRange)
    assert tree.field == "timestamp"
    assert tree.match.start.isoformat() == "2025-12-31T22:00:00+00:00"


@pytest.mark.parametrize(
    ("query", "message", "at"),
    [
        ("  ", "query cannot be empty", 0),
        ('user:"ana', "unterminated quoted value", 5),
        ("(user:ana OR host:dc01", "expected ')'", 22),
        ("AND", "expected a search term", 0),
        ("é AND )", "expected a search term", 7),
        ("user:)", "expected a field value", 5),
        ("host:to", "expected a field value", 5),
        ("user:[a TO b]", "ranges are supported only for timestamp", 6),
        ("time:[a ( b]", "invalid timestamp range", 10),
        ("time:[a b]", "expected 'TO' and closing ']' in range", 9),
        ("time:[x TO 2026-01-01T01:00:00Z]", "invalid RFC 3339 range start", 32),
        ("time:[2026-01-01T01:00:00Z TO x]", "invalid RFC 3339 range end", 32),
        ("time:[2026-01-02T00:00:00Z TO 2026-01-01T00:00:00Z]", "range start is after range end", 51),
        ("a )", "unexpected token", 2),
    ],
)
def test_errors(query, message, at):
    with pytest.raises(QueryParseError) as e:
        parse_query(query)
    assert e.value.message == message
    assert e.value.position == at
