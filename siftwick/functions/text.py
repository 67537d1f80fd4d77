"""Column functions over text and time, with the plain-Python form where parsers need it."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..schema import SEVERITY_SCORE

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TO_LOWER = str.maketrans(UPPER, LOWER)
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def ascii_lower(c: Column) -> Column:
    """Lower A-Z and nothing else.

    ``lower`` does the same on all-ASCII texts and is far faster than
    ``translate``, so only the others take the slow way.
    """
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def lower_text(s: str) -> str:
    return s.translate(_TO_LOWER)


#: What stands between tokens: anything but letters, their vowel signs, digits, ``_`` and ``-``.
BREAK = r"[^\p{IsAlphabetic}\p{N}_-]+"


def tokenize(c: Column) -> Column:
    """Runs of letters, marks, digits, ``_`` and ``-``, with A-Z lowered, in order."""
    return F.array_remove(F.split(ascii_lower(c), BREAK), "")


def tokens_of(s: str) -> list[str]:
    """``tokenize`` of a literal, by the same engine of regular expressions."""
    pattern = SparkSession.active().sparkContext._jvm.java.util.regex.Pattern.compile(BREAK)
    return [t for t in pattern.split(lower_text(s)) if t]


def is_space(ch: str) -> bool:
    """Unicode's White_Space, which the four information separators are not of."""
    return ch.isspace() and not "\x1c" <= ch <= "\x1f"


def severity_score(c: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in SEVERITY_SCORE.items() for x in kv])[c]


def parse_rfc3339(s: str) -> datetime | None:
    """A UTC instant, or None if the text is not one with an offset."""
    if not re.match(RFC3339, s):
        return None
    body = re.sub(r"(\.\d{6})\d+", r"\1", s.replace(" ", "T").replace("t", "T"))
    try:
        return datetime.fromisoformat(body.replace("z", "Z")).astimezone(timezone.utc)
    except (ValueError, OverflowError):
        return None


def to_instant(c: Column) -> Column:
    """A timestamp from RFC 3339 text with an offset; null from anything else."""
    return F.when(c.rlike(RFC3339), F.try_to_timestamp(c))


def rfc3339(c: Column, utc: str = "Z") -> Column:
    """UTC text with 0, 3 or 6 digits of a second, as few as say it."""
    micros = F.pmod(F.unix_micros(c.cast("timestamp")), F.lit(1_000_000))
    head = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    tail = F.when(micros == 0, "").when(micros % 1000 == 0, F.date_format(c, ".SSS")).otherwise(F.date_format(c, ".SSSSSS"))
    return F.concat(head, tail, F.lit(utc))


def floor_ms(t: datetime) -> datetime:
    return t - timedelta(microseconds=t.microsecond % 1000)


def epoch_seconds(c: Column) -> Column:
    return F.unix_seconds(c.cast("timestamp"))


def fingerprint(ts: Column, *parts: Column) -> Column:
    """An id from a hash over the fields, a NUL after each."""
    nul = F.chr(F.lit(0))
    cells = [x for p in (rfc3339(ts, "+00:00"), *parts) for x in (F.coalesce(p, F.lit("")), nul)]
    return F.concat(F.lit("tf-"), F.substring(F.sha2(F.concat(*cells), 256), 1, 20))
