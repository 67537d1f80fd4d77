"""Quality rules: a threshold table compiled into one Spark projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

# Frequent function words of the four languages.
STOP_WORDS = {
    "en": "the of and to in is that it for was on are as with his they be at this have from or by",
    "fr": "le la les de des du un une et en que qui dans pour par sur au aux avec ce est pas",
    "de": "der die das und in zu den von mit dem des auf für ist im nicht ein eine als auch sich",
    "es": "el la los las de del que y en un una por con para se no su al lo como más es",
}
ALL_STOP_WORDS = tuple(sorted({w for ws in STOP_WORDS.values() for w in ws.split()}))

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Rule:
    """A measured ratio must lie in [low, high]; None leaves a side open."""

    name: str
    low: float | None
    high: float | None


#: The production table. Ratios are by word but for line ones, which are by line.
RULES = (
    Rule("mean_word_chars", 2.0, 25.0),
    Rule("symbol_ratio", None, 0.3),
    Rule("stop_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("long_word_ratio", None, 0.3),
)


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts that rules are made of, one row per input row.

    Words are runs of anything but ASCII white space, over the whole text; a
    null text counts as empty. ``n_repeat_words`` marks the positions inside
    3-word windows that come twice or more: only in texts where fewer hashes
    of windows differ than there are windows, hashes are sorted with their
    positions and compared with their neighbours, which is n log n and stays
    in one row, so no text is ever split over a shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(text, f"[{SPACE}]+"), "")
    base = df.select(F.col(id_col).alias("doc_id"), text.alias("t"), words.alias("w"))
    # steps, so that neither the words nor the windows are computed again
    win = F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("w", i + 1), F.get("w", i + 2)))
    base = base.select("doc_id", "t", "w", win.alias("h"))
    again = F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    stop = F.filter("w", lambda w: F.lower(w).isin(*ALL_STOP_WORDS))
    counts = F.struct(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        lines.alias("l"),
        F.when(F.size(F.array_distinct("h")) < F.size("h"), again).alias("s"),
        F.size(stop).cast("long").alias("n_stop_words"),
        F.size(F.filter("w", lambda w: F.length(w) > 20)).cast("long").alias("n_long_words"),
    )
    # a generator, since a caller's filter would else be pushed below and carry the sort into its lambdas
    step = base.select(F.explode(F.array(counts)).alias("c")).select("c.*")
    same = F.filter("s", lambda x, i: (F.get("s", i - 1)["h"] == x["h"]) | (F.get("s", i + 1)["h"] == x["h"]))
    covered = F.flatten(F.transform(same, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    return step.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("s").isNull(), 0).otherwise(F.size(F.array_distinct(covered))).cast("long").alias("n_repeat_words"),
        F.size("l").cast("long").alias("n_lines"),
        "n_stop_words",
        "n_long_words",
    )


def ratios() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "mean_word_chars": F.col("word_chars") / words,
        "symbol_ratio": F.col("n_symbols") / words,
        "stop_ratio": F.col("n_stop_words") / words,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "long_word_ratio": F.col("n_long_words") / words,
    }


def compiled(rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(verdict, names of broken rules) of a threshold table, as two columns."""
    value = ratios()
    verdict, broken = F.lit(True), []
    for rule in rules:
        ok = F.lit(True)
        if rule.low is not None:
            ok &= value[rule.name] >= F.lit(rule.low)
        if rule.high is not None:
            ok &= value[rule.name] <= F.lit(rule.high)
        verdict &= ok
        broken.append(F.when(~ok, F.lit(rule.name)))
    return verdict, F.concat_ws(",", *broken)


def quality_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row with its counts, ``base_failed``, ``kept`` and the rules it broke.

    Null texts count as empty and fail the base rule; texts of any length are
    measured whole; repeated rows each get their own verdict; a ratio right at
    its threshold passes; an empty table gives an empty table; other columns
    are not read, so their names may be anything.
    """
    verdict, broken = compiled(rules)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (
        measured(df, id_col, text_col)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & verdict)
        .withColumn("broken_rules", broken)
    )


def quality_sql(table: str = "documents") -> str:
    """The same rows in DuckDB's SQL."""
    tests = []
    value = {
        "mean_word_chars": "word_chars / greatest(n_words, 1)",
        "symbol_ratio": "n_symbols / greatest(n_words, 1)",
        "stop_ratio": "n_stop_words / greatest(n_words, 1)",
        "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
        "long_word_ratio": "n_long_words / greatest(n_words, 1)",
    }
    names = []
    for r in RULES:
        ok = " AND ".join([f"{value[r.name]} >= {r.low}::DOUBLE"] * (r.low is not None) + [f"{value[r.name]} <= {r.high}::DOUBLE"] * (r.high is not None))
        tests.append(f"({ok})")
        names.append(f"CASE WHEN NOT ({ok}) THEN '{r.name}' END")
    stops = ", ".join(f"'{w}'" for w in ALL_STOP_WORDS)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM {table}),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^{SPACE}]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS l FROM t),
s AS (SELECT doc_id, t, w, l,
             list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: struct_pack(g := struct_pack(a := w[i], b := w[i + 1], c := w[i + 2]), i := i)) AS s FROM w),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
        SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (
          SELECT doc_id, x.i AS i, count(*) OVER (PARTITION BY doc_id, x.g) AS n
          FROM (SELECT doc_id, unnest(s) AS x FROM s)) WHERE n > 1) GROUP BY doc_id),
m AS (SELECT s.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[{SYMBOLS}]'))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
             len(l)::BIGINT AS n_lines,
             len(list_filter(w, lambda x: lower(x) IN ({stops})))::BIGINT AS n_stop_words,
             len(list_filter(w, lambda x: length(x) > 20))::BIGINT AS n_long_words
      FROM s LEFT JOIN r ON s.doc_id = r.doc_id),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {' AND '.join(tests)} AS kept, concat_ws(',', {', '.join(names)}) AS broken_rules FROM b
"""
