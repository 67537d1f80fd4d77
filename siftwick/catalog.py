"""Registered queries over the driver's tables, each with the SQL that says the same.

Every query runs over whole tables. Arrays are joined to strings and times
are left as they are, so that rows can be compared by value.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog_io
from .functions.text import fingerprint, tokenize
from .operators import detect, graph, postings, rank
from .operators.search import page, plan_trace, search, timeline
from .sources import adapters, synthetic
from .storage import numbered

#: The window of the detection queries: the table's events are spread over a month.
WIDE = detect.DetectorConfig(brute_force_failures=3, spray_accounts=4, window_seconds=86_400, lateral_hosts=3)
START, GOAL, APART = "user:u8", "user:u12", "user:u9"
EV = adapters.EVENTS_SQL
SHOWN = ("id", "timestamp", "user", "host", "source_ip", "outcome", "severity")
Query = Callable[[SparkSession, str], DataFrame]

#: Ends of a range that lie inside the milliseconds of events.
MS = ("2024-01-01T00:00:07.179600", "2024-01-01T00:03:52.824400")

# name: (query, mode, what DuckDB says for the predicate)
SEARCHES = {
    "search_exact_and": ("outcome:failure AND user:u8", "indexed", "outcome = 'failure' AND coalesce(\"user\" = 'u8', false)"),
    "search_or_prefix": ("host:ws-1* OR severity:critical", "indexed", "coalesce(host LIKE 'ws-1%', false) OR severity = 'critical'"),
    "search_not": ("NOT outcome:success AND type:view", "indexed", "NOT (outcome = 'success') AND event_type = 'view'"),
    "search_nested": ("outcome:failure AND (user:u8 OR severity:high) AND NOT NOT source:SRC-1", "indexed", "outcome = 'failure' AND (coalesce(\"user\" = 'u8', false) OR severity = 'high') AND source = 'src-1'"),
    "search_implicit_and": ('message:"invalid password" severity:high', "indexed", "message = 'Invalid password' AND severity = 'high'"),
    "search_time_range": ("timestamp:[2024-01-03T00:00:00Z TO 2024-01-09T12:00:00+02:00] AND outcome:failure", "indexed", "timestamp >= '2024-01-03' AND timestamp < '2024-01-09 10:00:00.001' AND outcome = 'failure'"),
    "search_field_exists": ("ip:* AND severity:critical", "indexed", "source_ip IS NOT NULL AND severity = 'critical'"),
    "search_unknown_field_empty": ("synthetic:true OR result:failure", "indexed", "false"),
    "search_alias_scan": ("event_type:error source_ip:10.1*", "scan", "event_type = 'error' AND source_ip LIKE '10.1%'"),
    "search_attribute_scan": ("k:69", "scan", "k = '69'"),
    "search_missing_field_scan": ("nowhere:invalid", "scan", "message = 'Invalid password'"),
    "search_message_prefix_scan": ("message:inv*", "scan", "message = 'Invalid password'"),
    "search_message_prefix": ("message:inv* OR severity:critical", "indexed", "severity = 'critical'"),
    "search_part_of_phrase": ('message:"nvalid passwor" OR user:u8', "indexed", "coalesce(\"user\" = 'u8', false)"),
    "search_part_of_phrase_scan": ('message:"nvalid passwor" OR user:u8', "scan", "message = 'Invalid password' OR coalesce(\"user\" = 'u8', false)"),
    "search_blank_phrase": ('" " OR user:u8', "indexed", "coalesce(\"user\" = 'u8', false)"),
    "search_blank_phrase_scan": ('" "', "scan", "contains(message, ' ')"),
    "search_milliseconds": (f"timestamp:[{MS[0]}Z TO {MS[1]}Z] OR user:u7", "indexed", f"coalesce(\"user\" = 'u7', false) OR date_trunc('millisecond', timestamp) BETWEEN date_trunc('millisecond', TIMESTAMP '{MS[0]}') AND date_trunc('millisecond', TIMESTAMP '{MS[1]}')"),
    "search_milliseconds_scan": (f"timestamp:[{MS[0]}Z TO {MS[1]}Z] OR user:u7", "scan", f"coalesce(\"user\" = 'u7', false) OR timestamp BETWEEN TIMESTAMP '{MS[0]}' AND TIMESTAMP '{MS[1]}'"),
}
DUCK_TOKENS = r"list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{L}\p{M}\p{N}_-]+'), lambda x: x <> '')"
DUCK_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TEXT_SEARCHES = {
    "search_token": ("idiot", f"list_contains({DUCK_TOKENS}, 'idiot')"),
    "search_token_prefix": ("text:idio* AND NOT type:de", f"len(list_filter({DUCK_TOKENS}, lambda x: starts_with(x, 'idio'))) > 0 AND lang <> 'de'"),
    "search_any_token": ("* AND type:de", f"len({DUCK_TOKENS}) > 0 AND lang = 'de'"),
    "search_phrase": ('message:"of the"', f"list_contains({DUCK_TOKENS}, 'of') AND list_contains({DUCK_TOKENS}, 'the') AND contains({DUCK_LOW}, 'of the')"),
}


def _search(spark: SparkSession, sf_dir: str, query: str, mode: str) -> DataFrame:
    return search(adapters.events(spark, sf_dir), query, mode=mode, ordered=False).select(*SHOWN)


def _text_search(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    return search(adapters.document_events(spark, sf_dir), query, ordered=False).select(F.col("id").cast("long").alias("doc_id"), F.col("event_type").alias("lang"))


def search_blank_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact values with blanks, on a field."""
    ev = adapters.events(spark, sf_dir).withColumn("host", F.replace("host", F.lit("-"), F.lit(" ")))
    return search(ev, 'host:"ws 1 3" OR host:"WS 2 1"', ordered=False).select(*SHOWN)


#: Messages beyond Latin, one for each remainder by three: vowel signs, and letters in circles.
BEYOND = ("हिन्दी भाषा में", "xⓐ b", "ⓐ b c")


def search_phrase_beyond_latin(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = adapters.events(spark, sf_dir)
    ev = ev.withColumn("message", F.element_at(F.array(*map(F.lit, BEYOND)), (F.col("id").cast("long") % 3 + 1).cast("int")))
    return search(ev, '"हिन्दी भाषा" OR "ⓐ b"', ordered=False).select(*SHOWN)


INDEX_SEARCHES = {
    "index_and_or": ("outcome:failure AND (user:u8 OR host:ws-1*)", "outcome = 'failure' AND (coalesce(\"user\" = 'u8', false) OR coalesce(host LIKE 'ws-1%', false))"),
    "index_not": ("NOT outcome:success AND NOT type:view", "NOT outcome = 'success' AND NOT event_type = 'view'"),
    "index_phrase_in_range": ('"invalid password" timestamp:[2024-01-03T00:00:00Z TO 2024-01-09T00:00:00Z]', "message = 'Invalid password' AND timestamp >= '2024-01-03' AND timestamp < '2024-01-09 00:00:00.001'"),
    "index_prefix_and_exists": ("text:inv* user:* NOT severity:high", "message = 'Invalid password' AND \"user\" IS NOT NULL AND severity <> 'high'"),
}


def _index_search(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    path = catalog_io.place(spark, "index")
    return postings.Index.build(adapters.events(spark, sf_dir), path).search(query).select(*SHOWN)


def search_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(adapters.events(spark, sf_dir), "outcome:failure", limit=100).select("id", "timestamp", "user")


def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(search(adapters.events(spark, sf_dir), "outcome:failure", ordered=False), 3).select("id", "timestamp", "user")


def plan_trace_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_trace(adapters.events(spark, sf_dir), "outcome:failure AND (user:u8 OR NOT severity:high)")
    rows = [(i, s.operator, s.input_candidates, s.output_candidates, s.operations) for i, s in enumerate(plan.steps)]
    return spark.createDataFrame(rows, "step int, operator string, input_candidates long, output_candidates long, operations long")


def plan_trace_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of steps that the other trace has not, with what they say."""
    plan = plan_trace(adapters.events(spark, sf_dir), 'timestamp:[2024-01-03T00:00:00Z TO 2024-01-09T00:00:00Z] AND (host:ws-1* OR message:"invalid password")')
    rows = [(i, s.operator, s.detail, s.input_candidates, s.output_candidates, s.operations, s.complexity) for i, s in enumerate(plan.steps)]
    return spark.createDataFrame(rows, "step int, operator string, detail string, input_candidates long, output_candidates long, operations long, complexity string")


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once, so that both sides of a set operation look terms up in one table."""
    path = catalog_io.place(spark, "postings")
    postings.build_postings(sequenced(spark, sf_dir)).sortWithinPartitions("term", "event_seq").write.parquet(path)
    return spark.read.parquet(path)


def sequenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(adapters.events(spark, sf_dir), ["timestamp", "id"], "event_seq")


def postings_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.lookup(_postings(spark, sf_dir), "user=u8")


def _posting_pair(spark: SparkSession, sf_dir: str, op: Callable) -> DataFrame:
    table = _postings(spark, sf_dir)
    return op(postings.lookup(table, "outcome=failure"), postings.lookup_prefix(table, "severity=h"))


def token_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return t.select(F.explode(tokenize(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def tokenize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return t.select("doc_id", F.size(tokenize(F.col("text"))).cast("long").alias("n_tokens"), F.md5(F.array_join(tokenize(F.col("text")), " ")).alias("tokens_md5"))


def _top(spark: SparkSession, sf_dir: str, field: str, limit: int) -> DataFrame:
    return rank.top_entities(adapters.events(spark, sf_dir), field, limit)


def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rank.duplicate_ids(line.select(F.col("l_orderkey").cast("string").alias("id")))


def fingerprint_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = adapters.events(spark, sf_dir)
    made = fingerprint(F.date_trunc("second", "timestamp"), *[F.col(c) for c in ("source", "event_type", "user", "host", "source_ip", "message")])
    return ev.select("id", made.alias("made_id"))


def _detections(spark: SparkSession, sf_dir: str, rule: Callable) -> DataFrame:
    out = rule(adapters.events(spark, sf_dir), WIDE)
    return out.select("id", "kind", "severity", "started_at", "ended_at", F.array_join("entities", ",").alias("entities"), F.array_join("event_ids", ",").alias("event_ids"))


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return graph.build(sequenced(spark, sf_dir))


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return graph.node_table(nodes, edges)


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[1]


def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    s = rank.stats(adapters.events(spark, sf_dir), nodes, edges)
    return spark.createDataFrame([(s["events"], s["nodes"], s["edges"])], "events long, nodes long, edges long")


def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return graph.node_table(nodes, edges).groupBy("component").agg(F.count("*").alias("n"))


def _distances(spark: SparkSession, sf_dir: str, weighted: bool) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    start = nodes.where(F.col("label") == START).first()["ord"]  # labels are unique
    return graph.distances(edges, start, weighted).join(nodes, "ord").select("label", "cost")


PATH = "found boolean, mode string, nodes string, cost long, visited long, explanation string"


def _path(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    """Of paths with equal risk cost any may be given, so that mode shows the cost alone."""
    got = graph.path(*_graph(spark, sf_dir), START, GOAL, mode)
    hops = mode == "hops"
    return spark.createDataFrame([(got.found, got.mode, ",".join(got.nodes) if hops else "", got.cost, got.visited if hops else 0, got.explanation)], PATH)


def graph_path_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three ways not to find a path."""
    nodes, edges = _graph(spark, sf_dir)
    rows = []
    for ends in (("user:nobody", START), (START, "host:none"), (START, APART)):
        got = graph.path(nodes, edges, *ends)
        rows.append((got.found, got.mode, ",".join(got.nodes), got.cost, got.visited, got.explanation))
    return spark.createDataFrame(rows, PATH)


def graph_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = _graph(spark, sf_dir)
    return graph.layout(nodes, nodes.count()).select("label", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def outcome_severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.events(spark, sf_dir).groupBy("outcome", "severity").agg(F.count("*").alias("n"))


def severity_score_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions.text import severity_score

    return adapters.events(spark, sf_dir).groupBy(severity_score(F.col("severity")).alias("score")).agg(F.count("*").alias("n"))


def timeline_mod32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline(search(adapters.events(spark, sf_dir), "outcome:failure", ordered=False))


def synthetic_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many made-up events the published query finds."""
    rows = []
    for n in (1_000, 10_000, 100_000):
        rows.append((n, search(synthetic.generate_events(spark, n), "outcome:failure AND user:ana", ordered=False).count()))
    return spark.createDataFrame(rows, "events long, matches long")


def synthetic_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect.detect_all(synthetic.generate_events(spark, 4_000))
    return out.select("id", "kind", F.unix_seconds("started_at").alias("started"), F.unix_seconds("ended_at").alias("ended"), F.size("event_ids").cast("long").alias("n_events"))


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {name: partial(_search, query=q, mode=mode) for name, (q, mode, _) in SEARCHES.items()}
    out |= {name: partial(_text_search, query=q) for name, (q, _) in TEXT_SEARCHES.items()}
    out |= {name: partial(_index_search, query=q) for name, (q, _) in INDEX_SEARCHES.items()}
    out |= {f"postings_{op.__name__}": partial(_posting_pair, op=op) for op in (postings.intersect, postings.union, postings.difference)}
    out |= {name: partial(_top, field=f, limit=n) for name, (f, n) in TOPS.items()}
    out |= {name: partial(_detections, rule=rule) for name, rule in RULES.items()}
    out |= {"graph_hops_from": partial(_distances, weighted=False), "graph_risk_cost_from": partial(_distances, weighted=True)}
    out |= {"graph_path_hops": partial(_path, mode="hops"), "graph_path_risk": partial(_path, mode="risk")}
    for f in (search_limit, search_page, plan_trace_counts, postings_lookup, token_frequency, tokenize_documents, duplicate_ids, fingerprint_ids, graph_nodes, graph_edges, graph_stats, graph_components, graph_layout, outcome_severity_counts, severity_score_dist, timeline_mod32, synthetic_matches, synthetic_detections, search_blank_field, search_phrase_beyond_latin, plan_trace_kinds, graph_path_none, *catalog_io.QUERIES):
        out[f.__name__] = f
    return out


TOPS = {"top_users": ("user", 10), "top_hosts": ("host", 7), "top_sources_ties": ("source", 3), "top_attribute": ("k", 5), "top_alias": ("result", 2)}
TOP_COLUMN = {"user": '"user"', "result": "outcome"}
RULES = {
    "detect_brute_force": detect.brute_force,
    "detect_password_spray": detect.password_spray,
    "detect_failure_success": detect.failure_then_success,
    "detect_lateral": detect.lateral_movement,
    "detect_all": detect.detect_all,
}
W = WIDE.window_seconds

BRUTE_SQL = f"""
b AS (SELECT *, lag(timestamp, {WIDE.brute_force_failures - 1}) OVER w AS began,
             string_agg(id, ',') OVER (PARTITION BY "user" ORDER BY timestamp, id ROWS BETWEEN {WIDE.brute_force_failures - 1} PRECEDING AND CURRENT ROW) AS ids
      FROM ev WHERE outcome = 'failure' AND "user" IS NOT NULL WINDOW w AS (PARTITION BY "user" ORDER BY timestamp, id)),
b1 AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY timestamp, id) AS rn FROM b WHERE began >= timestamp - INTERVAL {W} SECOND),
brute AS (SELECT 'brute-force-' || "user" || '-' || floor(epoch(timestamp))::BIGINT AS id, 'brute-force' AS kind, 'high' AS severity, began AS started_at,
                 timestamp AS ended_at, 'user:' || "user" AS entities, ids AS event_ids FROM b1 WHERE rn = 1)"""


def _distinct_sql(name: str, rows: str, key: str, value: str, seconds: int, least: int, head: str, kind: str, first: str, each: str) -> str:
    return f"""
{name}0 AS (SELECT * FROM ev WHERE {rows}),
{name}1 AS (SELECT a.{key}, a.timestamp, a.id, min(c.timestamp) AS began, string_agg(c.id, ',' ORDER BY c.timestamp, c.id) AS ids,
                   string_agg(DISTINCT '{each}:' || c.{value}, ',' ORDER BY '{each}:' || c.{value}) AS kinds, count(DISTINCT c.{value}) AS n
            FROM {name}0 a JOIN {name}0 c ON a.{key} = c.{key} AND c.timestamp >= a.timestamp - INTERVAL {seconds} SECOND
              AND (c.timestamp < a.timestamp OR (c.timestamp = a.timestamp AND c.id <= a.id))
            GROUP BY ALL),
{name}2 AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY timestamp, id) AS rn FROM {name}1 WHERE n >= {least}),
{name} AS (SELECT '{head}-' || replace({key}, '.', '-') || '-' || floor(epoch(timestamp))::BIGINT AS id, '{kind}' AS kind, 'high' AS severity, began AS started_at,
                  timestamp AS ended_at, '{first}:' || {key} || ',' || kinds AS entities, ids AS event_ids FROM {name}2 WHERE rn = 1)"""


SPRAY_SQL = _distinct_sql("spray", "outcome = 'failure' AND source_ip IS NOT NULL", "source_ip", '"user"', W, WIDE.spray_accounts, "password-spray", "password-spray", "ip", "user")
LATERAL_SQL = _distinct_sql("moved", "outcome = 'success' AND score >= 8 AND \"user\" IS NOT NULL AND host IS NOT NULL", '"user"', "host", 3 * W, WIDE.lateral_hosts, "lateral", "lateral-movement", "user", "host")
FAIL_SUCCESS_SQL = f"""
f0 AS (SELECT "user", source_ip, timestamp, id, outcome, row_number() OVER (PARTITION BY "user", source_ip ORDER BY timestamp, id) AS rn
       FROM ev WHERE "user" IS NOT NULL AND source_ip IS NOT NULL),
f1 AS (SELECT "user", source_ip, 0::BIGINT AS rn, []::STRUCT(t TIMESTAMP, i VARCHAR)[] AS q, NULL::STRUCT(s TIMESTAMP, e TIMESTAMP, ids VARCHAR) AS hit
       FROM (SELECT DISTINCT "user", source_ip FROM f0)
       UNION ALL
       SELECT "user", source_ip, rn,
         CASE WHEN outcome = 'failure' THEN list_append(live, struct_pack(t := timestamp, i := id))
              WHEN outcome = 'success' AND len(live) >= {WIDE.brute_force_failures} THEN [] ELSE live END,
         CASE WHEN outcome = 'success' AND len(live) >= {WIDE.brute_force_failures}
              THEN struct_pack(s := live[1].t, e := timestamp, ids := array_to_string(list_transform(live, lambda x: x.i), ',') || ',' || id) END
       FROM (SELECT f0."user", f0.source_ip, f0.rn, f0.timestamp, f0.id, f0.outcome, list_filter(f1.q, lambda x: x.t >= f0.timestamp - INTERVAL {2 * W} SECOND) AS live
             FROM f1 JOIN f0 ON f0."user" = f1."user" AND f0.source_ip = f1.source_ip AND f0.rn = f1.rn + 1)),
failsucc AS (SELECT 'failure-success-' || "user" || '-' || floor(epoch(hit.e))::BIGINT AS id, 'failure-then-success' AS kind, 'critical' AS severity, hit.s AS started_at,
                    hit.e AS ended_at, 'user:' || "user" || ',ip:' || source_ip AS entities, hit.ids AS event_ids FROM f1 WHERE hit IS NOT NULL)"""
GRAPH_SQL = f"""{EV},
seq AS (SELECT *, row_number() OVER (ORDER BY timestamp, id) - 1 AS event_seq FROM ev),
lab AS (SELECT event_seq, score, list_filter(['user:' || "user", 'host:' || host, 'ip:' || source_ip], lambda x: x IS NOT NULL) AS l FROM seq),
pr AS (SELECT event_seq, score, unnest([struct_pack(s := 0, a := l[1], b := l[2]), struct_pack(s := 1, a := l[1], b := l[3]), struct_pack(s := 2, a := l[2], b := l[3])]) AS p FROM lab WHERE len(l) > 1),
pq AS (SELECT event_seq, score, p.a AS a, p.b AS b FROM pr WHERE p.b IS NOT NULL),
pl AS (SELECT event_seq, unnest(l) AS label, generate_subscripts(l, 1) AS place FROM lab WHERE len(l) > 1),
nodes AS (SELECT label, row_number() OVER (ORDER BY min(event_seq * 4 + place)) - 1 AS ord FROM pl GROUP BY label),
edges AS (SELECT least(x.ord, y.ord) AS source, greatest(x.ord, y.ord) AS target, count(*) AS observations, max(score)::INTEGER AS risk
          FROM pq JOIN nodes x ON x.label = pq.a JOIN nodes y ON y.label = pq.b GROUP BY 1, 2),
both_ways AS (SELECT source AS a, target AS b, greatest(1, 11 - risk) AS cost FROM edges UNION ALL SELECT target, source, greatest(1, 11 - risk) FROM edges)"""
COMP_SQL = f"""WITH RECURSIVE {GRAPH_SQL},
reach AS (SELECT ord, ord AS r FROM nodes UNION SELECT b.b, reach.r FROM reach JOIN both_ways b ON b.a = reach.ord),
comp AS (SELECT ord, min(r) AS component FROM reach GROUP BY ord)"""
HOPS_SQL = f"""WITH RECURSIVE {GRAPH_SQL},
walk AS (SELECT ord, 0 AS d FROM nodes WHERE label = '{START}' UNION SELECT b.b, d + 1 FROM walk JOIN both_ways b ON b.a = walk.ord WHERE d < 8),
dist AS (SELECT ord, min(d)::BIGINT AS cost FROM walk GROUP BY ord)"""
RISK_SQL = f"""WITH RECURSIVE {GRAPH_SQL},
cheap AS (SELECT a, b, cost FROM both_ways),
walk AS (SELECT ord, 0 AS d, 0 AS k FROM nodes WHERE label = '{START}'
         UNION ALL SELECT b, min(d), any_value(k) FROM (SELECT c.b, walk.d + c.cost AS d, k + 1 AS k FROM walk JOIN cheap c ON c.a = walk.ord WHERE k < 14) GROUP BY b),
dist AS (SELECT ord, min(d)::BIGINT AS cost FROM walk GROUP BY ord)"""


#: Shortest routes by number, as lists; then who is settled before the goal is.
PATH_SQL = f"""WITH RECURSIVE {GRAPH_SQL},
walk AS (SELECT ord, 0::BIGINT AS d, [ord] AS route FROM nodes WHERE label = '{START}'
         UNION ALL SELECT b, d + 1, min(route) FROM (SELECT b.b, walk.d, list_append(walk.route, b.b) AS route FROM walk JOIN both_ways b ON b.a = walk.ord WHERE d < 8) GROUP BY b, d),
best AS (SELECT ord, min(struct_pack(d := d, route := route)) AS s FROM walk GROUP BY ord),
goal AS (SELECT s FROM best JOIN nodes USING (ord) WHERE label = '{GOAL}'),
steps AS (SELECT unnest(s.route) AS ord, generate_subscripts(s.route, 1) AS i FROM goal)
SELECT true AS found, 'hops' AS mode, (SELECT string_agg(label, ',' ORDER BY i) FROM steps JOIN nodes USING (ord)) AS nodes, goal.s.d AS cost,
       (SELECT count(*) FROM best WHERE best.s <= goal.s) AS visited, '{graph.FOUND['hops']}' AS explanation FROM goal"""

#: Seconds since the first made-up event, which is at this one.
MADE_AT = 1_785_398_400
MADE = (("brute-force-ana", "brute-force", 30, 102, 5), ("password-spray-203-0-113-77", "password-spray", 1397, 1575, 5), ("failure-success-ana", "failure-then-success", 30, 180, 8), ("lateral-svc-backup", "lateral-movement", 3000, 3180, 3))


def oracle_sql() -> dict[str, str]:
    shown = ", ".join(f'"{c}"' for c in SHOWN)
    out = {name: f"WITH {EV} SELECT {shown} FROM ev WHERE {where}" for name, (_, _, where) in SEARCHES.items()}
    out |= {name: f"SELECT doc_id, lang FROM documents WHERE {where}" for name, (_, where) in TEXT_SEARCHES.items()}
    failed = f"WITH {EV} SELECT id, timestamp, \"user\" FROM ev WHERE outcome = 'failure' ORDER BY timestamp, id"
    out["search_blank_field"] = f"WITH {EV.replace('ev AS', 'ev0 AS', 1)}, ev AS (SELECT * REPLACE (replace(host, '-', ' ') AS host) FROM ev0) SELECT {shown} FROM ev WHERE host IN ('ws 1 3', 'ws 2 1')"
    out["search_phrase_beyond_latin"] = f"WITH {EV} SELECT {shown} FROM ev WHERE id::BIGINT % 3 <> 1"
    out |= {name: f"WITH {EV} SELECT {shown} FROM ev WHERE {where}" for name, (_, where) in INDEX_SEARCHES.items()}
    out["search_limit"] = f"{failed} LIMIT 100"
    out["search_page"] = f"{failed} LIMIT 12 OFFSET 24"
    out["plan_trace_counts"] = f"""WITH {EV},
c AS (SELECT count(*) AS n, count(*) FILTER (outcome = 'failure') AS f, count(*) FILTER ("user" = 'u8') AS u, count(*) FILTER (severity = 'high') AS h,
      count(*) FILTER (coalesce("user" = 'u8', false) OR NOT severity = 'high') AS o,
      count(*) FILTER (outcome = 'failure' AND (coalesce("user" = 'u8', false) OR NOT severity = 'high')) AS a FROM ev)
SELECT 0 AS step, 'POSTING_LOOKUP' AS operator, n AS input_candidates, f AS output_candidates, 1::BIGINT AS operations FROM c
UNION ALL SELECT 1, 'POSTING_LOOKUP', n, u, 1 FROM c UNION ALL SELECT 2, 'POSTING_LOOKUP', n, h, 1 FROM c
UNION ALL SELECT 3, 'DIFFERENCE', n + h, n - h, n + h FROM c UNION ALL SELECT 4, 'UNION', u + n - h, o, u + n - h FROM c
UNION ALL SELECT 5, 'INTERSECT', f + o, a, f + o FROM c"""
    out["plan_trace_kinds"] = f"""WITH {EV}, f AS (SELECT *, timestamp >= '2024-01-03' AND timestamp < '2024-01-09 00:00:00.001' AS r, coalesce(host LIKE 'ws-1%', false) AS h, message = 'Invalid password' AS p FROM ev),
c AS (SELECT count(*) AS n, count(*) FILTER (timestamp < '2024-01-03') AS b, count(*) FILTER (r) AS r, count(*) FILTER (h) AS h, count(*) FILTER (p) AS p,
      count(*) FILTER (h OR p) AS o, count(*) FILTER (r AND (h OR p)) AS a FROM f)
SELECT 0 AS step, 'TIME_RANGE' AS operator, 'binary search temporal index [' || b || ', ' || (b + r) || ')' AS detail, n AS input_candidates, r AS output_candidates, (2 * length(bin(n)) + r)::BIGINT AS operations, 'O(log n + k)' AS complexity FROM c
UNION ALL SELECT 1, 'TRIE_PREFIX', 'host=ws-1', n, h, 4 + h, 'O(p + k)' FROM c
UNION ALL SELECT 2, 'PHRASE_VERIFY', 'intersect 2 token lists, then verify phrase', p, p, p + 2, 'O(sum postings + candidates)' FROM c
UNION ALL SELECT 3, 'UNION', 'deduplicating merge of ordered posting lists', h + p, o, h + p, 'O(n + m)' FROM c
UNION ALL SELECT 4, 'INTERSECT', 'linear merge of two ordered posting lists', r + o, a, r + o, 'O(n + m)' FROM c"""
    seq = f"WITH {EV}, s AS (SELECT *, row_number() OVER (ORDER BY timestamp, id) - 1 AS event_seq FROM ev)"
    out["postings_lookup"] = f"{seq} SELECT event_seq FROM s WHERE \"user\" = 'u8'"
    for name, op in (("intersect", "INTERSECT"), ("union", "UNION"), ("difference", "EXCEPT")):
        out[f"postings_{name}"] = f"{seq} SELECT event_seq FROM s WHERE outcome = 'failure' {op} SELECT event_seq FROM s WHERE severity LIKE 'h%'"
    out["token_frequency"] = f"SELECT token, count(*) AS n FROM (SELECT unnest({DUCK_TOKENS}) AS token FROM documents) GROUP BY token"
    out["tokenize_documents"] = f"SELECT doc_id, len({DUCK_TOKENS})::BIGINT AS n_tokens, md5(array_to_string({DUCK_TOKENS}, ' ')) AS tokens_md5 FROM documents"
    for name, (f, n) in TOPS.items():
        c = TOP_COLUMN.get(f, f)
        out[name] = f"WITH {EV} SELECT value, n FROM (SELECT {c} AS value, count(*) AS n FROM ev WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, value DESC LIMIT {n})"
    out["duplicate_ids"] = "SELECT l_orderkey::VARCHAR AS id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1"
    cells = " || chr(0) || ".join(["strftime(date_trunc('second', timestamp), '%Y-%m-%dT%H:%M:%S+00:00')", *[f"coalesce({c}, '')" for c in ("source", "event_type", '"user"', "host", "source_ip", "message")]])
    out["fingerprint_ids"] = f"WITH {EV} SELECT id, 'tf-' || substring(sha256({cells} || chr(0)), 1, 20) AS made_id FROM ev"
    one = "SELECT * FROM {}"
    out["detect_brute_force"] = f"WITH {EV}, {BRUTE_SQL} {one.format('brute')}"
    out["detect_password_spray"] = f"WITH {EV}, {SPRAY_SQL} {one.format('spray')}"
    out["detect_failure_success"] = f"WITH RECURSIVE {EV}, {FAIL_SUCCESS_SQL} {one.format('failsucc')}"
    out["detect_lateral"] = f"WITH {EV}, {LATERAL_SQL} {one.format('moved')}"
    every = " UNION ALL ".join(one.format(t) for t in ("brute", "spray", "failsucc", "moved"))
    out["detect_all"] = f"WITH RECURSIVE {EV}, {BRUTE_SQL}, {SPRAY_SQL}, {FAIL_SUCCESS_SQL}, {LATERAL_SQL} {every}"
    out["graph_nodes"] = f"{COMP_SQL} SELECT n.ord AS id, split_part(label, ':', 1) AS kind, substring(label, strpos(label, ':') + 1) AS label, component FROM nodes n JOIN comp USING (ord)"
    out["graph_edges"] = f"WITH {GRAPH_SQL} SELECT * FROM edges"
    out["graph_stats"] = f"WITH {GRAPH_SQL} SELECT (SELECT count(*) FROM ev) AS events, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges"
    out["graph_components"] = f"{COMP_SQL} SELECT component, count(*) AS n FROM comp GROUP BY 1"
    out["graph_hops_from"] = f"{HOPS_SQL} SELECT label, cost FROM dist JOIN nodes USING (ord)"
    out["graph_risk_cost_from"] = f"{RISK_SQL} SELECT label, cost FROM dist JOIN nodes USING (ord)"
    out["graph_path_hops"] = PATH_SQL
    out["graph_path_risk"] = f"{RISK_SQL} SELECT true AS found, 'risk' AS mode, '' AS nodes, cost, 0::BIGINT AS visited, '{graph.FOUND['risk']}' AS explanation FROM dist JOIN nodes USING (ord) WHERE label = '{GOAL}'"
    none = "SELECT false AS found, 'hops' AS mode, '' AS nodes, 0::BIGINT AS cost, 0::BIGINT AS visited, '{}' AS explanation"
    apart = f"CASE WHEN EXISTS (SELECT 1 FROM nodes WHERE label = '{APART}') THEN '{graph.NO_PATH}' ELSE '{graph.NO_TARGET}' END"
    out["graph_path_none"] = f"WITH {GRAPH_SQL} {none.format(graph.NO_SOURCE)} UNION ALL {none.format(graph.NO_TARGET)} UNION ALL {none.format('').replace(chr(39) * 2 + ' AS explanation', apart + ' AS explanation')}"
    out["synthetic_matches"] = "SELECT * FROM (VALUES (1000::BIGINT, 26::BIGINT), (10000, 221), (100000, 2149)) v(events, matches)"
    made = ", ".join(f"('{i}-{MADE_AT + b}', '{kind}', {MADE_AT + a}::BIGINT, {MADE_AT + b}::BIGINT, {n}::BIGINT)" for i, kind, a, b, n in MADE)
    out["synthetic_detections"] = f"SELECT * FROM (VALUES {made}) v(id, kind, started, ended, n_events)"
    out |= catalog_io.oracle_sql()
    out["graph_layout"] = f"""WITH {GRAPH_SQL}, n AS (SELECT label, ord, 2 * pi() * ord / (SELECT count(*) FROM nodes) - pi() / 2 AS a, 36 + 6 * (ord % 3) AS r FROM nodes)
SELECT label, round(50 + cos(a) * r, 6) AS x, round(50 + sin(a) * r, 6) AS y FROM n"""
    out["outcome_severity_counts"] = f"WITH {EV} SELECT outcome, severity, count(*) AS n FROM ev GROUP BY ALL"
    out["severity_score_dist"] = f"WITH {EV} SELECT score, count(*) AS n FROM ev GROUP BY ALL"
    out["timeline_mod32"] = f"""WITH {EV}, m AS (SELECT (row_number() OVER (ORDER BY timestamp, id) - 1) % 32 AS bucket FROM ev WHERE outcome = 'failure'),
c AS (SELECT bucket::INTEGER AS bucket, count(*) AS n FROM m GROUP BY 1)
SELECT bucket, n, greatest(5, round(100 * n / (SELECT max(n) FROM c)))::INTEGER AS height FROM c"""
    return out
