"""The entity graph: who occurs with whom, components, and paths."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import severity_score
from ..storage import counted, numbered, remove, written
from .components import components

KINDS = (("user", "user"), ("host", "host"), ("ip", "source_ip"))
#: Edges up to which paths are found on the driver; above, by Spark joins.
DRIVER_EDGES = 20_000


# What a path's explanation says.
NO_SOURCE = "source entity does not exist"
NO_TARGET = "target entity does not exist"
NO_PATH = "entities are in disconnected components"
FOUND = {
    "hops": "BFS minimizes the number of entity-to-entity hops; O(V + E).",
    "risk": "Dijkstra uses an indexed min-heap and inverse severity cost (11 - risk); O((V + E) log V).",
}


@dataclass
class PathResult:
    found: bool
    mode: str
    nodes: list[str] = field(default_factory=list)
    cost: int = 0
    visited: int = 0
    explanation: str = ""


def pairs(events: DataFrame) -> DataFrame:
    """(event_seq, slot, a, b, score): every pair of an event's entities, in the order user, host, ip."""
    labels = F.array(*[F.concat(F.lit(f"{kind}:"), F.col(column)) for kind, column in KINDS])
    named = events.select("event_seq", severity_score(F.col("severity")).alias("score"), F.filter(labels, lambda x: x.isNotNull()).alias("l"))
    two = [(0, 1), (0, 2), (1, 2)]
    rows = F.array(*[F.struct(F.lit(s).alias("slot"), F.get("l", F.lit(i)).alias("a"), F.get("l", F.lit(j)).alias("b")) for s, (i, j) in enumerate(two)])
    return named.where(F.size("l") > 1).select("event_seq", "score", F.inline(F.filter(rows, lambda r: r["b"].isNotNull())))


def build(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of events that have ``event_seq``.

    nodes(ord, label): numbered by first appearance. edges(source, target,
    observations, risk): each undirected edge once, from the entity seen first;
    risk is the largest severity score. Pairs are summed by label before
    anything else, so an edge that a third of all events bear is one row a task.
    """
    rows = pairs(events)
    edge = rows.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(
        F.count("*").alias("observations"),
        F.max("score").alias("risk"),
    )
    edge = written(edge, "edges")
    seen = rows.select(F.explode(F.array(F.struct(F.col("a").alias("label"), F.when(F.col("slot") == 2, 1).otherwise(0).alias("place")), F.struct(F.col("b").alias("label"), F.when(F.col("slot") == 0, 1).otherwise(2).alias("place")))).alias("n"), "event_seq")
    first = seen.groupBy("n.label").agg(F.min(F.struct("event_seq", "n.place")).alias("first"))
    nodes = numbered(first.select("label", F.col("first.event_seq").alias("__e"), F.col("first.place").alias("__q")), ["__e", "__q"], "ord").select("ord", "label")
    x = nodes.select(F.col("label").alias("x"), F.col("ord").alias("i"))
    y = nodes.select(F.col("label").alias("y"), F.col("ord").alias("j"))
    edges = edge.join(x, "x").join(y, "y")
    edges = edges.select(F.least("i", "j").alias("source"), F.greatest("i", "j").alias("target"), "observations", F.col("risk").cast("int").alias("risk"))
    return nodes, written(edges, "graph")


def node_table(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, kind, label, component); the component is its smallest id."""
    comp = components(edges, "source", "target")
    at = F.instr("label", ":")
    kind = F.when(at > 0, F.substring_index("label", ":", 1)).otherwise("entity")
    value = F.when(at > 0, F.substr("label", at + 1)).otherwise(F.col("label"))
    out = nodes.join(comp.withColumnRenamed("id", "ord"), "ord")
    return out.select(F.col("ord").alias("id"), kind.alias("kind"), value.alias("label"), F.col("comp").alias("component"))


def layout(nodes: DataFrame, n: int) -> DataFrame:
    """(ord, label, x, y): the n nodes on three circles around (50, 50), by number."""
    angle = 2 * math.pi * F.col("ord") / max(1, n) - math.pi / 2
    radius = 36 + 6 * (F.col("ord") % 3)
    return nodes.select("ord", "label", (50 + F.cos(angle) * radius).alias("x"), (50 + F.sin(angle) * radius).alias("y"))


def route_edges(route: list[str]) -> set[tuple[str, str]]:
    """The edges of a path, whichever way round, for marking them."""
    return {(min(a, b), max(a, b)) for a, b in zip(route, route[1:], strict=False)}


def edge_cost(risk: Column) -> Column:
    return F.greatest(F.lit(1), F.lit(11) - risk)


def both_ways(edges: DataFrame) -> DataFrame:
    e = edges.select(F.col("source").alias("a"), F.col("target").alias("b"), edge_cost(F.col("risk")).cast("long").alias("cost"))
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "cost"))


def distances(edges: DataFrame, start: int, weighted: bool, max_rounds: int = 10_000) -> DataFrame:
    """(ord, cost) of every node that ``start`` reaches: hops, or least sum of edge costs.

    Each round joins the nodes whose cost has fallen, the front, with their
    edges and writes only those that fall again; it ends when none does. Of
    hops, a front's neighbours are in it or one step off, so two fronts are
    all that it is held against; of costs, the smallest of all fronts is.
    """
    spark = edges.sparkSession
    near = written(both_ways(edges), "adjacency")
    fronts = [written(spark.createDataFrame([(start, 0)], "ord long, cost long"), "front")]
    for _ in range(max_rounds):
        step = F.col("e.cost") if weighted else F.lit(1).cast("long")
        found = fronts[-1].alias("s").join(near.alias("e"), F.col("s.ord") == F.col("e.a"))
        found = found.groupBy(F.col("e.b").alias("ord")).agg(F.min(F.col("s.cost") + step).alias("cost"))
        if weighted:
            known = _smallest(fronts).withColumnRenamed("cost", "was")
            found = found.join(known, "ord", "left").where("was IS NULL OR cost < was").select("ord", "cost")
        else:
            for front in fronts[-2:]:
                found = found.join(front.select("ord"), "ord", "left_anti")
        front, seen = counted(found, "front", n=F.count(F.lit(1)))
        if not seen["n"]:
            return _smallest(fronts)
        fronts.append(front)
        if weighted and len(fronts) > 8:  # so that plans stay short
            last = fronts[-1]
            old, fronts = fronts[:-1], [written(_smallest(fronts[:-1]), "distances"), last]
            remove(*old)
    raise RuntimeError("distances did not settle; raise max_rounds")


def _smallest(fronts: list[DataFrame]) -> DataFrame:
    out = fronts[0]
    for front in fronts[1:]:
        out = out.unionByName(front)
    return out.groupBy("ord").agg(F.min("cost").alias("cost"))


def _numbers(nodes: DataFrame, labels: list[str]) -> dict[str, int]:
    return {r["label"]: r["ord"] for r in nodes.where(F.col("label").isin(labels)).collect()}  # a row per label asked for


def path(nodes: DataFrame, edges: DataFrame, source: str, target: str, mode: str = "hops", driver_edges: int = DRIVER_EDGES) -> PathResult:
    """The path of fewest hops, or of least risk cost, between two labels ``kind:value``.

    Among shortest hop paths the one with the smallest node numbers, first
    place first, is given. Of equal risk costs any path may be.
    """
    if mode not in ("hops", "risk"):
        raise ValueError(f"unknown mode {mode}")
    known = _numbers(nodes, [source, target])
    if source not in known:
        return PathResult(False, mode, explanation=NO_SOURCE)
    if target not in known:
        return PathResult(False, mode, explanation=NO_TARGET)
    a, z = known[source], known[target]
    small = edges.limit(driver_edges + 1).count() <= driver_edges
    search = _driver_path if small else _spark_path
    got = search(edges, a, z, mode)
    if got is None:
        return PathResult(False, mode, explanation=NO_PATH)
    route, cost, visited = got
    names = {r["ord"]: r["label"] for r in nodes.where(F.col("ord").isin(route)).collect()}  # a row per step
    return PathResult(True, mode, [names[n] for n in route], cost, visited, FOUND[mode])


def _driver_path(edges: DataFrame, a: int, z: int, mode: str) -> tuple[list[int], int, int] | None:
    """For graphs of a checked size."""
    near: dict[int, list[tuple[int, int]]] = {}
    for r in edges.select("source", "target", "risk").collect():
        cost = 1 if mode == "hops" else max(1, 11 - r["risk"])
        near.setdefault(r["source"], []).append((r["target"], cost))
        near.setdefault(r["target"], []).append((r["source"], cost))
    heap: list[tuple[int, tuple[int, ...]]] = [(0, (a,))]
    done: set[int] = set()
    while heap:
        cost, route = heappop(heap)
        node = route[-1]
        if node in done:
            continue
        done.add(node)
        if node == z:
            return list(route), cost, len(done)
        for other, c in near.get(node, []):
            if other not in done:
                heappush(heap, (cost + c, (*route, other)))
    return None


def _spark_path(edges: DataFrame, a: int, z: int, mode: str) -> tuple[list[int], int, int] | None:
    """Rounds over the nodes whose (cost, route) has fallen; routes travel with them."""
    spark = edges.sparkSession
    near = written(both_ways(edges), "adjacency")
    cost = F.col("e.cost") if mode == "risk" else F.lit(1).cast("long")
    state = written(spark.createDataFrame([(a, 0, [a], True)], "ord long, cost long, route array<long>, new boolean"), "route")
    while True:
        front = state.where("new").alias("s")
        step = front.join(near.alias("e"), F.col("s.ord") == F.col("e.a"))
        found = step.select(F.col("e.b").alias("ord"), (F.col("s.cost") + cost).alias("cost"), F.concat("s.route", F.array("e.b")).alias("route"), F.lit(True).alias("new"))
        all_ = state.withColumn("new", F.lit(False)).unionByName(found)
        best = all_.groupBy("ord").agg(F.min(F.struct("cost", "route", "new")).alias("m")).select("ord", "m.cost", "m.route", "m.new")
        old = state
        state, seen = counted(best, "route", n=F.count_if("new"))
        remove(old)
        if not seen["n"]:
            break
    goal = state.where(F.col("ord") == z).select("cost", "route").first()
    if goal is None:
        return None
    before = F.struct("cost", "route") <= F.struct(F.lit(goal["cost"]).cast("long").alias("cost"), F.array(*[F.lit(n).cast("long") for n in goal["route"]]).alias("route"))
    return list(goal["route"]), goal["cost"], state.where(before).count()
