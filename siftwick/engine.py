"""One object that holds a dataset and answers for it."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import detect, graph, rank
from .operators.search import plan_trace, search
from .sources import sinks, synthetic
from .sources.ingest import MAX_EVENTS, IngestError, ingest
from .storage import numbered


class Engine:
    """Starts with 2,000 made-up events; a load that fails leaves the dataset as it was."""

    def __init__(self, spark: SparkSession, events: DataFrame | None = None, limits: bool = True):
        self.spark, self.limits = spark, limits
        self._set(events if events is not None else synthetic.generate_events(spark, 2_000))

    def _set(self, events: DataFrame) -> None:
        self.events = numbered(events, ["timestamp", "id"], "event_seq")
        self._graph: tuple[DataFrame, DataFrame] | None = None

    def generate(self, count: int, seed: int = 42, scenario: str = "mixed") -> int:
        if self.limits and count > MAX_EVENTS:
            raise IngestError("event limit is 100000")
        self._set(synthetic.generate_events(self.spark, count, seed, scenario))
        return self.events.count()

    def load(self, path: str, kind: str) -> dict:
        result = ingest(self.spark, path, kind, self.limits)
        report = result.counts() | {"issues": [r.asDict() for r in result.invalid.orderBy("row").limit(10).collect()]}
        self._set(result.events)
        return report

    def load_jsonl(self, path: str) -> dict:
        return self.load(path, "jsonl")

    def load_csv(self, path: str) -> dict:
        return self.load(path, "csv")

    def query(self, text: str, limit: int | None = 100) -> dict:
        """Query, matches (a DataFrame) and plan, whose candidates are counted before the limit."""
        plan = plan_trace(self.events, text)
        return {"query": text, "matches": search(self.events, text, limit).drop("event_seq"), "plan": asdict(plan)}

    def detections(self, config: detect.DetectorConfig | None = None) -> DataFrame:
        return detect.detect_all(self.events, config)

    def _built(self) -> tuple[DataFrame, DataFrame]:
        if self._graph is None:
            self._graph = graph.build(self.events)
        return self._graph

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges); edges by label, in the order of their nodes."""
        nodes, edges = self._built()
        a = nodes.select(F.col("ord").alias("source"), F.col("label").alias("a"))
        b = nodes.select(F.col("ord").alias("target"), F.col("label").alias("b"))
        named = edges.join(a, "source").join(b, "target").orderBy("source", "target")
        return graph.node_table(nodes, edges).orderBy("id"), named.select(F.col("a").alias("source"), F.col("b").alias("target"), "observations", "risk")

    def path(self, source: str, target: str, risk_weighted: bool = False) -> graph.PathResult:
        return graph.path(*self._built(), source, target, "risk" if risk_weighted else "hops")

    def stats(self) -> dict:
        return rank.stats(self.events, *self._built())

    def top(self, field: str, limit: int) -> DataFrame:
        return rank.top_entities(self.events, field, limit)

    def save(self, path: str) -> dict:
        return sinks.save_snapshot(self.events, path)
