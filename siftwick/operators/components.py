"""Connected components of a graph given as edges, by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import counted, remove, written


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, comp) for every id of an edge; comp is the smallest id that it is linked with.

    Each round gives an id the smallest label next to it, then the label's own
    label (pointer jumping), so a chain of n links needs about log n rounds.
    State is a written table, which a lost executor does not take along; sums
    are formed before rows are moved. Raises if the rounds run out.
    """
    both = edges.select(F.col(a).alias("id"), F.col(b).alias("to")).where("id <> to")
    both = written(both.unionByName(both.select(F.col("to").alias("id"), F.col("id").alias("to"))).distinct(), "edges")
    state = written(both.groupBy("id").agg(F.min("to").alias("m")).select("id", F.least("id", "m").alias("comp")), "components")
    for _ in range(max_rounds):
        near = both.join(state.select(F.col("id").alias("to"), "comp"), "to").groupBy("id").agg(F.min("comp").alias("n"))
        low = state.join(near, "id").select("id", "comp", F.least("comp", "n").alias("n"))
        # the label that was left hears of the smaller one too
        told = low.where("n < comp").groupBy("comp").agg(F.min("n").alias("h")).withColumnRenamed("comp", "id")
        low = low.join(told, "id", "left").select("id", "comp", F.least("n", F.coalesce("h", "n")).alias("n"))
        step = written(low, "components-step")
        jump = step.select(F.col("id").alias("n"), F.col("n").alias("j"))
        new = step.join(jump, "n", "left").select("id", F.least("n", F.coalesce("j", "n")).alias("comp"), F.col("comp").alias("was"))
        new, seen = counted(new, "components", moved=F.count_if(F.col("comp") != F.col("was")))
        remove(step, state)
        state = new.select("id", "comp")
        if not seen["moved"]:
            remove(both)
            return state
    raise RuntimeError("components did not settle; raise max_rounds")
