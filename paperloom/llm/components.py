"""Connected components by alternating large and small stars, with set-based joins and least-id aggregates.

No neighbour list is ever gathered: a hub's edges stay rows, the least neighbour is a partial aggregate, and
the joins are plain equi-joins, which AQE may split at a hub.  Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import discard, staged


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a, b) -> id, component (least id reachable), for every id that has an edge to another id."""
    u, v = F.col("u"), F.col("v")
    state = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(u != v).distinct()
    state = staged(state, "edges")
    for _ in range(rounds):
        if _settled(state):
            break
        both = state.unionByName(state.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.least(u, F.min("v")).alias("m"))
        large = both.join(least, "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).where(u != v)
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = large.join(lowest, "u").where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        after = staged(hooked.unionByName(lowest.withColumnRenamed("m", "v")).distinct(), "edges")
        discard(state)
        state = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return state.select(u.alias("id"), v.alias("component")).unionByName(state.select(v.alias("id"), v.alias("component")).distinct())


def _settled(state: DataFrame) -> bool:
    """Every id has one edge to an id that has none: all edges are stars around least ids."""
    out, into = F.struct(F.col("u").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("v").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("into"))
    ends = state.select(F.inline(F.array(out, into))).groupBy("id").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return ends.where("out > 1 or (out = 1 and into = 1)").isEmpty()
