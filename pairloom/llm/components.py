"""Connected components of a graph that is never gathered in one place.

Edges are rewritten until each node of a component points to its smallest node: every node hands its larger neighbours
to its smallest one, then its smaller neighbours and itself. Each pass is written to the shared folder, which cuts the
lineage, and compared with the one before by a count and a sum of hashes. Of more edges than one task can take, those of
nodes with very many neighbours, the centres of stars, stay where they lie and are met by broadcast (``looked_up``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import looked_up, written


#: So many edges (of 16 bytes) any task can take.
FEW = 1 << 20


def with_least(edges: DataFrame, n: int) -> DataFrame:
    """The edges (u, v) with m, the smallest neighbour of u or u itself."""
    least = edges.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"), F.count("*").alias("_degree")).withColumn("m", F.least("c", "m"))
    return looked_up(edges, least, "u", "c", weight="_degree", total=n) if n > FEW else edges.join(least, F.col("u") == F.col("c"))


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: bigint) -> (node, component): the smallest node reachable, for nodes with an edge to another."""
    state = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before, n = None, state.count()
    while True:
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = with_least(large, 2 * n)
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        state = written(small, "components")
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before, n = now, now[0]
