"""Connected components by alternating large and small stars.

Every round is two aggregations and two joins over the edges; adaptive execution splits the
joins' hot keys, and the aggregations combine before their shuffle, so a hub of any degree is
no problem. Rounds grow with the logarithm of the longest path. Steps run in one task per
``EDGES_PER_TASK`` edges, so that rounds over few edges leave few small files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.llm.storage import cut

EDGES_PER_TASK = 100_000


def _toward_least(pairs: DataFrame) -> DataFrame:
    """(u, v, least of u and its neighbours) for the directed pairs (u, v)."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) of all nodes with an edge; component is the least node of each.

    ``edges`` has columns a and b of a type with an order; loops, repeats and nulls are ignored.
    No edges give no rows. Raises where ``max_rounds`` rounds do not settle all components.
    """
    now = cut(edges.filter("a != b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    tasks, before = max(1, -(-now.count() // EDGES_PER_TASK)), None
    for _ in range(max_rounds):
        now = now.coalesce(tasks)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _toward_least(large.coalesce(tasks)).coalesce(tasks)
        now = cut(small.select("u", F.col("m").alias("v")).unionByName(
            small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct().coalesce(tasks))
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.expr("xxhash64(u, v) >> 20"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
