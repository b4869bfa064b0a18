"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

TASK_LINKS = 100_000  # links a task of a contraction handles; fewer links take fewer tasks, and fewer shuffle files


def _star(links: DataFrame, low: bool, tasks: int) -> DataFrame:
    """Move each node's larger (or, with ``low``, smaller) neighbours to its smallest neighbour."""
    if low:
        near = links
    else:
        near = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = near.join(least, "a")
    if low:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    else:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").coalesce(tasks).distinct().coalesce(tasks)


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` of every node in ``links(a, b)``; the component is its smallest node.

    Each round is a few shuffles with map-side minima; the number of rounds grows with the logarithm of the longest
    path. Nodes without a link are not in the result. No links give an empty table.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()

    before = state(edges)
    while before[0]:
        tasks = 1 + before[0] // TASK_LINKS
        edges = cut(_star(_star(edges.coalesce(tasks), False, tasks), True, tasks))
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        edges.select("b", F.col("b").alias("c")).distinct()
    )
