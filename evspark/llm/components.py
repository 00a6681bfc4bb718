"""Connected components of an edge table, by contracting to smallest neighbours with DataFrame operations.

Each round, every node points to the smallest of itself and its neighbours, pointers are followed once more, and edges
move to what their ends point to. Every round's tables are written to the shared folder, so lineage stays short. The
driver only asks whether edges are left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component), for all nodes of ``edges`` (columns a, b)."""
    current = materialise(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    while not current.isEmpty():
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = materialise(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("to")), "pointers")
        onward = point.select(F.col("node").alias("to"), F.col("to").alias("far"))
        point = materialise(point.join(onward, "to", "left").select("node", F.coalesce("far", "to").alias("to")), "pointers")
        maps.append(point)
        left = point.select(F.col("node").alias("a"), F.col("to").alias("ra"))
        right = point.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        moved = current.join(left, "a").join(right, "b").filter("ra != rb")
        current = materialise(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    if not maps:
        return current.select(F.col("a").alias("node"), F.col("b").alias("root"))

    def follow(roots: DataFrame, point: DataFrame) -> DataFrame:
        step = point.select(F.col("node").alias("root"), F.col("to").alias("next"))
        return roots.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))

    return reduce(follow, maps[1:], maps[0].select("node", F.col("to").alias("root")))
