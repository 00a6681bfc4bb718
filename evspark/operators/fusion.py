"""Combining rankings, adding neighbours and packing a budget."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
NEIGHBOUR_DISCOUNT = 0.25
ITEM_OVERHEAD = 32


def rrf(rankings: list[tuple[str, DataFrame, float]], qkey: str, key: str) -> DataFrame:
    """Reciprocal rank fusion of (name, ranking with qkey, key and rank, weight): score, sources and rank."""
    parts = [df.select(qkey, key, (F.lit(weight) / (F.lit(RRF_K) + F.col("rank"))).alias("part"), F.lit(name).alias("source")) for name, df, weight in rankings]
    fused = reduce(DataFrame.unionByName, parts).groupBy(qkey, key).agg(F.round(F.sum("part"), 9).alias("score"), F.array_join(F.sort_array(F.collect_set("source")), "+").alias("sources"))
    order = Window.partitionBy(qkey).orderBy(F.desc("score"), F.asc(key))
    return fused.withColumn("rank", F.row_number().over(order))


def ordered_union(rankings: list[DataFrame], qkey: str, key: str) -> DataFrame:
    """Distinct pages in the order of the lists and of their ranks."""
    parts = [df.select(qkey, key, F.lit(i).alias("list"), F.col("rank").alias("list_rank")) for i, df in enumerate(rankings)]
    first = reduce(DataFrame.unionByName, parts).groupBy(qkey, key).agg(F.min(F.struct("list", "list_rank")).alias("at"))
    order = Window.partitionBy(qkey).orderBy("at.list", "at.list_rank", key)
    return first.select(qkey, key, F.row_number().over(order).alias("position"))


def neighbours(hits: DataFrame, pages: DataFrame, qkey: str, doc: str, seq: str, distance: int) -> DataFrame:
    """Pages up to ``distance`` from a hit (qkey, doc, seq, score, rank) that are no hits themselves; the best-ranked hit claims a page."""
    offsets = F.array(*[F.lit(d) for d in range(-distance, distance + 1) if d])
    near = hits.select(qkey, doc, F.posexplode(offsets).alias("_o", "_d"), F.col(seq).alias("_s"), "score", "rank").withColumn(seq, F.col("_s") + F.col("_d"))
    claimed = near.groupBy(qkey, doc, seq).agg(F.min_by(F.struct("score", "rank", "_o"), F.struct("rank", "_o")).alias("by"))
    exists = claimed.join(pages.select(doc, seq), [doc, seq], "left_semi").join(hits.select(qkey, doc, seq), [qkey, doc, seq], "left_anti")
    return exists.select(qkey, doc, seq, (F.col("by.score") * NEIGHBOUR_DISCOUNT).alias("score"), F.col("by.rank").alias("claimed_by"))


def item_cost(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long") + ITEM_OVERHEAD


def pack_budget(items: DataFrame, group: str, key: str, order: list[Column], cost: str, budget: int) -> DataFrame:
    """Greedy packing in order: an item too large for what is left is skipped and later ones still tried; the first
    always fits. Adds ``kept``.

    Whether an item fits depends on all before it, so a group's places and costs are folded as one array; of a group only
    items that could fit at all are in it, and the fold remembers those kept, which the budget bounds.
    """
    ranked = items.select(group, key, F.col(cost).cast("long").alias("cost"), F.row_number().over(Window.partitionBy(group).orderBy(*order)).alias("position"))
    possible = ranked.filter((F.col("position") == 1) | (F.col("cost") <= budget))
    arrays = possible.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("position", "cost"))).alias("items"))
    empty = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"))

    def step(state: Column, item: Column) -> Column:
        fits = (F.size(state["kept"]) == 0) | (state["used"] + item["cost"] <= budget)
        return F.when(fits, F.struct((state["used"] + item["cost"]).alias("used"), F.concat(state["kept"], F.array(item["position"])).alias("kept"))).otherwise(state)

    folded = arrays.select(group, F.aggregate("items", empty, step)["kept"].alias("_kept"))
    return ranked.join(folded, group).select(group, key, "position", "cost", F.array_contains("_kept", F.col("position")).alias("kept"))
