"""Upserts without a table format: keep-latest and first-wins merges that give the table's next version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_latest(current: DataFrame, incoming: DataFrame, keys: list[str], version: str) -> DataFrame:
    """All columns of the newest row per key; of equal versions, the incoming row."""
    both = current.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    order = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_new")


def first_wins(current: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows already there stay; of the incoming ones only new keys come in, one each."""
    first = incoming.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
    return current.unionByName(first.join(current.select(*keys), keys, "left_anti"))


def update_columns(current: DataFrame, incoming: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """On a known key only ``columns`` change; new keys come in whole. A null does not overwrite."""
    side = incoming.select(*keys, *[F.col(c).alias(f"_{c}") for c in incoming.columns if c not in keys], F.lit(True).alias("_in"))
    joined = current.withColumn("_cur", F.lit(True)).join(side, keys, "full_outer")

    def merged(c: str) -> Column:
        if c in keys:
            return F.col(c)
        fresh = F.coalesce(f"_{c}", c) if c in columns else F.col(c)
        return F.when(F.col("_cur").isNull(), F.col(f"_{c}")).otherwise(fresh).alias(c)

    return joined.select(*[merged(c) for c in current.columns])


def unseen(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys (an id with a content hash, say) are not stored yet; makes ingest repeatable."""
    return incoming.join(stored.select(*keys), keys, "left_anti")


def replace_documents(df: DataFrame, path: str, key: str = "doc_id") -> None:
    """Writes documents over their earlier versions, partition by partition; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
