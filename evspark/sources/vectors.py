"""Importing page vectors: a sample must agree with a second embedding before anything is written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evspark.functions.vectors import cosine

LEAST_AGREEMENT = 0.98


class VectorMismatch(ValueError):
    """The incoming vectors are not from the same embedder."""


def agreement(incoming: DataFrame, sample: DataFrame, key: str) -> float | None:
    """Least cosine between incoming vectors and the sample's (columns key, embedding), over the sample's keys."""
    other = sample.select(key, F.col("embedding").alias("_e"))
    return incoming.join(other, key).agg(F.min(cosine(F.col("embedding"), F.col("_e"))).alias("least")).first()["least"]


def import_vectors(pages: DataFrame, incoming: DataFrame, sample: DataFrame, key: str = "page_id") -> DataFrame:
    """Pages with their vectors filled in; raises if the sample disagrees. Pages without an incoming vector keep theirs."""
    least = agreement(incoming, sample, key)
    if least is None or least < LEAST_AGREEMENT:
        raise VectorMismatch(f"least cosine {least}, wanted {LEAST_AGREEMENT}")
    side = incoming.select(key, F.col("embedding").alias("_new"))
    return pages.join(side, key, "left").withColumn("embedding", F.coalesce("_new", "embedding")).drop("_new")


def coverage_report(pages: DataFrame, group: str = "doc_id") -> DataFrame:
    return pages.groupBy(group).agg(F.count(F.lit(1)).alias("pages"), F.count("embedding").alias("with_vector"), F.count_if(F.col("embedding").isNull()).alias("missing"))
