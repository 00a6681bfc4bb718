"""Evaluation runs: the two baselines that bound every system, flat result rows, and totals of an ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import explain
from .evaluate import score_report

RESULT = "qid string, shape string, status string, answer string, gold string, score int, reason string, `where` string, abstain_reason string, tokens bigint, seconds double"


def baseline_answers(gold: DataFrame) -> DataFrame:
    """Every question answered twice: ``abstain`` refuses all, ``oracle`` gives the gold answer and cites the gold pages.

    ``gold`` has qid, shape, gold, gold_doc and gold_pages.
    """
    pages = F.coalesce("gold_pages", F.array().cast("array<int>"))
    cited = F.transform(pages, lambda p: F.struct(F.col("gold_doc").alias("doc_id"), p.cast("int").alias("page_seq")))
    both = gold.select("*", F.explode(F.array(F.lit("abstain"), F.lit("oracle"))).alias("baseline"))
    refuses = F.col("baseline") == "abstain"
    none = F.expr("cast(array() as array<struct<doc_id: string, page_seq: int>>)")
    return both.withColumn("abstained", refuses).withColumn("answer", F.when(~refuses, F.col("gold"))).withColumn("citations", F.when(refuses, none).otherwise(cited)).withColumn("overlap", F.lit(None).cast("double"))


def baseline_scores(gold: DataFrame, judged: str | None = None) -> DataFrame:
    """By baseline and shape, and over all shapes (null): n, total and mean. A harness in which ``abstain`` has another total than 0 is broken."""
    scored = explain.scored(baseline_answers(gold), judged)
    return scored.cube("baseline", "shape").agg(F.count(F.lit(1)).alias("n"), F.sum("score").cast("long").alias("total"), F.round(F.avg("score"), 6).alias("mean")).filter("baseline is not null")


def append_results(results: DataFrame, path: str) -> None:
    """Flat result rows as JSON lines, behind those that are there."""
    results.write.mode("append").json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT).json(path)


def results_report(results: DataFrame) -> DataFrame:
    """Counts and scores by shape and over all."""
    return score_report(results, "shape")


def ingest_totals(filings: DataFrame, pages: DataFrame, cells: DataFrame, facts: DataFrame) -> DataFrame:
    """One row: filings ready and failed, pages, cells, facts, and the share of ready filings that have aligned tables."""
    by = filings.select("doc_id", (F.col("ingest_status") == "ready").alias("ready"))
    for name, side in (("pages", pages), ("cells", cells), ("facts", facts)):
        by = by.join(side.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name)), "doc_id", "left")
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    sums = by.agg(F.count_if("ready").alias("ready"), F.count_if(~F.col("ready")).alias("failed"), n("pages"), n("cells"), n("facts"), F.count_if(F.col("ready") & (F.col("cells") > 0)).alias("_aligned"))
    return sums.withColumn("aligned_share", F.round(F.try_divide("_aligned", "ready"), 6)).drop("_aligned")
