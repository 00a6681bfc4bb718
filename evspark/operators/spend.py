"""Spend of evaluation runs: usage by question and stage, ceilings, and runs that can be taken up again.

A run goes through its questions in order and ends with the one that takes its spend to the ceiling. The sum so far is
built from sums of ordered ranges, so no task adds up the whole run. Results are appended once a question, and a run
that starts again leaves out what is stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from evspark.plans.stage import written

LEDGER = ("calls", "errors", "input_tokens", "output_tokens", "seconds")


def running_total(rows: DataFrame, order: list[str], value: str, total: str = "total_before") -> DataFrame:
    """Adds the sum of ``value`` over all rows before (0 for the first), in the order of ``order``, which must tell rows apart.

    Ranges of the order are dealt out and stored, each is summed, and a row's total is what earlier ranges have plus what
    comes before it in its own. Nulls count as 0.
    """
    ranged = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    amount = F.coalesce(F.col(value), F.lit(0))
    sums = ranged.groupBy("_range").agg(F.sum(amount).alias("_sum"))  # one row a range
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumn("_inside", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    return inside.join(bases, "_range").withColumn(total, F.col("_base") + F.col("_inside")).drop("_range", "_base", "_inside")


def until_ceiling(rows: DataFrame, order: list[str], value: str, ceiling: float | None) -> DataFrame:
    """Adds total_before and ``ran``: whether spend was still under the ceiling when the row's turn came. No ceiling lets all run."""
    if ceiling is None:
        return rows.withColumn("total_before", F.lit(None).cast("double")).withColumn("ran", F.lit(True))
    return running_total(rows, order, value).withColumn("ran", F.col("total_before") < F.lit(ceiling))


def cost(input_tokens: Column, output_tokens: Column, rate_in: float | None, rate_out: float | None) -> Column:
    """Money for tokens at rates for a million; null if a rate is not set, as none is guessed."""
    if rate_in is None or rate_out is None:
        return F.lit(None).cast("double")
    return input_tokens / 1e6 * rate_in + output_tokens / 1e6 * rate_out


def ledger(calls: DataFrame, qid: str = "qid") -> DataFrame:
    """What each question spent by stage, and in all (stage null): calls, errors, tokens, seconds. A failed call counts.

    ``calls`` has qid, stage, input_tokens, output_tokens, seconds and error, one row a call.
    """
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    spent = [F.count(F.lit(1)).alias("calls"), F.count("error").alias("errors"), n("input_tokens").alias("input_tokens"), n("output_tokens").alias("output_tokens"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds")]
    stages = calls.groupBy(qid, "stage").agg(*spent)
    whole = stages.groupBy(qid).agg(*[F.sum(c).alias(c) for c in LEDGER]).withColumn("stage", F.lit(None).cast("string"))
    return stages.unionByName(whole)


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """What earlier runs have appended, or None."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException:
        return None
    return found


def to_run(questions: DataFrame, done: DataFrame | None, qid: str = "qid") -> DataFrame:
    """Questions without a stored result."""
    return questions if done is None else questions.join(done.select(qid).distinct(), qid, "left_anti")


def append_once(results: DataFrame, path: str, qid: str = "qid") -> int:
    """Appends the results of questions that have none yet, one row each, and says how many."""
    fresh = written(to_run(results, stored(results.sparkSession, path), qid).dropDuplicates([qid]), "results")
    fresh.write.mode("append").parquet(path)
    return fresh.count()


def run_batch(questions: DataFrame, work, path: str, size: int, order: list[str], ceiling: float | None = None, spent: str = "tokens", qid: str = "qid") -> str:
    """Runs ``work`` (questions to one row each, with ``spent``) on the next ``size`` questions that have no result, and appends these.

    Says how it ended: ``done`` (nothing left), ``ceiling`` (what is stored has reached it) or ``more``.
    """
    done = stored(questions.sparkSession, path)
    if ceiling is not None and done is not None and (done.agg(F.sum(spent)).first()[0] or 0) >= ceiling:
        return "ceiling"
    left = to_run(questions, done, qid).orderBy(*order).limit(size)
    if left.isEmpty():
        return "done"
    append_once(work(written(left, "batch")), path, qid)
    return "more"
