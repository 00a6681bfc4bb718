"""Model calls remembered across runs: a content-addressed table that is asked before a service is.

An input's address is the digest of what it says. Inputs not stored yet are called once each; what succeeds is appended,
failures are not, so the next run asks for them again. One run at a time may append to a table; should two, both rows of
an input are good and one of them is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evspark.plans.stage import written

from .provider import Provider, call_provider
from .spend import stored

VERDICT = "equivalent boolean, reasoning string"


def address(*parts: Column) -> Column:
    """Digest of texts in order; their lengths are part of it, so that texts don't run into each other. Null counts as empty."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat(*[x for t in texts for x in (F.length(t).cast("string"), F.lit(":"), t)]), 256)


def remembered(rows: DataFrame, prompt: str, path: str, factory: Callable[[], Provider], attempts: int = 5) -> DataFrame:
    """``rows`` with output and error for the prompt column, from the table at ``path`` where it has them."""
    spark = rows.sparkSession
    keyed = rows.withColumn("_at", address(F.col(prompt)))
    asked = keyed.select("_at", F.col(prompt).alias("_prompt")).filter("_prompt is not null").dropDuplicates(["_at"])
    known = stored(spark, path)
    todo = asked if known is None else asked.join(known.select("_at"), "_at", "left_anti")
    replies = written(call_provider(written(todo, "asked"), "_prompt", factory, attempts).select("_at", "output", "error"), "called")
    fresh = replies.filter("error is null and output is not null").select("_at", "output")
    if not fresh.isEmpty():
        fresh.write.mode("append").parquet(path)
    failed = replies.filter("error is not null or output is null").select("_at", F.lit(None).cast("string").alias("output"), "error")
    good = stored(spark, path)
    every = failed if good is None else good.dropDuplicates(["_at"]).select("_at", "output", F.lit(None).cast("string").alias("error")).unionByName(failed)
    return keyed.join(every, "_at", "left").drop("_at")


def judge_prompt(question: Column, gold: Column, candidate: Column) -> Column:
    return F.when(F.trim(F.coalesce(candidate, F.lit(""))) != "", F.concat(F.lit("QUESTION:\n"), question, F.lit("\n\nGOLD ANSWER:\n"), gold, F.lit("\n\nCANDIDATE ANSWER:\n"), candidate))


def judge(rows: DataFrame, path: str, factory: Callable[[], Provider], question: str = "question", gold: str = "gold", candidate: str = "candidate") -> DataFrame:
    """Adds equivalent and reasoning. An empty candidate is never sent; a judge that fails or gives no verdict has not said yes."""
    texts = [F.coalesce(F.col(c), F.lit("")) for c in (question, gold, candidate)]
    found = remembered(rows.withColumn("_judged", judge_prompt(*texts)), "_judged", path, factory)
    verdict = F.try_variant_get(F.try_parse_json("output"), "$.equivalent", "boolean")
    said = F.try_variant_get(F.try_parse_json("output"), "$.reasoning", "string")
    reason = F.when(F.col("_judged").isNull(), "empty answer").when(F.col("error").isNotNull(), F.concat(F.lit("judge unavailable: "), "error")).otherwise(F.coalesce(said, F.lit("")))
    return found.withColumn("equivalent", F.coalesce(verdict, F.lit(False))).withColumn("reasoning", reason).drop("_judged", "output", "error")
