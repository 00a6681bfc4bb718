"""BM25 over a page table. Statistics cover all pages; scores are computed only where a page shares a query token.

Document frequencies and lengths come from one pass over distinct tokens, combined before the shuffle, and are what is
worth storing. Term frequencies are counted only for tokens that some question has. These are dealt by page once, and so
few weights that they fit a task meet them there: frequencies, products and sums of a page then stay in its partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evspark.functions.text import tokens

K1, B, FLOOR = 1.5, 0.75, 0.25
#: Rows of questions' terms that are sent to every task (some tens of MB at most).
MOST_SENT = 500_000
#: Bytes of input a core under which an input counts as small; a partition of dealt pages holds half as many.
SMALL_SPLIT = 16 << 20


def page_tokens(pages: DataFrame, key: str, text: Column, scope: str | None = None) -> DataFrame:
    """key[, scope], tokens and dl of every page."""
    kept = [F.col(key)] + ([F.col(scope)] if scope else [])
    return spread(pages, key).select(*kept, tokens(text).alias("tokens")).withColumn("dl", F.size("tokens"))


def corpus_statistics(paged: DataFrame) -> DataFrame:
    """One row: n pages and their mean length."""
    return paged.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def term_counts(paged: DataFrame) -> DataFrame:
    """term and df, combined before the shuffle."""
    return paged.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def term_statistics(paged: DataFrame) -> DataFrame:
    """term, df and total, in one pass: for the null term the number of pages and their tokens in all."""
    each = paged.select("dl", F.explode(F.concat(F.array_distinct("tokens"), F.array(F.lit(None).cast("string")))).alias("term"))
    return each.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("total"))


def term_idf(paged: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """term, df and idf; a negative idf becomes a quarter of the mean of all. ``counts``: a stored table of ``term_statistics``."""
    stats = term_statistics(paged) if counts is None else counts
    counted = stats.filter("term is not null").withColumn("n", stats.filter("term is null").select("df").scalar())
    raw = counted.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean_idf")).scalar()
    idf = F.when(F.col("raw") < 0, FLOOR * F.col("mean_idf")).otherwise(F.col("raw"))
    return raw.withColumn("mean_idf", mean).select("term", "df", idf.alias("idf"))


def input_bytes(df: DataFrame) -> int | None:
    """What the planner takes for the size of ``df``; None if it does not know."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else None


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt to all cores if it is small, as a file of one row group would be one task's work; larger inputs have splits enough and stay in place."""
    cores, size = df.sparkSession.sparkContext.defaultParallelism, input_bytes(df)
    return df.repartition(cores, key) if size is not None and size <= cores * SMALL_SPLIT else df


def dealt(df: DataFrame, key: str, pages: DataFrame) -> DataFrame:
    """``df``, made of ``pages``, by their key, in partitions of half of SMALL_SPLIT bytes of pages: with more pages there are more
    partitions, so that what a task holds does not grow."""
    cores, size = df.sparkSession.sparkContext.defaultParallelism, input_bytes(pages)
    return df.repartition(key) if size is None else df.repartition(max(cores, -(-2 * size // SMALL_SPLIT)), key)


def small_enough(df: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """``df`` to be sent to every task if it has at most ``most`` rows, else as it is, to be joined as the planner thinks best."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def bm25_scores(paged: DataFrame, questions: DataFrame, key: str, qkey: str, question: Column, scope: str | None = None, counts: DataFrame | None = None) -> DataFrame:
    """qkey, key[, scope] and score of every page that shares a token with a question. Repeated query tokens count again.

    ``counts``: a stored table of ``term_statistics``; without one, statistics are part of the plan.
    """
    stats = term_statistics(paged) if counts is None else counts
    asked = questions.select(qkey, F.explode(tokens(question)).alias("term")).groupBy(qkey, "term").agg(F.count(F.lit(1)).alias("times"))
    weights = asked.join(term_idf(paged, stats), "term").select(qkey, "term", (F.col("times") * F.col("idf")).alias("weight"))
    wanted = asked.select("term").distinct()
    if counts is not None:
        weights, wanted = small_enough(weights), small_enough(wanted)
    kept = [key] + ([scope] if scope else [])
    seen = paged.select(*kept, "dl", F.explode("tokens").alias("term")).join(wanted, "term", "left_semi")
    seen = dealt(seen, key, paged)
    length = F.try_divide(F.col("total"), F.col("df"))
    tf = seen.groupBy(*kept, "dl", "term").agg(F.count(F.lit(1)).alias("tf")).withColumn("avgdl", stats.filter("term is null").select(length.alias("avgdl")).scalar())
    share = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    hits = tf.select(*kept, "term", share.alias("share")).join(weights, "term")
    return hits.groupBy(qkey, *kept).agg(F.round(F.sum(F.col("weight") * F.col("share")), 6).alias("score"))


def top_pages(scores: DataFrame, qkey: str, key: str, k: int, scope: str | None = None) -> DataFrame:
    """Positive scores only: the best k (of each scope, if given), ranked over all by score, then key."""
    best = scores.filter("score > 0")
    order = [F.desc("score"), F.asc(key)]
    if scope:
        best = best.withColumn("_r", F.row_number().over(Window.partitionBy(qkey, scope).orderBy(*order))).filter(F.col("_r") <= k).drop("_r")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy(qkey).orderBy(*order)))
    return ranked if scope else ranked.filter(F.col("rank") <= k)
