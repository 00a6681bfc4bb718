"""Measuring answers: gold pages, locations, scores, samples, batches, stops, tallies and spend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evspark.functions.text import token_set

from .lexical import dealt, small_enough, spread
from .spend import running_total

JACCARD = 0.35
CONTAINMENT = 0.6


def shared_tokens(passages: DataFrame, pages: DataFrame, passage: str, page: str) -> DataFrame:
    """passage, page, their token counts and shared ones, for pairs that share any.

    Tokens that some passage has are dealt by page, in partitions of bounded size, and few passages' tokens go to every
    task, so that a page's matches are counted in its partition; many are met over an inverted index.
    """
    a = passages.select(passage, token_set(F.col("text")).alias("t")).select(passage, F.size("t").alias("n_passage"), F.explode("t").alias("token"))
    b = spread(pages, page).select(page, token_set(F.col("text")).alias("t")).select(page, F.size("t").alias("n_page"), F.explode("t").alias("token"))
    b = dealt(b.join(small_enough(a.select("token").distinct()), "token", "left_semi"), page, pages)
    return b.join(small_enough(a), "token").groupBy(passage, page, "n_passage", "n_page").agg(F.count(F.lit(1)).alias("shared"))


def gold_pages(passages: DataFrame, pages: DataFrame, passage: str, page: str, threshold: float = JACCARD) -> DataFrame:
    """The page with the largest Jaccard similarity of token sets for each passage, its score, and whether it counts as mapped."""
    scored = shared_tokens(passages, pages, passage, page).withColumn("score", F.round(F.col("shared") / (F.col("n_passage") + F.col("n_page") - F.col("shared")), 6))
    best = scored.groupBy(passage).agg(F.min_by(F.struct(page, "score"), F.struct(-F.col("score"), page)).alias("b"))
    return best.select(passage, f"b.{page}", "b.score", (F.col("b.score") >= threshold).alias("mapped"))


def location_hits(passages: DataFrame, cited: DataFrame, passage: str, page: str, threshold: float = CONTAINMENT) -> DataFrame:
    """passage and its best containment among cited pages."""
    shared = shared_tokens(passages, cited, passage, page)
    best = shared.groupBy(passage).agg(F.max(F.round(F.col("shared") / F.col("n_passage"), 6)).alias("containment"))
    return passages.select(passage).join(best, passage, "left").withColumn("containment", F.coalesce("containment", F.lit(0.0))).withColumn("located", F.col("containment") >= threshold)


def page_within(cited_page: Column, gold_page: Column, slack: int = 1) -> Column:
    return F.abs(cited_page - gold_page) <= slack


def score(abstained: Column, correct: Column, located: Column) -> Column:
    """0 for a refusal, -1 for a wrong answer, 1 for a right one at the right place, else 0."""
    return F.when(abstained, 0).when(~correct, -1).when(located, 1).otherwise(0)


def score_report(scored: DataFrame, by: str) -> DataFrame:
    """Counts, total and mean by ``by`` and over all (null)."""
    return scored.rollup(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") == 1).alias("plus"), F.count_if(F.col("score") == 0).alias("zero"), F.count_if(F.col("score") == -1).alias("minus"),
        F.sum("score").cast("long").alias("net"), F.round(F.avg("score"), 6).alias("mean"),
    )


def group_split(rows: DataFrame, group: str, share: float = 0.3) -> DataFrame:
    """Adds ``blind``: every k-th group in order, from the first. Groups are numbered apart from their rows."""
    stride = max(1, round(1 / share))
    numbered = rows.select(group).distinct().withColumn("blind", (F.row_number().over(Window.orderBy(group)) - 1) % stride == 0)
    return rows.join(numbered, group)


def stratified_sample(rows: DataFrame, stratum: str, order: list[str], n: int) -> DataFrame:
    """About n rows, in proportion to the strata, strided over each stratum in ``order``, which must tell its rows apart; position is the place taken.

    Places are numbered over ordered ranges of all rows, so that a stratum of any size is spread over tasks.
    """
    numbered = running_total(rows.withColumn("_one", F.lit(1)), [stratum, *order], "_one", "_before").drop("_one")
    sizes = numbered.groupBy(stratum).agg(F.count(F.lit(1)).alias("size"), F.min("_before").alias("_first"))
    total = F.sum("size").over(Window.partitionBy())  # one row a stratum
    want = F.greatest(F.lit(1), F.bround(F.lit(float(n)) * F.col("size") / total, 0).cast("int"))
    plan = sizes.withColumn("want", want).withColumn("stride", F.greatest(F.lit(1), F.expr("cast(size div want as int)"))).withColumnRenamed(stratum, "_stratum")
    placed = numbered.join(plan, F.col(stratum).eqNullSafe(F.col("_stratum"))).withColumn("_at", F.col("_before") - F.col("_first"))
    return placed.filter((F.col("_at") % F.col("stride") == 0) & (F.expr("_at div stride") < F.col("want"))).withColumn("position", F.expr("cast(_at div stride as int)")).drop("_at", "_before", "_first", "_stratum", "size", "want", "stride")


def plan_batches(rows: DataFrame, order: list[str], sizes: list[int]) -> DataFrame:
    """Adds ``batch`` (from 0) and ``seq``: sizes in turn, the last one again and again. ``order`` must tell rows apart."""
    numbered = running_total(rows.withColumn("_one", F.lit(1)), order, "_one", "seq").drop("_one").withColumn("seq", F.col("seq").cast("int"))
    edges = [sum(sizes[: i + 1]) for i in range(len(sizes))]
    last = F.floor((F.col("seq") - edges[-1]) / sizes[-1]) + len(sizes)
    batch = F.when(F.lit(False), 0)
    for i, edge in enumerate(edges):
        batch = batch.when(F.col("seq") < edge, i)
    return numbered.withColumn("batch", batch.otherwise(last).cast("int"))


def stop_flag(policy: str, score_: Column, correct: Column, located: Column) -> Column:
    """Whether a row stops the run: none, wrong, wrong+location or any."""
    wrong = score_ == -1
    return {"none": F.lit(False), "wrong": wrong, "wrong+location": wrong | (correct & ~located), "any": score_ != 1}[policy]


def until_stop(rows: DataFrame, partition: list[str], order: list[str], stop: str) -> DataFrame:
    """Rows up to and with the first that stops."""
    before = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_s", F.max(F.col(stop).cast("int")).over(before)).filter("coalesce(_s, 0) = 0").drop("_s")


def running_tally(rows: DataFrame, partition: list[str], order: list[str]) -> DataFrame:
    """Cumulative answered, right, wrong and false-answer rate."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    t = rows.withColumn("answered", F.count_if(~F.col("abstained")).over(w)).withColumn("right", F.count_if(F.col("score") == 1).over(w)).withColumn("wrong", F.count_if(F.col("score") == -1).over(w))
    return t.withColumn("false_rate", F.round(F.try_divide(F.col("wrong"), F.col("answered")), 6))


def usage_cost(usage: DataFrame, rates: dict[str, tuple[float, float]]) -> DataFrame:
    """Calls, errors, tokens, seconds and cost by stage; no cost without a rate (input, output per million tokens)."""
    total = usage.groupBy("stage").agg(*[F.sum(c).alias(c) for c in ("calls", "errors", "input_tokens", "output_tokens", "seconds")])
    rate = lambda i: F.coalesce(*[F.when(F.col("stage") == s, F.lit(r[i])) for s, r in rates.items()], F.lit(None).cast("double"))
    return total.withColumn("cost", F.round(F.col("input_tokens") / 1e6 * rate(0) + F.col("output_tokens") / 1e6 * rate(1), 6))


def parameter_grid(spark, base: dict[str, str], variants: dict[str, dict[str, str]]) -> DataFrame:
    """One row per ablation variant with all its settings."""
    return spark.createDataFrame([(name, base | changes) for name, changes in variants.items()], "variant string, settings map<string,string>")


def negative_questions(catalog: DataFrame, per_category: dict[str, int], seed: int = 0) -> DataFrame:
    """Unanswerable questions about catalogued companies, drawn in hash order: years never covered, quarters not filed, unknown metrics."""
    company = catalog.groupBy("company_slug").agg(F.max("fiscal_year").alias("newest"), F.min("fiscal_year").alias("oldest"))
    templates = {
        "future_year": F.format_string("What was the revenue of %s in FY%d?", "company_slug", F.col("newest") + 5),
        "past_year": F.format_string("What was the net income of %s in FY%d?", "company_slug", F.col("oldest") - 10),
        "absent_metric": F.format_string("What is the customer churn by postcode of %s in FY%d?", "company_slug", F.col("newest")),
    }
    rows = None
    for category, text in templates.items():
        order = Window.partitionBy("category").orderBy(F.xxhash64(F.lit(seed), F.lit(category), "company_slug"), "company_slug")
        part = company.select(F.lit(category).alias("category"), "company_slug", text.alias("question")).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_category.get(category, 0))
        rows = part if rows is None else rows.unionByName(part)
    return rows.withColumn("nid", F.format_string("%s-%02d", "category", "n")).withColumn("reviewed", F.lit(False)).drop("n")
