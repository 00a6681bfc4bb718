"""Scores by the answer's shape, and why a question scored what it did: reasons as codes with the figures they rest on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evspark.functions import text as T

from .evaluate import CONTAINMENT, score

# Fixed value: how a yes or no opens an answer.
YES_NO = r"^\s*([yY][eE][sS]|[nN][oO])\b"
NUMERIC, YES_OR_NO = "numeric", "yes_no"


def opening(answer: Column) -> Column:
    """yes or no, if the answer opens with it."""
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(answer, F.lit("")), T.plain_pattern(YES_NO), 1)), F.lit(""))


def nearest(figures: Column, gold: Column) -> Column:
    """The figure that is nearest to ``gold``; of equally near ones the least."""
    return F.array_min(F.transform(figures, lambda c: F.struct(F.abs(c - gold).alias("far"), c.alias("value"))))["value"]


def with_answer_verdict(rows: DataFrame, judged: str | None = None, tolerance: float = 0.005) -> DataFrame:
    """Adds correct, reason, gold_figure, nearest and off (share of the gold figure by which the nearest one misses it).

    ``rows`` has shape, gold, answer and abstained. Figures are compared as figures, yes and no by how answers open; what
    follows a right opening, and free text, is for the judge (boolean column ``judged``); without one it is wrong.
    """
    gold, figures = T.first_number(F.col("gold")), T.all_numbers(F.col("answer"))
    rows = rows.withColumn("gold_figure", gold).withColumn("_figures", figures)
    hit = F.exists("_figures", lambda n: T.within_tolerance(F.col("gold_figure"), n, tolerance))
    said, wanted = opening(F.col("answer")), opening(F.col("gold"))
    verdict = F.coalesce(F.col(judged), F.lit(False)) if judged else F.lit(False)
    numeric = (
        F.when(F.col("gold_figure").isNull(), "gold_has_no_figure")
        .when(F.size("_figures") == 0, "answer_has_no_figure")
        .when(hit, "figure_matches")
        .otherwise("figure_differs")
    )
    yes_no = F.when(wanted.isNull(), "gold_opens_otherwise").when(said.isNull(), "answer_opens_otherwise").when(said != wanted, "verdict_differs").otherwise("verdict_matches")
    reason = F.when(F.col("abstained"), "declined").when(F.col("shape") == NUMERIC, numeric).when(F.col("shape") == YES_OR_NO, yes_no).otherwise("judged")
    rows = rows.withColumn("reason", reason)
    correct = (F.col("reason") == "figure_matches") | (F.col("reason").isin("verdict_matches", "judged") & verdict)
    differs = F.col("reason") == "figure_differs"
    rows = rows.withColumn("correct", correct).withColumn("nearest", F.when(differs, nearest(F.col("_figures"), F.col("gold_figure"))))
    return rows.withColumn("off", F.round(F.try_divide(F.abs(F.col("gold_figure") - F.col("nearest")), F.abs("gold_figure")), 6)).drop("_figures")


def with_location_verdict(rows: DataFrame, containment: float = CONTAINMENT, slack: int = 1) -> DataFrame:
    """Adds located and where.

    ``rows`` has citations (array of doc_id and page_seq), gold_doc, gold_pages (array, empty if none could be mapped) and
    overlap (the best share of the evidence's words on a cited page, or null). A cited page near a gold one is right, and
    so is one that has enough of the evidence.
    """
    own = F.filter(F.coalesce("citations", F.expr("cast(array() as array<struct<doc_id: string, page_seq: int>>)")), lambda c: c["doc_id"] == F.col("gold_doc"))
    close = F.exists(own, lambda c: F.exists(F.coalesce("gold_pages", F.array().cast("array<int>")), lambda g: F.abs(c["page_seq"] - g) <= slack))
    enough = F.coalesce(F.col("overlap") >= containment, F.lit(False)) & (F.size(own) > 0)
    where = (
        F.when(F.coalesce(F.size("citations"), F.lit(0)) <= 0, "no_citations")
        .when(F.size(own) == 0, "wrong_document")
        .when(close, "near_gold_page")
        .when(enough, "evidence_on_page")
        .when(F.coalesce(F.size("gold_pages"), F.lit(0)) <= 0, "gold_page_unmapped")
        .otherwise("evidence_missing")
    )
    return rows.withColumn("where", where).withColumn("located", F.col("where").isin("near_gold_page", "evidence_on_page"))


def scored(rows: DataFrame, judged: str | None = None, tolerance: float = 0.005, containment: float = CONTAINMENT, slack: int = 1) -> DataFrame:
    """Both verdicts and the score."""
    found = with_location_verdict(with_answer_verdict(rows, judged, tolerance), containment, slack)
    return found.withColumn("score", score(F.col("abstained"), F.col("correct"), F.col("located")))


def message(rows: DataFrame, name: str = "explanation") -> DataFrame:
    """Adds the reason as a sentence."""
    plain = {
        "declined": "declined, so there is nothing to compare", "gold_has_no_figure": "the gold answer has no figure", "verdict_differs": "the verdict is the other one",
        "verdict_matches": "the verdict is right; the judge has the rest", "gold_opens_otherwise": "the gold answer opens with neither yes nor no",
        "answer_opens_otherwise": "the answer opens with neither yes nor no", "judged": "free text, for the judge",
    }
    shown = F.col("gold_figure").cast("string")
    text = F.when(F.col("reason") == "answer_has_no_figure", F.concat(F.lit("no figure in the answer, gold is "), shown)).when(F.col("reason") == "figure_matches", F.concat(F.lit("the answer states "), shown))
    differs = F.concat(F.lit("gold "), shown, F.lit(" is not in the answer; nearest is "), F.col("nearest").cast("string"), F.coalesce(F.concat(F.lit(", off by "), F.format_number(F.col("off") * 100, 2), F.lit("%")), F.lit("")))
    return rows.withColumn(name, text.when(F.col("reason") == "figure_differs", differs).otherwise(F.create_map(*[F.lit(x) for kv in plain.items() for x in kv])[F.col("reason")]))
