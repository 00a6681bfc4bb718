"""Answering questions over pages: retrieve, assemble, extract, compute, compose, gate; what is not answered is tried once more, deeper.

All questions go through each step together. Model calls go through a provider (see ``operators.provider``); a question
that fails anywhere ends as a refusal with its reason, it does not end the job.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evspark.functions import text as T
from evspark.operators import anchors, formulas, fusion, gates, lexical, metrics, provider, slots

from .stage import written

REFUSAL = "Not found in this filing."


@dataclass(frozen=True)
class Tier:
    """How deep a round of retrieval goes."""

    k: int
    distance: int


TIERS = (Tier(20, 1), Tier(40, 2))
BUDGET = 42_000


def lexical_index(paged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pages' tokens, cut where they are used, and their statistics as a stored table, a row a term."""
    return paged, written(lexical.term_statistics(paged), "term-statistics")


def retrieve(questions: DataFrame, scope: DataFrame, pages: DataFrame, sections: DataFrame, tier: Tier) -> list[tuple[str, DataFrame, float]]:
    """Structural and lexical rankings (qid, page_id, rank) within each question's documents. Lexical statistics stay those of all pages."""
    asked = questions.select("qid", "question")
    keyed = pages.select("page_id", "doc_id", "page_seq")
    structural = anchors.anchor_search(asked, scope, pages, sections).join(keyed, ["doc_id", "page_seq"]).select("qid", "page_id", "rank")
    paged = lexical.page_tokens(pages, "page_id", F.coalesce(F.nullif("lexical_text", F.lit("")), "raw_text") if "lexical_text" in pages.columns else F.col("raw_text"), "doc_id")
    paged, counts = lexical_index(paged)
    scores = lexical.bm25_scores(paged, asked, "page_id", "qid", F.col("question"), "doc_id", counts).join(scope.select("qid", "doc_id"), ["qid", "doc_id"], "left_semi")
    words = lexical.top_pages(scores, "qid", "page_id", tier.k, "doc_id").select("qid", "page_id", "rank")
    return [("anchors", written(structural, "anchors"), 1.0), ("bm25", written(words, "bm25"), 1.0)]


def assemble(rankings: list[tuple[str, DataFrame, float]], pages: DataFrame, tier: Tier, budget: int = BUDGET) -> DataFrame:
    """qid, doc_id, page_seq, page_id and raw_text of the pages that fit the budget: fused, with neighbours as one more
    ranking, packed in rank order. Only raw text reaches what follows."""
    keyed = pages.select("page_id", "doc_id", "page_seq", "raw_text")
    pool = fusion.ordered_union([df for _, df, _ in rankings], "qid", "page_id").join(keyed, "page_id")
    hits = pool.select("qid", "doc_id", "page_seq", F.lit(1.0).alias("score"), F.col("position").alias("rank"))
    near = fusion.neighbours(hits, keyed, "qid", "doc_id", "page_seq", tier.distance).join(keyed, ["doc_id", "page_seq"])
    claimed = F.row_number().over(Window.partitionBy("qid").orderBy("claimed_by", "page_seq", "page_id"))
    neighbours = near.select("qid", "page_id", claimed.alias("rank"))
    fused = fusion.rrf([*rankings, ("neighbours", neighbours, 1.0)], "qid", "page_id").join(keyed, "page_id")
    packed = fusion.pack_budget(fused.withColumn("cost", fusion.item_cost(F.col("raw_text"))), "qid", "page_id", [F.col("rank")], "cost", budget)
    return written(packed.filter("kept").select("qid", "page_id").join(keyed, "page_id"), "assembled")


def contexts(kept: DataFrame) -> DataFrame:
    """One text per question, pages in document order; its size is bounded by the budget."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "page_seq", "raw_text"))), lambda p: p["raw_text"])
    return kept.groupBy("qid").agg(F.array_join(ordered, "\n\n").alias("context"), F.collect_set("doc_id").alias("cited_docs"))


def compose(computed: Column, prose: Column, slot: Column) -> Column:
    """A computed result first, then the model's prose unless it declines, then the best slot's text."""
    written = F.when(F.trim(T.text_of(prose)) == "", None).when(T.reads_as_decline(prose), None).otherwise(prose)
    return F.coalesce(computed, written, slot)


def computed_values(asked: DataFrame, extractor: Callable[[], provider.Provider]) -> DataFrame:
    """qid, shown and missing for questions (with context) that have a formula, their own or the book's: figures come as
    slots out of the extractor's replies and are put into the formula. No model does arithmetic."""
    chosen = formulas.choose_formula(asked).filter("formula != ''").withColumn("required", F.expr(formulas.required_names("formula")))
    names = F.concat(F.lit("SLOT NAMES:\n"), F.array_join(F.transform("required", lambda n: F.concat(F.lit("- "), n)), "\n"))
    prompts = asked.join(chosen, "qid").withColumn("_prompt", F.when(F.col("context").isNotNull(), F.concat_ws("\n\n", "question", names, "context")))
    decoded = written(slots.decode_slots(provider.call_provider(prompts.select("qid", "required", "_prompt"), "_prompt", extractor), "output").select("qid", "required", "slots", F.col("missing").alias("said")), "slots")
    required = decoded.select("qid", F.explode("required").alias("required"))
    operands = slots.slot_operands(slots.slot_rows(decoded), required)
    rows = chosen.join(decoded.select("qid", "said"), "qid").join(operands, "qid", "left").withColumn("operands", F.coalesce("operands", F.create_map().cast("map<string,double>")))
    rows = formulas.with_values(rows, "formula", "operands", parsed="parsed")
    shown = F.round("value", 6).cast("string")
    for name in metrics.METRICS:
        shown = F.when(F.col("metric") == name, metrics.render(F.col("value"), name)).otherwise(shown)
    lost = F.array_distinct(F.concat(F.coalesce("missing", F.array().cast("array<string>")), F.coalesce("said", F.array().cast("array<string>"))))
    return rows.select("qid", shown.alias("shown"), F.when(F.col("value").isNull(), F.when(F.size(lost) > 0, lost).otherwise(F.array("error"))).alias("missing"))


def answer_tier(questions: DataFrame, scope: DataFrame, pages: DataFrame, sections: DataFrame, tier: Tier, factory: Callable[[], provider.Provider], operands: DataFrame | None = None, extractor: Callable[[], provider.Provider] | None = None) -> DataFrame:
    """qid, answer, metric, first_failure and abstain_reason for one round.

    ``operands`` (qid and one column per operand) gives the figures of metric questions, or ``extractor`` reads them from
    the pages; a formula whose figures are missing ends as a refusal. The provider writes the rest.
    """
    kept = assemble(retrieve(questions, scope, pages, sections, tier), pages, tier)
    text = contexts(kept)
    asked = questions.join(text, "qid", "left")
    prompt = F.when(F.col("context").isNotNull(), F.concat_ws("\n\n", "question", "context"))
    replies = written(provider.call_provider(asked.withColumn("prompt", prompt), "prompt", factory), "replies")  # calls are not to be repeated
    rows = replies.join(metrics.choose_metric(questions), "qid", "left")
    computed, complete = F.lit(None).cast("string"), F.lit(True)
    if operands is not None:
        rows = rows.join(operands, "qid", "left")
        for name, (_, formula, *_rest) in metrics.METRICS.items():
            column, needed = metrics.compile_formula(formula)
            if set(needed) <= set(operands.columns):
                computed = F.when(F.col("metric") == name, metrics.render(column, name)).otherwise(computed)
    if extractor is not None:
        rows = rows.join(written(computed_values(asked.select("qid", "question", "context"), extractor), "computed"), "qid", "left")
        computed, complete = F.coalesce(computed, "shown"), F.col("missing").isNull()
    rows = rows.withColumn("answer", compose(computed, F.col("output"), F.lit(None).cast("string"))).withColumn("computed", computed.isNotNull())
    quoted = F.coalesce(F.contains(T.normalise_quote(F.col("context")), T.normalise_quote(F.col("answer"))), F.lit(False)) | F.col("computed")
    gated = gates.run_gates(rows, {"G1": F.col("answer").isNotNull() & quoted, "G4": complete | F.col("computed"), "G7": F.col("context").isNotNull()})
    reason = F.when(F.col("context").isNull(), "no_candidates").when(F.col("error").isNotNull(), F.concat(F.lit("extractor_error:"), "error")).when(~(complete | F.col("computed")), "G4").when(F.col("answer").isNull(), "composer_declined_in_prose").otherwise(F.col("first_failure"))
    return gated.select("qid", "answer", "metric", "first_failure", reason.alias("abstain_reason"))


def answer(questions: DataFrame, scope: DataFrame, pages: DataFrame, sections: DataFrame, factory: Callable[[], provider.Provider], operands: DataFrame | None = None, tiers: tuple[Tier, ...] = TIERS, extractor: Callable[[], provider.Provider] | None = None) -> DataFrame:
    """qid, status, answer, tier and abstain_reason. Each tier sees only what the tiers before left unanswered."""
    left, done = questions, None
    last = None
    for number, tier in enumerate(tiers, 1):
        found = answer_tier(left, scope, pages, sections, tier, factory, operands, extractor).withColumn("tier", F.lit(number))
        found = written(found, "tier")
        accepted = found.filter("abstain_reason is null")
        done = accepted if done is None else done.unionByName(accepted)
        last = found
        left = left.join(accepted.select("qid"), "qid", "left_anti")
    refused = last.filter("abstain_reason is not null").withColumn("answer", F.lit(REFUSAL))
    every = done.unionByName(refused)
    return every.select("qid", F.when(F.col("abstain_reason").isNull(), "answered").otherwise("abstained").alias("status"), "answer", "metric", "tier", "abstain_reason")
