"""What verifiers see, and what they say: cited pages in full, the arithmetic as settled, two verdicts that must both be yes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .provider import Provider, call_provider

#: Characters of a cited page, and the verdicts that accept.
PAGE_CHARS = 6000
ACCEPTS = ("VALID", "SUPPORTED")


def cited_pages(citations: DataFrame, pages: DataFrame, qid: str = "qid") -> DataFrame:
    """qid and cited: each page that a question cites, once, in order of document and page, its first characters.

    Equal evidence gives equal text. Pages that are not there or have no text are left out. Texts are cut before they move.
    """
    wanted = citations.select(qid, "doc_id", "page_seq").filter("doc_id is not null and page_seq is not null").distinct()
    heads = pages.select("doc_id", "page_seq", F.left("raw_text", F.lit(PAGE_CHARS)).alias("head")).filter("head != ''")
    blocks = wanted.join(heads, ["doc_id", "page_seq"])
    ordered = F.sort_array(F.collect_list(F.struct("doc_id", "page_seq", "head")))
    shown = F.transform(ordered, lambda p: F.concat(F.lit("--- "), p["doc_id"], F.lit(" page "), p["page_seq"].cast("string"), F.lit(" ---\n"), p["head"]))
    return blocks.groupBy(qid).agg(F.array_join(shown, "\n\n").alias("cited"))


def computation_brief(formula: Column, operands: Column, shown: Column) -> Column:
    """What a verifier is told of a computed answer: that its arithmetic stands, and to look at the operands only. Null without a formula."""
    named = F.array_join(F.transform(F.array_sort(F.map_entries(operands)), lambda e: F.concat(e["key"], F.lit(" = "), e["value"].cast("string"))), "; ")
    lines = [F.lit("The result below was computed and checked; do not work it out again."), F.concat(F.lit("Formula: "), formula), F.concat(F.lit("Operands: "), named), F.concat(F.lit("Result: "), shown), F.lit("Say whether each operand stands in the quotes, for the period and in the unit asked for.")]
    return F.when(F.coalesce(formula, F.lit("")) != "", F.concat_ws("\n", *lines))


def verifier_prompt(question: Column, answer: Column, quotes: Column, brief: Column, cited: Column) -> Column:
    """Question, answer, quotes (an array), brief and cited pages; what is missing is left out."""
    return F.concat_ws("\n\n", F.concat(F.lit("QUESTION:\n"), question), F.concat(F.lit("ANSWER:\n"), answer), F.concat(F.lit("QUOTES:\n"), F.array_join(quotes, "\n")), brief, F.concat(F.lit("CITED PAGES:\n"), cited))


def verified(rows: DataFrame, prompt: str, first: Callable[[], Provider], second: Callable[[], Provider] | None) -> DataFrame:
    """Adds verdict_a, verdict_b and verified. Both see the same text; an error or any other verdict is a no. Without a second one, the first decides."""
    for name, factory in (("a", first), ("b", second)):
        if factory is None:
            rows = rows.withColumn("verdict_b", F.lit(None).cast("string"))
            continue
        found = call_provider(rows, prompt, factory)
        verdict = F.upper(F.try_variant_get(F.try_parse_json("output"), "$.verdict", "string"))
        rows = found.withColumn(f"verdict_{name}", verdict).drop("output", "error", "input_tokens", "output_tokens", "attempts")
    accepts = lambda c: F.coalesce(F.col(c).isin(*ACCEPTS), F.lit(False))
    return rows.withColumn("verified", accepts("verdict_a") & (F.lit(second is None) | accepts("verdict_b")))
