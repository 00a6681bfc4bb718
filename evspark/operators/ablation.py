"""Settings compared on the same evidence: every variant in one job over one scan of the rows.

A row holds what each stage found for a question (which gates passed, what the verifiers said, how deep routing and
retrieval had to go, tokens of context); a variant holds settings. Rows are multiplied by the variants inside the plan
and scored; sums are combined before anything is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GATES = ("G1", "G1b", "G2", "G3", "G4", "G5", "G6", "G7")


@dataclass(frozen=True)
class Settings:
    """What a variant runs with."""

    gates: tuple[str, ...] = GATES
    verifiers: bool = True
    adversarial: bool = True
    reranker: bool = True
    anchors: bool = True
    budget: int = 42_000
    filings: int = 4


def without(*gates: str) -> Settings:
    return Settings(gates=tuple(g for g in GATES if g not in gates))


# The variants that are compared, one change each.
VARIANTS: dict[str, Settings] = {
    "baseline": Settings(),
    "no_llm_verifiers": Settings(verifiers=False),
    "verifier_b_not_adversarial": Settings(adversarial=False),
    "no_gates": without(*GATES),
    "no_G1": without("G1", "G1b"),
    "no_G3": without("G3"),
    "no_G4": without("G4"),
    "no_reranker": Settings(reranker=False),
    "bm25_only": Settings(anchors=False),
    "narrow_budget": Settings(budget=21_000),
    "router_top1": Settings(filings=1),
    "router_top8": Settings(filings=8),
}


def variant_array(variants: dict[str, Settings] | None = None) -> Column:
    """The variants as one literal array of structs."""

    def one(name: str, s: Settings) -> Column:
        gates = F.array(*map(F.lit, s.gates)) if s.gates else F.array().cast("array<string>")
        plain = {"verifiers": s.verifiers, "adversarial": s.adversarial, "reranker": s.reranker, "anchors": s.anchors, "budget": s.budget, "filings": s.filings}
        return F.struct(F.lit(name).alias("variant"), gates.alias("gates"), *[F.lit(v).alias(k) for k, v in plain.items()])

    return F.array(*[one(name, s) for name, s in (variants or VARIANTS).items()])


def run_variants(rows: DataFrame, variants: dict[str, Settings] | None = None) -> DataFrame:
    """Each row under each variant: variant, the row's columns, ``found`` (the evidence got into the context) and ``answered``.

    ``rows`` has failed (array of gates that say no), verifier_a, verifier_b, verifier_b_plain (booleans), route_rank,
    anchor_tokens, rerank_tokens and plain_tokens: the tokens of context up to and with the evidence when structure, the
    reranker or word search alone ranks pages; null where it is not found at all.
    """
    each = rows.select("*", F.explode(variant_array(variants)).alias("v"))
    depth = F.when(F.col("v.reranker") & F.col("v.anchors"), F.least("anchor_tokens", "rerank_tokens")).when(F.col("v.reranker"), F.col("rerank_tokens")).when(F.col("v.anchors"), F.least("anchor_tokens", "plain_tokens")).otherwise(F.col("plain_tokens"))
    found = F.coalesce((F.col("route_rank") <= F.col("v.filings")) & (depth <= F.col("v.budget")), F.lit(False))
    second = F.when(F.col("v.adversarial"), F.col("verifier_b")).otherwise(F.col("verifier_b_plain"))
    verified = ~F.col("v.verifiers") | F.coalesce(F.col("verifier_a") & second, F.lit(False))
    gated = ~F.arrays_overlap(F.coalesce("failed", F.array().cast("array<string>")), "v.gates")
    return each.withColumn("variant", F.col("v.variant")).withColumn("found", found).withColumn("answered", found & verified & gated).drop("v")


def compare(scored: DataFrame) -> DataFrame:
    """By variant: n, answered, right, wrong, score (right minus wrong), false_rate (wrong of answered) and abstain_rate."""
    right, wrong = F.count_if(F.col("answered") & F.col("correct")), F.count_if(F.col("answered") & ~F.col("correct"))
    sums = scored.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.count_if("answered").alias("answered"), right.alias("right"), wrong.alias("wrong"))
    return sums.select("*", (F.col("right") - F.col("wrong")).alias("score"), F.round(F.try_divide("wrong", "answered"), 6).alias("false_rate"), F.round(1 - F.col("answered") / F.col("n"), 6).alias("abstain_rate"))
