"""Acceptance gates: ordered predicates over an answer row, the first failure reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evspark.functions.text import all_numbers, normalise_quote

MIN_QUOTE = 12
ORDER = ("G1", "G1b", "G2", "G3", "G4", "G5", "G6", "G7")


def quote_supported(quote: Column, page_text: Column, least: int = MIN_QUOTE) -> Column:
    """G1 for one citation: long enough, and found in the page once both are normalised."""
    q = normalise_quote(quote)
    return F.coalesce((F.length(q) >= least) & F.contains(normalise_quote(page_text), q), F.lit(False))


def quotes_gate(citations: DataFrame, pages: DataFrame, qid: str = "qid") -> DataFrame:
    """qid, n citations, supported (every quote found) and retrieved (every page there); citations carry doc_id, page_seq and quote."""
    joined = citations.join(pages.select("doc_id", "page_seq", "raw_text"), ["doc_id", "page_seq"], "left")
    ok = quote_supported(F.col("quote"), F.col("raw_text"))
    return joined.groupBy(qid).agg(F.count(F.lit(1)).alias("citations"), F.bool_and(ok).alias("supported"), F.bool_and(F.col("raw_text").isNotNull()).alias("retrieved"))


def digits_supported(value: Column, quote: Column) -> Column:
    """G1b: the operand's integer digits occur among its quote's digits."""
    return F.contains(F.regexp_replace(quote, "[^0-9]", ""), F.abs(value).cast("decimal(38,0)").cast("string"))


def scope_gate(cited: Column, routed: Column) -> Column:
    """G2: every cited document was routed; passes without a scope."""
    return (F.size(routed) <= 0) | (F.size(F.array_except(cited, routed)) == 0)


def period_gate(evidence_years: Column, coverage: Column, intent: Column) -> Column:
    """G3: some evidence year is covered, or a forecast looks past the coverage."""
    past = (intent == "forecast") & (F.array_max(evidence_years) > F.array_max(coverage))
    return F.coalesce((F.size(evidence_years) == 0) | F.arrays_overlap(evidence_years, coverage) | past, F.lit(False))


def slots_gate(missing: Column, answer_type: Column, computed: Column) -> Column:
    """G4: no slot is missing where the answer is computed or a single figure."""
    return (F.size(missing) == 0) | ~(computed | answer_type.isin("scalar", "ratio"))


def recompute_gate(computed: Column, rounded: Column, prose: Column, tolerance: float = 1e-6) -> Column:
    """G6: some number in the prose is the computed result or its rounded form; passes if nothing was computed."""
    near = lambda n, v: F.abs(n - v) <= tolerance * F.greatest(F.abs(v), F.lit(1e-12))
    return computed.isNull() | F.exists(all_numbers(prose), lambda n: near(n, computed) | near(n, rounded))


def run_gates(answers: DataFrame, gates: dict[str, Column], disabled: tuple[str, ...] = ()) -> DataFrame:
    """Adds first_failure (null if all pass) and trace, which ends with the first failure."""
    active = [(g, gates[g]) for g in ORDER if g in gates and g not in disabled]
    failed = F.coalesce(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(g)) for g, c in active], F.lit(None).cast("string"))
    names = F.array(*[F.lit(g) for g, _ in active])
    upto = F.coalesce(F.array_position(names, F.col("first_failure")), F.size(names)).cast("int")
    return answers.withColumn("first_failure", failed).withColumn("trace", F.slice(names, 1, upto))
