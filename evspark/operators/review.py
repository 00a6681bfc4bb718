"""Mechanical review of questions that should have no answer: phrases looked for in all pages, periods in the catalogue.

Phrases are found by one automaton for all of them, built in each task, so every page is read once whatever the number of
phrases; no phrase is joined with a page. What a task finds is a page's hits, combined by company before they move.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evspark.functions.text import years_in

# Categories, and the words that mark a question about a quarter.
WRONG_FILING, MISSING_METRIC, FALSE_PREMISE, MISSING_OPERAND, OUTSIDE_FILING = "wrong_filing_or_period", "missing_metric", "false_premise", "missing_operand", "outside_filing"
QUARTER = r"(?i)\bq([1-4])\b"
VERIFIED, NEEDS_EYES, CONTRADICTED = "verified", "needs_eyes", "contradicted"
NEVER_FILED = 4
#: Bytes of phrases that one automaton holds; more of them take another pass over the pages.
PHRASE_BYTES = 8 << 20


def phrase_hits(pages: DataFrame, phrases: DataFrame, company: str, page: str, text: str, phrase: str = "phrase", most_bytes: int = PHRASE_BYTES) -> DataFrame:
    """company, phrase, n_pages and first_page for each phrase that stands in a page of the company, whatever the case.

    Empty phrases are left out. The phrases of one automaton come to the driver; they take at most ``most_bytes``.
    """
    kinds = dict(pages.dtypes)
    ddl = f"company {kinds[company]}, phrase string, page {kinds[page]}"
    wanted = phrases.select(F.lower(phrase).alias("phrase")).filter("phrase != ''").distinct()
    size = wanted.agg(F.sum(F.octet_length("phrase"))).first()[0] or 0
    parts = max(1, -(-2 * size // most_bytes)) if size > most_bytes else 1
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ddl))
    found = None
    for part in range(parts):
        listed = [r[0] for r in wanted.filter(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == part).collect()]

        def kernel(batches: Iterator[pa.RecordBatch], listed: list[str] = listed) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for value in listed:
                automaton.add_word(value, value)
            automaton.make_automaton()
            for batch in batches:
                rows: list[tuple] = []
                for i in range(batch.num_rows if listed else 0):
                    body = batch.column(2)[i].as_py()
                    if body:
                        owner, at = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                        rows.extend((owner, hit, at) for hit in {value for _, value in automaton.iter(body)})
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

        hits = pages.select(F.col(company), F.col(page), F.lower(text)).mapInArrow(kernel, ddl)
        found = hits if found is None else found.unionByName(hits)
    return found.groupBy("company", "phrase").agg(F.count(F.lit(1)).alias("n_pages"), F.min("page").alias("first_page"))


def coverage(catalog: DataFrame) -> DataFrame:
    """company_slug with the years and quarters that its filings cover."""
    year = F.when(F.col("fiscal_year").isNotNull(), F.array("fiscal_year"))
    years = F.concat(F.coalesce("coverage_years", F.array().cast("array<int>")), F.coalesce(year, F.array().cast("array<int>")))
    each = catalog.select("company_slug", "fiscal_quarter", F.explode_outer(F.array_distinct(years)).alias("year"))
    return each.groupBy("company_slug").agg(F.sort_array(F.collect_set("year")).alias("years"), F.sort_array(F.collect_set("fiscal_quarter")).alias("quarters"))


def review(negatives: DataFrame, catalog: DataFrame, hits: DataFrame, phrases: DataFrame) -> DataFrame:
    """nid, status, reason and found (phrases of the question that its company's pages do have, in order).

    ``negatives`` has nid, question, category, company_slug and tags; ``phrases`` nid and phrase; ``hits`` comes from
    ``phrase_hits``.
    """
    probed = phrases.select("nid", F.lower("phrase").alias("phrase")).filter("phrase != ''").distinct().join(negatives.select("nid", "company_slug"), "nid")
    met = probed.join(hits.select(F.col("company").alias("company_slug"), "phrase", "n_pages"), ["company_slug", "phrase"], "left")
    probes = met.groupBy("nid").agg(F.count(F.lit(1)).alias("n_phrases"), F.sort_array(F.collect_list(F.when(F.col("n_pages") > 0, F.col("phrase")))).alias("found"))
    rows = negatives.join(probes, "nid", "left").join(coverage(catalog), "company_slug", "left")
    none = F.array().cast("array<int>")
    asked, covered, filed = years_in(F.coalesce("question", F.lit(""))), F.coalesce("years", none), F.coalesce("quarters", none)
    quarter = F.regexp_extract(F.coalesce("question", F.lit("")), QUARTER, 1).try_cast("int")
    about_quarter = quarter.isNotNull() | F.coalesce(F.array_contains("tags", "wrong_quarter"), F.lit(False))
    beyond = F.array_except(asked, covered)

    def verdict(status: str, reason: str) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))

    period = (
        F.when(about_quarter & (quarter == NEVER_FILED), verdict(VERIFIED, "quarter_never_filed"))
        .when(about_quarter & quarter.isNull(), verdict(NEEDS_EYES, "no_quarter_in_question"))
        .when(about_quarter & F.array_contains(filed, quarter), verdict(CONTRADICTED, "quarter_on_file"))
        .when(about_quarter, verdict(VERIFIED, "quarter_not_on_file"))
        .when(F.size(beyond) < F.size(asked), verdict(CONTRADICTED, "year_covered"))
        .when((F.size(asked) > 0) & (F.size(covered) > 0), verdict(VERIFIED, "year_not_covered"))
        .otherwise(verdict(NEEDS_EYES, "no_year_to_compare"))
    )
    text = (
        F.when(F.col("years").isNull(), verdict(NEEDS_EYES, "no_text"))
        .when(F.coalesce("n_phrases", F.lit(0)) == 0, verdict(NEEDS_EYES, "no_phrase"))
        .when(F.size("found") == 0, verdict(VERIFIED, "phrase_absent"))
        .otherwise(verdict(NEEDS_EYES, "phrase_present"))
    )
    kind = F.col("category")
    by_category = F.when(kind == WRONG_FILING, period).when(kind == OUTSIDE_FILING, verdict(VERIFIED, "outside_by_category")).when(kind.isin(MISSING_METRIC, FALSE_PREMISE), text).otherwise(verdict(NEEDS_EYES, "not_decidable"))
    return rows.select("nid", "category", by_category.alias("v"), F.coalesce("found", F.array().cast("array<string>")).alias("found")).select("nid", "category", "v.status", "v.reason", "found")
