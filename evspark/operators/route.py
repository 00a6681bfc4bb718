"""Routing questions to documents: aliases decide, then years, forms and dates add up to a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evspark.functions.text import normalise_question, text_of, years_in

# What each agreement between a question and a document is worth.
BASE = 10
YEAR_LATEST, YEAR_NAMED, YEAR_COVERED, YEAR_OTHER = 25, 8, 4, -15
NEWEST, NOT_NEWEST = 6, -3
QUARTERLY_ASKED, QUARTERLY_UNASKED, QUARTER_EQUAL, QUARTER_OTHER = 6, -6, 6, -4
ANNUAL_UNASKED, ANNUAL_ASKED = 4, -3
EVENT_ASKED, EVENT_UNASKED, EVENT_DATE = 5, -4, 8
QUARTER = r"\bq([1-4])\b"
EVENT_WORDS = r"8-k|announce|press release|agm|vote|nominee|credit agreement|separation|spin"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MONTH_DAY = r"(?i)\b((?:" + "|".join(MONTHS) + r")\s+\d{1,2})"


def prepare_questions(questions: DataFrame, question: str = "question") -> DataFrame:
    """Adds what scoring needs: the normalised text, years, quarter and month-days (as month * 100 + day)."""
    raw = F.regexp_extract_all(F.lower(text_of(question)), F.lit(MONTH_DAY), F.lit(1))
    month = lambda m: F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(m, r"^([a-z]+)", 1))
    days = F.transform(raw, lambda m: (month(m) * 100 + F.regexp_extract(m, r"(\d+)$", 1).cast("int")).cast("int"))
    q = questions.withColumn("ql", normalise_question(F.col(question))).withColumn("years", years_in(F.col(question)))
    return q.withColumn("quarter", F.regexp_extract("ql", QUARTER, 1).try_cast("int")).withColumn("event_days", days)


def alias_matches(questions: DataFrame, aliases: DataFrame, qid: str = "qid") -> DataFrame:
    """(qid, company_slug, names) where some of the company's aliases (names) stand in the question as whole words.

    Both sides are cut to word sequences of the aliases' lengths, so this is an equi-join, not a comparison of all pairs.
    """
    sized = aliases.select("company_slug", F.lower("alias").alias("alias")).withColumn("n_words", F.size(F.split("alias", " ")))
    lengths = sized.select("n_words").distinct().agg(F.collect_set("n_words").alias("lengths"))
    words = questions.select(qid, F.split(F.trim(F.regexp_replace("ql", " +", " ")), " ").alias("w")).withColumn("lengths", lengths.scalar())
    spans = words.select(qid, "w", F.explode("lengths").alias("n_words")).filter(F.size("w") >= F.col("n_words"))
    grams = spans.select(qid, "n_words", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n_words") + 1), lambda i: F.array_join(F.slice("w", i, F.col("n_words")), " "))).alias("alias"))
    return grams.join(sized, ["n_words", "alias"]).groupBy(qid, "company_slug").agg(F.collect_set("alias").alias("names"))


def years_beside(names: Column) -> Column:
    """A question's years that stand outside the names in it: a company may be named like a year."""
    apart = lambda text: F.regexp_replace(text, " +", "  ")  # noqa: E731  each word has its own spaces
    longest_first = F.reverse(F.array_sort(F.transform(names, lambda n: F.struct(F.length(n).alias("size"), n.alias("name")))))
    rest = F.aggregate(longest_first, apart(F.col("ql")), lambda text, n: F.replace(text, F.concat(F.lit(" "), apart(n["name"]), F.lit(" ")), F.lit(" ")))
    return F.array_intersect("years", years_in(rest))


def route_score(doc: str = "d", prefer_coverage: bool = True) -> Column:
    """Score over columns ql, years, quarter, event_days and form_type, fiscal_year, fiscal_quarter, filing_date, coverage_years, max_year."""
    named = F.size("years") > 0
    covered = F.arrays_overlap("years", "coverage_years") if prefer_coverage else F.lit(False)
    year = (
        F.when(named & (F.col("fiscal_year") == F.array_max("years")), YEAR_LATEST)
        .when(named & F.array_contains("years", F.col("fiscal_year")), YEAR_NAMED)
        .when(named & covered, YEAR_COVERED)
        .when(named, YEAR_OTHER)
        .when(F.col("fiscal_year") == F.col("max_year"), NEWEST)
        .otherwise(NOT_NEWEST)
    )
    quarterly = F.col("quarter").isNotNull() | F.col("ql").contains("quarter")
    equal = F.when(F.col("quarter").isNull(), 0).when(F.col("fiscal_quarter") == F.col("quarter"), QUARTER_EQUAL).otherwise(QUARTER_OTHER)
    form = (
        F.when(F.col("form_type") == "10-Q", F.when(quarterly, QUARTERLY_ASKED).otherwise(QUARTERLY_UNASKED) + equal)
        .when(F.col("form_type") == "10-K", F.when(quarterly, ANNUAL_ASKED).otherwise(ANNUAL_UNASKED))
        .when(F.col("form_type") == "8-K", F.when(F.col("ql").rlike(EVENT_WORDS), EVENT_ASKED).otherwise(EVENT_UNASKED))
        .otherwise(0)
    )
    filed = F.month("filing_date") * 100 + F.dayofmonth("filing_date")
    near = F.filter("event_days", lambda d: (filed >= d) & (F.month("filing_date") - F.floor(d / 100) <= 1))
    events = F.when(F.col("filing_date").isNotNull(), F.size(near) * EVENT_DATE).otherwise(0)
    return (F.lit(BASE) + year + form + events).cast("int")


def route(questions: DataFrame, catalog: DataFrame, aliases: DataFrame, top_k: int = 4, question: str = "question", qid: str = "qid") -> DataFrame:
    """qid, doc_id, score, rank and needs_clarification; a question that no alias matches has one row without a document."""
    asked = prepare_questions(questions, question)
    newest = catalog.withColumn("max_year", F.max("fiscal_year").over(Window.partitionBy("company_slug")))
    named = F.flatten(F.collect_list("names").over(Window.partitionBy(qid)))
    matched = alias_matches(asked, aliases, qid).withColumn("names", named).join(asked, qid).withColumn("years", years_beside(F.col("names")))
    scored = matched.join(newest, "company_slug").withColumn("score", route_score())
    order = Window.partitionBy(qid).orderBy(F.desc("score"), F.desc("fiscal_year"), F.asc("doc_id"))
    top = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k).select(qid, "doc_id", "score", "rank")
    return asked.select(qid).join(top, qid, "left").withColumn("needs_clarification", F.col("doc_id").isNull())
