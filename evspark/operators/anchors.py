"""Structural retrieval: pages whose head names a statement, and the spans of narrative sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD_CHARS = 600
SPAN_PAGES = 60
TOP_PAGES = 40
SPAN_BUCKET = "mdna_span"

# Statement titles, in the order of their buckets.
STATEMENT_TITLES = {
    "income": r"(?i)(consolidated|condensed).{0,40}statements? of (income|operations|earnings)",
    "balance": r"(?i)(consolidated|condensed).{0,40}(balance sheets?|statements? of financial position)",
    "cashflow": r"(?i)(consolidated|condensed).{0,40}statements? of cash flows?",
    "equity": r"(?i)statements? of (stockholders|shareholders).{0,20}equity",
    "compinc": r"(?i)statements? of comprehensive (income|loss)",
    "segment": r"(?i)(segment|business segment).{0,30}(information|reporting|results)",
    "mdna": r"(?i)management.s discussion and analysis",
}
# Question vocabulary and the statement that answers it, in order.
QUESTION_HINTS = (
    (r"(?i)\b(capex|capital expenditure|cash flow|dividend|share repurchase|buyback|financing activities|investing activities|depreciation|amortization|free cash flow)\b", "cashflow"),
    (r"(?i)\b(total assets|current assets|current liabilities|inventor(y|ies)|receivable|payable|goodwill|debt|equity|working capital|balance sheet|liquidity|quick ratio|current ratio)\b", "balance"),
    (r"(?i)\b(revenue|sales|gross (profit|margin)|operating (income|margin)|net income|earnings|eps|cost of (goods|revenue)|tax rate|income statement|profit)\b", "income"),
    (r"(?i)\bsegment\b|\bbusiness unit\b|\bwhich division\b", "segment"),
    (r"(?i)\b(why|drove|driver|dragged?|trend|outlook|guidance|forecast|expects?|organic(ally)?|constant currency|like.for.like|results of operations|management.s discussion)\b|excluding (the )?(impact of )?(m&a|acquisitions?|divestitures?)", "mdna"),
    (r"(?i)\bcomprehensive income\b", "compinc"),
    (r"(?i)\b(stockholders|shareholders).{0,3} equity\b", "equity"),
)
STOP_WORDS = (
    "the a an and or of in on for to from by with as at is are was were be been what which how much many did does do this that these those "
    "it its their there has have had will would can could not no than then thus also"
).split()
QUERY_WORD = r"([a-z][a-z0-9']+)"


def statement_hints(question: Column) -> Column:
    """Statements that a question is likely answered from, most likely first."""
    return F.array_compact(F.array(*[F.when(question.rlike(p), F.lit(s)) for p, s in QUESTION_HINTS]))


def anchor_index(pages: DataFrame) -> DataFrame:
    """bucket, doc_id, page_seq: pages whose head matches a title, and the page after each."""
    head = F.left("raw_text", F.lit(HEAD_CHARS))
    buckets = F.array_compact(F.array(*[F.when(head.rlike(p), F.lit(s)) for s, p in STATEMENT_TITLES.items()]))
    titled = pages.select("doc_id", "page_seq", F.explode(buckets).alias("bucket"))
    reached = titled.select("bucket", "doc_id", F.explode(F.array("page_seq", F.col("page_seq") + 1)).alias("page_seq")).distinct()
    return reached.join(pages.select("doc_id", "page_seq"), ["doc_id", "page_seq"], "left_semi").select("bucket", "doc_id", "page_seq")


def narrative_pages(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page_seq, raw_text of narrative sections' whole spans, at most SPAN_PAGES beyond the start."""
    narrative = sections.filter((F.col("kind") != "statement") & ((F.col("kind") == "mdna") | F.lower(F.coalesce("raw_title", F.lit(""))).contains("discussion and analysis")))
    end = F.least(F.greatest(F.coalesce("page_end", "page_start"), F.col("page_start")), F.col("page_start") + SPAN_PAGES)
    spans = narrative.select("doc_id", F.explode(F.sequence("page_start", end)).alias("page_seq")).distinct()
    return pages.select("doc_id", "page_seq", "raw_text").join(spans, ["doc_id", "page_seq"], "left_semi")


def anchor_search(questions: DataFrame, scope: DataFrame, pages: DataFrame, sections: DataFrame | None = None, k: int = TOP_PAGES) -> DataFrame:
    """qid, doc_id, page_seq, score, bucket and rank for questions (qid, question) and their documents (qid, doc_id, position).

    Hinted buckets come first, then the narrative span if hinted, then the other statements; a page keeps its best bucket.
    """
    hinted = questions.select("qid", "question", statement_hints(F.col("question")).alias("hints"))
    others = F.array(*map(F.lit, STATEMENT_TITLES))
    span = F.when(F.array_contains("hints", "mdna"), F.array(F.lit(SPAN_BUCKET))).otherwise(F.array().cast("array<string>"))
    order = hinted.select("qid", "question", F.posexplode(F.concat("hints", span, F.array_except(others, "hints"))).alias("at", "bucket"))
    index = anchor_index(pages).withColumn("overlap", F.lit(0))
    found = order.join(scope, "qid").join(index, ["bucket", "doc_id"])
    if sections is not None:
        words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("question"), F.lit(QUERY_WORD), F.lit(1)), lambda w: ~w.isin(STOP_WORDS)))
        spans = order.filter(F.col("bucket") == SPAN_BUCKET).join(scope, "qid").join(narrative_pages(sections, pages), "doc_id")
        ranked = spans.withColumn("overlap", F.size(F.filter(words, lambda w: F.lower("raw_text").contains(w)))).select(*found.columns)
        found = found.unionByName(ranked)
    scored = found.withColumn("score", 1 / (1 + F.col("at")))
    best = scored.groupBy("qid", "doc_id", "page_seq", "position").agg(F.max_by(F.struct("score", "bucket", "overlap"), F.struct("score", "overlap")).alias("b"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("b.score"), F.desc("b.overlap"), "position", "page_seq"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("qid", "doc_id", "page_seq", "b.score", "b.bucket", "rank")


def recall_at(rankings: dict[str, DataFrame], gold: DataFrame, keys: list[str]) -> DataFrame:
    """For each named configuration: the share of gold questions with a gold page among its pages, and the mean pages."""
    parts = []
    for name, pages in rankings.items():
        hit = gold.join(pages.select("qid", *keys).distinct(), ["qid", *keys], "left_semi").select("qid").distinct().withColumn("hit", F.lit(1))
        sizes = pages.select("qid", *keys).distinct().groupBy("qid").agg(F.count(F.lit(1)).alias("n_pages"))
        per = gold.select("qid").distinct().join(hit, "qid", "left").join(sizes, "qid", "left")
        parts.append(per.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"), F.avg(F.coalesce("n_pages", F.lit(0))).alias("pages")).withColumn("configuration", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)
