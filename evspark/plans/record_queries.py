"""Queries of the answering and evaluation operators that work row by row: formulas, slots, second rankings, reviews, spend, filings, stored indexes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evspark.functions import text as T
from evspark.operators import ablation, explain, formulas, lexical, memo, negatives, rerank, review, runs, slots, spend, verify
from evspark.operators.lexical_store import LexicalStore
from evspark.sources import envelopes, html, xbrl

from .registry import query, table
from .stage import shared_path


def _by_rest(key: str, n: int, *cases: Column) -> Column:
    """The case that the remainder of a key names; the last one stands for all others."""
    chosen = F.when(F.lit(False), cases[0])
    for k, case in enumerate(cases[:-1]):
        chosen = chosen.when(F.col(key) % n == k, case)
    return chosen.otherwise(cases[-1])


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 8 AS k, o_totalprice AS p, CAST(o_custkey AS DOUBLE) AS c, [0, 3, 7][1 + (o_orderkey // 8) % 3] AS m, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS q FROM orders)
    SELECT o_orderkey, 'question' AS source,
        round(CASE k WHEN 0 THEN CASE WHEN m <> 0 THEN (p - c) / m END WHEN 1 THEN -pow(p, 2) + c * 3 WHEN 2 THEN (q + p) / 2 * 2 / 3 WHEN 3 THEN (p - q) / q
            WHEN 4 THEN CASE WHEN p >= c * 100 AND p >= 50000 THEN 1 WHEN c * 100 >= 50000 THEN 2 ELSE 3 END WHEN 5 THEN sign(p - 150000) * c + 10 END, 2) + 0 AS value,
        CASE WHEN k = 0 AND m = 0 THEN 'zero_division' WHEN k IN (2, 3) AND q IS NULL THEN 'missing_operand' WHEN k = 6 THEN 'not_allowed' WHEN k = 7 THEN 'syntax' END AS error FROM o""")
def question_formula(spark, d):
    """Every order asks for a measure with a definition of its own, some of them ill-formed."""
    c = F.col("o_custkey").cast("string")
    m = F.element_at(F.array(*[F.lit(str(x)) for x in (0, 3, 7)]), (F.expr("o_orderkey div 8 % 3") + 1).cast("int"))
    say = F.concat
    formula = _by_rest(
        "o_orderkey", 8,
        say(F.lit("(total_price - "), c, F.lit(") / "), m), say(F.lit("-total_price ** 2 + "), c, F.lit(" * 3")), F.lit("avg(total_price, prev, current) * 2 / 3"), F.lit("delta(total_price) / prev(total_price)"),
        say(F.lit("rank(total_price, "), c, F.lit(" * 100, 50000)")), say(F.lit("compare(total_price, 150000) * "), c, F.lit(" + 10")), say(F.lit("__import__('os').system('"), c, F.lit("')")), say(F.lit("total_price * ("), c, F.lit(" + ")),
    )
    before = F.lag("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    values = F.map_filter(F.create_map(F.lit("total_price"), F.col("o_totalprice"), F.lit("total_price__prev"), before), lambda k, v: v.isNotNull())
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("qid"), F.concat(F.lit("What is the measure, calculated as "), formula, F.lit(" ?")).alias("question"), values.alias("operands"))
    # The operands ride along as a column, so that nothing is joined.
    chosen = formulas.choose_formula(asked.withColumn("key", F.struct("qid", "operands")), "key")
    # A definition that is no formula has its own error, as nothing stands in the book for it.
    rows = chosen.select(F.col("key.qid").alias("o_orderkey"), F.col("key.operands").alias("operands"), "source", "formula", "parsed")
    return formulas.with_values(rows, "formula", "operands", parsed="parsed").select("o_orderkey", "source", F.round("value", 2).alias("value"), "error")


@query("""WITH r AS (SELECT doc_id, doc_id % 6 AS k, n_chars, length(coalesce(text, '')) AS chars FROM documents)
    SELECT doc_id, CASE k WHEN 0 THEN 'whole' WHEN 1 THEN 'truncated' WHEN 2 THEN 'partial' WHEN 3 THEN 'malformed' WHEN 4 THEN 'whole' ELSE 'empty' END AS status,
        CASE k WHEN 0 THEN 2 WHEN 4 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS n_slots, CASE k WHEN 0 THEN 'cogs' WHEN 4 THEN 'cogs' WHEN 2 THEN 'cogs,half' ELSE '' END AS missing,
        CAST(CASE k WHEN 0 THEN 2 * n_chars WHEN 4 THEN 2 * n_chars WHEN 1 THEN -n_chars WHEN 2 THEN -n_chars ELSE 0 END AS DOUBLE) AS total, CASE WHEN k IN (0, 1, 2, 4) THEN chars END AS quote_chars,
        CASE WHEN k IN (0, 2, 4) THEN 'ratio' ELSE 'qualitative' END AS answer_type FROM r""")
def slot_decode(spark, d):
    """A reply for every document, quoting its whole text: whole, cut off, with a slot that has no place, in prose, fenced, blank."""
    docs = table(spark, d, "documents")

    def slot(name: str, value: Column, page: Column, quote: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit("count").alias("unit"), F.col("doc_id").cast("string").alias("doc_id"), page.alias("page_seq"), quote.alias("quote"))

    def reply(page: Column) -> Column:
        first = slot("chars", F.concat(F.lit("("), F.format_number("n_chars", 0), F.lit(")")), F.lit("1"), F.coalesce("text", F.lit("")))
        second = slot("half", F.concat(F.lit("$"), (F.col("n_chars") * 3).cast("string")), page, F.lit("a brace } and a quote \" inside"))
        return F.to_json(F.struct(F.array(first, second).alias("slots"), F.array(F.lit("cogs")).alias("missing_slots"), F.lit("ratio").alias("answer_type")))

    whole, lost = reply(F.lit("2")), reply(F.lit("n/a"))
    text = _by_rest("doc_id", 6, whole, F.expr("substring(whole, 1, length(whole) - 90)"), lost, F.concat(F.lit("I cannot say. "), F.coalesce("text", F.lit(""))), F.concat(F.lit("```json\n"), whole, F.lit("\n```")), F.lit("  \n"))
    decoded = slots.decode_slots(docs.withColumn("whole", whole).select("doc_id", text.alias("reply")))
    total = F.expr("coalesce(aggregate(slots, cast(0 as double), (t, s) -> t + coalesce(cast(s.amount as double), 0)), 0)")
    return decoded.select("doc_id", "status", F.size("slots").alias("n_slots"), F.array_join("missing", ",").alias("missing"), total.alias("total"), F.length(F.get("slots", F.lit(0))["quote"]).alias("quote_chars"), "answer_type")


class LengthReranker:
    """Scores by length; questions of some lengths find it out of order."""

    def rerank(self, question: str, documents: list[str]) -> list[float]:
        if len(question) % 3 == 0:
            raise RuntimeError("out of order")
        return [len(x) % 997 for x in documents]


def _scores_sql(documents: str = "documents") -> str:
    from .queries import _SCORES

    return _SCORES.replace("FROM documents", f"FROM {documents}")


def rerank_head_sql() -> str:
    from .queries import _GLOBAL

    return f"""WITH {_scores_sql()}, {_GLOBAL},
        base AS (SELECT r.item_id, r.doc_id, r.rank, length(b.text) % 3 = 0 AS failed, length(substr(coalesce(x.text, ''), 1, 4000)) % 997 AS s FROM ranked r JOIN benchmark b USING (item_id) JOIN documents x USING (doc_id) WHERE rank <= 30)
        SELECT item_id, doc_id, CAST(CASE WHEN rank > 15 OR failed THEN rank ELSE row_number() OVER (PARTITION BY item_id ORDER BY rank > 15, s DESC, rank) END AS INT) AS rank, CASE WHEN rank <= 15 AND NOT failed THEN CAST(s AS DOUBLE) END AS score, failed AND rank <= 15 AS failed FROM base"""


@query()
def rerank_head(spark, d):
    """The first 15 of 30 pages of each passage ranked anew."""
    from .queries import global_ranking

    docs, asked = table(spark, d, "documents"), table(spark, d, "benchmark").select("item_id", F.col("text").alias("question"))
    base = global_ranking(spark, d, 30).select("item_id", "doc_id", "rank").join(docs.select("doc_id", "text"), "doc_id").join(asked, "item_id")
    found = rerank.rerank_head(base, LengthReranker, 5, "item_id", "doc_id")
    return found.select("item_id", "doc_id", "rank", "score", F.col("error").isNotNull().alias("failed"))


_NEGATIVES = """n AS (SELECT doc_id AS nid, source AS company, doc_id % 5 AS k, CASE WHEN doc_id % 2 = 0 THEN 2015 + doc_id % 12 END AS y, CASE WHEN doc_id % 2 = 1 THEN 1 + doc_id % 4 END AS q, lower(list_aggregate(string_split(b.text, ' ')[1:1 + doc_id % 4], 'string_agg', ' ')) AS phrase
        FROM documents LEFT JOIN benchmark b ON b.item_id = doc_id % 40),
    p AS (SELECT DISTINCT phrase FROM n WHERE phrase IS NOT NULL AND phrase <> ''),
    h AS (SELECT DISTINCT source AS company, phrase FROM documents JOIN p ON contains(lower(text), phrase)),
    c AS (SELECT source AS company, list(DISTINCT 2010 + n_chars % 8) AS ys, list(DISTINCT 2009 + n_chars % 8) AS zs, list(DISTINCT doc_id % 3) FILTER (doc_id % 3 > 0) AS qs FROM documents GROUP BY 1)"""


@query(f"""WITH {_NEGATIVES}, v AS (
        SELECT nid, CASE k WHEN 0 THEN 'wrong_filing_or_period' WHEN 1 THEN 'missing_metric' WHEN 2 THEN 'false_premise' WHEN 3 THEN 'missing_operand' ELSE 'outside_filing' END AS category, phrase, h.phrase IS NOT NULL AS met,
        CASE WHEN k = 4 THEN 'outside_by_category' WHEN k = 3 THEN 'not_decidable' WHEN k IN (1, 2) THEN CASE WHEN coalesce(phrase, '') = '' THEN 'no_phrase' WHEN h.phrase IS NULL THEN 'phrase_absent' ELSE 'phrase_present' END
            WHEN q = 4 THEN 'quarter_never_filed' WHEN q IS NOT NULL THEN CASE WHEN list_contains(qs, q) THEN 'quarter_on_file' ELSE 'quarter_not_on_file' END
            WHEN list_contains(ys, y) OR list_contains(zs, y) THEN 'year_covered' ELSE 'year_not_covered' END AS reason
        FROM n LEFT JOIN h USING (company, phrase) LEFT JOIN c USING (company))
    SELECT nid, category, CASE WHEN reason IN ('outside_by_category', 'phrase_absent', 'quarter_never_filed', 'quarter_not_on_file', 'year_not_covered') THEN 'verified' WHEN reason IN ('quarter_on_file', 'year_covered') THEN 'contradicted' ELSE 'needs_eyes' END AS status,
        reason, CASE WHEN met THEN phrase ELSE '' END AS found FROM v""")
def negative_review(spark, d):
    """A question that should have no answer for every document, of its source; phrases are openings of benchmark passages, looked for in all texts."""
    docs = table(spark, d, "documents")
    opening = F.array_join(F.slice(F.split("b_text", " "), F.lit(1), (F.lit(1) + F.col("doc_id") % 4).cast("int")), " ")
    passages = table(spark, d, "benchmark").select("item_id", F.col("text").alias("b_text"))
    period = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("What was the revenue in FY"), (2015 + F.col("doc_id") % 12).cast("string"), F.lit("?"))).otherwise(F.concat(F.lit("What was the income in Q"), (1 + F.col("doc_id") % 4).cast("string"), F.lit("?")))
    kind = _by_rest("doc_id", 5, *[F.lit(c) for c in (review.WRONG_FILING, review.MISSING_METRIC, review.FALSE_PREMISE, review.MISSING_OPERAND, review.OUTSIDE_FILING)])
    rows = docs.join(passages, F.col("item_id") == F.col("doc_id") % 40, "left")
    negatives = docs.select(F.col("doc_id").alias("nid"), period.alias("question"), kind.alias("category"), F.col("source").alias("company_slug"), F.array().cast("array<string>").alias("tags"))
    phrases = rows.select(F.col("doc_id").alias("nid"), opening.alias("phrase")).filter("phrase is not null")
    year = (2010 + F.col("n_chars") % 8).cast("int")
    catalog = docs.select(F.col("source").alias("company_slug"), year.alias("fiscal_year"), F.nullif((F.col("doc_id") % 3).cast("int"), F.lit(0)).alias("fiscal_quarter"), F.array(year - 1, year).alias("coverage_years"))
    found = review.review(negatives, catalog, review.phrase_hits(docs, phrases, "source", "doc_id", "text"), phrases)
    return found.select("nid", "category", "status", "reason", F.array_join("found", ",").alias("found"))


@query("""WITH s AS (SELECT event_id, CAST(floor(value * 10) AS BIGINT) AS tokens, ts FROM events), t AS (SELECT event_id, tokens, CAST(coalesce(sum(tokens) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS total_before FROM s)
    SELECT event_id, tokens, total_before, total_before < 2000000 AS ran FROM t""")
def spend_stop(spark, d):
    """Events in order of time as questions that spend tokens, up to two million."""
    rows = table(spark, d, "events").select("event_id", "ts", F.floor(F.col("value") * 10).cast("long").alias("tokens"))
    return spend.until_ceiling(rows, ["ts", "event_id"], "tokens", 2_000_000).select("event_id", "tokens", "total_before", "ran")


@query("""SELECT CAST(user_id AS VARCHAR) AS qid, stage, count(*) AS calls, count(*) FILTER (bad) AS errors, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, round(sum(s), 2) AS seconds, round(sum(i) / 1e6 * 3 + sum(o) / 1e6 * 15, 6) AS cost FROM
    (SELECT user_id, event_type AS stage, event_id % 13 = 0 AS bad, event_id % 1000 AS i, CASE WHEN event_id % 13 <> 0 THEN event_id % 100 ELSE 0 END AS o, value AS s FROM events) GROUP BY GROUPING SETS ((user_id, stage), (user_id))""")
def usage_ledger(spark, d):
    """Events as model calls of their user's question; every thirteenth fails and still counts."""
    bad = F.col("event_id") % 13 == 0
    calls = table(spark, d, "events").select(F.col("user_id").cast("string").alias("qid"), F.col("event_type").alias("stage"), (F.col("event_id") % 1000).alias("input_tokens"), F.when(~bad, F.col("event_id") % 100).alias("output_tokens"), F.col("value").alias("seconds"), F.when(bad, "Throttled").alias("error"))
    priced = spend.ledger(calls).withColumn("cost", F.round(spend.cost(F.col("input_tokens"), F.col("output_tokens"), 3.0, 15.0), 6))
    return priced.withColumn("seconds", F.round("seconds", 2))


_ENVELOPE_TEXT = "'Exhibit ' || page_id || ' of ' || url || '. ' || repeat('It states what the filing refers to, word by word. ', CAST(page_id % 3 AS INT) * 5)"


@query(f"""WITH p AS (SELECT page_id, 'P' || page_id || '_2022_10K' AS doc_id, trim('Report ' || page_id || ' found at ' || url || '. ' || repeat('The year was a good one for all who took part in it. ', 8)) AS main, trim({_ENVELOPE_TEXT}) AS exhibit FROM pages),
    t AS (SELECT *, length(exhibit) < 200 AS short FROM p WHERE page_id % 10 <> 7)
    SELECT doc_id, 1 AS page_seq, CASE WHEN short THEN main || chr(10) || exhibit ELSE main END AS raw_text, CASE WHEN page_id % 4 = 0 THEN 1 ELSE 3 END AS n_parts, CAST(NULL AS VARCHAR) AS error FROM t WHERE page_id % 4 <> 0
    UNION ALL SELECT doc_id, 2, exhibit, 3, NULL FROM t WHERE page_id % 4 <> 0 AND NOT short
    UNION ALL SELECT doc_id, 1, main, 1, NULL FROM t WHERE page_id % 4 = 0
    UNION ALL SELECT 'notes' || page_id, NULL, NULL, 0, 'unrecognised name' FROM p WHERE page_id % 10 = 7""".replace("3 END AS n_parts", "2 END AS n_parts").replace("exhibit, 3, NULL", "exhibit, 2, NULL"))
def envelope_pages(spark, d):
    """Every web page in an envelope: a report, the page itself as a picture that is skipped, an exhibit. Every fourth file is a report alone; every tenth has a bad name."""
    escaped = F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    key = F.col("page_id").cast("string")
    main = F.concat(F.lit("<html><body><div><p>Report "), key, F.lit(" found at "), escaped, F.lit(". "), F.repeat(F.lit("The year was a good one for all who took part in it. "), 8), F.lit("</p></div></body></html>"))
    more = F.repeat(F.lit("It states what the filing refers to, word by word. "), (F.col("page_id") % 3 * 5).cast("int"))
    exhibit = F.concat(F.lit("<html><body><p>Exhibit "), key, F.lit(" of "), escaped, F.lit(". "), more, F.lit("</p></body></html>"))
    envelope = F.concat(F.lit("<SEC-DOCUMENT>\n<TYPE>10-K\n"), main, F.lit("\n<TYPE>GRAPHIC\n"), F.regexp_replace(F.coalesce("html", F.lit("")), "(?i)<(/?)html", "<$1picture"), F.lit("\n<TYPE>EX-99.1\n"), exhibit)
    name = F.when(F.col("page_id") % 10 == 7, F.concat(F.lit("notes"), key)).otherwise(F.concat(F.lit("P"), key, F.lit("_2022_10K")))
    files = table(spark, d, "pages").select(name.alias("doc_id"), F.when(F.col("page_id") % 4 == 0, main).otherwise(envelope).alias("raw"))
    parts = envelopes.typed_documents(files)
    paged = html.page_table(envelopes.parse_filings(parts)).select("doc_id", "page_seq", "raw_text")
    counts = parts.groupBy("doc_id").agg(F.count("html").cast("int").alias("n_parts"), F.first("error").alias("error"))
    return counts.join(paged, "doc_id", "left").select("doc_id", "page_seq", "raw_text", "n_parts", "error")


@query("""WITH p AS (SELECT p_partkey, 'part' || p_partkey AS doc_id, CAST(p_size AS BIGINT) AS size, p_name FROM part), n AS (SELECT * FROM p, (VALUES (1, 0), (1, 1), (2, 0), (3, 0), (3, 1)) AS v(page_seq, k) WHERE page_seq < 3 OR size % 2 = 0 OR k = 0)
    SELECT doc_id, page_seq, doc_id || '#p' || page_seq || '#f' || k AS fact_id, CASE WHEN page_seq = 2 THEN 'us-gaap:Assets' WHEN k = 0 THEN 'us-gaap:Revenues' ELSE 'us-gaap:NetIncomeLoss' END AS qname,
        CAST((p_partkey * 10 + page_seq) * CASE WHEN k = 1 THEN -1 ELSE 1 END * 1000 AS DOUBLE) AS value, CASE WHEN page_seq = 2 THEN 'shares' WHEN page_seq = 3 THEN 'USD/shares' ELSE 'USD' END AS unit,
        CASE WHEN page_seq = 2 THEN '2022-12-31' ELSE '2022-01-01' END AS period_start, CASE WHEN page_seq = 2 THEN 'Total assets' WHEN k = 1 THEN 'Net earnings' WHEN p_partkey % 3 = 0 THEN 'Sales' ELSE 'Total revenues' END AS row_label,
        NOT (page_seq <> 2 AND k = 0 AND p_partkey % 3 = 0) AND NOT (page_seq <> 2 AND k = 1) AS fits FROM n""")
def page_facts(spark, d):
    """A tagged filing of three pages for every part; contexts and units stand on the first."""
    key, n = F.col("p_partkey").cast("string"), F.col("p_partkey")
    context = lambda ref, period: f'<xbrli:context id="{ref}"><xbrli:period>{period}</xbrli:period></xbrli:context>'
    unit = lambda ref, *names: f'<xbrli:unit id="{ref}">' + "".join(f"<xbrli:measure>{x}</xbrli:measure>" for x in names) + "</xbrli:unit>"
    year = "<xbrli:startDate>2022-01-01</xbrli:startDate><xbrli:endDate>2022-12-31</xbrli:endDate>"
    header = "<ix:header>" + context("y", year) + context("i", "<xbrli:instant>2022-12-31</xbrli:instant>") + unit("usd", "iso4217:USD") + unit("sh", "xbrli:shares") + unit("per", "iso4217:USD", "xbrli:shares") + "</ix:header>"
    filler = "<p>" + "These pages say what the figures mean and where they come from. " * 4 + "</p>"

    def row(label: Column, name: str, ref: str, unit_ref: str, page: int, sign: str = "") -> Column:
        opened = F.concat(F.lit("<tr><td>"), label, F.lit(f'</td><td><ix:nonFraction name="us-gaap:{name}" contextRef="{ref}" unitRef="{unit_ref}" scale="3"{sign}>'))
        return F.concat(opened, F.format_number(n * 10 + page, 0), F.lit("</ix:nonFraction></td></tr>"))

    sales = F.when(n % 3 == 0, "Sales").otherwise("Total revenues")
    lost = row(F.lit("Lost"), "Liabilities", "gone", "usd", 1)
    income = lambda page, unit_ref: row(F.lit("Net earnings"), "NetIncomeLoss", "y", unit_ref, page, ' sign="-"')
    first = F.concat(F.lit(header + filler + "<table>"), row(sales, "Revenues", "y", "usd", 1), lost, income(1, "usd"), F.lit("</table><hr/>"))
    second = F.concat(F.lit(filler + "<table>"), row(F.lit("Total assets"), "Assets", "i", "sh", 2), F.lit("</table><hr/>"))
    third = F.concat(F.lit(filler + "<table>"), row(sales, "Revenues", "y", "per", 3), F.when(F.col("p_size") % 2 == 0, income(3, "per")).otherwise(""), F.lit("</table>"))
    parts = lexical.spread(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey")
    filings = parts.select(F.concat(F.lit("part"), key).alias("doc_id"), F.concat(first, second, third).alias("html"))
    found = xbrl.page_facts(xbrl.read_tagged(filings, "doc_id", "html", by_page=True))
    fits = xbrl.label_matches(F.col("row_label"), F.array(F.lit("Revenue"), F.lit("assets"), F.lit("")))
    return found.select("doc_id", "page_seq", "fact_id", "qname", F.col("value").cast("double").alias("value"), "unit", F.col("period_start").cast("string").alias("period_start"), "row_label", fits.alias("fits"))


def index_update_sql() -> str:
    return f"""WITH {_scores_sql("(SELECT * FROM documents WHERE doc_id % 7 <> 0)")}, best AS (SELECT *, row_number() OVER (PARTITION BY item_id, source ORDER BY score DESC, doc_id) AS r FROM sc WHERE score > 0)
        SELECT item_id, source, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM best WHERE r <= 3"""


@query()
def index_update(spark, d):
    """A stored index that is built from two thirds of the documents, some with older texts, then brought up to date, then loses every seventh; asked with the passages."""
    docs = table(spark, d, "documents")
    store = LexicalStore(spark, shared_path(spark, "lexical"))
    older = docs.filter("doc_id % 3 != 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("older words in place of new ones "), F.coalesce("source", F.lit("")))).otherwise(F.col("text")))
    store.update(older, "doc_id", F.col("text"), "source")
    store.update(docs, "doc_id", F.col("text"), "source")
    store.update(docs.limit(0), "doc_id", F.col("text"), "source", docs.filter("doc_id % 7 = 0").select("doc_id"))
    scores = store.scores(table(spark, d, "benchmark"), "item_id", F.col("text")).withColumnsRenamed({"key": "doc_id", "scope": "source"})
    return lexical.top_pages(scores, "item_id", "doc_id", 3, "source").select("item_id", "source", "doc_id", "score", "rank")


class SameAnswer:
    """Judges by equality; out of order for some questions."""

    def complete(self, text: str) -> str:
        question, gold, candidate = (part.partition(":\n")[2] for part in text.split("\n\n"))
        if question.endswith("1?"):
            raise RuntimeError("out of order")
        return json.dumps({"equivalent": gold == candidate, "reasoning": "same" if gold == candidate else "not the same"})


@query("""WITH r AS (SELECT doc_id, CAST(quality AS VARCHAR) AS gold, CASE WHEN toxic = 1 THEN ' ' ELSE CAST(doc_id % 2 AS VARCHAR) END AS candidate, doc_id % 10 = 1 AS down FROM labels)
    SELECT doc_id, candidate <> ' ' AND NOT down AND gold = candidate AS equivalent, CASE WHEN candidate = ' ' THEN 'empty answer' WHEN down THEN 'judge unavailable: RuntimeError: out of order' WHEN gold = candidate THEN 'same' ELSE 'not the same' END AS reasoning FROM r""")
def judge_memo(spark, d):
    """Every label judged against a guess, twice: the second run takes what the first one stored."""
    rows = table(spark, d, "labels").select(
        "doc_id", F.concat(F.lit("Is document good: "), F.col("doc_id").cast("string"), F.lit("?")).alias("question"), F.col("quality").cast("string").alias("gold"), F.when(F.col("toxic") == 1, " ").otherwise((F.col("doc_id") % 2).cast("string")).alias("candidate")
    )
    path = shared_path(spark, "judged")
    memo.judge(rows, path, SameAnswer)
    return memo.judge(rows, path, SameAnswer).select("doc_id", "equivalent", "reasoning")


def _ablation_sql() -> str:
    values = ", ".join(f"('{name}', [{', '.join(repr(g) for g in s.gates)}]::VARCHAR[], {s.verifiers}, {s.adversarial}, {s.reranker}, {s.anchors}, {s.budget}, {s.filings})" for name, s in ablation.VARIANTS.items())
    return f"""WITH v(variant, gates, verifiers, adversarial, reranker, anchors, budget, filings) AS (VALUES {values}),
        r AS (SELECT o_orderkey AS k, list_filter([CASE WHEN o_orderkey % 7 = 0 THEN 'G1' END, CASE WHEN o_orderkey % 11 = 0 THEN 'G3' END, CASE WHEN o_orderkey % 6 = 0 THEN 'G4' END], lambda x: x IS NOT NULL) AS failed, 1 + o_custkey % 9 AS route, o_custkey % 60000 AS a, CASE WHEN o_orderkey % 4 > 0 THEN CAST(floor(o_totalprice) AS BIGINT) % 70000 END AS re, CAST(floor(o_totalprice) AS BIGINT) % 90000 AS pl, o_orderkey % 5 <> 0 AS correct FROM orders),
        x AS (SELECT variant, correct, coalesce(route <= filings AND CASE WHEN reranker AND anchors THEN least(a, re) WHEN reranker THEN re WHEN anchors THEN least(a, pl) ELSE pl END <= budget, FALSE)
            AND (NOT verifiers OR (k % 17 <> 0 AND CASE WHEN adversarial THEN k % 9 <> 0 ELSE k % 23 <> 0 END)) AND NOT list_has_any(failed, gates) AS answered FROM r, v)
        SELECT variant, count(*) AS n, count(*) FILTER (answered) AS answered, count(*) FILTER (answered AND correct) AS "right", count(*) FILTER (answered AND NOT correct) AS wrong, count(*) FILTER (answered AND correct) - count(*) FILTER (answered AND NOT correct) AS score,
            round(CASE WHEN count(*) FILTER (answered) > 0 THEN count(*) FILTER (answered AND NOT correct) / CAST(count(*) FILTER (answered) AS DOUBLE) END, 6) AS false_rate, round(1 - count(*) FILTER (answered) / CAST(count(*) AS DOUBLE), 6) AS abstain_rate FROM x GROUP BY variant"""


@query(_ablation_sql())
def ablation_grid(spark, d):
    """Orders as questions with the findings of each stage, under twelve variants, in one scan."""
    k, price = F.col("o_orderkey"), F.floor("o_totalprice")
    failed = F.array_compact(F.array(F.when(k % 7 == 0, "G1"), F.when(k % 11 == 0, "G3"), F.when(k % 6 == 0, "G4")))
    rows = table(spark, d, "orders").select(
        failed.alias("failed"), (k % 17 != 0).alias("verifier_a"), (k % 9 != 0).alias("verifier_b"), (k % 23 != 0).alias("verifier_b_plain"), (1 + F.col("o_custkey") % 9).alias("route_rank"),
        (F.col("o_custkey") % 60_000).alias("anchor_tokens"), F.when(k % 4 > 0, price % 70_000).alias("rerank_tokens"), (price % 90_000).alias("plain_tokens"), (k % 5 != 0).alias("correct"),
    )
    return ablation.compare(ablation.run_variants(rows))


def verdict_reasons_sql() -> str:
    from .queries import _FIGURES

    return f"""WITH {_FIGURES},
        r AS (SELECT l.doc_id, l.doc_id % 4 AS k, l.toxic = 1 AS abstained, l.quality = 1 AS judged, CAST(l.doc_id % 40 AS DOUBLE) AS g, CASE l.doc_id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE NULLIF(lower(regexp_extract(coalesce(d.text, ''), '^\\s*([yY][eE][sS]|[nN][oO])\\b', 1)), '') END AS said,
            n.found, l.doc_id % 6 AS c, l.doc_id % 5 AS p FROM labels l JOIN documents d USING (doc_id) JOIN read n ON n.txt = 'doc' || l.doc_id),
        m AS (SELECT *, len(list_filter(found, lambda x: x = g OR CASE WHEN g = 0 THEN abs(x) <= 0.005 ELSE abs(g - x) <= 0.005 * abs(g) OR len(list_filter([1e3, 1e6, 1e9], lambda f: (x <> 0 AND abs(g * f - x) <= 0.005 * abs(x)) OR (x <> 0 AND abs(g - x * f) <= 0.005 * abs(x * f)))) > 0 END)) > 0 AS hit FROM r),
        w AS (SELECT *, CASE WHEN abstained THEN 'declined' WHEN k < 2 THEN CASE WHEN len(found) = 0 THEN 'answer_has_no_figure' WHEN hit THEN 'figure_matches' ELSE 'figure_differs' END WHEN k = 2 THEN CASE WHEN said IS NULL THEN 'answer_opens_otherwise' WHEN said <> 'yes' THEN 'verdict_differs' ELSE 'verdict_matches' END ELSE 'judged' END AS reason,
            CASE WHEN c = 0 THEN 'no_citations' WHEN c = 1 THEN 'wrong_document' WHEN p > 0 AND abs(c - p) <= 1 THEN 'near_gold_page' WHEN c = 5 THEN 'evidence_on_page' WHEN p = 0 THEN 'gold_page_unmapped' ELSE 'evidence_missing' END AS place FROM m),
        z AS (SELECT *, reason = 'figure_matches' OR (reason IN ('verdict_matches', 'judged') AND judged) AS correct, place IN ('near_gold_page', 'evidence_on_page') AS located, CASE WHEN reason = 'figure_differs' THEN list_min(list_transform(found, lambda x: {{'far': abs(x - g), 'v': x}})).v END AS nearest FROM w)
        SELECT doc_id, reason, place AS "where", nearest, round(CASE WHEN nearest IS NOT NULL AND g <> 0 THEN abs(g - nearest) / abs(g) END, 6) AS off, CASE WHEN abstained THEN 0 WHEN NOT correct THEN -1 WHEN located THEN 1 ELSE 0 END AS score FROM z"""


@query()
def verdict_reasons(spark, d):
    """Every labelled document's whole text as an answer: to a figure, to a yes-or-no question, or in free text; with citations of all kinds."""
    k, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    gold = F.when(k % 4 < 2, F.concat(F.lit("$"), (k % 40).cast("string"))).when(k % 4 == 2, "Yes, it did").otherwise("It did well")
    opened = _by_rest("doc_id", 3, F.concat(F.lit("Yes. "), text), F.concat(F.lit("no, "), text), text)
    answer = F.when(k % 4 == 2, opened).otherwise(text)
    page = (k % 6).cast("int")
    cited = F.when(k % 6 > 0, F.array(F.struct(F.when(k % 6 == 1, "other").otherwise(k.cast("string")).alias("doc_id"), page.alias("page_seq"))))
    pages = F.when(k % 5 > 0, F.array((k % 5).cast("int")))
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select(
        "doc_id", F.when(k % 4 < 2, explain.NUMERIC).when(k % 4 == 2, explain.YES_OR_NO).otherwise("phrase").alias("shape"), gold.alias("gold"), answer.alias("answer"), (F.col("toxic") == 1).alias("abstained"), (F.col("quality") == 1).alias("judged"),
        cited.alias("citations"), k.cast("string").alias("gold_doc"), pages.alias("gold_pages"), F.when(k % 6 == 5, 0.7).otherwise(0.2).alias("overlap"),
    )
    found = explain.message(explain.scored(rows, "judged"))
    return found.filter(F.col("explanation").isNotNull()).select("doc_id", "reason", "where", "nearest", "off", "score")


def _negatives_sql() -> str:
    slug, names = "'CO_' || c_custkey", "CASE c_custkey % 3 WHEN 0 THEN 'company ' || c_custkey WHEN 1 THEN 'short' || c_custkey END"
    turn = lambda texts: "CASE (n - 1) % " + str(len(texts)) + " " + " ".join(f"WHEN {i} THEN " + "'" + t.replace("%1$s", "' || name || '").replace("%2$d", "' || y || '") + "'" for i, t in enumerate(texts)) + " END"
    kinds = {
        "future_period": ("wrong_filing_or_period", "form = '10-K'", "'What was the total revenue of ' || name || ' in FY' || (newest + 2) || '?'"),
        "wrong_quarter": ("wrong_filing_or_period", "form = '10-Q'", "'What was the net income of ' || name || ' in Q' || (CASE WHEN q <> 4 THEN 4 ELSE 1 END) || ' FY' || y || '?'"),
        "missing_metric": ("missing_metric", "form = '10-K'", f"'What was the number for ' || {turn(negatives.ABSENT)} || ' of ' || name || ' in FY' || y || '?'"),
        "false_premise": ("false_premise", "form = '10-K'", turn(negatives.PREMISES)),
        "missing_operand": ("missing_operand", "form = '10-K'", turn(negatives.OPERANDS)),
        "outside_filing": ("outside_filing", "TRUE", turn(negatives.OUTSIDE)),
    }
    parts = [f"SELECT printf('{kind}-%02d', n) AS nid, {question} AS question, '{category}' AS category, slug AS company_slug FROM (SELECT *, row_number() OVER (ORDER BY md5('1|{kind}|' || doc_id), doc_id) AS n FROM k WHERE {fits}) WHERE n <= {negatives.COUNTS[kind]}" for kind, (category, fits, question) in kinds.items()]
    return f"""WITH c AS (SELECT {slug} AS slug, {names} AS alias, c_custkey FROM customer),
        f AS (SELECT 'D' || o_orderkey AS doc_id, slug, CASE WHEN o_orderkey % 3 = 0 THEN '10-Q' ELSE '10-K' END AS form, year(o_orderdate) AS y, CASE WHEN o_orderkey % 3 = 0 THEN quarter(o_orderdate) END AS q, c_custkey, alias FROM orders JOIN c ON o_custkey = c_custkey),
        k AS (SELECT *, max(y) OVER (PARTITION BY slug) AS newest, CASE WHEN alias IS NULL THEN 'Co ' || c_custkey ELSE upper(alias[1]) || alias[2:] END AS name FROM f) """ + " UNION ALL ".join(parts)


@query(_negatives_sql())
def negative_set(spark, d):
    """Questions without an answer about customers as companies and orders as their filings."""
    customers = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("CO_"), F.col("c_custkey").cast("string")).alias("company_slug"))
    key = F.col("c_custkey").cast("string")
    aliases = customers.withColumn("alias", F.explode(F.when(F.col("c_custkey") % 3 == 0, F.array(F.concat(F.lit("company "), key), F.concat(F.lit("averyverylongname"), key))).when(F.col("c_custkey") % 3 == 1, F.array(F.concat(F.lit("short"), key), F.lit("s"))))).select("company_slug", "alias")
    quarterly = F.col("o_orderkey") % 3 == 0
    catalog = table(spark, d, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit("D"), F.col("o_orderkey").cast("string")).alias("doc_id"), "company_slug", F.when(quarterly, "10-Q").otherwise("10-K").alias("form_type"), F.year("o_orderdate").alias("fiscal_year"), F.when(quarterly, F.quarter("o_orderdate")).alias("fiscal_quarter")
    )
    return negatives.generate(catalog, aliases).select("nid", "question", "category", "company_slug")


@query("""WITH e AS (SELECT event_type AS category, event_id % 9 = 0 AS answered, CASE WHEN event_id % 9 <> 0 THEN 'G' || (user_id % 5) END AS reason FROM events),
    g AS (SELECT category, reason, count(*) AS t FROM e GROUP BY GROUPING SETS ((category, reason), (reason))),
    h AS (SELECT category, string_agg(reason || ':' || t, ', ' ORDER BY t DESC, reason) FILTER (reason IS NOT NULL) AS reasons, CAST(sum(t) AS BIGINT) AS n, CAST(coalesce(sum(t) FILTER (reason IS NULL), 0) AS BIGINT) AS answered FROM g GROUP BY category)
    SELECT category, n, answered, round(answered / CAST(n AS DOUBLE), 6) AS false_answer_rate, reasons FROM h""")
def negatives_report(spark, d):
    """Events as outcomes of questions without an answer."""
    answered = F.col("event_id") % 9 == 0
    rows = table(spark, d, "events").select(F.col("event_type").alias("category"), (~answered).alias("abstained"), F.concat(F.lit("G"), (F.col("user_id") % 5).cast("string")).alias("abstain_reason"))
    return negatives.report(rows)


@query("""WITH g AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'numeric' WHEN doc_id % 3 = 1 THEN 'yes_no' ELSE 'phrase' END AS shape, doc_id % 3 = 0 AS right_, quality = 1 AS judged, doc_id % 4 > 0 AS mapped FROM labels),
    b AS (SELECT 'abstain' AS baseline, shape, 0 AS score FROM g UNION ALL SELECT 'oracle', shape, CASE WHEN NOT (right_ OR judged) THEN -1 WHEN mapped THEN 1 ELSE 0 END FROM g)
    SELECT baseline, shape, count(*) AS n, CAST(sum(score) AS BIGINT) AS total, round(avg(score), 6) AS mean FROM b GROUP BY GROUPING SETS ((baseline, shape), (baseline))""")
def baseline_scores(spark, d):
    """Labels as questions of all shapes, refused and answered perfectly."""
    k = F.col("doc_id")
    gold = table(spark, d, "labels").select(
        k.cast("string").alias("qid"), F.when(k % 3 == 0, explain.NUMERIC).when(k % 3 == 1, explain.YES_OR_NO).otherwise("phrase").alias("shape"), F.when(k % 3 == 0, F.concat(F.lit("$"), k.cast("string"))).when(k % 3 == 1, "No, not at all").otherwise("Much of it").alias("gold"),
        k.cast("string").alias("gold_doc"), F.when(k % 4 > 0, F.array((k % 50).cast("int"))).alias("gold_pages"), (F.col("quality") == 1).alias("judged"),
    )
    return runs.baseline_scores(gold, "judged")


@query("""WITH p AS (SELECT doc_id // 3 AS qid, printf('D%08d', doc_id) AS name, doc_id % 5 AS page, left(coalesce(text, ''), 6000) AS head FROM documents)
    SELECT qid, string_agg('--- ' || name || ' page ' || page || ' ---' || chr(10) || head, chr(10) || chr(10) ORDER BY name, page) AS cited FROM p WHERE head <> '' GROUP BY qid""")
def verifier_context(spark, d):
    """Every three documents cited by one question, some twice, some that are not there."""
    name = F.format_string("D%08d", "doc_id")
    docs = table(spark, d, "documents")
    pages = docs.select(name.alias("doc_id"), (F.col("doc_id") % 5).alias("page_seq"), F.col("text").alias("raw_text"))
    cited = docs.select(F.expr("doc_id div 3").alias("qid"), name.alias("doc_id"), F.explode(F.array(F.col("doc_id") % 5, F.col("doc_id") % 5, F.lit(99).cast("long"))).alias("page_seq"))
    return verify.cited_pages(cited, pages)


#: SQL that takes parts of other queries' SQL; set by ``queries`` once those are there.
LATE_SQL = {"rerank_head": rerank_head_sql, "index_update": index_update_sql, "verdict_reasons": verdict_reasons_sql}
