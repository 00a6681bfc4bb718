"""Queries over the driver's tables, one or more for each operator, and the SQL that each is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evspark.functions import keys
from evspark.functions import text as T
from evspark.operators import anchors, composite, dense, evaluate, fusion, gates, lexical, metrics, route, sections, tables
from evspark.sources import filings, html, sinks, xbrl
from evspark.streaming import ingest

from . import answer, fixtures, ingest_plan
from .registry import ORACLE_SQL, QUERIES, query, table  # noqa: F401
from .stage import written

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLES))
def corpus_stats(spark, d):
    return filings.table_counts({t: table(spark, d, t) for t in TABLES})


@query("""
    WITH h AS (SELECT doc_id, sha256(text) AS content_hash FROM documents),
         s AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'changed' ELSE content_hash END AS content_hash FROM h WHERE doc_id % 2 = 0)
    SELECT doc_id, content_hash FROM h WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = h.doc_id AND s.content_hash = h.content_hash)""")
def content_hash_skip(spark, d):
    """Even ids are stored already, every third with another content: what has to be ingested?"""
    hashed = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    stored = hashed.filter("doc_id % 2 = 0").withColumn("content_hash", F.when(F.col("doc_id") % 3 == 0, "changed").otherwise(F.col("content_hash")))
    return sinks.unseen(hashed, stored, ["doc_id", "content_hash"]).select("doc_id", "content_hash")


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '([^/?#]*)$', 1) AS tail, length(html) AS html_chars FROM pages")
def url_metadata(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", "([^/?#]*)$", 1).alias("tail"), F.length("html").cast("long").alias("html_chars"))


_NAME_FORMS = ("Acme{}_2022_10K", "acme{}_2023Q2_10Q", "GLOBEX_{}_2022_8K_dated-2022-07-01", "Initech{}_2021_10k", "notes{}", "UMBRELLA_CORP_{}_2020Q4_10Q", "HOOLI{}_2019_8K")
_NAME_SQL = "CASE c_custkey % 7 " + " ".join(f"WHEN {k} THEN {' || '.join(repr(x) for x in form.split('{}')).replace(' || ', ' || c_custkey || ')}" for k, form in enumerate(_NAME_FORMS)) + " END"


@query(f"""
    WITH n AS (SELECT {_NAME_SQL} AS doc_id FROM customer),
    p AS (SELECT doc_id, regexp_extract(doc_id, '(?i)^(.+?)_(\\d{{4}})(Q([1-4]))?_(10K|10Q|8K)(_dated[-_](\\d{{4}}-\\d{{2}}-\\d{{2}}))?$', ['slug', 'y', 'qq', 'q', 'f', 'dd', 'd']) AS g FROM n),
    m AS (SELECT doc_id, upper(g.slug) AS slug, TRY_CAST(g.y AS INT) AS y, TRY_CAST(g.q AS INT) AS q, upper(g.f) AS f, TRY_CAST(g.d AS DATE) AS d FROM p)
    SELECT doc_id, CASE WHEN slug <> '' THEN slug END AS company_slug, CASE f WHEN '10K' THEN '10-K' WHEN '10Q' THEN '10-Q' WHEN '8K' THEN '8-K' END AS form_type,
        y AS fiscal_year, q AS fiscal_quarter, CASE WHEN y IS NULL THEN NULL WHEN q IS NOT NULL THEN 'Q' || q || ' FY' || y WHEN f = '8K' THEN coalesce(CAST(d AS VARCHAR), CAST(y AS VARCHAR)) ELSE 'FY' || y END AS period_label,
        CAST(d AS VARCHAR) AS filing_date, y - CASE f WHEN '10K' THEN 2 WHEN '10Q' THEN 1 ELSE 0 END AS first_year, CASE WHEN y IS NULL THEN 'unrecognised name' END AS error FROM m""")
def filing_catalog(spark, d):
    """A filing's name for every customer, in all forms."""
    key = F.col("c_custkey").cast("string")
    names = [F.concat(*[x for part in form.split("{}") for x in (F.lit(part), key)][:-1]) for form in _NAME_FORMS]
    chosen = F.coalesce(*[F.when(F.col("c_custkey") % 7 == k, name) for k, name in enumerate(names)])
    names = table(spark, d, "customer").select(chosen.alias("doc_id"))
    found = filings.catalog(names)
    return found.withColumn("first_year", F.array_min("coverage_years")).withColumn("filing_date", F.col("filing_date").cast("string")).drop("coverage_years")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return lexical.page_tokens(table(spark, d, "documents"), "doc_id", F.col("text"), "source")


_TOKENS = """tok AS (SELECT doc_id, source, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM documents),
    docs AS (SELECT doc_id, source, t, len(t) AS dl FROM tok),
    stat AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM docs),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM docs) GROUP BY 1, 2),
    raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, stat GROUP BY term),
    idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""
_SCORES = f"""{_TOKENS},
    q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY 1, 2),
    sc AS (SELECT q.item_id, docs.doc_id, docs.source, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
           FROM q JOIN tf USING (term) JOIN idf USING (term) JOIN docs USING (doc_id), stat GROUP BY 1, 2, 3)"""


@query(f"WITH {_TOKENS} SELECT term, df, round(idf, 6) AS idf FROM idf")
def token_stats(spark, d):
    return lexical.term_idf(corpus(spark, d)).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"""WITH {_SCORES}, best AS (SELECT *, row_number() OVER (PARTITION BY item_id, source ORDER BY score DESC, doc_id) AS r FROM sc WHERE score > 0)
    SELECT item_id, source, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM best WHERE r <= 3""")
def bm25_scoped_topk(spark, d):
    """Top 3 of each source for each passage, then ranked over all."""
    paged, counts = answer.lexical_index(corpus(spark, d))
    scores = lexical.bm25_scores(paged, table(spark, d, "benchmark"), "doc_id", "item_id", F.col("text"), "source", counts)
    return lexical.top_pages(scores, "item_id", "doc_id", 3, "source").select("item_id", "source", "doc_id", "score", "rank")


_GLOBAL = "ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0)"


def global_ranking(spark, d, k: int = 10) -> DataFrame:
    paged, counts = answer.lexical_index(corpus(spark, d))
    scores = lexical.bm25_scores(paged, table(spark, d, "benchmark"), "doc_id", "item_id", F.col("text"), counts=counts)
    return lexical.top_pages(scores, "item_id", "doc_id", k)


@query(f"WITH {_SCORES}, {_GLOBAL} SELECT item_id, doc_id, score, rank FROM ranked WHERE rank <= 10")
def bm25_global_topk(spark, d):
    return global_ranking(spark, d).select("item_id", "doc_id", "score", "rank")


_COSINE = "round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))), 6)"


@query(f"""
    WITH v AS (SELECT vec_id, label, CASE WHEN vec_id % 7 <> 0 THEN embedding END AS embedding FROM embeddings),
    s AS (SELECT q.vec_id AS qid, a.vec_id, a.label, {_COSINE} AS score FROM v a JOIN embeddings q ON a.label = q.label WHERE q.vec_id % 20 = 0 AND a.embedding IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT qid, vec_id, label, score, rank FROM r WHERE rank <= 10""")
def dense_scoped_topk(spark, d):
    """Vectors with an id divisible by 20 ask within their label; every seventh vector is missing."""
    vectors = table(spark, d, "embeddings").withColumn("embedding_", F.when(F.col("vec_id") % 7 != 0, F.col("embedding")))
    asked = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "label", F.col("embedding").alias("query_vector"))
    index = dense.vector_index(vectors, "vec_id", "embedding_", "label")
    return dense.dense_topk(index, asked, "vec_id", "qid", "embedding_", "label", 10)


@query("SELECT label, count(*) AS n, count(CASE WHEN vec_id % 7 <> 0 THEN embedding END) AS with_vector FROM embeddings GROUP BY label")
def dense_coverage(spark, d):
    vectors = table(spark, d, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 7 != 0, F.col("embedding")))
    return dense.coverage(vectors, "embedding", "label")


def jaccard_ranking(spark, d, k: int = 10) -> DataFrame:
    shared = evaluate.shared_tokens(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "doc_id")
    scored = shared.withColumn("score", F.round(F.col("shared") / (F.col("n_passage") + F.col("n_page") - F.col("shared")), 6))
    return lexical.top_pages(scored, "item_id", "doc_id", k)


_SETS = """bt AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM benchmark),
    dt AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS t FROM documents),
    sh AS (SELECT b.item_id, x.doc_id, b.np, x.nd, count(*) AS shared FROM (SELECT item_id, len(t) AS np, unnest(t) AS token FROM bt) b JOIN (SELECT doc_id, len(t) AS nd, unnest(t) AS token FROM dt) x USING (token) GROUP BY 1, 2, 3, 4),
    jac AS (SELECT item_id, doc_id, np, shared, round(shared / CAST(np + nd - shared AS DOUBLE), 6) AS jscore FROM sh)"""
_JRANK = "jr AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY jscore DESC, doc_id) AS rank FROM jac WHERE jscore > 0)"
_FUSED = f"""WITH {_SCORES}, {_GLOBAL}, {_SETS}, {_JRANK},
    parts AS (SELECT item_id, doc_id, 1.0 / (60 + rank) AS part, 'bm25' AS source FROM ranked WHERE rank <= 10 UNION ALL SELECT item_id, doc_id, 0.5 / (60 + rank), 'jaccard' FROM jr WHERE rank <= 10),
    fused AS (SELECT item_id, doc_id, round(sum(CAST(part AS DOUBLE)), 9) AS score, string_agg(source, '+' ORDER BY source) AS sources FROM parts GROUP BY 1, 2),
    fr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM fused)"""


def fused_ranking(spark, d) -> DataFrame:
    return fusion.rrf([("bm25", global_ranking(spark, d), 1.0), ("jaccard", jaccard_ranking(spark, d), 0.5)], "item_id", "doc_id")


@query(f"{_FUSED} SELECT item_id, doc_id, score, sources, rank FROM fr")
def rrf_fusion(spark, d):
    return fused_ranking(spark, d).select("item_id", "doc_id", "score", "sources", "rank")


@query(f"""WITH {_SCORES}, {_GLOBAL}, {_SETS}, {_JRANK},
    u AS (SELECT item_id, doc_id, 0 AS l, rank FROM ranked WHERE rank <= 10 UNION ALL SELECT item_id, doc_id, 1, rank FROM jr WHERE rank <= 10),
    f AS (SELECT item_id, doc_id, min(struct_pack(l := l, r := rank)) AS best FROM u GROUP BY 1, 2)
    SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY best.l, best.r, doc_id) AS position FROM f""")
def ordered_union(spark, d):
    return fusion.ordered_union([global_ranking(spark, d), jaccard_ranking(spark, d)], "item_id", "doc_id")


_HITS = "hits AS (SELECT conv_id % 5 AS qid, conv_id, turn, CAST(1.0 / (1 + turn) AS DOUBLE) AS score, row_number() OVER (PARTITION BY conv_id % 5 ORDER BY turn, conv_id) AS rank FROM conversations WHERE role = 'system' OR turn = 3)"


@query(f"""WITH {_HITS},
    near AS (SELECT qid, conv_id, turn + o AS turn, score, rank, o FROM hits, (VALUES (-1), (1)) v(o)),
    claim AS (SELECT qid, conv_id, turn, score, rank, row_number() OVER (PARTITION BY qid, conv_id, turn ORDER BY rank, o) AS n FROM near)
    SELECT qid, conv_id, turn, score * 0.25 AS score, rank AS claimed_by FROM claim c WHERE n = 1
      AND EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND x.turn = c.turn) AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.qid = c.qid AND h.conv_id = c.conv_id AND h.turn = c.turn)""")
def neighbour_expand(spark, d):
    """Conversations stand in for documents and turns for pages."""
    turns = table(spark, d, "conversations")
    w = Window.partitionBy("qid").orderBy("turn", "conv_id")
    hits = turns.filter("role = 'system' OR turn = 3").select((F.col("conv_id") % 5).alias("qid"), "conv_id", "turn", (1.0 / (1 + F.col("turn"))).alias("score")).withColumn("rank", F.row_number().over(w))
    return fusion.neighbours(hits, turns, "qid", "conv_id", "turn", 1)


@query("""
    WITH RECURSIVE i AS (SELECT source, doc_id, length(text) // 4 + 32 AS cost, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos FROM documents),
    p AS (SELECT source, doc_id, pos, cost, TRUE AS kept, cost AS used FROM i WHERE pos = 1
          UNION ALL SELECT i.source, i.doc_id, i.pos, i.cost, p.used + i.cost <= 20000, CASE WHEN p.used + i.cost <= 20000 THEN p.used + i.cost ELSE p.used END FROM p JOIN i ON i.source = p.source AND i.pos = p.pos + 1)
    SELECT source, doc_id, pos AS position, cost, kept FROM p""")
def budget_pack(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", fusion.item_cost(F.col("text")).alias("cost"))
    return fusion.pack_budget(docs, "source", "doc_id", [F.col("doc_id")], "cost", 20_000)


@query("SELECT conv_id, turn, lag(turn) OVER w AS prev_turn, lead(turn) OVER w AS next_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def page_links(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.lag("turn").over(w).alias("prev_turn"), F.lead("turn").over(w).alias("next_turn"))


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS user_turn FROM conversations")
def carry_parent(spark, d):
    """The nearest user turn before each turn, as headings are carried to the blocks below them."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, d, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), True).over(w).alias("user_turn"))


@query("SELECT user_id, event_id, greatest(coalesce(lead(event_id) OVER w - 1, (SELECT max(event_id) FROM events)), event_id) AS span_end FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def span_close(spark, d):
    events = table(spark, d, "events").select("user_id", "event_id")
    last = events.agg(F.max("event_id").alias("last")).scalar()
    w = Window.partitionBy("user_id").orderBy("event_id")
    return events.withColumn("last", last).select("user_id", "event_id", F.greatest(F.coalesce(F.lead("event_id").over(w) - 1, "last"), "event_id").alias("span_end"))


@query("""
    WITH s AS (SELECT conv_id, turn AS start, least(turn + 2, max(turn) OVER (PARTITION BY conv_id)) AS stop, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal, role FROM conversations WHERE role <> 'assistant'),
    c AS (SELECT p.conv_id, p.turn, s.ordinal, s.role, row_number() OVER (PARTITION BY p.conv_id, p.turn ORDER BY s.ordinal) AS n FROM conversations p LEFT JOIN s ON s.conv_id = p.conv_id AND p.turn BETWEEN s.start AND s.stop)
    SELECT conv_id, turn, ordinal, CASE WHEN ordinal IS NOT NULL THEN conv_id || '#s' || ordinal END AS section_id FROM c WHERE n = 1""")
def span_expand_assign(spark, d):
    """Sections of three turns from each non-assistant turn; a turn belongs to the first that covers it."""
    turns = table(spark, d, "conversations")
    w, o = Window.partitionBy("conv_id"), Window.partitionBy("conv_id").orderBy("turn")
    s = turns.filter("role <> 'assistant'").withColumn("ordinal", F.row_number().over(o) - 1)
    s = s.select(F.col("conv_id").alias("doc_id"), F.concat_ws("#s", "conv_id", "ordinal").alias("section_id"), "ordinal", F.col("turn").alias("page_start"), F.least(F.col("turn") + 2, F.max("turn").over(w)).alias("page_end"))
    pages = turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_seq"))
    placed = sections.section_of_page(pages, s)
    return placed.select(F.col("doc_id").alias("conv_id"), F.col("page_seq").alias("turn"), F.regexp_extract("section_id", "#s(.*)$", 1).try_cast("long").alias("ordinal"), "section_id")


@query("""
    WITH cat AS (SELECT DISTINCT o_custkey AS slug, year(o_orderdate) AS fy FROM orders),
    mx AS (SELECT *, max(fy) OVER (PARTITION BY slug) AS max_year FROM cat),
    q AS (SELECT c_custkey AS qid, c_custkey AS slug, CASE WHEN c_custkey % 3 <> 0 THEN 1996 + c_custkey % 4 END AS y FROM customer),
    s AS (SELECT qid, 'c' || q.slug || '-' || fy AS doc_id, fy, 10 + CASE WHEN y IS NULL THEN CASE WHEN fy = max_year THEN 6 ELSE -3 END WHEN fy = y THEN 25 WHEN y BETWEEN fy - 2 AND fy THEN 4 ELSE -15 END + 4 AS score FROM q JOIN mx USING (slug)),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, fy DESC, doc_id) AS rank FROM s)
    SELECT q.qid, r.doc_id, r.score, r.rank, r.doc_id IS NULL AS needs_clarification FROM q LEFT JOIN (SELECT * FROM r WHERE rank <= 4) r USING (qid)""")
def route_score_topk(spark, d):
    """Customers stand in for companies and their order years for annual reports; every third question names no year."""
    orders = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("y")).distinct()
    # Two-digit years before 2000 are outside a question's years, so the stand-in moves by a century.
    year = F.col("y") + 100
    catalog = orders.select(
        F.concat(F.lit("c"), "o_custkey", F.lit("-"), "y").alias("doc_id"), F.concat(F.lit("C"), "o_custkey").alias("company_slug"), F.lit("10-K").alias("form_type"), year.alias("fiscal_year"),
        F.lit(None).cast("int").alias("fiscal_quarter"), F.lit(None).cast("date").alias("filing_date"), F.sequence(year - 2, year).alias("coverage_years"),
    )
    c = table(spark, d, "customer").select("c_custkey")
    asked = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit(" in FY"), (2096 + F.col("c_custkey") % 4).cast("string"))).otherwise("")
    questions = c.select(F.col("c_custkey").alias("qid"), F.concat(F.lit("What was the revenue of c"), "c_custkey", asked, F.lit("?")).alias("question"))
    aliases = c.select(F.concat(F.lit("C"), "c_custkey").alias("company_slug"), F.concat(F.lit("c"), "c_custkey").alias("alias"))
    return route.route(questions, catalog, aliases)


_QUESTION_VALUES = ", ".join("(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in row) + ")" for row in fixtures.QUESTIONS)


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


# RE2 has no look-around: figures' points go in two turns, and sentence ends keep what follows them.
_SHAPES = f"""a AS (SELECT 'doc' || doc_id AS qid, coalesce(text, '') AS raw, trim(coalesce(text, '')) AS txt FROM documents),
    p AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(txt, {_sql(T.ABBREVIATION)}, '', 'g'), '([0-9])[.]([0-9])', '\\1\\2', 'g'), '([0-9])[.]([0-9])', '\\1\\2', 'g') AS plain FROM a),
    e AS (SELECT *, len(list_filter(string_split(regexp_replace(regexp_replace(plain, '[.!?](\\s|\\(|\\$)', chr(1) || '\\1', 'g'), '[.!?]$', chr(1)), chr(1)), lambda x: trim(x) <> '')) AS sentences FROM p),
    docs AS (SELECT qid, CASE WHEN regexp_matches(regexp_replace(raw, {_sql(T.FORECAST_EXCLUSIONS)}, ' ', 'g'), {_sql(T.FORECAST_MARKERS)}) THEN 'forecast' ELSE 'historical' END AS intent,
        CASE WHEN txt = '' THEN 'phrase' WHEN regexp_matches(txt, {_sql(T.YES_NO)}) THEN 'yes_no' WHEN regexp_matches(txt, {_sql(T.NUMERIC_ANSWER)}) THEN 'numeric'
             WHEN regexp_matches(txt, {_sql(T.LIST_MARKER)}) OR sentences >= 2 OR len(regexp_extract_all(txt, {_sql(T.NUMBER)})) >= 2 THEN 'multi_sentence' ELSE 'phrase' END AS shape,
        regexp_matches(txt, {_sql(T.DECLINE_OPENING)}) AS declined FROM e)"""


@query(f"WITH v(qid, question, answer, intent, shape, declined) AS (VALUES {_QUESTION_VALUES}), {_SHAPES} SELECT qid, intent, shape, declined = 'yes' AS declined FROM v UNION ALL SELECT qid, intent, shape, declined FROM docs")
def intent_shape(spark, d):
    """Written questions with known intents and shapes, and all documents as questions and answers."""
    q = fixtures.questions(spark).select("qid", T.intent(F.col("question")).alias("intent"), T.answer_shape(F.col("answer")).alias("shape"), T.reads_as_decline(F.col("answer")).alias("declined"))
    read = [T.intent(F.col("text")).alias("intent"), T.answer_shape(F.col("text")).alias("shape"), T.reads_as_decline(F.col("text")).alias("declined")]
    return q.unionByName(table(spark, d, "documents").select(F.concat(F.lit("doc"), "doc_id").alias("qid"), *read))


@query(f"""WITH {_SETS}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY jscore DESC, doc_id) AS n FROM jac)
    SELECT item_id, doc_id, jscore AS score, jscore >= 0.35 AS mapped FROM r WHERE n = 1""")
def gold_jaccard(spark, d):
    return evaluate.gold_pages(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "doc_id")


_LOCATED = f"WITH {_SETS}, loc AS (SELECT b.item_id, coalesce(max(round(shared / CAST(s.np AS DOUBLE), 6)), 0) AS containment FROM bt b LEFT JOIN sh s USING (item_id) GROUP BY 1)"


def located(spark, d) -> DataFrame:
    """Every document counts as cited."""
    return evaluate.location_hits(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "doc_id")


@query(f"{_LOCATED} SELECT item_id % 10 AS grp, bool_or(containment >= 0.6) AS located FROM loc GROUP BY 1")
def location_any(spark, d):
    return located(spark, d).groupBy((F.col("item_id") % 10).alias("grp")).agg(F.bool_or("located").alias("located"))


@query(f"{_LOCATED} SELECT item_id % 10 AS grp, bool_and(containment >= 0.6) AS located, round(min(containment), 6) AS least FROM loc GROUP BY 1")
def location_all(spark, d):
    return located(spark, d).groupBy((F.col("item_id") % 10).alias("grp")).agg(F.bool_and("located").alias("located"), F.round(F.min("containment"), 6).alias("least"))


@query(f"""WITH {_SETS}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY jscore DESC, doc_id) AS n FROM jac),
    norm AS (SELECT b.item_id, lower(trim(regexp_replace(b.text, '\\s+', ' ', 'g'))) AS q, lower(trim(regexp_replace(x.text, '\\s+', ' ', 'g'))) AS p FROM benchmark b JOIN r ON r.item_id = b.item_id AND n = 1 JOIN documents x ON x.doc_id = r.doc_id)
    SELECT item_id, 1 AS citations, length(q) >= 12 AND contains(p, q) AS supported, TRUE AS retrieved FROM norm""")
def quote_gate(spark, d):
    """Each passage is quoted from the page it is most like."""
    best = evaluate.gold_pages(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "doc_id")
    quotes = best.join(table(spark, d, "benchmark").withColumnRenamed("text", "quote"), "item_id").select("item_id", "doc_id", F.lit(1).alias("page_seq"), "quote")
    pages = table(spark, d, "documents").select("doc_id", F.lit(1).alias("page_seq"), F.col("text").alias("raw_text"))
    return gates.quotes_gate(quotes, pages, "item_id")


@query("""WITH a AS (SELECT doc_id, quality = 1 AS g1, toxic = 0 AS g2, doc_id % 5 <> 0 AS g4 FROM labels), t AS (SELECT doc_id, CASE WHEN NOT g1 THEN 'G1' WHEN NOT g2 THEN 'G2' WHEN NOT g4 THEN 'G4' END AS first_failure FROM a)
    SELECT doc_id, first_failure, CASE first_failure WHEN 'G1' THEN 'G1' WHEN 'G2' THEN 'G1,G2' ELSE 'G1,G2,G4' END AS trace FROM t""")
def first_failure(spark, d):
    labels = table(spark, d, "labels")
    found = gates.run_gates(labels, {"G1": F.col("quality") == 1, "G2": F.col("toxic") == 0, "G3": F.lit(False), "G4": F.col("doc_id") % 5 != 0}, disabled=("G3",))
    return found.select("doc_id", "first_failure", F.array_join("trace", ",").alias("trace"))


_OPERANDS = """y AS (SELECT n_nationkey AS entity, year(o_orderdate) AS period,
        CAST(sum(l_extendedprice) AS DOUBLE) AS revenue, CAST(sum(l_extendedprice * l_discount) AS DOUBLE) AS cogs, CAST(sum(l_extendedprice * (1 - l_discount)) AS DOUBLE) AS gross_profit,
        CAST(sum(l_extendedprice * (1 - l_discount) * 0.4) AS DOUBLE) AS operating_income, CAST(sum(l_extendedprice * (1 - l_discount) * 0.3) AS DOUBLE) AS net_income, CAST(sum(l_quantity) AS DOUBLE) AS inventory,
        CAST(sum(l_quantity * 50) AS DOUBLE) AS current_assets, CAST(sum(l_quantity * 20) AS DOUBLE) AS current_liabilities, CAST(sum(l_extendedprice * l_tax) AS DOUBLE) AS tax_expense,
        CAST(sum(l_quantity * 900) AS DOUBLE) AS total_assets, CAST(sum(l_quantity * 7) AS DOUBLE) AS receivables, CAST(sum(l_quantity * 5) AS DOUBLE) AS payables, CAST(sum(l_quantity * 300) AS DOUBLE) AS equity
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"""
OPERAND_NAMES = ("revenue", "cogs", "gross_profit", "operating_income", "net_income", "inventory", "current_assets", "current_liabilities", "tax_expense", "total_assets", "receivables", "payables", "equity")


def yearly_operands(spark, d) -> DataFrame:
    """Operands per nation and year from the order tables; dimensions are joined after the first aggregation by customer."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("period"))
    price, net, q = F.col("l_extendedprice"), F.col("l_extendedprice") * (1 - F.col("l_discount")), F.col("l_quantity")
    sums = {
        "revenue": price, "cogs": price * F.col("l_discount"), "gross_profit": net, "operating_income": net * 0.4, "net_income": net * 0.3, "inventory": q, "current_assets": q * 50,
        "current_liabilities": q * 20, "tax_expense": price * F.col("l_tax"), "total_assets": q * 900, "receivables": q * 7, "payables": q * 5, "equity": q * 300,
    }
    nations = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("entity"))
    joined = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(nations, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("entity", "period").agg(*[F.sum(c).alias(n) for n, c in sums.items()])


@query(f"""WITH {_OPERANDS} SELECT entity, period, round((current_assets - inventory) / current_liabilities, 4) AS quick_ratio, round(current_assets / current_liabilities, 4) AS current_ratio,
    round(current_assets - current_liabilities, 2) AS working_capital, round(gross_profit / revenue, 4) AS gross_margin, round(operating_income / revenue, 4) AS operating_margin, round(net_income / revenue, 4) AS net_margin FROM y""")
def metric_ratios(spark, d):
    names = ["quick_ratio", "current_ratio", "gross_margin", "operating_margin", "net_margin"]
    found = metrics.with_metrics(metrics.with_metrics(yearly_operands(spark, d), names, 4), ["working_capital"], 2)
    return found.select("entity", "period", "working_capital", *names)


_PREV = f"WITH {_OPERANDS}, p AS (SELECT *, " + ", ".join(f"lag({n}) OVER w AS {n}__prev" for n in ("total_assets", "equity", "inventory", "receivables", "payables", "revenue")) + " FROM y WINDOW w AS (PARTITION BY entity ORDER BY period))"


def with_prev(spark, d) -> DataFrame:
    return metrics.with_previous(yearly_operands(spark, d), "entity", "period", ["total_assets", "equity", "inventory", "receivables", "payables", "revenue"])


@query(f"""{_PREV} SELECT entity, period, round(net_income / ((total_assets__prev + total_assets) / 2), 4) AS roa, round(net_income / ((equity__prev + equity) / 2), 4) AS roe,
    round(cogs / ((inventory__prev + inventory) / 2), 4) AS inventory_turnover, round(revenue / ((total_assets__prev + total_assets) / 2), 4) AS asset_turnover,
    round(365 * ((receivables__prev + receivables) / 2) / revenue, 4) AS dso, round(365 * ((payables__prev + payables) / 2) / (cogs + (inventory - inventory__prev)), 4) AS dpo FROM p""")
def metric_averages(spark, d):
    names = ["roa", "roe", "inventory_turnover", "asset_turnover", "dso", "dpo"]
    return metrics.with_metrics(with_prev(spark, d), names, 4).select("entity", "period", *names)


@query(f"""{_PREV}, c AS (SELECT entity, max_by(revenue, period) AS e, min_by(revenue, period) AS s, max(period) - min(period) AS n FROM y GROUP BY 1)
    SELECT p.entity, period, round((revenue - revenue__prev) / revenue__prev, 4) AS revenue_growth, round(pow(e / s, 1.0 / n) - 1, 4) AS cagr FROM p JOIN c USING (entity)""")
def metric_growth_cagr(spark, d):
    rows = with_prev(spark, d)
    span = rows.groupBy("entity").agg(F.max_by("revenue", "period").alias("end"), F.min_by("revenue", "period").alias("start"), (F.max("period") - F.min("period")).alias("n"))
    return metrics.with_metrics(rows.join(span, "entity"), ["revenue_growth", "cagr"], 4).select("entity", "period", "revenue_growth", "cagr")


@query(f"""{_PREV} SELECT entity, period, CAST(CASE WHEN greatest(revenue, cogs, gross_profit) = revenue THEN 1 WHEN greatest(revenue, cogs, gross_profit) = cogs THEN 2 ELSE 3 END AS DOUBLE) AS rank_of_max,
    CAST(sign(revenue - revenue__prev) AS DOUBLE) AS direction, round(revenue__prev + revenue, 2) AS two_years FROM p""")
def metric_rank_compare(spark, d):
    rows = with_prev(spark, d)
    columns = {"rank_of_max": "rank(revenue, cogs, gross_profit)", "direction": "compare(revenue, prev(revenue))", "two_years": "sum_range(revenue, prev, current)"}
    for name, formula in columns.items():
        rows = rows.withColumn(name, metrics.compile_formula(formula)[0])
    return rows.select("entity", "period", "rank_of_max", "direction", F.round("two_years", 2).alias("two_years"))


_NUMBER_VALUES = ", ".join("(" + ", ".join(repr(v) if isinstance(v, str) else "NULL" if v is None else str(v) for v in row) + ")" for row in fixtures.NUMBERS)


_SCALE_CASES = " ".join(f"WHEN '{word}' THEN 1e{power}" for word, power in T.SCALE_WORDS.items())
_FIGURES = f"""raw AS (SELECT 'doc' || doc_id AS txt, regexp_extract_all(coalesce(text, ''), {_sql(T.NUMBER_WITH_SCALE)}, 1) AS found FROM documents),
    parts AS (SELECT txt, list_transform(found, lambda x: {{'word': lower(regexp_extract(x, '([A-Za-z]*)$', 1)), 'figure': regexp_replace(x, '(?i)(thousands?|millions?|billions?|trillions?|k|mm|bn)$', '')}}) AS found FROM raw),
    digits AS (SELECT txt, list_transform(found, lambda x: {{'word': x.word, 'figure': x.figure, 'digits': regexp_replace(x.figure, '[()$,+ \t\n]', '', 'g')}}) AS found FROM parts),
    read AS (SELECT txt, list_filter(list_transform(found, lambda x: (CASE WHEN contains(x.figure, '(') OR starts_with(x.digits, '-') THEN -1.0 ELSE 1.0 END) * TRY_CAST(replace(x.digits, '-', '') AS DOUBLE) * CAST(CASE x.word {_SCALE_CASES} ELSE 1 END AS DOUBLE)), lambda x: x IS NOT NULL) AS found FROM digits),
    near AS (SELECT txt, found, len(list_filter(found, lambda x: abs(1577 - x) <= 0.005 * 1577 OR len(list_filter([1e3, 1e6, 1e9], lambda f: (x <> 0 AND abs(1577 * f - x) <= 0.005 * abs(x)) OR (x <> 0 AND abs(1577 - x * f) <= 0.005 * abs(x * f)))) > 0)) > 0 AS matches FROM read)"""


@query(f"WITH v(txt, first, n, matches) AS (VALUES {_NUMBER_VALUES}), {_FIGURES} SELECT txt, CAST(first AS DOUBLE) AS first_value, n AS figures, matches = 1 AS matches FROM v UNION ALL SELECT txt, found[1], len(found), matches FROM near")
def number_extract(spark, d):
    """Written answers with known figures, and all documents."""
    read = lambda c: [T.first_number(c).alias("first_value"), F.size(T.all_numbers(c)).alias("figures"), T.numbers_match(F.lit("1577"), c).alias("matches")]
    written = fixtures.numbers(spark).select("txt", *read(F.col("txt")))
    return written.unionByName(table(spark, d, "documents").select(F.concat(F.lit("doc"), "doc_id").alias("txt"), *read(F.col("text"))))


_SCORED = "sc AS (SELECT l.doc_id, d.lang AS shape, doc_id % 11 = 0 AS abstained, quality = 1 AS correct, toxic = 0 AS located FROM labels l JOIN documents d USING (doc_id)), s AS (SELECT *, CASE WHEN abstained THEN 0 WHEN NOT correct THEN -1 WHEN located THEN 1 ELSE 0 END AS score FROM sc)"


def scored(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("shape"))
    rows = table(spark, d, "labels").join(docs, "doc_id").select("doc_id", "shape", (F.col("doc_id") % 11 == 0).alias("abstained"), (F.col("quality") == 1).alias("correct"), (F.col("toxic") == 0).alias("located"))
    return rows.withColumn("score", evaluate.score(F.col("abstained"), F.col("correct"), F.col("located")))


@query(f"WITH {_SCORED} SELECT shape, count(*) AS n, count(*) FILTER (score = 1) AS plus, count(*) FILTER (score = 0) AS zero, count(*) FILTER (score = -1) AS minus, CAST(sum(score) AS BIGINT) AS net, round(avg(score), 6) AS mean FROM s GROUP BY ROLLUP (shape)")
def score_rollup(spark, d):
    return evaluate.score_report(scored(spark, d), "shape")


@query("WITH g AS (SELECT source, (row_number() OVER (ORDER BY source) - 1) % 3 = 0 AS blind FROM (SELECT DISTINCT source FROM documents)) SELECT doc_id, source, blind FROM documents JOIN g USING (source)")
def group_split(spark, d):
    return evaluate.group_split(table(spark, d, "documents").select("doc_id", "source"), "source")


@query("""
    WITH t AS (SELECT count(*) AS n FROM documents), s AS (SELECT lang, count(*) AS size, greatest(1, CAST(round_even(100.0 * count(*) / any_value(n), 0) AS INT)) AS want FROM documents, t GROUP BY lang),
    p AS (SELECT doc_id, d.lang, want, greatest(1, size // want) AS stride, row_number() OVER (PARTITION BY d.lang ORDER BY source, doc_id) - 1 AS pos FROM documents d JOIN s USING (lang))
    SELECT doc_id, lang, pos // stride AS position FROM p WHERE pos % stride = 0 AND pos // stride < want""")
def stratified_sample(spark, d):
    return evaluate.stratified_sample(table(spark, d, "documents").select("doc_id", "lang", "source"), "lang", ["source", "doc_id"], 100).select("doc_id", "lang", "position")


@query("WITH n AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS seq FROM benchmark) SELECT item_id, seq, CASE WHEN seq < 1 THEN 0 WHEN seq < 4 THEN 1 WHEN seq < 12 THEN 2 ELSE (seq - 12) // 8 + 3 END AS batch FROM n")
def batch_plan(spark, d):
    return evaluate.plan_batches(table(spark, d, "benchmark").select("item_id"), ["item_id"], [1, 3, 8])


_RUN = "r AS (SELECT event_id, user_id, value, event_type, event_id % 13 = 0 AS abstained, CASE WHEN event_id % 13 = 0 THEN 0 WHEN event_id % 17 = 0 THEN -1 ELSE 1 END AS score FROM events)"


def run_rows(spark, d) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", (F.col("event_id") % 13 == 0).alias("abstained"))
    return e.withColumn("score", F.when(F.col("abstained"), 0).when(F.col("event_id") % 17 == 0, -1).otherwise(1))


@query(f"WITH {_RUN}, s AS (SELECT *, coalesce(max(CASE WHEN score = -1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM r) SELECT user_id, event_id, score FROM s WHERE stopped = 0")
def stop_prefix(spark, d):
    rows = run_rows(spark, d)
    rows = rows.withColumn("stop", evaluate.stop_flag("wrong", F.col("score"), F.col("score") >= 0, F.lit(True)))
    return evaluate.until_stop(rows, ["user_id"], ["event_id"], "stop").select("user_id", "event_id", "score")


@query(f"WITH {_RUN}, t AS (SELECT user_id, event_id, count(*) FILTER (NOT abstained) OVER w AS answered, count(*) FILTER (score = 1) OVER w AS \"right\", count(*) FILTER (score = -1) OVER w AS wrong FROM r WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)) SELECT user_id, event_id, answered, \"right\", wrong, round(wrong / CAST(nullif(answered, 0) AS DOUBLE), 6) AS false_rate FROM t")
def running_tally(spark, d):
    return evaluate.running_tally(run_rows(spark, d), ["user_id"], ["event_id"]).select("user_id", "event_id", "answered", "right", "wrong", "false_rate")


@query("""SELECT event_type AS stage, CAST(sum(1) AS BIGINT) AS calls, CAST(sum(CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS errors, CAST(sum(event_id % 1000) AS BIGINT) AS input_tokens, CAST(sum(event_id % 100) AS BIGINT) AS output_tokens,
    round(sum(value), 2) AS seconds, CASE event_type WHEN 'click' THEN round(sum(event_id % 1000) / 1e6 * 3.0 + sum(event_id % 100) / 1e6 * 15.0, 6) WHEN 'view' THEN round(sum(event_id % 1000) / 1e6 * 1.0 + sum(event_id % 100) / 1e6 * 5.0, 6) END AS cost FROM events GROUP BY 1""")
def usage_cost(spark, d):
    e = table(spark, d, "events")
    usage = e.select(F.col("event_type").alias("stage"), F.lit(1).cast("long").alias("calls"), (F.col("event_id") % 50 == 0).cast("long").alias("errors"), (F.col("event_id") % 1000).alias("input_tokens"), (F.col("event_id") % 100).alias("output_tokens"), F.col("value").alias("seconds"))
    return evaluate.usage_cost(usage, {"click": (3.0, 15.0), "view": (1.0, 5.0)}).withColumn("seconds", F.round("seconds", 2))


_UPSERT = "cur AS (SELECT event_id % 500 AS k, event_id AS v, event_type FROM events WHERE event_id % 2 = 0), inc AS (SELECT event_id % 700 AS k, event_id AS v, event_type FROM events WHERE event_id % 2 = 1)"


def upsert_sides(spark, d) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events")
    side = lambda m, r: e.filter(F.col("event_id") % 2 == r).select((F.col("event_id") % m).alias("k"), F.col("event_id").alias("v"), "event_type")
    return side(500, 0), side(700, 1)


@query(f"WITH {_UPSERT}, b AS (SELECT *, 0 AS nw FROM cur UNION ALL SELECT *, 1 FROM inc), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v DESC, nw DESC) AS n FROM b) SELECT k, v, event_type FROM r WHERE n = 1")
def upsert_latest(spark, d):
    return sinks.keep_latest(*upsert_sides(spark, d), ["k"], "v")


@query(f"WITH {_UPSERT}, c1 AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v) AS n FROM cur), i1 AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v) AS n FROM inc) SELECT k, v, event_type FROM c1 WHERE n = 1 UNION ALL SELECT k, v, event_type FROM i1 WHERE n = 1 AND k NOT IN (SELECT k FROM cur)")
def insert_first_wins(spark, d):
    current, incoming = upsert_sides(spark, d)
    empty = current.limit(0)
    return sinks.first_wins(sinks.first_wins(empty, current, ["k"], ["v"]), incoming, ["k"], ["v"])


@query("""WITH c AS (SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id % 2 = 0), i AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'xx' END AS lang, 'new' AS source, n_chars + 1 AS n_chars FROM documents WHERE doc_id % 4 <> 2)
    SELECT coalesce(c.doc_id, i.doc_id) AS doc_id, CASE WHEN c.doc_id IS NULL THEN i.lang ELSE coalesce(i.lang, c.lang) END AS lang, CASE WHEN c.doc_id IS NULL THEN i.source ELSE c.source END AS source, CASE WHEN c.doc_id IS NULL THEN i.n_chars ELSE coalesce(i.n_chars, c.n_chars) END AS n_chars
    FROM c FULL JOIN i ON c.doc_id = i.doc_id""")
def upsert_columns(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    incoming = docs.filter("doc_id % 4 <> 2").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "xx").alias("lang"), F.lit("new").alias("source"), (F.col("n_chars") + 1).alias("n_chars"))
    return sinks.update_columns(docs.filter("doc_id % 2 = 0"), incoming, ["doc_id"], ["lang", "n_chars"])


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_antijoin(spark, d):
    return sinks.unseen(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), ["doc_id"])


@query("SELECT event_type, " + ", ".join(f"count(*) FILTER (user_id % 3 = {k}) AS v{k}" for k in range(3)) + " FROM events GROUP BY 1")
def verdict_pivot(spark, d):
    e = table(spark, d, "events").select("event_type", F.concat(F.lit("v"), F.col("user_id") % 3).alias("verdict"))
    return e.groupBy("event_type").pivot("verdict", ["v0", "v1", "v2"]).count().na.fill(0)


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def usage_windows(spark, d):
    found = ingest.windowed_usage(table(spark, d, "events"))
    return found.withColumn("total", F.round("total", 2))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
    SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, sid""")
def usage_sessions(spark, d):
    return ingest.sessions(table(spark, d, "events"))


def parsed_pages(spark, d) -> DataFrame:
    return html.parse_documents(table(spark, d, "pages"), "page_id", "html", 1)


_BLANKS = r"[\t\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_BODY = r"body AS (SELECT CAST(page_id AS VARCHAR) AS doc_id, regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<!doctype[^>]*>', '', 'g'), '(?is)<head>.*?</head>', '', 'g') AS h FROM pages)"


def _unescaped(text: str) -> str:
    for name, sign in (("middot", "\u00b7"), ("copy", "\u00a9"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        text = f"replace({text}, '&{name};', '{sign}')"
    return text


def _cleaned(text: str) -> str:
    """SQL for one space between words; lines stay, and of empty ones in a row one."""
    spaced = f"regexp_replace(regexp_replace({text}, '[\\x{{200b}}-\\x{{200d}}\\x{{feff}}]', '', 'g'), '{_BLANKS}', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({spaced}, ' ?\\n ?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))"


_FOOTER = r"nullif(try_cast(regexp_extract(right(raw_text, 120), '(?i)(?:^|\n)\s*(?:page\s*)?(\d{1,3})\s*$', 1) AS INT), 0)"
_LAID = r"regexp_replace(regexp_replace(regexp_replace(h, '(?i)<br[^>]*>', chr(10) || chr(10), 'g'), '(?i)</?(p|div|tr|table|li|ul|ol|h[1-6]|td|th|tbody|thead|section|article)( [^>]*)?>', chr(10), 'g'), '<[^>]*>', '', 'g')"


@query(f"""WITH {_BODY}, t AS (SELECT doc_id, {_cleaned(_unescaped(_LAID))} AS raw_text FROM body)
    SELECT doc_id, 1 AS page_seq, raw_text, {_FOOTER} AS printed_no, 0 AS char_start, length(raw_text) AS char_end, doc_id || '#p1' AS page_id, length(raw_text) // 4 AS token_estimate, CAST(NULL AS VARCHAR) AS prev_page_id, CAST(NULL AS VARCHAR) AS next_page_id FROM t WHERE raw_text <> ''""")
def html_pages(spark, d):
    return html.page_table(parsed_pages(spark, d))


_LEAF = r"(?is)<(p|div|li|h[1-6])(?: [^>]*)?>((?:[^<]|</?(?:a|b|br)(?: [^>]*)?>)*)</(?:p|div|li|h[1-6]|ul|article)>"
_SHAPE = r"(?i)^(item\s+\d+[a-z]?\.?|part\s+[ivx]+\.?|note\s+\d+|(consolidated|condensed)\s+(statements?|balance))"


@query(rf"""WITH {_BODY}, found AS (SELECT doc_id, unnest(regexp_extract_all(h, '{_LEAF}', 1)) AS tag, unnest(regexp_extract_all(h, '{_LEAF}', 2)) AS inside, generate_subscripts(regexp_extract_all(h, '{_LEAF}', 2), 1) AS n FROM body),
    shown AS (SELECT doc_id, tag, n, trim(regexp_replace({_unescaped("regexp_replace(inside, '<[^>]*>', '', 'g')")}, '(?:\n|{_BLANKS})+', ' ', 'g')) AS text FROM found),
    kept AS (SELECT doc_id, tag, text, min(n) AS n FROM shown WHERE text <> '' GROUP BY ALL),
    typed AS (SELECT doc_id, n, text, CASE WHEN length(text) <= 200 AND ((length(text) BETWEEN 4 AND 119 AND text = upper(text) AND text <> lower(text)) OR tag LIKE 'h_' OR regexp_matches(text, '{_SHAPE}')) THEN 'heading'
        WHEN tag = 'li' THEN 'list' WHEN regexp_matches(text, '(?i)^\(?[0-9a-z]\)\s+\S|^\*\s+\S') AND length(text) < 600 THEN 'footnote' ELSE 'paragraph' END AS block_type FROM kept),
    placed AS (SELECT *, row_number() OVER w - 1 AS block_at, last_value(CASE WHEN block_type = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS caption FROM typed WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
    keyed AS (SELECT *, doc_id || '#p1.b' || block_at AS block_id FROM placed)
    SELECT doc_id, 1 AS page_seq, block_at, block_id, block_type, text, caption, lag(block_id) OVER w AS prev_block_id, lead(block_id) OVER w AS next_block_id FROM keyed WINDOW w AS (PARTITION BY doc_id ORDER BY block_at)""")
def html_blocks(spark, d):
    return html.block_table(parsed_pages(spark, d))


def broken_documents(spark, d) -> DataFrame:
    """Every document as a filing whose lines break pages."""
    return html.parse_documents(table(spark, d, "documents").select("doc_id", fixtures.paged_html(F.col("text")).alias("html")), "doc_id", "html")


@query(f"""WITH RECURSIVE line AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
    shown AS (SELECT doc_id, n, unnest([{_cleaned("line")}, CASE WHEN n % 7 = 5 THEN 'Page ' || n END]) AS line, unnest([0, 1]) AS place FROM line),
    numbered AS (SELECT *, 3 * ((n - 1) // 7) + CASE WHEN (n - 1) % 7 < 2 THEN 0 WHEN (n - 1) % 7 < 5 THEN 1 ELSE 2 END AS k FROM shown),
    fragment AS (SELECT doc_id, k, coalesce(string_agg(line, chr(10) || chr(10) ORDER BY n, place) FILTER (WHERE line <> ''), '') AS text FROM numbered GROUP BY ALL),
    fold AS (SELECT doc_id, k, length(text) AS joined, 0 AS page, text FROM fragment WHERE k = 0 UNION ALL
        SELECT f.doc_id, f.k, CASE WHEN s.joined >= 200 THEN 0 ELSE s.joined END + length(f.text) + CASE WHEN s.joined BETWEEN 1 AND 199 AND f.text <> '' THEN 1 ELSE 0 END, s.page + CASE WHEN s.joined >= 200 THEN 1 ELSE 0 END, f.text FROM fold s JOIN fragment f ON f.doc_id = s.doc_id AND f.k = s.k + 1),
    full_pages AS (SELECT doc_id, count(*) FILTER (WHERE joined >= 200) AS n FROM fold GROUP BY 1),
    page AS (SELECT doc_id, least(page, greatest(n - 1, 0)) AS page, string_agg(text, chr(10) ORDER BY k) FILTER (WHERE text <> '') AS raw_text FROM fold JOIN full_pages USING (doc_id) GROUP BY ALL),
    spans AS (SELECT *, row_number() OVER w AS page_seq, sum(length(raw_text) + 1) OVER w - 1 AS char_end FROM page WHERE raw_text <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY page))
    SELECT doc_id, page_seq, raw_text, {_FOOTER} AS printed_no, char_end - length(raw_text) AS char_start, char_end FROM spans""")
def page_breaks(spark, d):
    """Pages of all documents, laid out with breaks of every kind; short fragments are joined."""
    return html.page_table(broken_documents(spark, d)).select("doc_id", "page_seq", "raw_text", "printed_no", "char_start", "char_end")


@query("""WITH line AS (SELECT doc_id, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS n FROM documents)
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, count(*) FILTER (n % 7 IN (0, 3)) AS styled_breaks, count(*) FILTER (n % 7 IN (5, 6)) AS rules, count(*) FILTER (n % 7 = 5) AS page_rules FROM line GROUP BY 1""")
def break_markers(spark, d):
    """How many breaks and rules each document has."""
    return broken_documents(spark, d).select("doc_id", *[F.col("markers")[name].alias(name) for name in ("styled_breaks", "rules", "page_rules")])


@query("""WITH page AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS page_seq FROM documents), each AS (SELECT *, unnest(['page', 'block', 'table', 'cell']) AS kind FROM page)
    SELECT doc_id, page_seq, kind, CASE WHEN kind <> 'page' THEN page_seq % 5 END AS ordinal, CASE WHEN kind = 'cell' THEN page_seq % 3 END AS row_idx, CASE WHEN kind = 'cell' THEN page_seq + 1 END AS col_idx,
        doc_id || '#p' || page_seq || CASE kind WHEN 'page' THEN '' WHEN 'block' THEN '.b' || page_seq % 5 ELSE '.t' || page_seq % 5 END || CASE WHEN kind = 'cell' THEN '.r' || page_seq % 3 || 'c' || (page_seq + 1) ELSE '' END AS key FROM each""")
def key_parts(spark, d):
    """Keys of pages, blocks, tables and cells by the lines of all documents, and what is read back from them."""
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    doc, page = F.col("doc_id"), F.col("page_seq")
    rows = table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(1), lines)).alias("page_seq"))
    grid = keys.table_key(doc, page, page % 5)
    made = F.array(keys.page_key(doc, page), keys.block_key(doc, page, page % 5), grid, keys.cell_key(grid, page % 3, page + 1))
    return rows.select(F.explode(made).alias("key")).select("key", keys.key_parts(F.col("key")).alias("k")).select("k.*", "key")


_DOC = "'S' || s_suppkey || '_2022_10K'"
_SHOWN = "format('{:,}', s_suppkey + 1000)"


def supplier_filings(spark, d) -> DataFrame:
    """Keys are dealt to all cores before filings are made of them: a table that fits few row groups would be few tasks' work."""
    return fixtures.filings_of(lexical.spread(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey"))


@query(f"WITH v(ordinal, raw_title, kind, page_start, page_end, parent) AS (VALUES {fixtures.sql_rows(fixtures.SECTIONS)}) SELECT {_DOC} AS doc_id, ordinal, raw_title, kind, page_start, page_end, {_DOC} || '#s' || parent AS parent_id FROM v, supplier")
def heading_tree(spark, d):
    """Sections of a filing for every supplier."""
    tree = sections.build_tree(written(html.page_table(html.parse_documents(supplier_filings(spark, d), "doc_id", "html", 40)), "pages"))
    return tree.select("doc_id", "ordinal", "raw_title", "kind", "page_start", "page_end", "parent_id")


@query(f"""WITH v(row_idx, col_idx, row_label, col_label, raw_text, numeric_value, sign) AS (VALUES {fixtures.sql_rows(fixtures.CELLS)})
    SELECT {_DOC} AS doc_id, row_idx, col_idx, row_label, col_label, CASE WHEN raw_text = '(1,577)' THEN '(' || {_SHOWN} || ')' ELSE raw_text END AS raw_text, CAST(CASE WHEN raw_text = '(1,577)' THEN -(s_suppkey + 1000) ELSE numeric_value END AS DOUBLE) AS numeric_value, sign, 'millions' AS scale FROM v, supplier""")
def table_cells(spark, d):
    """Typed cells of a filing for every supplier."""
    parsed = html.parse_documents(supplier_filings(spark, d), "doc_id", "html", 40)
    grids = html.grid_table(parsed).drop("page_seq")
    cells = tables.typed_cells(tables.analyse(grids), ["doc_id", "table_at"])
    return cells.select("doc_id", "row_idx", "col_idx", "row_label", "col_label", "raw_text", F.col("numeric_value").cast("double").alias("numeric_value"), "sign", "scale")


@query(f"""WITH v(n, qname, value, sign, scale, period_start, period_end, is_instant, row_label, dimensions) AS (VALUES {fixtures.sql_rows(fixtures.FACTS)})
    SELECT {_DOC} AS doc_id, {_DOC} || '#f' || n AS fact_id, qname, CAST(CASE n WHEN 0 THEN -(s_suppkey + 1000) * 1000000 ELSE (s_suppkey + 2000) * 1000 END AS DOUBLE) AS value, 'USD' AS unit, scale, sign, period_start, period_end, is_instant, dimensions, row_label FROM v, supplier""")
def xbrl_facts(spark, d):
    """Facts of a filing for every supplier."""
    found = xbrl.facts(xbrl.read_tagged(supplier_filings(spark, d), "doc_id", "html"))
    shown = {"dimensions": F.to_json("dimensions"), "value": F.col("value").cast("double"), "period_start": F.col("period_start").cast("string"), "period_end": F.col("period_end").cast("string")}
    return found.withColumns(shown)


@query(f"""SELECT {_DOC} AS doc_id, 'ready' AS ingest_status, CAST(NULL AS VARCHAR) AS error, 5 AS n_pages, 6 AS n_sections, 6 AS n_cells, 2 AS n_facts, CAST(-(s_suppkey + 1000) - 1373 + 300 + 280 + 1200 + 1100 AS DOUBLE) AS cells, {_DOC} || '#p5#f0' AS first_fact FROM supplier
    UNION ALL SELECT 'draft' || s_suppkey, 'failed', 'unrecognised name', 0, 0, 0, 0, NULL, NULL FROM supplier WHERE s_suppkey % 3 = 0""")
def ingest_full(spark, d):
    """Filings of all suppliers in envelopes, and files with bad names, through the whole ingest."""
    files = supplier_filings(spark, d).select("doc_id", F.concat(F.lit("<SEC-DOCUMENT>\n<TYPE>10-K\n"), "html", F.lit("\n<TYPE>XML\n<html>data</html>")).alias("raw"))
    drafts = table(spark, d, "supplier").filter("s_suppkey % 3 = 0").select(F.concat(F.lit("draft"), F.col("s_suppkey").cast("string")).alias("doc_id"), F.lit("<p>not yet</p>").alias("raw"))
    made = ingest_plan.ingest(files.unionByName(drafts), 40)
    count = lambda df, name, *more: df.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias(name), *more)
    found = made.filings.select("doc_id", "ingest_status", "error", F.col("n_pages").cast("int").alias("n_pages"))
    for side in (count(made.sections, "n_sections"), count(made.cells, "n_cells", F.sum(F.col("numeric_value").cast("double")).alias("cells")), count(made.facts, "n_facts", F.min("fact_id").alias("first_fact"))):
        found = found.join(side, "doc_id", "left")
    return found.na.fill(0, ["n_sections", "n_cells", "n_facts"])


@query("""WITH s AS (SELECT o_custkey AS qid, year(o_orderdate) AS y, CAST(sum(o_totalprice) AS DOUBLE) AS value FROM orders GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY y DESC) AS n FROM s)
    SELECT qid, max(value) FILTER (n = 1) AS revenue, max(value) FILTER (n = 2) AS revenue_prev, CAST(NULL AS DOUBLE) AS cogs FROM r GROUP BY 1""")
def operand_align(spark, d):
    """Every customer's yearly totals as slots named after their year, for a formula that asks for this year's and the last one's."""
    totals = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("qid"), F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").cast("double").alias("value"))
    year = F.col("y").cast("string")
    slots = totals.select("qid", F.concat(F.lit("Revenue FY"), year).alias("name"), F.concat(F.lit("FY"), year).alias("period"), "value")
    required = totals.select("qid").distinct().withColumn("required", F.explode(F.array(*map(F.lit, ("revenue", "revenue__prev", "cogs")))))
    found = metrics.align_operands(slots, required).groupBy("qid").pivot("required", ["revenue", "revenue__prev", "cogs"]).agg(F.first("value"))
    return found.withColumnRenamed("revenue__prev", "revenue_prev")


@query("""SELECT p_partkey, p_partkey % 23 - 12 AS scale, CAST(CASE WHEN p_partkey % 5 = 0 THEN -1 ELSE 1 END * CAST((p_partkey * 1234567) || 'e' || (p_partkey % 23 - 12) AS DECIMAL(38, 6)) AS VARCHAR) AS value FROM part""")
def xbrl_scale(spark, d):
    """A tagged filing for every part, with scales from -12 to 10 and signs."""
    scale, sign = (F.col("p_partkey") % 23 - 12).cast("string"), F.when(F.col("p_partkey") % 5 == 0, ' sign="-"').otherwise("")
    head = '<ix:header><xbrli:context id="c"><xbrli:period><xbrli:instant>2022-12-31</xbrli:instant></xbrli:period></xbrli:context></ix:header>'
    tag = F.concat(F.lit('<p><ix:nonFraction name="us-gaap:Assets" contextRef="c" scale="'), scale, F.lit('"'), sign, F.lit(">"), F.format_number(F.col("p_partkey") * 1234567, 0), F.lit("</ix:nonFraction></p>"))
    docs = lexical.spread(table(spark, d, "part").select("p_partkey"), "p_partkey").select("p_partkey", F.concat(F.lit(head), tag).alias("html"))
    found = xbrl.facts(xbrl.read_tagged(docs, "p_partkey", "html"))
    return found.select(F.col("doc_id").cast("long").alias("p_partkey"), F.col("scale").cast("long").alias("scale"), F.col("value").cast("string").alias("value"))


@query("""WITH p AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, n_chars, text FROM documents),
    h AS (SELECT *, '[' || source || ' | ' || lang || ' | FY' || (2000 + doc_id % 25) || CASE WHEN doc_id % 3 = 0 THEN ' | Item ' || (doc_id % 9) ELSE '' END || ' | p.' || (doc_id % 40 + 1) || CASE WHEN doc_id % 7 <> 0 THEN ' (printed ' || (doc_id % 7) || ')' ELSE '' END || ']' AS header FROM p)
    SELECT doc_id, header, header || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'Item ' || (doc_id % 9) ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '2021' || chr(10) || 'Net sales' ELSE '' END || CASE WHEN coalesce(text, '') <> '' THEN chr(10) || text ELSE '' END AS lexical FROM h""")
def lexical_text(spark, d):
    """Every document as a page with provenance, section, table words and its text as summary."""
    n = F.col("doc_id")
    part = lambda k, extra=0: (n % k + extra).cast("int")
    section = F.when(n % 3 == 0, F.concat(F.lit("Item "), part(9).cast("string")))
    words = F.when(n % 2 == 0, F.array(F.lit("2021"), F.lit(""), F.lit("Net sales")))
    pages = table(spark, d, "documents").withColumn("header", composite.context_header(F.col("source"), F.col("lang"), F.concat(F.lit("FY"), part(25, 2000).cast("string")), section, part(40, 1), part(7)))
    return pages.select("doc_id", "header", composite.lexical_text(F.col("header"), section, words, F.col("text")).alias("lexical"))


@query(f"""WITH v(n, page_seq, score, bucket, rank) AS (VALUES ('a', 4, 1.0, 'cashflow', 1), ('a', 5, 1.0, 'cashflow', 2), ('a', 2, 1 / 7.0, 'mdna', 3), ('a', 3, 1 / 7.0, 'mdna', 4), ('b', 2, 1.0, 'mdna', 1), ('b', 3, 1.0, 'mdna', 2), ('b', 4, 0.2, 'cashflow', 3), ('b', 5, 0.2, 'cashflow', 4))
    SELECT {_DOC} || '-' || n AS qid, {_DOC} AS doc_id, page_seq, CAST(round(CAST(score AS DOUBLE), 6) AS DOUBLE) AS score, bucket, rank FROM v, supplier""")
def anchor_pages(spark, d):
    """Structural retrieval over a filing for every supplier, two questions each."""
    filed = supplier_filings(spark, d)
    pages = written(html.page_table(html.parse_documents(filed, "doc_id", "html", 40)), "pages")
    texts = F.array(F.struct(F.lit("a").alias("n"), F.lit("What were capital expenditures and cash flow?").alias("q")), F.struct(F.lit("b").alias("n"), F.lit("Why did organic growth slow, and what drove it?").alias("q")))
    each = filed.select("doc_id", F.explode(texts).alias("t")).select(F.concat("doc_id", F.lit("-"), "t.n").alias("qid"), "doc_id", F.col("t.q").alias("question"))
    found = anchors.anchor_search(each.select("qid", "question"), each.select("qid", "doc_id", F.lit(1).alias("position")), pages, sections.build_tree(pages))
    return found.withColumn("score", F.round("score", 6))


@query(f"""{_FUSED}, gold AS (SELECT item_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY jscore DESC, doc_id) AS n FROM jac) WHERE n = 1),
    parts AS (SELECT 'bm25@10' AS configuration, item_id, doc_id FROM ranked WHERE rank <= 10 UNION ALL SELECT 'bm25@3', item_id, doc_id FROM ranked WHERE rank <= 3 UNION ALL SELECT 'fused', item_id, doc_id FROM fr)
    SELECT c.configuration, round(avg(CASE WHEN EXISTS (SELECT 1 FROM parts p WHERE p.configuration = c.configuration AND p.item_id = g.item_id AND p.doc_id = g.doc_id) THEN 1.0 ELSE 0.0 END), 6) AS recall,
        round(avg((SELECT count(*) FROM parts p WHERE p.configuration = c.configuration AND p.item_id = g.item_id)), 6) AS pages FROM gold g, (SELECT DISTINCT configuration FROM parts) c GROUP BY 1""".replace("parts AS (SELECT 'bm25@10'", "cfg AS (SELECT 'bm25@10'").replace("FROM parts p", "FROM cfg p").replace("configuration FROM parts)", "configuration FROM cfg)"))
def recall_report(spark, d):
    gold = evaluate.gold_pages(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "doc_id").select(F.col("item_id").alias("qid"), "doc_id")
    # Each ranking is made once; these tables have a few rows a question.
    gold = written(gold, "gold")
    best, shared = written(global_ranking(spark, d).select("item_id", "doc_id", "rank"), "ranked"), written(jaccard_ranking(spark, d).select("item_id", "doc_id", "rank"), "ranked")
    ranked = best.withColumnRenamed("item_id", "qid")
    fused = fusion.rrf([("bm25", best, 1.0), ("jaccard", shared, 0.5)], "item_id", "doc_id").withColumnRenamed("item_id", "qid")
    found = anchors.recall_at({"bm25@10": ranked, "bm25@3": ranked.filter("rank <= 3"), "fused": fused}, gold, ["doc_id"])
    return found.select("configuration", F.round("recall", 6).alias("recall"), F.round("pages", 6).alias("pages"))


@query(f"""WITH {_SCORES}, {_GLOBAL}, {_SETS}, top AS (SELECT item_id, doc_id, score FROM ranked WHERE rank = 1), j AS (SELECT t.item_id, t.doc_id, t.score, coalesce(round(shared / CAST(np AS DOUBLE), 6), 0) AS containment FROM top t LEFT JOIN sh USING (item_id, doc_id))
    SELECT b.item_id, j.doc_id, j.score, coalesce(containment, 0) AS containment, CASE WHEN coalesce(containment, 0) >= 0.6 THEN 'answered' ELSE 'abstained' END AS status FROM benchmark b LEFT JOIN j USING (item_id)""")
def answer_status(spark, d):
    """End to end: the best page of each passage, how much of the passage it has, and whether that is enough to answer."""
    best = global_ranking(spark, d, 1).select("item_id", "doc_id", "score")
    docs = table(spark, d, "documents").join(best.select("doc_id").distinct(), "doc_id", "left_semi")
    shared = evaluate.shared_tokens(table(spark, d, "benchmark"), docs, "item_id", "doc_id")
    found = best.join(shared.select("item_id", "doc_id", F.round(F.col("shared") / F.col("n_passage"), 6).alias("containment")), ["item_id", "doc_id"], "left")
    rows = table(spark, d, "benchmark").select("item_id").join(found, "item_id", "left").withColumn("containment", F.coalesce("containment", F.lit(0.0)))
    return rows.select("item_id", "doc_id", "score", "containment", F.when(F.col("containment") >= 0.6, "answered").otherwise("abstained").alias("status"))


from . import record_queries  # noqa: E402, F401  registers its queries with these

ORACLE_SQL.update({name: sql() for name, sql in record_queries.LATE_SQL.items()})
