"""Operators on small written inputs."""

import math

import pytest
from pyspark.sql import functions as F

from evspark.functions import keys
from evspark.functions import text as T
from evspark.functions import vectors
from evspark.operators import anchors, composite, dense, evaluate, fusion, gates, metrics, provider, route, sections, tables
from evspark.plans import fixtures
from evspark.sources import filings, html, sinks, xbrl


def values(spark, column, rows, ddl="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], ddl).select(column).collect()]


def test_cell_numbers(spark):
    shown = ["(1,577)", "-12.5", "$ 3,000", "12.4%", "", "—", "$", "words", None]
    found = values(spark, tables.cell_number(F.col("x")), shown)
    assert [None if v is None else float(v) for v in found] == [-1577.0, -12.5, 3000.0, 12.4, None, None, None, None, None]


def test_years(spark):
    found = values(spark, T.years_in(F.col("x")), ["FY2022 and 2020", "fy21", "12020", None])
    assert [sorted(v) for v in found] == [[2020, 2022], [2021], [], []]


@pytest.mark.parametrize("row", fixtures.QUESTIONS)
def test_intent_shape_decline(spark, row):
    _, question, answer, intent, shape, declined = row
    got = spark.createDataFrame([(question, answer)], "q string, a string").select(T.intent(F.col("q")), T.answer_shape(F.col("a")), T.reads_as_decline(F.col("a"))).first()
    assert tuple(got) == (intent, shape, declined == "yes")


def test_numbers_match(spark):
    pairs = [("$8.70 billion", "8,700", True), ("1577", "In FY2018 it was $1,577 million", True), ("12.4%", "0.124", False), ("5", "no figure", False), ("0", "0.001", True)]
    df = spark.createDataFrame([(g, c) for g, c, _ in pairs], "g string, c string")
    assert [r[0] for r in df.select(T.numbers_match(F.col("g"), F.col("c"))).collect()] == [p[2] for p in pairs]


def test_formula_compiles_and_rejects(spark):
    df = spark.createDataFrame([(10.0, 4.0, 3.0, 8.0)], "revenue double, cogs double, n double, revenue__prev double")
    evaluate_ = lambda f: df.select(metrics.compile_formula(f)[0]).first()[0]
    assert evaluate_("(revenue - cogs) / n") == 2.0
    assert evaluate_("revenue / (n - 3)") is None
    assert evaluate_("avg(revenue)") == 9.0
    assert evaluate_("delta(revenue) / prev(revenue)") == 0.25
    assert evaluate_("rank(cogs, revenue, revenue)") == 2.0
    assert evaluate_("compare(cogs, revenue)") == -1.0
    assert math.isclose(evaluate_("revenue ** 2"), 100.0)
    for bad in ("__import__('os')", "revenue.real", "[1]", "lambda: 1", "open('x')", "revenue if 1 else 2", "'a'", "avg(1)", "f(x=1)", "(", "True + 1"):
        with pytest.raises(metrics.FormulaError):
            metrics.compile_formula(bad)


def test_every_metric_compiles():
    for _, formula, *_rest in metrics.METRICS.values():
        assert metrics.required_operands(formula)
    assert len(metrics.METRICS) == 25 and len(metrics.OPERANDS) == 23


def test_choose_metric_prefers_longest(spark):
    df = spark.createDataFrame([("a", "What is the EBITDA margin?"), ("b", "free cash flow conversion in 2022"), ("c", "nothing")], "qid string, question string")
    assert {r["qid"]: r["metric"] for r in metrics.choose_metric(df).collect()} == {"a": "ebitda_margin", "b": "fcf_conversion", "c": None}


def test_align_operands(spark):
    slots = spark.createDataFrame([("q", "Total Assets", "2021", 1.0), ("q", "total assets", "2022", 2.0), ("q", "net revenue", "2022", 3.0)], "qid string, name string, period string, value double")
    required = spark.createDataFrame([("q", "total_assets"), ("q", "revenue"), ("q", "cogs")], "qid string, required string")
    assert {r["required"]: r["value"] for r in metrics.align_operands(slots, required).collect()} == {"total_assets": 2.0, "revenue": 3.0, "cogs": None}


def test_align_operands_by_period(spark):
    """The latest period serves ``x`` and the one before it ``x__prev``; a slot serves one name."""
    rows = [("a", "revenue_fy2021", "FY2021", 8.0), ("a", "Revenue FY2022", "FY2022", 10.0), ("a", "revenue", None, 1.0), ("b", "net income", "2020", 5.0), ("c", "inventory", "2019", 4.0)]
    slots = spark.createDataFrame(rows, "qid string, name string, period string, value double")
    asked = [("a", "revenue"), ("a", "revenue__prev"), ("b", "net_income"), ("b", "income"), ("c", "inventory__prev"), ("d", "revenue")]
    got = {(r["qid"], r["required"]): r["value"] for r in metrics.align_operands(slots, spark.createDataFrame(asked, "qid string, required string")).collect()}
    assert got[("a", "revenue")] == 10.0 and got[("a", "revenue__prev")] == 8.0
    assert sorted([got[("b", "net_income")] or 0.0, got[("b", "income")] or 0.0]) == [0.0, 5.0]
    assert got[("c", "inventory__prev")] is None and got[("d", "revenue")] is None


def test_facts_resolve_in_order(spark):
    facts = spark.createDataFrame([("d", "us-gaap:Revenues", 5.0), ("d", "us-gaap:SalesRevenueNet", 6.0), ("d", "us-gaap:Assets", 7.0)], "doc_id string, qname string, value double")
    row = metrics.resolve_facts(facts, ["doc_id"]).first()
    assert row["revenue"] == 5.0 and row["total_assets"] == 7.0 and row["cash"] is None


def test_gates(spark):
    quote = spark.createDataFrame([("the “net  sales” rose by much", "The net sales rose by much in 2022"), ("short", "short page"), ("not in the page at all", "page")], "q string, p string")
    assert [r[0] for r in quote.select(gates.quote_supported(F.col("q"), F.col("p"))).collect()] == [True, False, False]
    df = spark.createDataFrame([(True, False, True)], "a boolean, b boolean, c boolean")
    row = gates.run_gates(df, {"G1": F.col("a"), "G2": F.col("b"), "G3": F.col("c")}).first()
    assert row["first_failure"] == "G2" and row["trace"] == ["G1", "G2"]
    assert gates.run_gates(df, {"G1": F.col("a"), "G2": F.col("b"), "G3": F.col("c")}, ("G2",)).first()["first_failure"] is None
    years = spark.createDataFrame([([2022], [2021, 2022], "historical"), ([2024], [2022], "historical"), ([2024], [2022], "forecast")], "e array<int>, c array<int>, i string")
    assert [r[0] for r in years.select(gates.period_gate(F.col("e"), F.col("c"), F.col("i"))).collect()] == [True, False, True]
    digits = spark.createDataFrame([(1577.0, "was $1,577 million"), (1578.0, "was $1,577 million")], "v double, q string")
    assert [r[0] for r in digits.select(gates.digits_supported(F.col("v"), F.col("q"))).collect()] == [True, False]
    prose = spark.createDataFrame([(12.345, 12.35, "It was 12.35%"), (12.345, 12.35, "It was 13%"), (None, None, "words")], "c double, r double, p string")
    assert [r[0] for r in prose.select(gates.recompute_gate(F.col("c"), F.col("r"), F.col("p"))).collect()] == [True, False, True]


def test_pack_budget_against_fold(spark):
    items = [("g", i, c) for i, c in enumerate([50, 60, 30, 20, 1, 90])]
    got = fusion.pack_budget(spark.createDataFrame(items, "g string, k int, c int"), "g", "k", [F.col("k")], "c", 100).orderBy("k").collect()
    used, kept = 0, []
    for _, _, c in items:
        fits = not kept or used + c <= 100
        used += c if fits else 0
        kept.append(fits)
    assert [r["kept"] for r in got] == kept


def test_dense_edges(spark):
    v = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.0, 1.0]), (3, "a", None), (4, "a", [1.0]), (5, "b", [1.0, 0.0]), (6, "a", [0.0, 0.0])], "k int, s string, e array<float>")
    q = spark.createDataFrame([("q", "a", [2.0, 0.0]), ("z", "a", [0.0, 0.0])], "qid string, s string, query_vector array<float>")
    got = dense.dense_topk(dense.vector_index(v, "k", "e", "s"), q, "k", "qid", "e", "s", 5).orderBy("rank").collect()
    assert [(r["qid"], r["k"], r["score"]) for r in got] == [("q", 1, 1.0), ("q", 2, 0.0)]
    assert values(spark, vectors.coerce_vector(F.col("x")), ["[1, 2]", "bad"]) == [[1.0, 2.0], None]


def test_catalog_names(spark):
    rows = {r["doc_id"]: r for r in filings.catalog(spark.createDataFrame([(n,) for n in fixtures.FILING_NAMES], "doc_id string")).collect()}
    assert rows["acme_2023Q2_10Q"]["company_slug"] == "ACME" and rows["acme_2023Q2_10Q"]["period_label"] == "Q2 FY2023"
    assert rows["ACME_2022_10K"]["coverage_years"] == [2020, 2021, 2022]
    assert str(rows["GLOBEX_2022_8K_dated-2022-07-01"]["filing_date"]) == "2022-07-01"
    assert rows["notes"]["error"] and rows["notes"]["form_type"] is None


def test_router(spark):
    names = spark.createDataFrame([("ACME_2022_10K",), ("ACME_2021_10K",), ("ACME_2022Q2_10Q",), ("GLOBEX_2022_8K_dated-2022-07-01",)], "doc_id string")
    aliases = filings.read_aliases(spark, {"ACME": ["acme corp"], "GLOBEX": []})
    asked = spark.createDataFrame([("a", "ACME Corp revenue in FY2021?"), ("b", "acme's q2 revenue in 2022"), ("c", "What did Globex announce on June 30?"), ("d", "Who knows?")], "qid string, question string")
    best = {r["qid"]: r["doc_id"] for r in route.route(asked, filings.catalog(names), aliases).filter("rank = 1 or rank is null").collect()}
    assert best == {"a": "ACME_2021_10K", "b": "ACME_2022Q2_10Q", "c": "GLOBEX_2022_8K_dated-2022-07-01", "d": None}


def test_envelopes(spark):
    raw = "<SEC-DOCUMENT><html>index</html><TYPE>10-K\n<html>main</html><TYPE>EX-101.INS\n<html>machine</html><TYPE>EX-99\n<html>exhibit</html>"
    df = spark.createDataFrame([("e", raw), ("p", "<html>one</html>"), ("x", "<SEC-DOCUMENT>nothing")], "doc_id string, raw string")
    got = [(r["doc_id"], r["doc_type"], r["html"]) for r in filings.split_envelopes(df).orderBy("doc_id", "part").collect()]
    assert got == [("e", "10-K", "<html>main</html>"), ("e", "EX-99", "<html>exhibit</html>"), ("p", "primary", "<html>one</html>"), ("x", "primary", "<SEC-DOCUMENT>nothing")]


def test_pages_and_blocks(spark):
    filing = "<div><p>one</p><hr></div><table><tr><td>a</td></tr><tr><td><hr></td></tr></table><div style='page-break-before:always'>two &nbsp; words</div><p>end</p><p>Page 7</p>"
    parsed = lambda text, least: html.parse_documents(spark.createDataFrame([("d", text)], "doc_id string, html string"), "doc_id", "html", least)
    paged = lambda text, least: html.page_table(parsed(text, least)).orderBy("page_seq").collect()
    pages = paged(filing, 1)
    assert [p.raw_text for p in pages] == ["one", "a", "two words\n\nend\n\nPage 7"]  # of empty lines in a row one stays
    assert pages[2].printed_no == 7 and pages[0].char_start == 0 and pages[1].char_start == pages[0].char_end + 1
    assert [p.raw_text for p in paged(filing, 6)] == ["one\na\ntwo words\n\nend\n\nPage 7"]
    assert paged("", 1) == paged(None, 1) == []
    assert parsed(filing, 1).first().markers == {"styled_breaks": 1, "rules": 2, "page_rules": 1}
    blocks = parsed("<h1>Title</h1><p>text</p><ul><li>item</li></ul><p>text</p><h2>More</h2><p>end</p>", 1).first().blocks[0]
    assert [tuple(b) for b in blocks] == [("heading", "Title", None), ("paragraph", "text", "Title"), ("list", "item", "Title"), ("heading", "More", "Title"), ("paragraph", "end", "More")]


def test_fragments_join(spark):
    """Short fragments join the next, the last one the previous; rules, both spellings of styles and both sides cut; blanks of any kind are one."""
    filing = "<p>a</p><hr><p>bcd&#8203;ef&#160;\t&#8195;g</p><div style='BREAK-AFTER: page'>hij<p>kl</p></div>mnopqrs<p style='page-break-before : always'>t</p>"
    rows = spark.createDataFrame([("d", filing)], "doc_id string, html string")
    texts = lambda least: [p.raw_text for p in html.parse_documents(rows, "doc_id", "html", least).first().pages]
    assert texts(1) == ["a", "bcdef g\n\nhij\nkl", "mnopqrs", "t"]
    assert texts(2) == ["a\nbcdef g\n\nhij\nkl", "mnopqrs\nt"]
    assert texts(20) == ["a\nbcdef g\n\nhij\nkl\nmnopqrs\nt"]


def test_keys_and_their_parts(spark):
    rows = [("A_2022_10K#p12", ("A_2022_10K", 12, "page", None, None, None)), ("d#p1.b0", ("d", 1, "block", 0, None, None)), ("d#p1.t2.r3c4", ("d", 1, "cell", 2, 3, 4)), ("#p7", ("", 7, "page", None, None, None)),
            ("d#px", (None,) * 6), ("a#p1#p2", (None,) * 6), ("", (None,) * 6), (None, (None,) * 6)]
    found = spark.createDataFrame([(k,) for k, _ in rows], "key string").select("key", keys.key_parts(F.col("key")).alias("k")).collect()
    assert [(r.key, tuple(r.k)) for r in found] == rows
    assert spark.range(1).select(keys.page_key(F.lit(None), F.lit(1))).first()[0] is None


def test_grid_spans():
    table = next(n for n in html.parse("<table><tr><td colspan=2>a</td><td rowspan=2>b</td></tr><tr><td>c</td><td>d</td></tr><tr><td>e</td></tr></table>").walk() if n.tag == "table")
    assert html.grid_of(table) == [["a", "", "b"], ["c", "d", ""], ["e", "", ""]]


def test_table_pipeline(spark):
    grid = [["(In millions)", "", "2022", "", "2021"], ["Sales", "$", "1,000", "$", "(900)"], ["Costs", "$", "700", "$", "650"], ["Other items", "$", "5", "$", "6"]]
    df = tables.analyse(spark.createDataFrame([("t", grid), ("u", [["Year ended June 30,", "2022"], ["a b", "1"]])], "t string, grid array<array<string>>"))
    rows = {r["t"]: r for r in df.collect()}
    assert rows["t"]["header_tokens"] == ["2022", "2021"] and rows["t"]["col_kinds"] == ["label", "symbol", "value", "symbol", "value"]
    assert rows["t"]["alignment_ok"] and rows["t"]["units"] == "millions" and not rows["u"]["is_data_table"]
    cells = {(r["row_label"], r["col_label"]): float(r["numeric_value"]) for r in tables.typed_cells(df, ["t"]).collect()}
    assert cells[("Sales", "2021")] == -900 and len(cells) == 6
    labels = df.select(tables.row_labels(F.col("grid"))).first()[0]
    assert "Sales" in labels and "Other items" in labels
    assert df.filter("t = 't'").select(tables.markdown(F.col("grid"))).first()[0].count("\n") == 4


def test_sections(spark):
    pages = [("d", 1, "PART I\nItem 1. Business\ntext"), ("d", 2, "\n".join(f"Item {i}. X{i}" for i in range(1, 9))), ("d", 3, "Note 1 Basis\nbody"), ("d", 4, "PART II\nItem 7. Management's Discussion and Analysis of Financial Condition and Results of Operations.\n"), ("d", 5, "The following tables contain consolidated statements of income that are long prose lines and go on and on")]
    tree = sections.build_tree(spark.createDataFrame(pages, "doc_id string, page_seq int, raw_text string")).orderBy("ordinal").collect()
    assert [(r["kind"], r["page_start"], r["page_end"]) for r in tree] == [("part", 1, 1), ("item", 1, 2), ("note", 3, 3), ("part", 4, 4), ("mdna", 4, 5)]
    assert tree[2]["parent_id"] == "d#s1" and tree[4]["parent_id"] == "d#s3"


def test_xbrl(spark):
    rows = {r["qname"]: r for r in xbrl.facts(xbrl.read_tagged(fixtures.filings(spark), "doc_id", "html")).collect()}
    assert len(rows) == 2 and float(rows["us-gaap:PaymentsToAcquirePropertyPlantAndEquipment"]["value"]) == -1577e6
    assert rows["us-gaap:Assets"]["is_instant"] and rows["us-gaap:Assets"]["row_label"] == "Assets" and len(rows["us-gaap:Assets"]["dimensions"]) == 1


def test_anchor_search(spark):
    pages = spark.createDataFrame([("d", s, t) for s, t in [(1, "Consolidated Statements of Cash Flows"), (2, "more"), (3, "Management's Discussion and Analysis"), (4, "organic growth slowed")]], "doc_id string, page_seq int, raw_text string")
    spans = spark.createDataFrame([("d", "item", "Item 7. Discussion and Analysis", 3, 4), ("d", "statement", "x", 1, 4)], "doc_id string, kind string, raw_title string, page_start int, page_end int")
    asked = spark.createDataFrame([("q", "Why did organic growth slow?")], "qid string, question string")
    got = anchors.anchor_search(asked, spark.createDataFrame([("q", "d", 1)], "qid string, doc_id string, position int"), pages, spans).orderBy("rank").collect()
    assert [(r["page_seq"], r["bucket"]) for r in got] == [(3, "mdna"), (4, "mdna"), (1, "cashflow"), (2, "cashflow")]


def test_upserts(spark):
    cur = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    inc = spark.createDataFrame([(1, "A", 1), (2, "old", 0), (3, "c", 1), (3, "d", 2)], "k int, v string, t int")
    assert {(r["k"], r["v"]) for r in sinks.keep_latest(cur, inc, ["k"], "t").collect()} == {(1, "A"), (2, "b"), (3, "d")}
    assert {(r["k"], r["v"]) for r in sinks.first_wins(cur, inc, ["k"], ["t"]).collect()} == {(1, "a"), (2, "b"), (3, "c")}


def test_provider_dedupes_and_fails_softly(spark):
    class Half:
        def complete(self, text):
            if text == "bad":
                raise ValueError("no")
            return text.upper()

    df = spark.createDataFrame([("a",), ("a",), ("bad",), (None,)], "t string")
    rows = provider.call_provider(df, "t", Half).collect()
    assert sorted((r["t"] or "", r["output"] or "", r["error"] or "") for r in rows) == [("", "", ""), ("a", "A", ""), ("a", "A", ""), ("bad", "", "ValueError: no")]
    calls = []

    def throttled():
        calls.append(1)
        if len(calls) < 3:
            raise provider.Throttled
        return "ok"

    assert provider.with_retry(throttled, sleep=lambda _: None) == ("ok", 3)


def test_stop_policies(spark):
    df = spark.createDataFrame([("r", i, s, c, loc) for i, (s, c, loc) in enumerate([(1, True, True), (0, True, False), (-1, False, True), (1, True, True)])], "r string, i int, score int, c boolean, l boolean")
    sizes = {}
    for policy in ("none", "wrong", "wrong+location", "any"):
        rows = df.withColumn("stop", evaluate.stop_flag(policy, F.col("score"), F.col("c"), F.col("l")))
        sizes[policy] = evaluate.until_stop(rows, ["r"], ["i"], "stop").count()
    assert sizes == {"none": 4, "wrong": 3, "wrong+location": 2, "any": 2}


def test_negatives_and_grid(spark):
    cat = spark.createDataFrame([(f"C{i}", 2020) for i in range(9)], "company_slug string, fiscal_year int")
    got = evaluate.negative_questions(cat, {"future_year": 3, "absent_metric": 2})
    assert got.count() == 5 and got.select("nid").distinct().count() == 5
    assert evaluate.parameter_grid(spark, {"k": "1"}, {"a": {}, "b": {"k": "2"}}).count() == 2


def test_gold_reader(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"q_id":"q","question":"?","answer":"$5","doc_name":"D","company":"C","evidence":[{"evidence_text":"t","evidence_text_full_page":"p"}]}\n')
    row = filings.read_gold(spark, str(tmp_path / "g.jsonl"), "q_id").first()
    assert row["shape"] == "numeric" and row["evidence_texts"] == ["t"] and row["evidence_pages"] == ["p"]


def test_ingest_stream(spark, tmp_path):
    from evspark.streaming.ingest import ingest_stream

    landing = tmp_path / "in"
    landing.mkdir()
    (landing / "ACME_2022_10K.htm").write_text(fixtures.FILING)
    args = [str(landing), str(tmp_path / "pages"), str(tmp_path / "status"), str(tmp_path / "ck")]
    ingest_stream(spark, *args, min_chars=40).awaitTermination()
    first = spark.read.parquet(args[1]).count()
    (landing / "B_2022_10K.htm").write_text("<p>" + "word " * 50 + "</p>")
    ingest_stream(spark, *args, min_chars=40).awaitTermination()
    assert spark.read.parquet(args[1]).count() == first + 1 and spark.read.parquet(args[2]).count() == 2


def test_schema_health(spark):
    assert filings.schema_health(spark.createDataFrame([("a", 1)], "a string, b int"), "a string, b bigint, c date") == ["b: int, not bigint", "c: missing, not date"]


def test_ingested_pages_carry_their_provenance(spark):
    parsed = html.parse_documents(fixtures.filings(spark), "doc_id", "html", 40)
    catalog = fixtures.filings(spark).select("doc_id").withColumns({"company_slug": F.lit("ACME"), "form_type": F.lit("10-K"), "period_label": F.lit("FY2022")})
    rows = composite.ingest_pages(parsed, catalog).collect()
    assert len(rows) == html.page_table(parsed).count() > 0
    assert all(r["context_header"].startswith("[ACME | 10-K | FY2022") and f"p.{r['page_seq']}" in r["context_header"] for r in rows)
    assert all(r["lexical_text"].split("\n")[0] == r["context_header"] for r in rows)
    titled = [r for r in rows if r["section_path"]]
    assert titled and all(r["section_path"] in r["context_header"] and r["section_path"] in r["lexical_text"] for r in titled)
    assert any(r["lexical_text"].count("\n") > 1 for r in rows)


def test_blocks_are_typed_by_marks(spark):
    page = "<div>" + "".join(f"<p>{t}</p>" for t in ("(1) a note on a figure", "* another note", "a) third note", "12 months ended in March", "Consolidated Statements of Income", "plain words here")) + "<li>* an item</li></div>"
    parsed = html.parse_documents(spark.createDataFrame([("d", page)], "doc_id string, html string"), "doc_id", "html", 1)
    got = {b["text"]: b["block_type"] for blocks in parsed.first()["blocks"] for b in blocks}
    assert [got[t] for t in ("(1) a note on a figure", "* another note", "a) third note", "12 months ended in March", "Consolidated Statements of Income", "plain words here", "* an item")] == ["footnote", "footnote", "footnote", "paragraph", "heading", "paragraph", "list"]
