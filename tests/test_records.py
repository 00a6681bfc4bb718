"""Row-wise formulas, slots, second rankings, reviews, spend, envelopes, page facts, stored indexes, memos and ablations."""

import json
import math

import pytest
from pyspark.sql import functions as F

from evspark.operators import ablation, explain, formulas, lexical, memo, metrics, rerank, review, sections, slots, spend
from evspark.operators.lexical_store import LexicalStore
from evspark.plans import answer, fixtures, ingest_plan
from evspark.plans.queries import QUERIES
from evspark.sources import envelopes, html, xbrl
from evspark.streaming.ingest import ingest_filings_stream

from .oracle import SF, assert_same

VALUES = {"a": 5.0, "a__prev": 4.0, "b": 2.0, "c": 4.0, "zero": 0.0}
GOOD = {
    "1+2*3": 7, "-2**2": -4, "2**-1*3": 1.5, "(a-b)/c": 0.75, "avg(a, prev, current)": 4.5, "avg(a)": 4.5, "delta(a)/prev(a)": 0.25, "rank(1, a, 3)": 2, "compare(a, b)": 1,
    "2**3**2": 512, "8/4/2": 1, "a-b-c": -1, "(((a)))": 5, "+a - -b": 7, "rank(a, (b+c)*2, sum_range(a))": 2, "-(a+b)*c": -28, "1e3*.5": 500, "sum_range(a, current)": 5, "a*(b+-c)": -10,
}
BAD = {
    "": "empty", None: "empty", "  ": "empty", "1 +": "syntax", "a b": "syntax", "3(4)": "syntax", "(1,2)": "syntax", "((a)": "syntax", "a)": "syntax", "rank()": "syntax", "prev(a+1)": "syntax", "a // b": "syntax", "compare(a)": "syntax",
    "a if b else c": "syntax", "a and b": "syntax", "delta(a, prev)": "syntax", "zzz": "missing_operand", "prev(b)": "missing_operand", "avg(b)": "missing_operand", "a/0": "zero_division", "a/zero": "zero_division", "10**400": "not_a_number", "1e400": "not_a_number",
    "__import__('os').system('x')": "not_allowed", "open(1)": "not_allowed", "a.b": "not_allowed", "lambda: 1": "not_allowed", "[x for x in a]": "not_allowed", "a % b": "not_allowed", "exec(a)": "not_allowed", "(1).__class__": "not_allowed", "a; b": "not_allowed", "{a}": "not_allowed", "a == b": "not_allowed", "'a'": "not_allowed",
}


def test_formulas_by_row(spark):
    rows = spark.createDataFrame([(f, VALUES) for f in [*GOOD, *BAD]], "f string, o map<string,double>")
    for r in formulas.with_values(rows, "f", "o").collect():
        if r.f in GOOD:
            assert r.error is None and math.isclose(r.value, GOOD[r.f]), r
        else:
            assert r.value is None and r.error in (BAD[r.f], "not_allowed" if r.f in ("1e400", "a; b", "(1).__class__", "a == b") else None, "syntax" if r.f in ("(1).__class__", "a.b", "lambda: 1", "a == b") else None), r


def test_formulas_agree_with_the_compiler(spark):
    names = sorted({n for m in metrics.METRICS.values() for n in metrics.required_operands(m[1])})
    values = {n: 3.0 + 7 * i % 11 for i, n in enumerate(names)}
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"`{n}` double" for n in names))
    rows = spark.createDataFrame([(m, v[1], values) for m, v in metrics.METRICS.items()], "m string, f string, o map<string,double>")
    got = {r.m: r.value for r in formulas.with_values(rows, "f", "o").collect()}
    expected = row.select(*[metrics.compile_formula(v[1])[0].alias(m) for m, v in metrics.METRICS.items()]).first().asDict()
    assert got.keys() == expected.keys() and all(math.isclose(got[m], expected[m]) for m in got)


def test_definition_in_the_question_comes_first(spark):
    asked = [
        (1, "What is FY2020 gross margin?"), (2, "What is the quick ratio, calculated as (cash + receivables) divided by current liabilities?"),
        (3, "What is the ROA, defined as income over average of beginning and ending total assets?"), (4, "hello"), (5, None),
    ]
    got = {r.qid: r for r in formulas.choose_formula(spark.createDataFrame(asked, "qid int, question string")).collect()}
    assert (got[1].source, got[1].formula) == ("book", "gross_profit / revenue")
    assert (got[2].source, got[2].metric, got[2].formula) == ("question", "quick_ratio", "(cash + receivables) / current_liabilities")
    assert got[3].source == "question" and got[3].formula == metrics.METRICS["roa"][1] and got[3].period_rule == "average_of(prev, current)"
    assert got[4].formula == got[5].formula == "" and got[4].source is None


REPLY = {
    "slots": [{"name": "revenue", "value": "(1,234.5)", "scale": "million", "period": "FY2020", "doc_id": "D", "page_seq": 3, "quote": 'a "{ b\\'}, {"name": "x", "value": None, "doc_id": "D", "page_seq": "4"}],
    "missing_slots": ["cogs"], "answer_type": "ratio", "metric_name": "roa",
}


def decoded(spark, *replies):
    rows = spark.createDataFrame(list(enumerate(replies)), "qid int, reply string")
    return [r for r in sorted(slots.decode_slots(rows).collect(), key=lambda r: r.qid)]


def test_replies_are_told_apart(spark):
    whole = json.dumps(REPLY)
    odd = ['{"slots":[{"name":"a","value":"5","page_seq":"n/a","doc_id":"D"},{"value":"-7%","doc_id":"D","page_seq":2}]}', "I cannot", "", None, "[1,2]", '{"slots": 5}', '{"slots":[1,null]}', "{bad}", '{"slots":[{"doc_id":"D","page_seq":1,"value":12}],"answer_type":"odd"}']
    got = decoded(spark, whole, whole[:-60], whole[: whole.index('"x"')], f"```json\n{whole}\n```", *odd)
    assert [r.status for r in got] == ["whole", "truncated", "truncated", "whole", "partial", "malformed", "empty", "empty", "malformed", "whole", "partial", "malformed", "whole"]
    assert [len(r.slots) for r in got[:5]] == [2, 2, 1, 2, 1]
    assert [float(s.amount) if s.amount is not None else None for s in got[0].slots] == [-1234.5, None] and got[0].slots[0].quote == 'a "{ b\\'
    assert got[0].missing == ["cogs"] and got[4].missing == ["a"] and got[10].missing == ["value", "value"]
    assert got[0].answer_type == "ratio" and got[12].answer_type == "qualitative" and float(got[12].slots[0].amount) == 12


def test_long_replies(spark):
    long = json.dumps({"slots": [{"name": "q", "doc_id": "D", "page_seq": 1, "value": "1", "quote": 'say "x" {and}\n' * 30_000}, {"name": "r", "doc_id": "D", "page_seq": 1, "quote": "y" * 100_000}]})
    whole, cut = decoded(spark, long, long[:-1000])
    assert (whole.status, len(whole.slots)) == ("whole", 2)
    assert (cut.status, len(cut.slots)) == ("truncated", 1) and len(cut.slots[0].quote) == 14 * 30_000


def test_slots_become_operands(spark):
    found = slots.slot_rows(slots.decode_slots(spark.createDataFrame([(1, json.dumps(REPLY))], "qid int, reply string")))
    more = found.unionByName(found.withColumn("name", F.lit("odd one")).withColumn("value", F.lit(7).cast("decimal(28,8)")).withColumn("scale", F.lit(None).cast("string")))
    required = spark.createDataFrame([(1, "revenue"), (1, "cogs")], "qid int, required string")
    got = slots.slot_operands(more, required).first()
    assert got.operands == {"revenue": -1234.5e6, "odd one": 7.0} and got.missing == ["cogs"]


class ByWords:
    def rerank(self, question, documents):
        if "down" in question:
            raise RuntimeError("down")
        if "short" in question:
            return [1.0]
        return [float(d.count("x")) for d in documents]


def test_rerank_head(spark):
    rows = [(q, f"p{i}", i + 1, q, "x" * (i % 4)) for q in ("up", "down", "short") for i in range(8)]
    ranked = spark.createDataFrame(rows, "qid string, page_id string, rank int, question string, text string")
    got = {}
    for r in rerank.rerank_head(ranked, ByWords, 2).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.page_id, r.rank, r.error))
    assert [p for p, _, _ in got["up"]] == ["p3", "p2", "p1", "p5", "p0", "p4", "p6", "p7"]
    for q in ("down", "short"):
        assert [p for p, _, _ in got[q]] == [f"p{i}" for i in range(8)] and got[q][0][2]
    assert all([r for _, r, _ in rows] == list(range(1, 9)) for rows in got.values())
    floored = rerank.rerank_head(ranked.filter("qid = 'up'"), ByWords, 2, keep_floor=2.0).orderBy("rank").collect()
    assert [(r.page_id, r.rank) for r in floored] == [("p3", 1), ("p2", 2), ("p6", 3), ("p7", 4)]
    assert rerank.rerank_head(ranked.limit(0), ByWords, 2).count() == 0


def test_phrases_are_found_in_one_pass(spark):
    pages = spark.createDataFrame([(1, "A", "Product recalls and a special dividend"), (2, "A", None), (3, "B", "special  dividend"), (4, "B", "RECALL of product")], "page int, company string, text string")
    phrases = spark.createDataFrame([("special dividend",), ("Product Recall",), ("recall",), ("",), (None,), ("special dividend",)], "phrase string")
    for most in (review.PHRASE_BYTES, 8):
        hits = {(r.company, r.phrase): (r.n_pages, r.first_page) for r in review.phrase_hits(pages, phrases, "company", "page", "text", most_bytes=most).collect()}
        assert hits == {("A", "special dividend"): (1, 1), ("A", "product recall"): (1, 1), ("A", "recall"): (1, 1), ("B", "recall"): (1, 4)}
    plan = review.phrase_hits(pages, phrases, "company", "page", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan


def test_running_total_over_ranges(spark):
    rows = spark.createDataFrame([(i, i % 7, None if i % 11 == 0 else i % 5) for i in range(500)], "id int, k int, v int").repartition(9)
    expected, so_far = {}, 0
    for i in sorted(range(500), key=lambda i: (i % 7, i)):
        expected[i] = so_far
        so_far += 0 if i % 11 == 0 else i % 5
    assert {r.id: r.total_before for r in spend.running_total(rows, ["k", "id"], "v").collect()} == expected
    assert spend.until_ceiling(rows, ["k", "id"], "v", None).filter("ran").count() == 500
    assert spend.running_total(rows.limit(0), ["k", "id"], "v").count() == 0


def test_a_run_is_killed_and_resumed(spark, tmp_path):
    path = str(tmp_path / "results")
    questions = spark.createDataFrame([(i,) for i in range(10)], "qid int")
    work = lambda df: df.withColumn("tokens", F.lit(10))
    assert spend.run_batch(questions, work, path, 4, ["qid"]) == "more"

    def dies(df):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        spend.run_batch(questions, dies, path, 4, ["qid"])
    assert sorted(r.qid for r in spend.stored(spark, path).collect()) == [0, 1, 2, 3]
    assert spend.run_batch(questions, work, path, 4, ["qid"], ceiling=80) == "more"
    assert spend.run_batch(questions, work, path, 4, ["qid"], ceiling=80) == "ceiling"
    assert spend.run_batch(questions, work, path, 4, ["qid"]) == "more"
    assert spend.run_batch(questions, work, path, 4, ["qid"]) == "done"
    assert spend.append_once(work(questions), path) == 0
    assert sorted(r.qid for r in spend.stored(spark, path).collect()) == list(range(10))


def envelope(*parts):
    return "<SEC-DOCUMENT>\n" + "\n".join(f"<TYPE>{kind}\n<html><body>{body}</body></html>" for kind, body in parts)


def test_envelopes_are_paged_as_one_filing(spark):
    body = "<p>" + "words of the report " * 20 + "</p>"
    files = [
        ("A_2022_10K", envelope(("10-K", body + "<hr/>" + body), ("GRAPHIC", "<p>skipped</p>"), ("EX-21", body), ("EX-99", "<p>short end</p>"))), ("B_2022_8K", "<p>plain</p>"),
        ("bad name", envelope(("10-K", body))), (None, "x"), ("C_2022_10K", None),
    ]
    typed = envelopes.typed_documents(spark.createDataFrame(files, "doc_id string, raw string"))
    rows = sorted((r.doc_id or "", r.part, r.doc_type or "", r.error or "") for r in typed.collect())
    assert rows == [("", 0, "", "unrecognised name"), ("A_2022_10K", 0, "10-K", ""), ("A_2022_10K", 1, "EX-21", ""), ("A_2022_10K", 2, "EX-99", ""), ("B_2022_8K", 0, "primary", ""), ("C_2022_10K", 0, "primary", ""), ("bad name", 0, "", "unrecognised name")]
    pages = html.page_table(envelopes.parse_filings(typed)).orderBy("doc_id", "page_seq").collect()
    assert [(p.doc_id, p.page_seq) for p in pages] == [("A_2022_10K", 1), ("A_2022_10K", 2), ("A_2022_10K", 3), ("B_2022_8K", 1)]
    assert pages[2].raw_text.endswith("short end") and pages[1].char_start == pages[0].char_end + 1 and pages[0].next_page_id == "A_2022_10K#p2"


def test_facts_are_placed_on_pages(spark):
    head = '<ix:header><xbrli:context id="c"><xbrli:period><xbrli:instant>2022-12-31</xbrli:instant></xbrli:period></xbrli:context><xbrli:unit id="u"><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit></ix:header>'
    fact = lambda v, c="c": f'<tr><td>Assets {v}</td><td><ix:nonFraction name="us-gaap:Assets" contextRef="{c}" unitRef="u">{v}</ix:nonFraction></td></tr>'
    text = "<p>" + "what the figures mean " * 20 + "</p>"
    rows = [("d", [head + text + f"<table>{fact(1)}{fact(2, 'gone')}{fact(3)}</table><hr/>{text}<table>{fact(4)}</table>", text + f"<table>{fact(5)}</table>"]), ("empty", [None])]
    found = xbrl.page_facts(xbrl.read_tagged(spark.createDataFrame(rows, "doc_id string, htmls array<string>"), "doc_id", "htmls", by_page=True)).orderBy("fact_id").collect()
    assert [(f.fact_id, f.page_seq, int(f.value), f.unit) for f in found] == [("d#p1#f0", 1, 1, "USD"), ("d#p1#f1", 1, 3, "USD"), ("d#p2#f0", 2, 4, "USD"), ("d#p3#f0", 3, 5, "USD")]
    labels = spark.createDataFrame([("Capital spending", ["capital", "capex"]), ("Share-based pay", ["capex"]), (None, ["capex"]), ("", ["capex"]), ("Sales", []), ("Sales", None), ("Sales", [""])], "label string, terms array<string>")
    assert [r[0] for r in labels.select(xbrl.label_matches(F.col("label"), F.col("terms"))).collect()] == [True, False, True, True, True, True, True]


def test_a_stored_index_equals_a_rebuild(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    asked = spark.read.parquet(f"{SF}/benchmark.parquet").limit(5)
    store = LexicalStore(spark, str(tmp_path / "index"), 16)
    assert store.version() == 0
    assert store.update(docs.filter("doc_id < 100"), "doc_id", F.col("text"), "source") == docs.filter("doc_id < 100").count()
    changed = docs.withColumn("text", F.when(F.col("doc_id") % 9 == 0, "quite other words").otherwise(F.col("text")))
    assert store.update(changed, "doc_id", F.col("text"), "source") == docs.filter("doc_id >= 100 or doc_id % 9 = 0").count()
    assert store.update(changed, "doc_id", F.col("text"), "source") == 0
    paged = lexical.page_tokens(changed, "doc_id", F.col("text"), "source")
    expected = lexical.bm25_scores(paged, asked, "doc_id", "item_id", F.col("text"), "source").withColumnsRenamed({"doc_id": "key", "source": "scope"})
    assert_same(store.scores(asked, "item_id", F.col("text")).toPandas(), expected.toPandas())
    assert store.terms().filter("term = 'quite'").first()["df"] == docs.filter("doc_id % 9 = 0").count()
    (tmp_path / "index" / "pages" / "version=9").mkdir()  # an update that did not end
    assert store.version() == 3
    plan = store.matches(spark.createDataFrame([("quite",)], "term string"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]


class Counted:
    """Writes down each call."""

    def __init__(self, log):
        self.log = log

    def complete(self, text):
        with open(self.log, "a") as file:
            file.write(text.replace("\n", "|") + "\n")
        if "bad" in text:
            raise RuntimeError("no")
        return '{"equivalent": true, "reasoning": "fine"}'


def test_a_second_run_makes_no_call(spark, tmp_path):
    log, path = str(tmp_path / "log"), str(tmp_path / "memo")
    rows = spark.createDataFrame([(1, "q", "1", "1"), (2, "q", "1", "1"), (3, "q", "1", " "), (4, "bad", "1", "1"), (5, "q", "11", ""), (6, None, None, "z")], "id int, question string, gold string, candidate string")
    runs = []
    for _ in range(2):
        runs.append({r.id: (r.equivalent, r.reasoning) for r in memo.judge(rows, path, lambda: Counted(log)).collect()})
        with open(log) as file:
            runs.append(file.read().splitlines())
    first, calls, second, more = runs
    assert first == second == {1: (True, "fine"), 2: (True, "fine"), 3: (False, "empty answer"), 4: (False, "judge unavailable: RuntimeError: no"), 5: (False, "empty answer"), 6: (True, "fine")}
    assert len(calls) == 3 and len(more) == 4 and "bad" in more[-1]  # only what failed is asked again


def test_variants_share_one_scan(spark):
    assert len(ablation.VARIANTS) == 12
    got = QUERIES["ablation_grid"](spark, SF)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan
    rows = {r.variant: r for r in got.collect()}
    assert rows["no_gates"].answered > rows["no_G1"].answered > rows["baseline"].answered and rows["router_top1"].answered < rows["baseline"].answered < rows["router_top8"].answered


def test_reasons(spark):
    rows = [
        ("numeric", "$100", "It was 99.9 or 7", False, "figure_matches", True, None), ("numeric", "$100", "Some 80, or 130", False, "figure_differs", False, 80.0), ("numeric", "$100", "none", False, "answer_has_no_figure", False, None),
        ("numeric", "none", "5", False, "gold_has_no_figure", False, None), ("numeric", "$100", "100", True, "declined", False, None), ("yes_no", "Yes, so", "yes it is", False, "verdict_matches", True, None),
        ("yes_no", "Yes", "No", False, "verdict_differs", False, None), ("yes_no", "Yes", "Maybe", False, "answer_opens_otherwise", False, None), ("yes_no", "So", "Yes", False, "gold_opens_otherwise", False, None), ("phrase", "x", "y", False, "judged", True, None), ("phrase", "x", None, False, "judged", True, None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, shape string, gold string, answer string, abstained boolean, want string, right boolean, near double").withColumn("judged", F.lit(True))
    for r in explain.message(explain.with_answer_verdict(df, "judged")).collect():
        assert (r.reason, r.correct and not r.abstained, r.nearest) == (r.want, r.right, r.near) and r.explanation
    places = [([("d", 4)], [5], None, "near_gold_page"), ([("d", 1)], [5], 0.7, "evidence_on_page"), ([("d", 1)], [5], 0.5, "evidence_missing"), ([("e", 5)], [5], 0.9, "wrong_document"), ([], [5], None, "no_citations"), (None, [5], None, "no_citations"), ([("d", 1)], [], None, "gold_page_unmapped")]
    cited = spark.createDataFrame([(c, "d", g, o, w) for c, g, o, w in places], "citations array<struct<doc_id:string,page_seq:int>>, gold_doc string, gold_pages array<int>, overlap double, want string")
    assert all(r.where == r.want for r in explain.with_location_verdict(cited).collect())


class Extracts:
    """Gives the figures that it is asked for, from lines of the pages."""

    def complete(self, text):
        names = [line[2:] for line in text.split("\n") if line.startswith("- ")]
        known = {"capex": ("1,577", "million"), "d_and_a": ("1,200", "million"), "d_and_a__prev": ("1,100", "million")}
        found = [{"name": n, "value": known[n][0], "scale": known[n][1], "doc_id": "ACME_2022_10K", "page_seq": 4, "quote": "x", "period": "FY2021" if n.endswith("prev") else "FY2022"} for n in names if n in known]
        return json.dumps({"slots": found, "missing_slots": [n for n in names if n not in known], "answer_type": "ratio"})


def test_figures_are_extracted_and_computed(spark):
    pages = html.page_table(html.parse_documents(fixtures.filings(spark), "doc_id", "html", 40)).cache()
    asked = [("a", "What is the reinvestment rate, calculated as capex divided by d and a?"), ("b", "What was the gross margin?"), ("c", "Why did organic growth slow in the year?")]
    scope = spark.createDataFrame([(q, "ACME_2022_10K", 1) for q, _ in asked], "qid string, doc_id string, position int")

    class Prose:
        def complete(self, text):
            return "Organic growth slowed because of prices and weather in the year."

    questions = spark.createDataFrame(asked, "qid string, question string")
    got = {r["qid"]: r for r in answer.answer(questions, scope, pages, sections.build_tree(pages), Prose, tiers=answer.TIERS[:1], extractor=Extracts).collect()}
    assert got["a"]["status"] == "answered" and got["a"]["answer"].startswith("1.314167")
    assert got["b"]["status"] == "abstained" and got["b"]["abstain_reason"] == "G4"
    assert got["c"]["status"] == "answered"


def test_a_landing_folder_goes_through_the_whole_ingest(spark, tmp_path):
    landing, store = tmp_path / "in", str(tmp_path / "store")
    landing.mkdir()
    (landing / "ACME_2022_10K.htm").write_text(fixtures.FILING)
    (landing / "draft.htm").write_text("<p>x</p>")
    for _ in range(2):
        ingest_filings_stream(spark, str(landing), store, str(tmp_path / "check"), 40).awaitTermination()
    status = {r.doc_id: (r.ingest_status, r.error) for r in spark.read.parquet(f"{store}/filings").collect()}
    assert status == {"ACME_2022_10K": ("ready", None), "draft": ("failed", "unrecognised name")}
    assert [r.doc_id for r in ingest_plan.ready(spark, store).collect()] == ["ACME_2022_10K"]
    counts = {t: spark.read.parquet(f"{store}/{t}").count() for t in ("pages", "sections", "cells", "facts")}
    assert counts == {"pages": 5, "sections": 6, "cells": 6, "facts": 2}
    assert spark.read.parquet(f"{store}/cells").filter("table_ordinal = 0 and page_seq = 4").count() == 6
