"""Negative questions, verifiers, baselines and result files."""

import json

import pytest
from pyspark.sql import functions as F

from evspark.operators import negatives, provider, review, runs, verify


def catalog(spark):
    rows = [(f"D{i}", f"CO_{i % 7}", "10-Q" if i % 3 == 0 else "10-K", 2015 + i % 6, 1 + i % 4 if i % 3 == 0 else None) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id string, company_slug string, form_type string, fiscal_year int, fiscal_quarter int")


def test_negatives_are_drawn_and_stored(spark, tmp_path):
    aliases = spark.createDataFrame([("CO_1", "coca-cola"), ("CO_1", "cocacolaco"), ("CO_2", "mmm"), ("CO_2", "3m")], "company_slug string, alias string")
    names = {r.company_slug: r.display for r in negatives.display_names(aliases).collect()}
    assert names == {"CO_1": "Coca-cola", "CO_2": "Mmm"}
    found = negatives.generate(catalog(spark), aliases, "s")
    rows = found.collect()
    assert len(rows) == sum(negatives.COUNTS.values()) and len({r.nid for r in rows}) == len(rows)
    assert {r.category for r in rows} == {review.WRONG_FILING, review.MISSING_METRIC, review.FALSE_PREMISE, review.MISSING_OPERAND, review.OUTSIDE_FILING}
    assert sorted(map(str, rows)) == sorted(map(str, negatives.generate(catalog(spark).repartition(5), aliases, "s").collect()))
    assert sorted(map(str, rows)) != sorted(map(str, negatives.generate(catalog(spark), aliases, "t").collect()))
    path = str(tmp_path / "negatives")
    negatives.save(found, path)
    assert sorted(map(str, negatives.load(spark, path).collect())) == sorted(map(str, rows))
    (tmp_path / "bad").write_text("not a question\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        negatives.load(spark, str(tmp_path / "bad")).collect()
    # What was made to be wrong about periods is found to be so.
    none = spark.createDataFrame([], "nid string, phrase string")
    checked = review.review(found, catalog(spark).withColumn("coverage_years", F.array("fiscal_year")), spark.createDataFrame([], "company string, phrase string, n_pages long"), none)
    assert {r.status for r in checked.filter(F.col("nid").startswith("future_period")).collect()} == {review.VERIFIED}


class Says:
    def __init__(self, verdict):
        self.verdict = verdict

    def complete(self, text):
        if "down" in text:
            raise RuntimeError("down")
        return json.dumps({"verdict": self.verdict, "reasoning": "r"}) if self.verdict else "no json"


def test_verifiers_must_both_accept(spark):
    rows = spark.createDataFrame([(1, "p"), (2, "down"), (3, None)], "qid int, prompt string")
    for a, b, expected in (("VALID", "SUPPORTED", True), ("VALID", "REFUTED", False), ("INVALID", "SUPPORTED", False), ("valid", "supported", True), ("VALID", None, False)):
        got = {r.qid: r.verified for r in verify.verified(rows, "prompt", lambda a=a: Says(a), lambda b=b: Says(b)).collect()}
        assert got == {1: expected, 2: False, 3: False}
    alone = {r.qid: r.verified for r in verify.verified(rows, "prompt", lambda: Says("VALID"), None).collect()}
    assert alone == {1: True, 2: False, 3: False}


def test_verifiers_see_pages_and_brief(spark):
    pages = spark.createDataFrame([("d", 2, "x" * 7000), ("d", 1, "one"), ("e", 1, ""), ("c", 9, None)], "doc_id string, page_seq int, raw_text string")
    cited = spark.createDataFrame([(1, "d", 2), (1, "d", 1), (1, "d", 2), (1, "e", 1), (1, "z", 1), (1, None, 1), (2, "c", 9)], "qid int, doc_id string, page_seq int")
    got = {r.qid: r.cited for r in verify.cited_pages(cited, pages).collect()}
    assert got == {1: "--- d page 1 ---\none\n\n--- d page 2 ---\n" + "x" * 6000}
    row = spark.createDataFrame([("b / a", {"b": 2.0, "a": 1.0}, "2.0"), (None, None, None)], "f string, o map<string,double>, s string")
    briefs = [r[0] for r in row.select(verify.computation_brief(F.col("f"), F.col("o"), F.col("s"))).collect()]
    assert "Formula: b / a" in briefs[0] and "Operands: a = 1.0; b = 2.0" in briefs[0] and "Result: 2.0" in briefs[0] and briefs[1] is None


def test_baselines_bound_the_score(spark):
    gold = spark.createDataFrame([("1", "numeric", "$5", "d", [3]), ("2", "numeric", "7%", "d", []), ("3", "phrase", "x", "d", [1])], "qid string, shape string, gold string, gold_doc string, gold_pages array<int>")
    totals = {(r.baseline, r["shape"]): (r.n, r.total) for r in runs.baseline_scores(gold).collect()}
    assert totals["abstain", None] == (3, 0) and totals["oracle", "numeric"] == (2, 1) and totals["oracle", "phrase"] == (1, -1)


def test_results_are_appended(spark, tmp_path):
    path = str(tmp_path / "results")
    row = ("q", "numeric", "answered", "5", "5", 1, "figure_matches", "near_gold_page", None, 10, 0.5)
    for _ in range(2):
        runs.append_results(spark.createDataFrame([row], runs.RESULT), path)
    assert [tuple(r) for r in runs.read_results(spark, path).collect()] == [row, row]
    assert {r["shape"]: r["net"] for r in runs.results_report(runs.read_results(spark, path)).collect()} == {"numeric": 2, None: 2}


def test_ingest_totals(spark):
    filings = spark.createDataFrame([("a", "ready"), ("b", "ready"), ("c", "failed")], "doc_id string, ingest_status string")
    side = lambda *ids: spark.createDataFrame([(i,) for i in ids], "doc_id string")
    assert tuple(runs.ingest_totals(filings, side("a", "a", "b"), side("a"), side()).first()) == (2, 1, 3, 1, 0, 0.5)


def test_equal_inputs_are_asked_once(spark, tmp_path):
    log = str(tmp_path / "log")

    class Logged:
        def complete(self, text):
            with open(log, "a") as file:
                file.write(text + "\n")
            return text.upper()

    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "b")], "id int, text string").repartition(3)
    assert {r.id: r.output for r in provider.call_provider(rows, "text", Logged).collect()} == {1: "A", 2: "A", 3: None, 4: "B"}
    with open(log) as file:
        assert sorted(file.read().split()) == ["a", "b"]
