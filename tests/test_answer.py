"""The answering plan end to end with an offline provider, and vector import."""

import pytest
from pyspark.sql import functions as F

from evspark.operators import sections
from evspark.plans import answer, fixtures
from evspark.sources import html, vectors


class Quoting:
    """Answers with the line of the context that shares most words with the question."""

    def complete(self, text):
        question, _, context = text.partition("\n\n")
        words = set(question.lower().split())
        lines = [line for line in context.split("\n") if line.strip()]
        if "secret" in question:
            return "I cannot determine this from the pages"
        return max(lines, key=lambda line: len(words & set(line.lower().split())))


def test_answers(spark):
    pages = html.page_table(html.parse_documents(fixtures.filings(spark), "doc_id", "html", 40)).cache()
    asked = spark.createDataFrame([("a", "Why did organic growth slow in the year?"), ("b", "What is the secret recipe?"), ("c", "What was the gross margin?"), ("d", "Who?")], "qid string, question string")
    scope = spark.createDataFrame([(q, "ACME_2022_10K", 1) for q in "abc"], "qid string, doc_id string, position int")
    operands = spark.createDataFrame([("c", 30.0, 120.0)], "qid string, gross_profit double, revenue double")
    got = {r["qid"]: r for r in answer.answer(asked, scope, pages, sections.build_tree(pages), Quoting, operands).collect()}
    assert got["a"]["status"] == "answered" and "organic growth" in got["a"]["answer"].lower() and got["a"]["tier"] == 1
    assert got["b"]["status"] == "abstained" and got["b"]["answer"] == answer.REFUSAL and got["b"]["abstain_reason"] == "composer_declined_in_prose" and got["b"]["tier"] == 2
    assert got["c"]["answer"] == "25.0%" and got["c"]["metric"] == "gross_margin"
    assert got["d"]["abstain_reason"] == "no_candidates"


def test_vector_import(spark):
    pages = spark.createDataFrame([("p1", "d", None), ("p2", "d", [1.0, 0.0])], "page_id string, doc_id string, embedding array<float>")
    incoming = spark.createDataFrame([("p1", [0.0, 1.0])], "page_id string, embedding array<float>")
    good, bad = (spark.createDataFrame([("p1", v)], "page_id string, embedding array<float>") for v in ([0.0, 2.0], [1.0, 1.0]))
    filled = vectors.import_vectors(pages, incoming, good)
    assert filled.filter(F.col("embedding").isNull()).count() == 0
    assert vectors.coverage_report(filled).first()["with_vector"] == 2
    with pytest.raises(vectors.VectorMismatch):
        vectors.import_vectors(pages, incoming, bad)
