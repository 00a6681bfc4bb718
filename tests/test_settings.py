"""Settings, tables from files and the status listing."""

import json

import pytest

from evspark.operators.metrics import FormulaError
from evspark.settings import Settings, SettingsError, check_vectors, load_aliases, load_book, load_settings, status_listing


def test_settings_come_from_file_and_environment(tmp_path):
    assert load_settings(environment={}) == Settings()
    path = tmp_path / "s.toml"
    path.write_text("[retrieval]\ntop_k = 30\nuse_reranker = false\n[evaluation]\nprice_in = 3\n[verification]\nenabled_gates = ['G1', 'G2']\n")
    s = load_settings(str(path), {"EVSPARK_RETRIEVAL_TOP_K": "40", "EVSPARK_VERIFICATION_ADVERSARIAL": "false", "OTHER": "x"})
    assert (s.retrieval.top_k, s.retrieval.use_reranker, s.evaluation.price_in, s.evaluation.price_out) == (40, False, 3.0, None)
    assert s.verification.enabled_gates == ("G1", "G2") and not s.verification.adversarial


@pytest.mark.parametrize("given", [{"retrieval": {"top": 1}}, {"nothing": {}}, {"retrieval": {"top_k": "many"}}, {"retrieval": {"use_reranker": 5}}, {"retrieval": {"top_k": 1.5}}, {"retrieval": {"top_k": True}}])
def test_bad_settings_are_refused(tmp_path, given):
    path = tmp_path / "s.json"
    path.write_text(json.dumps(given))
    with pytest.raises(SettingsError):
        load_settings(str(path), {})


def test_vector_sizes_are_checked(spark):
    s = load_settings(environment={"EVSPARK_RETRIEVAL_VECTOR_SIZE": "2"})
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "id int, embedding array<float>")
    check_vectors(s, vectors)
    with pytest.raises(SettingsError, match="2 components"):
        check_vectors(load_settings(environment={}), vectors)


def test_tables_from_files(spark, tmp_path):
    aliases = tmp_path / "a.json"
    aliases.write_text(json.dumps({"acme": ["Acme Tools", "ACME"], "globex": None}))
    assert sorted(map(tuple, load_aliases(spark, str(aliases)).collect())) == [("ACME", "acme"), ("ACME", "acme tools"), ("GLOBEX", "globex")]
    book = tmp_path / "b.toml"
    book.write_text('[burn]\naliases = ["Cash Burn"]\nformula = "-(cfo - capex)"\nunit = "currency"\ndecimals = 0\n')
    assert load_book(str(book)) == {"burn": (("cash burn",), "-(cfo - capex)", "currency", 0, False)}
    book.write_text('[bad]\nformula = "open(1)"\n')
    with pytest.raises(FormulaError):
        load_book(str(book))


def test_status_listing(spark):
    rows = [("a", "ACME", "10-K", "FY2021", "ready", 1.0, None, 2021), ("b", "ACME", "10-K", "FY2022", "failed", 0.0, "no page", 2022), ("c", "GLOBEX", "8-K", "2020", "ready", 1.0, None, None)]
    filings = spark.createDataFrame(rows, "doc_id string, company_slug string, form_type string, period_label string, ingest_status string, ingest_progress double, error string, fiscal_year int")
    assert [r.doc_id for r in status_listing(filings).collect()] == ["b", "a", "c"]
    assert [r.doc_id for r in status_listing(filings, "acme", "ready").collect()] == ["a"]
