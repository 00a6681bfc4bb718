"""Schemas of the stored tables, as DDL."""

FILINGS = "doc_id string, company_slug string, form_type string, fiscal_year int, fiscal_quarter int, period_label string, filing_date date, coverage_years array<int>, content_hash string, ingest_status string, ingest_progress float, error string"
ALIASES = "company_slug string, alias string"
PAGES = "doc_id string, page_seq int, page_id string, raw_text string, printed_no int, char_start bigint, char_end bigint, section_id string, context_header string, lexical_text string, token_estimate int, prev_page_id string, next_page_id string, embedding array<float>"
SECTIONS = "doc_id string, section_id string, ordinal int, raw_title string, kind string, stmt_type string, source string, level int, parent_id string, page_start int, page_end int"
BLOCKS = "doc_id string, page_seq int, block_id string, block_type string, text string, char_start int, char_end int, table_ordinal int"
TABLE_CELLS = "doc_id string, table_ordinal int, row_idx int, col_idx int, row_label string, col_label string, raw_text string, numeric_value decimal(38,6), sign int, scale string, unit string"
FACTS = "doc_id string, fact_id string, qname string, value decimal(38,6), unit string, scale int, sign int, period_start date, period_end date, is_instant boolean, dimensions map<string,string>, row_label string"
QUESTIONS = "qid string, question string, answer string, doc_name string, company string, shape string, evidence_texts array<string>, evidence_pages array<string>"
NEGATIVES = "nid string, question string, category string, rationale string, company_slug string, reviewed boolean, notes string, tags array<string>"
USAGE = "qid string, stage string, calls bigint, errors bigint, input_tokens bigint, output_tokens bigint, seconds double"
#: Ingest passes through these, in order; ``failed`` may follow any.
STATUSES = ("registered", "parsing", "sections", "tables", "xbrl", "summaries", "embedding", "ready", "failed")
