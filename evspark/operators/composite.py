"""What a page is found by: its provenance line, and one text of provenance, section, table words and summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evspark.operators.sections import build_tree, section_of_page
from evspark.operators.tables import analyse, row_labels
from evspark.sources.html import grid_table, page_table


def context_header(company: Column, form: Column, period: Column, section: Column, page_seq: Column, printed: Column) -> Column:
    """Where a page stands, in brackets: company, form, period, section if known, its number and the printed one if known."""
    known = lambda c: F.nullif(c.cast("string"), F.lit(""))
    shown = F.when(printed.isNotNull() & (printed != 0), F.format_string(" (printed %d)", printed)).otherwise("")
    place = F.concat(F.lit("p."), page_seq.cast("string"), shown)
    always = [F.coalesce(c.cast("string"), F.lit("")) for c in (company, form, period)]
    return F.concat(F.lit("["), F.concat_ws(" | ", *always, known(section), place), F.lit("]"))


def lexical_text(header: Column, section: Column, words: Column, summary: Column) -> Column:
    """Lines of header, section path, table words (an array, verbatim) and summary; empty ones are left out."""
    lines = F.concat(F.array(header, section), F.coalesce(words, F.array().cast("array<string>")), F.array(summary))
    return F.array_join(F.filter(lines, lambda x: F.coalesce(x, F.lit("")) != ""), "\n")


def table_words(parsed: DataFrame, min_rows: int = 3, min_numeric: int = 4) -> DataFrame:
    """doc_id, page_seq and words: headers and line items of the page's data tables, in order."""
    grids = grid_table(parsed).filter(F.size("grid") > 0)
    found = analyse(grids, min_rows=min_rows, min_numeric=min_numeric).filter("is_data_table")
    words = found.select("doc_id", "page_seq", "table_at", F.concat("header_tokens", row_labels(F.col("grid"))).alias("w"))
    ordered = words.groupBy("doc_id", "page_seq").agg(F.sort_array(F.collect_list(F.struct("table_at", "w"))).alias("all"))
    return ordered.select("doc_id", "page_seq", F.flatten("all.w").alias("words"))


def ingest_pages(parsed: DataFrame, catalog: DataFrame) -> DataFrame:
    """The page table of parsed filings with section_id, context_header and lexical_text.

    ``catalog`` has doc_id, company_slug, form_type and period_label; pages of documents without a row have empty ones.
    """
    pages = page_table(parsed)
    tree = build_tree(pages, catalog)
    titles = tree.select("section_id", F.col("raw_title").alias("title"), F.col("parent_id"))
    parents = titles.select(F.col("section_id").alias("parent_id"), F.col("title").alias("above"))
    paths = titles.join(parents, "parent_id", "left").select("section_id", F.concat_ws(" > ", "above", "title").alias("section_path"))
    placed = section_of_page(pages, tree).join(paths, "section_id", "left").join(catalog.select("doc_id", "company_slug", "form_type", "period_label"), "doc_id", "left")
    placed = placed.join(table_words(parsed), ["doc_id", "page_seq"], "left")
    header = context_header(F.col("company_slug"), F.col("form_type"), F.col("period_label"), F.col("section_path"), F.col("page_seq"), F.col("printed_no"))
    made = placed.withColumn("context_header", header)
    return made.withColumn("lexical_text", lexical_text(F.col("context_header"), F.col("section_path"), F.col("words"), F.lit(None).cast("string"))).drop("words", "company_slug", "form_type", "period_label")
