"""Whole ingest of filings: envelopes to documents, pages, sections, blocks, cells and facts, with a status for every file.

Each step is one plan over all files of a batch. A file that can't be taken in (bad name, no page) has a status ``failed``
with its error, and no rows elsewhere; the others end ``ready``.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evspark.functions import keys
from evspark.operators import composite, sections, tables
from evspark.sources import envelopes, filings, html, sinks, xbrl

from .stage import written


@dataclass(frozen=True)
class Ingested:
    """The tables that an ingest makes, by name; all have doc_id."""

    filings: DataFrame
    pages: DataFrame
    sections: DataFrame
    blocks: DataFrame
    cells: DataFrame
    facts: DataFrame


def cells_of(parsed: DataFrame) -> DataFrame:
    """Typed cells of all data tables, whose number counts through the filing; keys have a table's place on its page."""
    grids = html.grid_table(parsed).filter(F.size("grid") > 0)
    found = tables.analyse(grids).filter("is_data_table").withColumn("table_ordinal", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_seq", "table_at")) - 1)
    found = found.withColumn("table_id", keys.table_key(F.col("doc_id"), F.col("page_seq"), F.col("table_at")))
    cells = tables.typed_cells(found, ["doc_id", "page_seq", "table_ordinal", "table_id"])
    return cells.withColumn("cell_id", keys.cell_key(F.col("table_id"), F.col("row_idx"), F.col("col_idx")))


def ingest(files: DataFrame, min_chars: int = html.MIN_PAGE_CHARS) -> Ingested:
    """All tables for files (doc_id, raw)."""
    documents = written(envelopes.typed_documents(files), "documents")
    htmls = documents.filter("error is null").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("part", "html"))).alias("d")).select("doc_id", F.col("d.html").alias("htmls"))
    parsed = written(envelopes.parse_filings(documents, min_chars), "parsed")
    catalog = filings.catalog(documents.select("doc_id").distinct())
    pages = written(composite.ingest_pages(parsed, catalog), "pages")
    facts = written(xbrl.page_facts(xbrl.read_tagged(htmls, "doc_id", "htmls", by_page=True, min_chars=min_chars)), "facts")
    counted = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"))
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("n_pages").isNull(), "failed").otherwise("ready")
    rows = catalog.join(counted, "doc_id", "left").withColumn("ingest_status", status)
    rows = rows.withColumn("error", F.coalesce("error", F.when(F.col("n_pages").isNull(), "no page"))).withColumn("ingest_progress", F.when(F.col("ingest_status") == "ready", 1.0).otherwise(0.0))
    return Ingested(rows.withColumn("n_pages", F.coalesce("n_pages", F.lit(0))), pages, sections.build_tree(pages, catalog), html.block_table(parsed), cells_of(parsed), facts)


def store(made: Ingested, path: str) -> None:
    """Writes all tables under ``path``, documents over their earlier versions; statuses last, so that what is ``ready`` is there."""
    for field in (*[f for f in fields(made) if f.name != "filings"], *[f for f in fields(made) if f.name == "filings"]):
        sinks.replace_documents(getattr(made, field.name), f"{path.rstrip('/')}/{field.name}")


def ready(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue rows of filings that can be asked about."""
    return spark.read.parquet(f"{path.rstrip('/')}/filings").filter("ingest_status = 'ready'")
