"""Filing envelopes as a source: one file in, its typed documents out, bad names as rows with their error; paged as one filing.

A file is cut by column functions (see ``filings.split_envelopes``). Its documents are paged one after the other: each
begins a new page, and page numbers, offsets and the joining of short fragments go on through the filing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import filings, html
from .paging import MIN_PAGE_CHARS


def typed_documents(files: DataFrame, raw: str = "raw") -> DataFrame:
    """doc_id, part, doc_type, html and error of files (doc_id, raw), batch or stream.

    A file whose name does not parse gives one row with an error and no document; a null file one document without text.
    """
    known = F.col("doc_id").rlike(filings.NAME)
    refused = F.when(~F.coalesce(known, F.lit(False)), F.lit("unrecognised name"))
    parts = filings.split_envelopes(files.filter(known).withColumn(raw, F.coalesce(raw, F.lit(""))), raw).withColumn("error", F.lit(None).cast("string"))
    bad = files.withColumn("error", refused).filter("error is not null")
    return parts.unionByName(bad.select("doc_id", F.lit(0).alias("part"), F.lit(None).cast("string").alias("doc_type"), F.lit(None).cast("string").alias("html"), "error"))


def parse_filings(documents: DataFrame, min_chars: int = MIN_PAGE_CHARS) -> DataFrame:
    """What ``html.parse_documents`` gives, for filings of several documents (rows of ``typed_documents``); refused ones are left out."""
    ordered = documents.filter("error is null").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("part", "html"))).alias("d"))
    return html.parse_filings(ordered.select("doc_id", F.col("d.html").alias("htmls")), min_chars)
