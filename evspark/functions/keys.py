"""Keys of pages, blocks, tables and cells, derived from what they stand in, and their parts again.

A null part makes a null key; what is not a key has null parts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: how keys are written.
KEY = r"(?s)^((?:(?!#p).)*)#p(\d+)(?:\.([bt])(\d+)(?:\.r(\d+)c(\d+))?)?$"


def _joined(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def page_key(doc: Column, page_seq: Column) -> Column:
    return _joined(doc, "#p", page_seq)


def block_key(doc: Column, page_seq: Column, at: Column) -> Column:
    return _joined(page_key(doc, page_seq), ".b", at)


def table_key(doc: Column, page_seq: Column, at: Column) -> Column:
    return _joined(page_key(doc, page_seq), ".t", at)


def cell_key(table: Column, row: Column, col: Column) -> Column:
    return _joined(table, ".r", row, "c", col)


def key_parts(key: Column) -> Column:
    """doc_id, page_seq, kind (page, block, table or cell), ordinal (of the block or table), row_idx and col_idx of a key."""
    part = lambda i: F.nullif(F.regexp_extract(key, KEY, i), F.lit(""))
    number = lambda i: part(i).try_cast("int")
    kind = F.when(part(5).isNotNull(), "cell").when(part(3) == "t", "table").when(part(3) == "b", "block").when(part(2).isNotNull(), "page")
    doc = F.when(key.rlike(KEY), F.regexp_extract(key, KEY, 1))
    return F.struct(doc.alias("doc_id"), number(2).alias("page_seq"), kind.alias("kind"), number(4).alias("ordinal"), number(5).alias("row_idx"), number(6).alias("col_idx"))
