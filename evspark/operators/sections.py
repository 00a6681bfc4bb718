"""Section trees from page heads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .anchors import STATEMENT_TITLES

# What opens a heading.
ITEM = r"(?i)^item\s+(\d+[a-z]?)\s*[.\-:]?\s*(.*)$"
PART = r"(?i)^part\s+([ivx]+)\s*[.\-:]?\s*(.*)$"
NOTE = r"(?i)^note\s+(\d+)\s*[.\-:—–]?\s*(.*)$"
EXHIBIT = r"(?i)^exhibit\s"
HEADING_CHARS, HEADING_WORDS = (4, 120), 14
HEAD_CHARS, HEAD_LINES = 1200, 40
CONTENTS_DENSITY = 6
TITLE_KEY_CHARS = 60


def kind_of(title: Column) -> Column:
    """part, item, note, statement, mdna, exhibit or other."""
    text = F.trim(title)
    statement = F.lit(False)
    for name, pattern in STATEMENT_TITLES.items():
        if name != "mdna":
            statement = statement | text.rlike(pattern)
    return (
        F.when(statement, "statement")
        .when(text.rlike(STATEMENT_TITLES["mdna"]), "mdna")
        .when(text.rlike(PART), "part")
        .when(text.rlike(ITEM), "item")
        .when(text.rlike(NOTE), "note")
        .when(text.rlike(EXHIBIT), "exhibit")
        .otherwise("other")
    )


def statement_of(title: Column) -> Column:
    """The statement a title names, if any."""
    return F.coalesce(*[F.when(title.rlike(p), F.lit(s)) for s, p in STATEMENT_TITLES.items() if s != "mdna"])


def is_heading(line: Column) -> Column:
    """Whether a line is a heading and not prose: short, and enumerated or opening with a statement's title."""
    text = F.trim(line)
    short = F.length(text).between(*HEADING_CHARS) & (F.size(F.split(text, r"\s+")) <= HEADING_WORDS)
    opening = text.rlike(PART) | text.rlike(ITEM) | text.rlike(NOTE)
    for pattern in STATEMENT_TITLES.values():
        opening = opening | text.rlike("(?i)^.{0,4}?" + pattern.removeprefix("(?i)"))
    return short & opening


def heading_candidates(pages: DataFrame) -> DataFrame:
    """doc_id, page_seq, line_at and raw_title of headings in page heads; pages dense with them are tables of contents."""
    lines = F.slice(F.filter(F.transform(F.split(F.left("raw_text", F.lit(HEAD_CHARS)), "\n"), F.trim), lambda s: s != ""), 1, HEAD_LINES)
    titles = F.filter(lines, is_heading)
    return pages.select("doc_id", "page_seq", titles.alias("titles")).filter(F.size("titles").between(1, CONTENTS_DENSITY - 1)).select("doc_id", "page_seq", F.posexplode("titles").alias("line_at", "raw_title"))


def build_tree(pages: DataFrame, forms: DataFrame | None = None) -> DataFrame:
    """Sections with ordinal, kind, parent and closed page interval. ``forms`` (doc_id, form_type) takes out event reports."""
    if forms is not None:
        pages = pages.join(forms.filter("form_type = '8-K'").select("doc_id"), "doc_id", "left_anti")
    key = F.left(F.regexp_replace(F.lower("raw_title"), "[^a-z0-9]", ""), F.lit(TITLE_KEY_CHARS))
    first = Window.partitionBy("doc_id", "key").orderBy("page_seq", "line_at")
    distinct = heading_candidates(pages).withColumn("key", key).withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    order = Window.partitionBy("doc_id").orderBy("page_seq", "line_at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last_page = pages.groupBy("doc_id").agg(F.max("page_seq").alias("last_page"))
    s = distinct.withColumn("ordinal", F.row_number().over(order) - 1).withColumn("kind", kind_of(F.col("raw_title"))).withColumn("stmt_type", statement_of(F.col("raw_title")))
    s = s.withColumn("part_at", F.last(F.when(F.col("kind") == "part", F.col("ordinal")), True).over(before)).withColumn("item_at", F.last(F.when(F.col("kind") == "item", F.col("ordinal")), True).over(before))
    item = F.when(F.col("item_at") > F.coalesce("part_at", F.lit(-1)), F.col("item_at"))  # a part resets the item
    parent = F.when(F.col("kind") == "part", None).when(F.col("kind") == "item", F.col("part_at")).otherwise(F.coalesce(item, "part_at"))
    s = s.withColumn("parent", parent).withColumn("next_start", F.lead("page_seq").over(order)).join(last_page, "doc_id")
    end = F.greatest(F.coalesce(F.col("next_start") - 1, "last_page"), "page_seq")
    name = lambda n: F.when(n.isNotNull(), F.format_string("%s#s%d", F.col("doc_id"), n))
    level = F.when(F.col("parent").isNull(), 0).when(item.isNotNull() & (F.col("kind") != "item"), 2).otherwise(1)
    return s.select("doc_id", name(F.col("ordinal")).alias("section_id"), "ordinal", "raw_title", "kind", "stmt_type", level.alias("level"), name(F.col("parent")).alias("parent_id"), F.col("page_seq").alias("page_start"), end.alias("page_end"))


def section_of_page(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """The first section, by ordinal, that covers each page. Spans are expanded, so the range join is an equi-join."""
    covered = sections.select("doc_id", "section_id", "ordinal", F.explode(F.sequence("page_start", "page_end")).alias("page_seq"))
    first = covered.groupBy("doc_id", "page_seq").agg(F.min_by("section_id", "ordinal").alias("section_id"))
    return pages.join(first, ["doc_id", "page_seq"], "left")
