"""Pages and blocks from the events of linearised documents, by column functions in the document's own row: nothing moves.

An event is a run of text, the opening or the closing of an element, or the beginning of a document. Breaks cut the events
into fragments, fragments are cleaned and joined into pages, and a page's openings give its blocks and tables. Null
events (a null document) give no pages; a document without text none either.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# How page breaks, footers and headings are written.
BREAK_STYLE = r"(?i)page-break-{side}\s*:\s*always|(?<!-)\bbreak-{side}\s*:\s*(always|page)"
FOOTER = r"(?i)(?:^|\n)\s*(?:page\s*)?(\d{1,3})\s*$"
FOOTER_CHARS = 120
MIN_PAGE_CHARS = 200
BLOCK_LEVEL = ("p", "div", "tr", "table", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "td", "th", "tbody", "thead", "section", "article")
HEADING_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BOLD = r"(?i)font-weight\s*:\s*(bold|[6-9]00)"
HEADING_SHAPE = r"(?i)^(item\s+\d+[a-z]?\.?|part\s+[ivx]+\.?|note\s+\d+|(consolidated|condensed)\s+(statements?|balance))"
FOOTNOTE_MARK = r"(?i)^\(?[0-9a-z]\)\s+\S|^\*\s+\S"
HEADING_CHARS, STYLED_CHARS, FOOTNOTE_CHARS = 200, 120, 600
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"
#: White space but for the line feed.
BLANKS = "[\\t\\x0b\\f\\r\\x1c-\\x1f \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def part_of(events: Column, page: Column) -> Column:
    """The events of a page or fragment (first, to)."""
    return F.slice(events, page["first"] + 1, page["to"] - page["first"])


def clean(text: Column) -> Column:
    """One space for runs of blanks; lines are kept, and of empty ones in a row one."""
    spaced = F.regexp_replace(F.translate(text, ZERO_WIDTH, ""), BLANKS, " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(spaced, " ?\n ?", "\n"), "\n{3,}", "\n\n"), F.lit(" \n"))


def styled_break(event: Column, side: str) -> Column:
    """Whether an element's style breaks the page on that side of it."""
    kind = {"before": "open", "after": "close"}[side]
    return F.coalesce((event["kind"] == kind) & event["style"].rlike(BREAK_STYLE.format(side=side)), F.lit(False))


def page_rule(event: Column) -> Column:
    """A rule is a seam unless it stands inside a table."""
    return F.coalesce((event["kind"] == "open") & (event["tag"] == "hr") & ~event["in_table"], F.lit(False))


def fragments(events: Column) -> Column:
    """first and to (places of events) and text of what lies between breaks; every document begins one."""

    def begins(event: Column, i: Column) -> Column:
        before = F.get(events, i - 1)
        return (event["kind"] == "document") | styled_break(event, "before") | page_rule(before) | styled_break(before, "after")

    def shown(event: Column) -> Column:
        return F.when(event["kind"] == "text", event["text"]).when(event["tag"].isin(*BLOCK_LEVEL), "\n").otherwise("")

    starts = F.array_compact(F.transform(events, lambda e, i: F.when(begins(e, i), i)))
    spans = let(starts, lambda s: F.transform(s, lambda a, i: F.struct(a.alias("first"), F.coalesce(F.get(s, i + 1), F.size(events)).alias("to"))))
    return F.transform(spans, lambda f: F.struct(f["first"].alias("first"), f["to"].alias("to"), clean(F.array_join(F.transform(part_of(events, f), shown), "")).alias("text")))


def last_fragments(lengths: Column, min_chars: int) -> Column:
    """The number of each page's last fragment: a text shorter than ``min_chars`` joins the next, a last one the previous."""
    start = F.struct(F.lit(0).alias("held"), F.array().cast("array<int>").alias("ends"), F.lit(0).alias("at"))

    def step(state: Column, length: Column) -> Column:
        joined = state["held"] + length + F.when((state["held"] > 0) & (length > 0), 1).otherwise(0)
        held = F.when(joined < min_chars, joined).otherwise(0)
        ends = F.when(joined < min_chars, state["ends"]).otherwise(F.concat(state["ends"], F.array(state["at"])))
        return F.struct(held.alias("held"), ends.alias("ends"), (state["at"] + 1).alias("at"))

    def finish(state: Column) -> Column:
        ends, last = state["ends"], state["at"] - 1
        return F.when(F.get(ends, F.size(ends) - 1) == last, ends).otherwise(F.concat(F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))), F.array(last)))

    return F.aggregate(lengths, start, step, finish)


def pages(events: Column, min_chars: int = MIN_PAGE_CHARS) -> Column:
    """page_seq, raw_text, printed_no (the number in its footer), first and to (places of events) of the pages that have text."""

    def joined(parts: Column, ends: Column) -> Column:
        spans = F.transform(ends, lambda to, i: F.struct(F.coalesce(F.get(ends, i - 1) + 1, F.lit(0)).alias("a"), to.alias("b")))
        text = lambda s: F.array_join(F.filter(F.slice(parts["text"], s["a"] + 1, s["b"] - s["a"] + 1), lambda t: t != ""), "\n")
        return F.transform(spans, lambda s: F.struct(text(s).alias("text"), F.get(parts, s["a"])["first"].alias("first"), F.get(parts, s["b"])["to"].alias("to")))

    def numbered(page: Column, i: Column) -> Column:
        footer = F.regexp_extract(F.right(page["text"], F.lit(FOOTER_CHARS)), FOOTER, 1).try_cast("int")
        return F.struct((i + 1).alias("page_seq"), page["text"].alias("raw_text"), F.nullif(footer, F.lit(0)).alias("printed_no"), page["first"].alias("first"), page["to"].alias("to"))

    made = let(fragments(events), lambda parts: let(last_fragments(F.transform(parts["text"], F.length), min_chars), lambda ends: joined(parts, ends)))
    return F.coalesce(F.transform(F.filter(made, lambda p: p["text"] != ""), numbered), F.array())


def block_type(block: Column) -> Column:
    """Headings by tag, by how the text opens, or by style of a short text: bold, or capitals only."""
    text, size = block["text"], F.length(block["text"])
    capitals = (size > 3) & (text == F.upper(text)) & (text != F.lower(text))
    styled = (size < STYLED_CHARS) & (F.coalesce(block["style"].rlike(BOLD), F.lit(False)) | capitals)
    heading = (size <= HEADING_CHARS) & (styled | block["tag"].isin(*HEADING_TAGS) | text.rlike(HEADING_SHAPE))
    note = text.rlike(FOOTNOTE_MARK) & (size < FOOTNOTE_CHARS)
    return F.when(block["tag"] == "table", "table").when(heading, "heading").when(block["tag"] == "li", "list").when(note, "footnote").otherwise("paragraph")


def captioned(blocks: Column) -> Column:
    """block_type, text and caption: the nearest heading before. Blocks are cut at headings, so each is looked at once."""

    def cut(heads: Column) -> Column:
        row = lambda b, caption: F.struct(b["block_type"].alias("block_type"), b["text"].alias("text"), caption.cast("string").alias("caption"))
        title = lambda i: F.get(blocks, F.get(heads, i))["text"]
        lead = F.transform(F.slice(blocks, 1, F.coalesce(F.get(heads, F.lit(0)), F.size(blocks))), lambda b: row(b, F.lit(None)))
        under = lambda at, i: F.transform(F.slice(blocks, at + 1, F.coalesce(F.get(heads, i + 1), F.size(blocks)) - at), lambda b, j: row(b, F.when(j == 0, title(i - 1)).otherwise(title(i))))
        return F.concat(lead, F.flatten(F.transform(heads, under)))

    return let(F.array_compact(F.transform(blocks, lambda b, i: F.when(b["block_type"] == "heading", i))), cut)


def blocks(events: Column) -> Column:
    """A page's leaf blocks and tables outside tables, in order; of those that repeat tag and text the first."""
    found = F.filter(events, lambda e: (e["kind"] == "open") & (e["text"] != "") & ~e["in_table"])
    by_text = F.array_sort(F.transform(found, lambda e, i: F.struct(e["tag"].alias("tag"), e["text"].alias("text"), i.alias("at"), e["style"].alias("style"))))
    same = lambda a, b: F.coalesce((a["tag"] == b["tag"]) & (a["text"] == b["text"]), F.lit(False))
    first = let(by_text, lambda s: F.filter(s, lambda b, i: ~same(F.get(s, i - 1), b)))
    in_order = F.array_sort(F.transform(first, lambda b: F.struct(b["at"].alias("at"), block_type(b).alias("block_type"), b["text"].alias("text"))))
    return let(in_order, captioned)


def grids(events: Column) -> Column:
    """The cells of a page's tables, nested ones included."""
    return F.transform(F.filter(events, lambda e: e["grid"].isNotNull()), lambda e: e["grid"])


def markers(events: Column) -> Column:
    """How many styled breaks, rules, and rules that are seams a filing has."""
    count = lambda test: F.size(F.filter(events, test))
    styled = count(lambda e: styled_break(e, "before")) + count(lambda e: styled_break(e, "after"))
    return F.create_map(F.lit("styled_breaks"), styled, F.lit("rules"), count(lambda e: (e["kind"] == "open") & (e["tag"] == "hr")), F.lit("page_rules"), count(page_rule))
