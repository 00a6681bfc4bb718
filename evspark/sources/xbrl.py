"""Tagged facts of inline-XBRL documents. Contexts and units stand in the facts' own filing, so each filing's facts get
theirs where it is read: a filing is parsed once, and only facts move, to be numbered."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evspark.functions.keys import page_key
from evspark.operators.tables import cell_number

from . import paging
from .html import EVENT, FACT_TAGS, Node, events_of, local, parse
from .paging import MIN_PAGE_CHARS

RAW = (
    "doc_id string, facts array<struct<qname:string,shown:string,scale:int,sign:string,row_label:string,event_at:int,unit:string,"
    f"period_start:string,period_end:string,is_instant:boolean,dimensions:map<string,string>>>, events array<{EVENT}>"
)
#: Filings that are read at once: events and trees are larger than what they are made of.
AT_ONCE = 20


def _first(node: Node, name: str) -> str | None:
    return next((n.text() for n in node.walk() if local(n.tag) == name), None)


def _row_label(node: Node) -> str | None:
    up: Node | None = node
    while up is not None and up.tag != "tr":
        up = up.parent
    if up is None:
        return None
    texts = (c.text() for c in up.children if isinstance(c, Node) and c.tag in ("td", "th"))
    return next((t for t in texts if t.strip(" \t0123456789.,()$%+-–—")), None)


def _fact(node: Node, event_at: int | None, contexts: dict[str, dict], units: dict[str, str]) -> dict | None:
    a, scale = node.attributes, node.attributes.get("scale", "")
    context, unit = contexts.get(a.get("contextref")), a.get("unitref")
    if context is None:
        return None
    own = {"qname": a.get("name"), "shown": node.text(), "scale": int(scale) if scale.lstrip("+-").isdigit() else 0, "sign": a.get("sign"), "row_label": _row_label(node), "event_at": event_at}
    return own | context | {"unit": units.get(unit, unit)}


def read_filing(htmls: list[str | None], by_page: bool = False) -> tuple[list[dict], list | None]:
    """Facts of a filing's documents, in order; contexts and units hold throughout, the last one of a name counts, and a
    fact whose context is missing is dropped. ``by_page``: facts have the place of their event, and all events are given."""
    roots = [parse(html or "") for html in htmls]
    contexts: dict[str, dict] = {}
    units: dict[str, str] = {}
    for root in roots:
        more = read_header(root)
        contexts |= more[0]
        units |= more[1]
    rows, nodes = events_of(roots) if by_page else (None, [node for root in roots for node in root.walk()])
    facts = [_fact(node, at if by_page else None, contexts, units) for at, node in enumerate(nodes) if node is not None and local(node.tag) in FACT_TAGS]
    return [f for f in facts if f is not None], rows


def read_header(root: Node) -> tuple[dict[str, dict], dict[str, str]]:
    """Contexts and units by their names, wherever they stand."""
    contexts, units = {}, {}
    for node in root.walk():
        name, a = local(node.tag), node.attributes
        if name == "context" and a.get("id"):
            instant = _first(node, "instant")
            members = [(n.attributes.get("dimension", ""), n.text()) for n in node.walk() if local(n.tag) in ("explicitmember", "typedmember")]
            contexts[a["id"]] = {"period_start": instant or _first(node, "startdate"), "period_end": instant or _first(node, "enddate"), "is_instant": instant is not None, "dimensions": members}
        elif name == "unit" and a.get("id"):
            measures = [n.text().rpartition(":")[2] for n in node.walk() if local(n.tag) == "measure"]
            units[a["id"]] = "/".join(measures)
    return contexts, units


def read_tagged(docs: DataFrame, id_col: str, html_col: str, by_page: bool = False, min_chars: int = MIN_PAGE_CHARS) -> DataFrame:
    """Raw facts of each document, or filing if the html column is an array. ``by_page`` places facts on pages."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(RAW))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                rows = [(doc, *read_filing(htmls or [], by_page)) for doc, htmls in zip(*(c.to_pylist() for c in batch.slice(at, AT_ONCE).columns))]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    htmls = F.col(html_col) if dict(docs.dtypes)[html_col].startswith("array") else F.array(html_col)
    read = docs.select(F.col(id_col).cast("string").alias("doc_id"), htmls.alias("htmls")).mapInArrow(kernel, RAW)
    if not by_page:
        return read.drop("events")
    pages = F.transform(paging.pages(F.col("events"), min_chars), lambda p: F.struct(p["page_seq"].alias("page_seq"), p["first"].alias("first"), p["to"].alias("to")))
    page = lambda f, ps: F.get(F.filter(ps, lambda p: (p["first"] <= f["event_at"]) & (f["event_at"] < p["to"])), F.lit(0))["page_seq"]
    # Pages are worked out once a filing, not once a fact.
    placed = paging.let(pages, lambda ps: F.transform("facts", lambda f: f.withField("page_seq", page(f, ps))))
    return read.select("doc_id", F.filter(placed, lambda f: f["page_seq"].isNotNull()).alias("facts"))


def facts(raw: DataFrame) -> DataFrame:
    """Facts with their period, dimensions, unit and scaled value. A fact whose context is missing is dropped; a missing
    unit leaves its reference."""
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1
    return _resolved(raw).select("doc_id", F.format_string("%s#f%d", "doc_id", number).alias("fact_id"), *FACT_COLUMNS)


def page_facts(raw: DataFrame) -> DataFrame:
    """The same for facts that were read by page: page_seq and page_id, facts numbered on their page."""
    page = page_key(F.col("doc_id"), F.col("page_seq"))
    number = F.row_number().over(Window.partitionBy("doc_id", "page_seq").orderBy("at")) - 1
    return _resolved(raw).select("doc_id", "page_seq", page.alias("page_id"), F.format_string("%s#f%d", page, number).alias("fact_id"), *FACT_COLUMNS)


def label_matches(row_label: Column, terms: Column) -> Column:
    """False only if the row's label has none of the metric's terms (an array); without label or terms nothing is refuted."""
    known = F.filter(F.coalesce(terms, F.array().cast("array<string>")), lambda t: F.coalesce(t, F.lit("")) != "")
    silent = (F.coalesce(row_label, F.lit("")) == "") | (F.size(known) == 0)
    return silent | F.exists(known, lambda t: F.contains(F.lower(row_label), F.lower(t)))


FACT_COLUMNS = ("qname", "value", "unit", "scale", "sign", "period_start", "period_end", "is_instant", "dimensions", "row_label")


def _resolved(raw: DataFrame) -> DataFrame:
    # An outer generator, before which the optimizer puts no filter that would work the facts out again.
    rows = raw.filter("doc_id is not null").select("doc_id", F.posexplode_outer("facts").alias("at", "f")).filter("f is not null").select("doc_id", "at", "f.*")
    shown = cell_number(F.col("shown"))
    exact = F.concat(shown.cast("string"), F.lit("E"), F.col("scale").cast("string")).try_cast("decimal(38,6)")  # shifts digits, without a double
    value = F.when(F.col("scale") == 0, shown).otherwise(exact)
    signed = F.when((F.trim(F.coalesce("sign", F.lit(""))) == "-") & (value > 0), -value).otherwise(value).cast("decimal(38,6)")
    made = {"value": signed, "period_start": F.to_date("period_start"), "period_end": F.to_date("period_end")}
    return rows.withColumns(made).withColumn("sign", F.when(F.col("value") < 0, -1).otherwise(1))
