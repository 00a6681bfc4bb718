"""Small written inputs for operators that the driver's tables do not exercise."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILING_NAMES = ("ACME_2022_10K", "acme_2023Q2_10Q", "GLOBEX_2022_8K_dated-2022-07-01", "Initech_2021_10k", "notes", "UMBRELLA_CORP_2020Q4_10Q", "HOOLI_2019_8K")

#: qid, question, answer, intent, shape, declined
QUESTIONS = (
    ("q1", "What does management forecast for next year?", "Yes, revenue will grow 3.2%", "forecast", "yes_no", "no"),
    ("q2", "What are the pension plan assets?", "$1,577.00", "historical", "numeric", "no"),
    ("q3", "Is the pension plan growing, and what is the outlook?", "It rose from 3 to 5", "forecast", "multi_sentence", "no"),
    ("q4", "What was capex in FY2018?", "The provided pages do not state it", "historical", "phrase", "yes"),
    ("q5", "What are expected credit losses?", "Sales fell. Costs rose.", "historical", "multi_sentence", "no"),
    ("q6", "", "", "historical", "phrase", "no"),
    ("q7", "Which projects are planned?", "I cannot determine this", "historical", "phrase", "yes"),
    ("q8", "Does it expect to grow?", "Growth is not disclosed by segment", "forecast", "phrase", "no"),
)

#: text, first figure, number of figures, whether one of them is 1577
NUMBERS = (
    ("The FY2018 capex was $1,577 million.", 2018, 2, 1),
    ("$1577.00", 1577, 1, 1),
    ("(1,577)", -1577, 1, 0),
    ("about 8.70 billion", 8700000000, 1, 0),
    ("no figure", None, 0, 0),
    ("1.577 thousand units in 2022", 1577, 2, 1),
    ("12.4% up from 11", 12.4, 2, 0),
)

_STATEMENT = """<div><p>CONSOLIDATED STATEMENTS OF CASH FLOWS</p><table>
<tr><td>(In millions)</td><td></td><td colspan="2">2022</td><td colspan="2">2021</td></tr>
<tr><td>Purchases of equipment</td><td></td><td>$</td><td>(1,577)</td><td>$</td><td>(1,373)</td></tr>
<tr><td>Dividends paid</td><td></td><td>$</td><td>300</td><td>$</td><td>280</td></tr>
<tr><td>Depreciation</td><td></td><td>$</td><td>1,200</td><td>$</td><td>1,100</td></tr></table></div>"""
_TAGGED = """<ix:header><xbrli:context id="c1"><xbrli:period><xbrli:startDate>2022-01-01</xbrli:startDate><xbrli:endDate>2022-12-31</xbrli:endDate></xbrli:period></xbrli:context>
<xbrli:context id="c2"><xbrli:entity><xbrli:segment><xbrldi:explicitMember dimension="us-gaap:StatementBusinessSegmentsAxis">acme:Tools</xbrldi:explicitMember></xbrli:segment></xbrli:entity><xbrli:period><xbrli:instant>2022-12-31</xbrli:instant></xbrli:period></xbrli:context>
<xbrli:unit id="usd"><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit></ix:header>
<table><tr><td>Capital spending</td><td><ix:nonFraction name="us-gaap:PaymentsToAcquirePropertyPlantAndEquipment" contextRef="c1" unitRef="usd" scale="6" sign="-">1,577</ix:nonFraction></td></tr>
<tr><td>Assets</td><td><ix:nonFraction name="us-gaap:Assets" contextRef="c2" unitRef="usd" scale="3">2,500</ix:nonFraction></td></tr>
<tr><td>Lost</td><td><ix:nonFraction name="us-gaap:Revenues" contextRef="gone" unitRef="usd">9</ix:nonFraction></td></tr></table>"""
FILING = f"""<html><head><title>Report</title></head><body><div><h1>PART I</h1><p>Item 1. Business</p><p>We make tools and sell them in many places around the world.</p></div>
<div style="page-break-before:always"><p>Item 7. Management's Discussion and Analysis of Financial Condition and Results of Operations.</p><p>Organic growth slowed because of prices and weather in the year.</p><hr/></div>
<div><p>Volumes were driven by new shops, and organic sales rose in the last months.</p></div><div style="break-after: page"><p>PART II</p><p>Item 8. Financial Statements</p><p>See the pages that follow for them all.</p></div>
{_STATEMENT}<hr/>{_TAGGED}<p>Notes close the report, as every year before it. 12</p></body></html>"""

# What the filing above holds, read off by hand.
#: row_idx, col_idx, row_label, col_label, raw_text, numeric_value, sign
CELLS = (
    (1, 2, "Purchases of equipment", "2022", "(1,577)", -1577, -1),
    (1, 4, "Purchases of equipment", "2021", "(1,373)", -1373, -1),
    (2, 2, "Dividends paid", "2022", "300", 300, 1),
    (2, 4, "Dividends paid", "2021", "280", 280, 1),
    (3, 2, "Depreciation", "2022", "1,200", 1200, 1),
    (3, 4, "Depreciation", "2021", "1,100", 1100, 1),
)
#: fact number, qname, value, sign, scale, period_start, period_end, is_instant, row_label, dimensions
FACTS = (
    (0, "us-gaap:PaymentsToAcquirePropertyPlantAndEquipment", -1577000000, -1, 6, "2022-01-01", "2022-12-31", False, "Capital spending", "{}"),
    (1, "us-gaap:Assets", 2500000, 1, 3, "2022-12-31", "2022-12-31", True, "Assets", '{"us-gaap:StatementBusinessSegmentsAxis":"acme:Tools"}'),
)
#: ordinal, raw_title, kind, page_start, page_end, parent ordinal
SECTIONS = (
    (0, "PART I", "part", 1, 1, None),
    (1, "Item 1. Business", "item", 1, 1, 0),
    (2, "Item 7. Management's Discussion and Analysis of Financial Condition and Results of Operations.", "mdna", 2, 2, 1),
    (3, "PART II", "part", 3, 3, None),
    (4, "Item 8. Financial Statements", "item", 3, 3, 3),
    (5, "CONSOLIDATED STATEMENTS OF CASH FLOWS", "statement", 4, 5, 4),
)


def sql_rows(rows: tuple) -> str:
    """Rows as SQL VALUES."""

    def cell(v) -> str:
        return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


def filings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("ACME_2022_10K", FILING), ("EMPTY_2022_10K", ""), ("PLAIN_2022_10K", "<p>Only a few words, on one page, without any break.</p>")], "doc_id string, html string")


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([q[:3] for q in QUESTIONS], "qid string, question string, answer string")


def numbers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n[0],) for n in NUMBERS], "txt string")


def filings_of(suppliers: DataFrame) -> DataFrame:
    """The filing above for every supplier, with figures of its own (see FIGURES)."""
    # Cut at the figures first: one put in may look like another that is to be replaced.
    parts = re.split("(" + "|".join(map(re.escape, FIGURES)) + ")", FILING)
    html = F.concat(*[F.format_number(F.col("s_suppkey") + FIGURES[p], 0) if p in FIGURES else F.lit(p) for p in parts])
    return suppliers.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string"), F.lit("_2022_10K")).alias("doc_id"), html.alias("html"))


#: What a figure shown in the filing becomes: the supplier's key and so much.
FIGURES = {"1,577": 1000, "2,500": 2000}


def paged_html(text: Column) -> Column:
    """A text as HTML whose lines break pages by their number modulo 7, in every way that is known; rules in tables do not."""
    shown = lambda line: F.replace(F.replace(F.replace(line, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    def element(line: Column, i: Column) -> Column:
        number, body = i + 1, shown(line)
        wrapped = lambda before, after: F.concat(F.lit(before), body, F.lit(after))
        footer = F.concat(wrapped("<p>", "</p><p>Page "), number.cast("string"), F.lit("</p><hr>"))
        ways = {3: wrapped('<p style="page-break-before: always">', "</p>"), 5: footer, 6: wrapped("<table><tr><td>", "</td></tr><tr><td><hr></td></tr></table>"), 0: wrapped('<div style="break-after:page">', "</div>")}
        found = F.when(F.lit(False), body)
        for rest, way in ways.items():
            found = found.when(number % 7 == rest, way)
        return found.otherwise(wrapped("<p>", "</p>"))

    return F.array_join(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), element), "")
