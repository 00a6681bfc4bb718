"""Filings: directory scan, names to metadata, envelopes to documents, and the smaller readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How filings are named and what their forms cover.
NAME = r"(?i)^(.+?)_(\d{4})(?:Q([1-4]))?_(10K|10Q|8K)(?:_dated[-_](\d{4}-\d{2}-\d{2}))?$"
COVERAGE_BACK = {"10-K": 2, "10-Q": 1, "8-K": 0}
ENVELOPE = r"(?i)<SEC-DOCUMENT>"
HTML_BLOCK = r"(?is)(<html.*?</html>)"
TYPE_OR_HTML = r"(?is)(<TYPE>[^\r\n<]+|<html.*?</html>)"
SKIPPED_TYPES = r"(?i)^(XML|EX-101(\.\w+)?|GRAPHIC|ZIP|EXCEL|JSON|EX-27(\.\w+)?)$"


def scan_directory(spark: SparkSession, path: str) -> DataFrame:
    """Files as doc_id, content and content_hash; only .htm files are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.htm").load(path)
    stem = F.regexp_extract("path", r"([^/]+)\.htm$", 1)
    return files.select(stem.alias("doc_id"), "content", F.sha2("content", 256).alias("content_hash"))


def catalog(names: DataFrame, name: str = "doc_id") -> DataFrame:
    """Metadata from names. A name that does not parse has an ``error`` and no metadata."""
    part = lambda i: F.nullif(F.regexp_extract(name, NAME, i), F.lit(""))
    year, quarter, form = part(2).cast("int"), part(3).cast("int"), F.upper(part(4))
    form = F.when(form == "10K", "10-K").when(form == "10Q", "10-Q").when(form == "8K", "8-K")
    back = F.coalesce(*[F.when(form == f, F.lit(n)) for f, n in COVERAGE_BACK.items()])
    date = part(5).try_cast("date")
    label = F.when(quarter.isNotNull(), F.format_string("Q%d FY%d", quarter, year)).when(form == "8-K", F.coalesce(date.cast("string"), year.cast("string"))).otherwise(F.format_string("FY%d", year))
    bad = ~F.col(name).rlike(NAME)
    keep = lambda c: F.when(~bad, c)
    return names.select(
        F.col(name).alias("doc_id"), F.upper(part(1)).alias("company_slug"), form.alias("form_type"), year.alias("fiscal_year"), quarter.alias("fiscal_quarter"),
        keep(label).alias("period_label"), date.alias("filing_date"), F.when(year.isNotNull(), F.sequence(year - back, year)).alias("coverage_years"), F.when(bad, "unrecognised name").alias("error"),
    )


def is_envelope(raw: Column) -> Column:
    return raw.rlike(ENVELOPE) | (F.regexp_count(raw, F.lit(HTML_BLOCK)) > 1)


def split_envelopes(files: DataFrame, raw: str = "raw") -> DataFrame:
    """doc_id, part, doc_type and html. Blocks take the nearest type before them; machine types and the index go; if nothing
    is left, the file stays whole."""
    marks = F.regexp_extract_all(raw, F.lit(TYPE_OR_HTML), F.lit(1))
    empty = F.struct(F.lit("").alias("type"), F.array().cast("array<struct<doc_type:string,html:string>>").alias("out"))

    def step(state: Column, mark: Column) -> Column:
        is_type = F.upper(F.left(mark, F.lit(6))) == "<TYPE>"
        wanted = (state["type"] != "") & ~state["type"].rlike(SKIPPED_TYPES)
        added = F.concat(state["out"], F.array(F.struct(state["type"].alias("doc_type"), mark.alias("html"))))
        return F.struct(F.when(is_type, F.trim(F.substring(mark, F.lit(7), F.length(mark)))).otherwise(state["type"]).alias("type"), F.when(~is_type & wanted, added).otherwise(state["out"]).alias("out"))

    whole = F.array(F.struct(F.lit("primary").alias("doc_type"), F.col(raw).alias("html")))
    parts = F.aggregate(marks, empty, step)["out"]
    chosen = F.when(is_envelope(F.col(raw)) & (F.size(parts) > 0), parts).otherwise(whole)
    return files.select("doc_id", F.posexplode(chosen).alias("part", "d")).select("doc_id", "part", "d.doc_type", "d.html")


def read_aliases(spark: SparkSession, table: dict[str, list[str]]) -> DataFrame:
    """(company_slug, alias): slugs in capitals, aliases in lower case, a slug its own alias."""
    rows = [(str(slug).upper(), alias) for slug, aliases in table.items() for alias in sorted({str(a).lower() for a in aliases} | {str(slug).lower()})]
    return spark.createDataFrame(rows, "company_slug string, alias string")


GOLD = "question string, answer string, justification string, doc_name string, company string, question_type string, evidence array<struct<evidence_text:string,evidence_text_full_page:string>>"


def read_gold(spark: SparkSession, path: str, id_field: str = "id") -> DataFrame:
    """Questions from JSON lines, evidence split in two lists, the answer's shape derived; ``id_field`` holds the question's id."""
    from evspark.functions.text import answer_shape

    raw = spark.read.schema(f"`{id_field}` string, {GOLD}").json(path)
    pick = lambda f: F.filter(F.transform("evidence", lambda e: e[f]), lambda t: t.isNotNull())
    return raw.select(F.col(f"`{id_field}`").alias("qid"), "question", "answer", "doc_name", "company", answer_shape(F.col("answer")).alias("shape"), pick("evidence_text").alias("evidence_texts"), pick("evidence_text_full_page").alias("evidence_pages"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table, in one plan."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def schema_health(df: DataFrame, expected_ddl: str) -> list[str]:
    """Columns of the expected schema that are missing or of another type."""
    from pyspark.sql.types import StructType

    have = dict(df.dtypes)
    return [f"{f.name}: {have.get(f.name, 'missing')}, not {f.dataType.simpleString()}" for f in StructType.fromDDL(expected_ddl) if have.get(f.name) != f.dataType.simpleString()]
