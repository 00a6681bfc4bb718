"""Typed cells from table grids (array<array<string>>), with higher-order functions only.

A grid's columns are dropped if empty; the header row is the one of the first twelve with most period tokens, at least
two; columns are typed by what stands below it; the k-th header token belongs to the k-th value column, and cells are
given only if the counts agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as a number, a symbol, a period and a unit note.
NUMERIC = r"^\(?\s*[-+]?[$€£]?\s*\d{1,3}(?:,\d{3})*(?:\.\d+)?\s*%?\s*\)?$"
SYMBOL = r"^[\s$€£%()\[\].,;:*+\-–—―]*$"
YEAR_TOKEN = r"(?<!\d)(19|20)\d{2}(?!\d)"
PERIOD_TOKEN = r"(?i)\b(q[1-4]|fy\d{2,4}|three|six|nine|twelve|months?|quarter|year|weeks?)\b"
QUARTER_TOKEN = r"(?i)\b(q[1-4]|fy\s?\d{2,4})\b"
DESCRIPTOR = r"(?i)\b(years?|three|six|nine|twelve|months?|quarters?|weeks?|periods?|fiscal)\b.{0,30}?\b(ended|ending)\b"
UNITS_NOTE = r"(?i)\(\s*(?:dollars\s+|amounts\s+)?(?:in\s+)?(thousands|millions|billions)\b[^)]*\)"
HEADER_ROWS, WORDY, NUMERIC_SHARE = 12, 0.6, 0.6


def cell_number(text: Column) -> Column:
    """The value of a cell: separators, symbols and percent signs dropped; brackets or a leading minus negate."""
    t = F.trim(F.coalesce(text, F.lit("")))
    bracketed = t.startswith("(") & t.endswith(")")
    bare = F.trim(F.translate(F.regexp_replace(t, r"^[()]+|[()]+$", ""), ",$€£%", ""))
    negative = bracketed | bare.startswith("-")
    value = F.trim(F.regexp_replace(bare, "^-", "")).try_cast("decimal(38,6)")
    return F.when(bare != "", F.when(negative, -value).otherwise(value))


def cell_sign(text: Column) -> Column:
    return F.when(cell_number(text) < 0, -1).otherwise(1)


def is_numeric(text: Column) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    return (t != "") & ~t.rlike(SYMBOL) & t.rlike(NUMERIC)


def _column(grid: Column, c: Column, first: Column) -> Column:
    """Filled cells of a column from row ``first`` on."""
    return F.filter(F.transform(F.slice(grid, first + 1, F.greatest(F.size(grid) - first, F.lit(0))), lambda r: F.trim(F.coalesce(F.get(r, c), F.lit("")))), lambda v: v != "")


def drop_empty_columns(grid: Column) -> Column:
    width = F.size(F.get(grid, F.lit(0)))
    kept = F.filter(F.sequence(F.lit(0), width - 1), lambda c: F.exists(grid, lambda r: F.trim(F.get(r, c)) != ""))
    return F.when(width > 0, F.transform(grid, lambda r: F.transform(kept, lambda c: F.get(r, c))))


def label_column(grid: Column) -> Column:
    """The leftmost column that is filled enough and mostly words; null if none."""

    def wordy(c: Column) -> Column:
        filled = _column(grid, c, F.lit(0))
        words = F.size(F.filter(filled, lambda v: ~is_numeric(v) & ~v.rlike(SYMBOL)))
        return (F.size(filled) >= F.greatest(F.lit(2), F.floor(F.size(grid) / 3))) & (words >= WORDY * F.size(filled))

    return F.get(F.filter(F.sequence(F.lit(0), F.size(F.get(grid, F.lit(0))) - 1), wordy), F.lit(0))


def header_row(grid: Column) -> Column:
    """Position of the row with most period tokens (at least two) among the first rows; the earliest of equals."""
    count = lambda r: F.size(F.filter(r, lambda v: F.coalesce(v, F.lit("")).rlike(YEAR_TOKEN) | F.coalesce(v, F.lit("")).rlike(PERIOD_TOKEN)))
    scored = F.transform(F.slice(grid, 1, HEADER_ROWS), lambda r, i: F.struct(count(r).alias("n"), (-i).alias("at")))
    best = F.array_max(F.filter(scored, lambda s: s["n"] >= 2))
    return -best["at"]


def header_tokens(grid: Column, row: Column, label: Column) -> Column:
    """Column labels of the header row: no unit notes, and no descriptor of a period that names neither year nor quarter."""
    cells = F.transform(F.get(grid, row), lambda v, i: F.struct(i.alias("i"), F.trim(F.coalesce(v, F.lit(""))).alias("t")))
    descriptor = lambda t: t.rlike(DESCRIPTOR) & ~(t.rlike(YEAR_TOKEN) | t.rlike(QUARTER_TOKEN))
    kept = F.filter(cells, lambda s: (s["t"] != "") & ~s["i"].eqNullSafe(label) & ~s["t"].rlike(UNITS_NOTE) & ~descriptor(s["t"]))
    return F.transform(kept, lambda s: s["t"])


def column_kinds(grid: Column, row: Column) -> Column:
    """empty, symbol, value or label for each column, from the rows below the header."""

    def kind(c: Column) -> Column:
        filled = _column(grid, c, F.coalesce(row + 1, F.lit(0)))
        numeric = F.size(F.filter(filled, is_numeric))
        return F.when(F.size(filled) == 0, "empty").when(F.forall(filled, lambda v: v.rlike(SYMBOL)), "symbol").when(numeric >= NUMERIC_SHARE * F.size(filled), "value").otherwise("label")

    return F.transform(F.sequence(F.lit(0), F.size(F.get(grid, F.lit(0))) - 1), kind)


def analyse(grids: DataFrame, grid: str = "grid", min_rows: int = 3, min_numeric: int = 4) -> DataFrame:
    """Adds label_col, header_row, header_tokens, col_kinds, value_cols, is_data_table, alignment_ok and units to tables."""
    t = grids.withColumn(grid, drop_empty_columns(F.col(grid))).withColumn("label_col", label_column(F.col(grid))).withColumn("header_row", header_row(F.col(grid)))
    t = t.withColumn("header_tokens", F.coalesce(header_tokens(F.col(grid), F.col("header_row"), F.col("label_col")), F.array().cast("array<string>")))
    t = t.withColumn("col_kinds", column_kinds(F.col(grid), F.col("header_row")))
    t = t.withColumn("value_cols", F.filter(F.transform("col_kinds", lambda k, i: F.when(k == "value", i)), lambda i: i.isNotNull()))
    numeric = F.size(F.filter(F.flatten(grid), is_numeric))
    data = (F.size(grid) >= min_rows) & (numeric >= min_numeric) & F.col("label_col").isNotNull()
    note = F.regexp_extract(F.array_join(F.flatten(grid), " "), UNITS_NOTE, 1)
    t = t.withColumn("is_data_table", F.coalesce(data, F.lit(False))).withColumn("units", F.when(note != "", F.lower(note)))
    return t.withColumn("alignment_ok", F.col("is_data_table") & (F.size("header_tokens") > 0) & (F.size("header_tokens") == F.size("value_cols")))


def typed_cells(analysed: DataFrame, keys: list[str], grid: str = "grid") -> DataFrame:
    """Cells of aligned tables: row and column label, text, value, sign and scale. Cells without label or number are left out."""
    aligned = analysed.filter("alignment_ok")
    rows = aligned.select(*keys, "label_col", "units", "header_row", F.arrays_zip("value_cols", "header_tokens").alias("cols"), F.posexplode(grid).alias("row_idx", "r")).filter("row_idx > header_row")
    cells = rows.select(*keys, "units", "row_idx", "r", F.trim(F.expr("get(r, label_col)")).alias("row_label"), F.explode("cols").alias("c"))
    raw = F.trim(F.expr("get(r, c.value_cols)"))
    typed = cells.select(*keys, "row_idx", F.col("c.value_cols").alias("col_idx"), "row_label", F.col("c.header_tokens").alias("col_label"), raw.alias("raw_text"), F.col("units").alias("scale"))
    typed = typed.withColumn("numeric_value", cell_number(F.col("raw_text"))).filter("row_label != '' and numeric_value is not null")
    return typed.withColumn("sign", cell_sign(F.col("raw_text")))


def row_labels(grid: Column) -> Column:
    """Line items: 3 to 120 characters with a letter, no number, distinct without regard to case."""
    labels = F.transform(grid, lambda r: F.trim(F.coalesce(F.get(F.filter(r, lambda v: F.trim(v) != ""), F.lit(0)), F.lit(""))))
    kept = F.filter(labels, lambda s: F.length(s).between(3, 120) & s.rlike("[A-Za-z]") & ~is_numeric(s))
    return F.filter(kept, lambda s, i: F.array_position(F.transform(kept, lambda x: F.lower(x)), F.lower(s)) == i + 1)


def markdown(grid: Column) -> Column:
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda v: F.replace(v, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(F.get(grid, F.lit(0)))))
    lines = F.transform(grid, line)
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")
