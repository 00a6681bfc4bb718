"""Named metrics compiled to Spark columns.

A formula is parsed once on the driver; names become columns of an operand row (``x`` for the current period, ``x__prev``
for the one before), and only arithmetic and six helpers are let through, so nothing else can reach Spark. Division by
zero and missing operands give null.
"""

from __future__ import annotations

import ast
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The operands' concepts, tried in order, and the metrics.
OPERANDS: dict[str, list[str]] = {
    "revenue": ["us-gaap:RevenueFromContractWithCustomerExcludingAssessedTax", "us-gaap:Revenues", "us-gaap:SalesRevenueNet"],
    "cogs": ["us-gaap:CostOfGoodsAndServicesSold", "us-gaap:CostOfRevenue"],
    "gross_profit": ["us-gaap:GrossProfit"],
    "operating_income": ["us-gaap:OperatingIncomeLoss"],
    "net_income": ["us-gaap:NetIncomeLoss", "us-gaap:ProfitLoss"],
    "pretax_income": ["us-gaap:IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest"],
    "tax_expense": ["us-gaap:IncomeTaxExpenseBenefit"],
    "total_assets": ["us-gaap:Assets"],
    "current_assets": ["us-gaap:AssetsCurrent"],
    "current_liabilities": ["us-gaap:LiabilitiesCurrent"],
    "inventory": ["us-gaap:InventoryNet"],
    "receivables": ["us-gaap:AccountsReceivableNetCurrent"],
    "payables": ["us-gaap:AccountsPayableCurrent"],
    "ppe_net": ["us-gaap:PropertyPlantAndEquipmentNet"],
    "capex": ["us-gaap:PaymentsToAcquirePropertyPlantAndEquipment"],
    "cfo": ["us-gaap:NetCashProvidedByUsedInOperatingActivities"],
    "cfi": ["us-gaap:NetCashProvidedByUsedInInvestingActivities"],
    "cff": ["us-gaap:NetCashProvidedByUsedInFinancingActivities"],
    "d_and_a": ["us-gaap:DepreciationDepletionAndAmortization", "us-gaap:DepreciationAmortizationAndAccretionNet"],
    "equity": ["us-gaap:StockholdersEquity"],
    "lt_debt": ["us-gaap:LongTermDebtNoncurrent"],
    "st_debt": ["us-gaap:ShortTermBorrowings", "us-gaap:LongTermDebtCurrent"],
    "cash": ["us-gaap:CashAndCashEquivalentsAtCarryingValue"],
}
#: metric: (aliases, formula, unit, decimals, shown as percent)
METRICS: dict[str, tuple[tuple[str, ...], str, str, int, bool]] = {
    "quick_ratio": (("quick ratio", "acid test"), "(current_assets - inventory) / current_liabilities", "ratio", 2, False),
    "current_ratio": (("current ratio",), "current_assets / current_liabilities", "ratio", 2, False),
    "working_capital": (("working capital",), "current_assets - current_liabilities", "currency", 0, False),
    "gross_margin": (("gross margin", "gross profit margin"), "gross_profit / revenue", "ratio", 1, True),
    "operating_margin": (("operating margin", "operating profit margin"), "operating_income / revenue", "ratio", 1, True),
    "net_margin": (("net margin", "net profit margin"), "net_income / revenue", "ratio", 1, True),
    "capex_to_revenue": (("capex as a percent of revenue", "capital intensity"), "capex / revenue", "ratio", 1, True),
    "fixed_assets_to_total_assets": (("fixed assets to total assets",), "ppe_net / total_assets", "ratio", 1, True),
    "roa": (("return on assets", "roa"), "net_income / avg(total_assets, prev, current)", "ratio", 2, True),
    "roe": (("return on equity", "roe"), "net_income / avg(equity, prev, current)", "ratio", 2, True),
    "inventory_turnover": (("inventory turnover",), "cogs / avg(inventory, prev, current)", "ratio", 2, False),
    "fixed_asset_turnover": (("fixed asset turnover",), "revenue / avg(ppe_net, prev, current)", "ratio", 2, False),
    "asset_turnover": (("asset turnover",), "revenue / avg(total_assets, prev, current)", "ratio", 2, False),
    "dso": (("days sales outstanding", "dso"), "365 * avg(receivables, prev, current) / revenue", "days", 2, False),
    "dpo": (("days payable outstanding", "dpo"), "365 * avg(payables, prev, current) / (cogs + delta(inventory, prev, current))", "days", 2, False),
    "operating_cash_flow_ratio": (("operating cash flow ratio",), "cfo / current_liabilities", "ratio", 2, False),
    "free_cash_flow": (("free cash flow", "fcf"), "cfo - capex", "currency", 0, False),
    "fcf_conversion": (("free cash flow conversion",), "(cfo - capex) / net_income", "ratio", 1, True),
    "ebitda": (("ebitda",), "operating_income + d_and_a", "currency", 0, False),
    "ebitda_margin": (("ebitda margin", "unadjusted ebitda margin"), "(operating_income + d_and_a) / revenue", "ratio", 1, True),
    "effective_tax_rate": (("effective tax rate",), "tax_expense / pretax_income", "ratio", 1, True),
    "total_debt": (("total debt", "debt on balance sheet"), "st_debt + lt_debt", "currency", 0, False),
    "debt_to_equity": (("debt to equity", "leverage ratio"), "(st_debt + lt_debt) / equity", "ratio", 2, False),
    "revenue_growth": (("revenue growth", "sales growth", "year-over-year revenue change"), "delta(revenue, prev, current) / prev(revenue)", "ratio", 1, True),
    "cagr": (("cagr", "compound annual growth rate"), "(end / start) ** (1 / n) - 1", "ratio", 1, True),
}
SCALES = {"thousand": 3, "thousands": 3, "million": 6, "millions": 6, "billion": 9, "billions": 9, "unit": 0, "units": 0}
HELPERS = ("avg", "delta", "prev", "sum_range", "rank", "compare")
PERIODS = ("current", "prev")


class FormulaError(ValueError):
    """A formula has something that is not let through."""


def column_name(operand: str, period: str = "current") -> str:
    return operand if period == "current" else f"{operand}__{period}"


class _Compiler:
    """Turns a parsed formula into a Column, and gathers the operand columns it reads."""

    def __init__(self, as_double: bool):
        self.as_double, self.needed = as_double, []

    def operand(self, name: str, period: str = "current") -> Column:
        column = column_name(name, period)
        if column not in self.needed:
            self.needed.append(column)
        return F.col(column).cast("double") if self.as_double else F.col(column).cast("decimal(24,6)")

    def bare(self, node: ast.AST) -> str:
        if not isinstance(node, ast.Name):
            raise FormulaError("helpers take bare names")
        return node.id

    def visit(self, node: ast.AST) -> Column:
        if isinstance(node, ast.Expression):
            return self.visit(node.body)
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            return F.lit(float(node.value)) if self.as_double else F.lit(str(node.value)).cast("decimal(24,6)")
        if isinstance(node, ast.Name):
            return self.operand(node.id)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.UAdd, ast.USub)):
            value = self.visit(node.operand)
            return -value if isinstance(node.op, ast.USub) else value
        if isinstance(node, ast.BinOp):
            return self.binary(node)
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in HELPERS and not node.keywords:
            return getattr(self, f"call_{node.func.id}")(node.args)
        raise FormulaError(f"not allowed in a formula: {type(node).__name__}")

    def binary(self, node: ast.BinOp) -> Column:
        left, right = self.visit(node.left), self.visit(node.right)
        if isinstance(node.op, ast.Add):
            return left + right
        if isinstance(node.op, ast.Sub):
            return left - right
        if isinstance(node.op, ast.Mult):
            return left * right
        if isinstance(node.op, ast.Div):
            return F.try_divide(left, right)
        if isinstance(node.op, ast.Pow):
            return F.pow(left.cast("double"), right.cast("double"))
        raise FormulaError(f"not allowed in a formula: {type(node.op).__name__}")

    def periods(self, args: list[ast.AST], default: tuple[str, ...]) -> tuple[str, list[str]]:
        if not args:
            raise FormulaError("a helper needs an operand")
        return self.bare(args[0]), [self.bare(a) for a in args[1:]] or list(default)

    def call_avg(self, args):
        name, periods = self.periods(args, ("prev", "current"))
        return reduce(lambda a, b: a + b, [self.operand(name, p) for p in periods]) / len(periods)

    def call_sum_range(self, args):
        name, periods = self.periods(args, ("prev", "current"))
        return reduce(lambda a, b: a + b, [self.operand(name, p) for p in periods])

    def call_delta(self, args):
        name, periods = self.periods(args, ("prev", "current"))
        return self.operand(name, periods[1]) - self.operand(name, periods[0])

    def call_prev(self, args):
        return self.operand(self.bare(args[0]), "prev")

    def call_rank(self, args):
        values = F.array(*[self.visit(a).cast("double") for a in args])
        return F.array_position(values, F.array_max(values)).cast("double")

    def call_compare(self, args):
        return F.signum((self.visit(args[0]) - self.visit(args[1])).cast("double"))


def compile_formula(formula: str, as_double: bool = True) -> tuple[Column, list[str]]:
    """The formula as a Column, and the operand columns it needs. Raises FormulaError for anything beyond the grammar."""
    try:
        tree = ast.parse(formula, mode="eval")
    except (SyntaxError, ValueError, RecursionError) as error:
        raise FormulaError(str(error)) from error
    compiler = _Compiler(as_double)
    return compiler.visit(tree), compiler.needed


def required_operands(formula: str) -> list[str]:
    return compile_formula(formula)[1]


def with_metrics(operands: DataFrame, names: list[str] | None = None, decimals: int = 6) -> DataFrame:
    """Adds a column for each metric whose operand columns are there."""
    for name in names or METRICS:
        column, needed = compile_formula(METRICS[name][1])
        if set(needed) <= set(operands.columns):
            operands = operands.withColumn(name, F.round(column, decimals))
    return operands


def with_previous(rows: DataFrame, entity: str, period: str, operands: list[str]) -> DataFrame:
    """Adds ``x__prev`` for each operand: its value in the entity's period before."""
    order = Window.partitionBy(entity).orderBy(period)
    return rows.withColumns({column_name(o, "prev"): F.lag(o).over(order) for o in operands})


def render(value: Column, metric: str) -> Column:
    """The metric's value as shown: percent or plain, rounded half up."""
    _, _, _, decimals, percent = METRICS[metric]
    shown = (value * 100 if percent else value).cast("decimal(28,10)")
    text = F.format_number(F.round(shown, decimals), decimals)
    return F.concat(text, F.lit("%")) if percent else text


def scaled(value: Column, scale: Column) -> Column:
    """The value in units; an unknown scale word gives null."""
    words = F.create_map(*[F.lit(x) for k, v in SCALES.items() for x in (k, 10.0**v)])
    return F.when(scale.isNull(), value.cast("double")).otherwise(value.cast("double") * words[F.lower(scale)])


def units_compatible(units: Column) -> Column:
    """At most one unit among an array of them, nulls aside."""
    return F.size(F.array_distinct(F.transform(F.array_compact(units), F.lower))) <= 1


def metric_named(question: Column) -> Column:
    """The metric of the longest alias that stands in the question as whole words, or null."""
    lowered = F.lower(question)
    text = F.concat(F.lit(" "), F.regexp_replace(lowered, "[^a-z0-9& ]", " "), F.lit(" "))
    options = [(alias, metric) for metric, (aliases, *_rest) in METRICS.items() for alias in aliases]
    options.sort(key=lambda o: (-len(o[0]), o[0]))
    # One look for all of them first, with anything for a space, as most texts have none and putting in spaces takes longest.
    # Then over an array: a branch for each makes code too long to be compiled.
    some = f"(?s)(?<![a-z0-9&])(?:{'|'.join('.'.join(map(re.escape, alias.split(' '))) for alias, _ in options)})"
    spaced = F.array(*[F.lit(f" {alias} ") for alias, _ in options])
    metric = F.create_map(*[F.lit(x) for alias, named in options for x in (f" {alias} ", named)])
    longest = F.get(F.filter(spaced, lambda alias: F.contains(text, alias)), F.lit(0))
    return F.when(lowered.rlike(some), F.try_element_at(metric, longest))


def choose_metric(questions: DataFrame, qid: str = "qid", question: str = "question") -> DataFrame:
    """qid and the metric that the question names."""
    return questions.select(qid, metric_named(F.col(question)).alias("metric"))


def resolve_facts(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Operand values from tagged facts: for each key and operand, the first concept that has a value."""
    listed = [(concept, operand, at) for operand, concepts in OPERANDS.items() for at, concept in enumerate(concepts)]
    concepts = F.broadcast(facts.sparkSession.createDataFrame(listed, "qname string, operand string, at int"))  # the catalogue
    best = facts.join(concepts, "qname").groupBy(*keys, "operand").agg(F.min_by("value", "at").alias("value"))
    return best.groupBy(*keys).pivot("operand", sorted(OPERANDS)).agg(F.first("value"))


# Fixed value: how a slot's name or period shows a year.
SLOT_YEAR = r"(?i)(?:fy)?\s*(?:19|20)\d{2}"


def canonical_name(name: Column) -> Column:
    """The name without years, in lower case, words apart by single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), SLOT_YEAR, " "), "[^a-z0-9]+", " "))


def align_operands(slots: DataFrame, required: DataFrame, qid: str = "qid") -> DataFrame:
    """For each required name of a question, a slot (name, period, value), or none.

    Slots are grouped by canonical name, latest period first, those without a year last. ``x`` takes the first slot of
    its group and ``x__prev`` the second. A name without a group takes the first group that contains it or is contained
    in it. No slot serves two names; the current period's go first.
    """
    s = slots.withColumn("slot", F.row_number().over(Window.partitionBy(qid).orderBy("name", F.desc("period"), "value"))).withColumn("group", canonical_name(F.col("name")))
    year = F.regexp_extract(F.col("period").cast("string"), r"((?:19|20)\d{2})", 1).try_cast("int")
    by_period = Window.partitionBy(qid, "group").orderBy(F.desc_nulls_last(year), "slot")
    ranked = s.withColumn("place", F.row_number().over(by_period) - 1)
    groups = ranked.groupBy(qid, "group").agg(F.min("slot").alias("first"))
    asked = required.select(qid, "required").distinct()
    asked = asked.withColumn("wanted", canonical_name(F.split("required", "__")[0])).withColumn("place", F.col("required").contains("__").cast("int"))
    loose = (F.col("wanted") != "") & (F.col("group").contains(F.col("wanted")) | F.col("wanted").contains(F.col("group")))
    kind = F.when(F.col("group") == F.col("wanted"), 0).when(loose, 1)
    options = asked.join(groups, qid).withColumn("kind", kind).filter("kind is not null")
    best = options.groupBy(qid, "required", "place").agg(F.min_by("group", F.struct("kind", "first")).alias("group"))
    found = best.join(ranked, [qid, "group", "place"])
    claimed = found.withColumn("turn", F.row_number().over(Window.partitionBy(qid, "slot").orderBy("place", "required"))).filter("turn = 1")
    return required.join(claimed.select(qid, "required", "name", "period", "value"), [qid, "required"], "left")
