"""Questions without an answer: drawn from a catalogue in five categories, stored as JSON lines, and reports on how they were met.

A category takes its filings without replacement in the order of a digest, so a set depends on its seed and the catalogue
alone. Only as many rows as are asked for are ever sorted out of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .review import FALSE_PREMISE, MISSING_METRIC, MISSING_OPERAND, OUTSIDE_FILING, WRONG_FILING

SCHEMA = "nid string, question string, category string, rationale string, company_slug string, reviewed boolean, notes string, tags array<string>"
#: How many questions of each kind a set has.
COUNTS = {"future_period": 10, "wrong_quarter": 5, MISSING_METRIC: 10, FALSE_PREMISE: 10, MISSING_OPERAND: 10, OUTSIDE_FILING: 15}
#: What is asked for in turn; %1$s is the company's name, %2$d the year.
ABSENT = ("visitors to the website", "average age of staff", "share of repeat customers", "hours of training for each employee", "patents applied for abroad", "complaints settled by phone")
PREMISES = ("Why did %1$s move its headquarters in FY%2$d?", "How large was the product recall of %1$s in FY%2$d?", "What special dividend did %1$s pay in FY%2$d?")
OPERANDS = ("What was the revenue of %1$s for each store visit in FY%2$d?", "How much did %1$s earn for each hour worked in FY%2$d?")
OUTSIDE = ("At what price does the share of %1$s trade today?", "Is %1$s a good buy after FY%2$d?", "What do analysts expect of %1$s beyond FY%2$d?", "Whom has %1$s taken over since it filed for FY%2$d?")


def display_names(aliases: DataFrame) -> DataFrame:
    """company_slug and the name to ask by: the longest alias of several words, else the longest, with capitals; ties go to the last in order."""
    spaced = F.col("alias").contains(" ") | F.col("alias").contains("-")
    best = aliases.groupBy("company_slug").agg(F.max(F.struct(spaced.alias("spaced"), F.length("alias").alias("n"), "alias")).alias("best"))
    return best.select("company_slug", F.initcap("best.alias").alias("display"))


def generate(catalog: DataFrame, aliases: DataFrame, seed: str = "1", counts: dict[str, int] | None = None) -> DataFrame:
    """Rows of SCHEMA. ``catalog`` has doc_id, company_slug, form_type, fiscal_year and fiscal_quarter."""
    wanted = COUNTS | (counts or {})
    newest = catalog.groupBy("company_slug").agg(F.max("fiscal_year").alias("newest"))
    known = catalog.join(newest, "company_slug").join(display_names(aliases), "company_slug", "left")
    known = known.withColumn("name", F.coalesce("display", F.initcap(F.replace("company_slug", F.lit("_"), F.lit(" ")))))
    year, name, quarter = F.col("fiscal_year"), F.col("name"), F.col("fiscal_quarter")
    annual, quarterly = F.col("form_type") == "10-K", F.col("form_type") == "10-Q"
    other = F.when(quarter != 4, 4).otherwise(1)

    def in_turn(texts: tuple[str, ...]) -> Column:
        return F.element_at(F.array(*map(F.lit, texts)), (F.pmod(F.col("n") - 1, F.lit(len(texts))) + 1).cast("int"))

    def asked(texts: tuple[str, ...]) -> Column:
        return F.replace(F.replace(in_turn(texts), F.lit("%1$s"), name), F.lit("%2$d"), year.cast("string"))

    kinds: dict[str, tuple[str, Column, Column, str]] = {
        "future_period": (WRONG_FILING, annual, F.format_string("What was the total revenue of %s in FY%d?", name, F.col("newest") + 2), "no filing covers this year"),
        "wrong_quarter": (WRONG_FILING, quarterly, F.format_string("What was the net income of %s in Q%d FY%d?", name, other, year), "another quarter is on file"),
        MISSING_METRIC: (MISSING_METRIC, annual, F.format_string("What was the number for %s of %s in FY%d?", in_turn(ABSENT), name, year), "filings do not disclose this"),
        FALSE_PREMISE: (FALSE_PREMISE, annual, asked(PREMISES), "takes for granted what the filing does not record"),
        MISSING_OPERAND: (MISSING_OPERAND, annual, asked(OPERANDS), "the divisor is not disclosed"),
        OUTSIDE_FILING: (OUTSIDE_FILING, F.lit(True), asked(OUTSIDE), "no filing says this"),
    }
    parts = []
    for kind, (category, fits, question, rationale) in kinds.items():
        order = F.md5(F.concat_ws("|", F.lit(seed), F.lit(kind), "doc_id"))
        drawn = known.filter(fits).orderBy(order, "doc_id").limit(wanted[kind])
        placed = drawn.agg(F.sort_array(F.collect_list(F.struct(order.alias("_at"), "doc_id", "company_slug", "name", "fiscal_year", "fiscal_quarter", "newest"))).alias("rows"))
        rows = placed.select(F.posexplode("rows").alias("n", "r")).select((F.col("n") + 1).alias("n"), "r.*")
        tags = F.array(F.lit(kind)) if kind != category else F.array().cast("array<string>")
        parts.append(rows.select(F.format_string(f"{kind}-%02d", "n").alias("nid"), question.alias("question"), F.lit(category).alias("category"), F.lit(rationale).alias("rationale"), "company_slug", F.lit(False).alias("reviewed"), F.lit("").alias("notes"), tags.alias("tags")))
    return reduce(DataFrame.unionByName, parts)


def save(negatives: DataFrame, path: str) -> None:
    negatives.select(*[c.split()[0] for c in SCHEMA.split(", ")]).write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Stored questions; blank lines are passed over, a line that is no question is an error."""
    return spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path)


def report(outcomes: DataFrame) -> DataFrame:
    """By category and over all (null): n, answered, false_answer_rate and reasons (refusals by reason, most frequent first).

    ``outcomes`` has category, abstained and abstain_reason, one row a question.
    """
    each = outcomes.withColumn("reason", F.when(F.col("abstained"), F.coalesce("abstain_reason", F.lit("unknown"))))
    counted = each.groupBy("category", "reason").agg(F.count(F.lit(1)).alias("times"))  # few rows, whatever the number of questions
    levels = counted.unionByName(counted.groupBy("reason").agg(F.sum("times").alias("times")).withColumn("category", F.lit(None).cast("string")))
    pairs = F.sort_array(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct((-F.col("times")).alias("minus"), "reason"))))
    sums = levels.groupBy("category").agg(F.sum("times").alias("n"), F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("times"))), F.lit(0)).alias("answered"), pairs.alias("p"))
    reasons = F.array_join(F.transform("p", lambda x: F.concat(x["reason"], F.lit(":"), (-x["minus"]).cast("string"))), ", ")
    return sums.select("category", "n", "answered", F.round(F.col("answered") / F.col("n"), 6).alias("false_answer_rate"), reasons.alias("reasons"))
