"""Evidence slots out of models' replies: decoded, typed and matched to operands by column functions.

A reply should be one JSON object of the stage's form. What came instead is told apart (``status``):

``whole``      valid, and every slot has a place (document and page)
``partial``    valid, but some slots have none; those count as missing
``truncated``  cut off inside the object; slots complete before the cut are still read
``malformed``  anything else that is not an object
``empty``      null or blank

A code fence around a reply is taken off first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics

# Kinds of answers of the extraction stage.
ANSWER_TYPES = ("scalar", "ratio", "comparison", "ranking", "qualitative")
DEFAULT_TYPE, DEFAULT_NAME = "qualitative", "value"

_FENCE = r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$"
#: The text with what strings hold blanked out, letter by letter, so that only its own brackets are left; without regular
#: expressions that repeat a choice, as those need stack for long texts.
_MASKED = r"""array_join(transform(split(regexp_replace(_text, '(?s)\\\\.', '__'), '"'), (x, i) -> if(i % 2 = 1, repeat('x', length(x)), x)), '"')"""
#: Whole flat objects behind the bracket that opens the slots, in order.
_SAVED = """aggregate(sequence(1, greatest(1, length(_masked) - length(replace(_masked, '}', '')))),
    named_struct('at', locate('[', _masked, greatest(1, locate('"slots"', _text))), 'out', cast(array() as array<string>)),
    (s, k) -> if(s.at = 0 or locate('{', _masked, s.at) = 0 or locate('}', _masked, locate('{', _masked, s.at)) = 0, named_struct('at', 0, 'out', s.out),
        named_struct('at', locate('}', _masked, s.at) + 1, 'out', concat(s.out, array(substring(_text, locate('{', _masked, s.at), locate('}', _masked, s.at) - locate('{', _masked, s.at) + 1))))),
    s -> s.out)"""
SLOT = {"name": "string", "value": "string", "unit": "string", "scale": "string", "period": "string", "doc_id": "string", "page_seq": "int", "quote": "string"}


def unfenced(reply: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(reply, F.lit("")), _FENCE, "$1"), r"^\s+|\s+$", "")


def _number(text: str) -> str:
    """SQL: the figure that a slot's text states. Parentheses or a leading minus mean below zero."""
    bare = rf"trim(regexp_replace(regexp_replace({text}, '^[()]+|[()]+$', ''), '[,$%]', ''))"
    below = rf"({text} like '(%' and {text} like '%)') or {bare} like '-%'"
    return f"if({below}, -1, 1) * try_cast(trim(regexp_replace({bare}, '^-', '')) as decimal(28,8))"


def decode_slots(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Adds status, answer_type, metric_name, slots (see SLOT, each with ``amount`` as decimal or null) and missing (names).

    Missing are the names that the reply gives as missing and those of slots without a document or page.
    """
    rows = replies.withColumn("_text", unfenced(F.col(reply))).withColumn("_json", F.try_parse_json("_text"))
    rows = rows.withColumn("_whole", F.coalesce(F.schema_of_variant("_json").startswith("OBJECT"), F.lit(False)))
    rows = rows.withColumn("_masked", F.when(F.col("_json").isNull() & F.col("_text").startswith("{"), F.expr(_MASKED)).otherwise(""))
    opened = F.length(F.regexp_replace("_masked", r"[^\[{]", "")) - F.length(F.regexp_replace("_masked", r"[^\]}]", ""))
    saved = F.transform(F.expr(_SAVED), lambda x: F.try_parse_json(x))
    listed = F.when(F.col("_whole"), F.try_variant_get("_json", "$.slots", "array<variant>")).when(F.col("_cut"), F.filter(saved, lambda x: x.isNotNull()))
    rows = rows.withColumn("_cut", opened > 0).withColumn("_slots", F.coalesce(listed, F.expr("cast(array() as array<variant>)")))
    fields = ", ".join(f"'{name}', try_variant_get(v, '$.{name}', '{kind}')" for name, kind in SLOT.items())
    read = F.expr(f"transform(_slots, v -> named_struct({fields}))")
    named = F.transform(read, lambda s: s.withField("name", F.coalesce(F.nullif(s["name"], F.lit("")), F.lit(DEFAULT_NAME))).withField("quote", F.coalesce(s["quote"], F.lit(""))))
    rows = rows.withColumn("_read", named)
    located = "x.doc_id is not null and x.page_seq >= 0"
    amounts = f"transform(filter(_read, x -> {located}), x -> named_struct({', '.join(f'{chr(39)}{n}{chr(39)}, x.{n}' for n in SLOT)}, 'amount', {_number('trim(x.value)')}))"
    lost = F.expr(f"transform(filter(_read, x -> not coalesce({located}, false)), x -> x.name)")
    said = F.filter(F.coalesce(F.try_variant_get("_json", "$.missing_slots", "array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull())
    kind = F.try_variant_get("_json", "$.answer_type", "string")
    rows = rows.withColumn("missing", F.concat(said, lost)).withColumn("slots", F.expr(amounts))
    status = F.when(F.col("_text") == "", "empty").when(F.col("_whole"), F.when(F.size(lost) > 0, "partial").otherwise("whole")).when(F.col("_cut"), "truncated").otherwise("malformed")
    rows = rows.withColumn("status", status).withColumn("answer_type", F.when(kind.isin(*ANSWER_TYPES), kind).otherwise(DEFAULT_TYPE))
    return rows.withColumn("metric_name", F.try_variant_get("_json", "$.metric_name", "string")).drop("_text", "_json", "_whole", "_masked", "_cut", "_slots", "_read")


def slot_rows(decoded: DataFrame, qid: str = "qid") -> DataFrame:
    """One row per slot: qid, name, value (the amount), unit, scale, period, doc_id, page_seq, quote."""
    each = decoded.select(qid, F.explode("slots").alias("s"))
    return each.select(qid, "s.name", F.col("s.amount").alias("value"), "s.unit", "s.scale", "s.period", "s.doc_id", "s.page_seq", "s.quote")


def slot_operands(slots: DataFrame, required: DataFrame, qid: str = "qid") -> DataFrame:
    """qid, operands (map from names to doubles) and missing (required names without a figure).

    A slot that a required name claims goes by that name. All others stay there under their own names, unless taken.
    """
    figures = slots.filter("value is not null").withColumn("value", metrics.scaled(F.col("value"), F.col("scale"))).filter("value is not null").select(qid, "name", "period", "value")
    aligned = metrics.align_operands(figures, required, qid)
    own = figures.select(qid, F.col("name").alias("operand"), "value", F.lit(1).alias("turn"))
    claimed = aligned.select(qid, F.col("required").alias("operand"), "value", F.lit(0).alias("turn"))
    best = claimed.unionByName(own).groupBy(qid, "operand").agg(F.min_by("value", F.struct("turn", "value")).alias("value"), F.min("turn").alias("turn"))
    pair = F.when(F.col("value").isNotNull(), F.struct("operand", "value"))
    lost = F.when((F.col("turn") == 0) & F.col("value").isNull(), F.col("operand"))
    return best.groupBy(qid).agg(F.map_from_entries(F.sort_array(F.collect_list(pair))).alias("operands"), F.sort_array(F.collect_list(lost)).alias("missing"))
