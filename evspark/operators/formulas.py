"""Formulas that come with the rows: parsed and evaluated by column functions, a different formula for every row.

A formula is cut into tokens; a fold over them turns it into postfix order (operators wait on a stack until something of
less binding follows), and a second fold runs that on a stack of values. Only arithmetic, six helpers and the operands of
the row exist in the machine, so whatever else a formula says ends as an error of its row.

Errors: ``empty``, ``not_allowed`` (a character or function beyond the grammar), ``syntax``, ``missing_operand``,
``zero_division``, ``not_a_number``. A row has a value or an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics

# How a question announces a definition of its own, and asks for averages.
DEFINITION = r"(?i)\b(?:defined as|calculated as|computed as|using the formula|which is defined|i\.e\.,?\s|defined by)\b([^?]{10,300})"
AVERAGING = r"(?i)\baverage of (?:the )?(?:beginning|opening) and (?:ending|closing)\b"

TOKEN = r"\*\*|[-+*/(),]|(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?|[A-Za-z_]\w*|\S"
_NAME = "'^[A-Za-z_]'"
_HELPERS = ", ".join(f"'{h}'" for h in metrics.HELPERS)
_BINARY = "('+', '-', '*', '/', '**')"


def _begins(token: str) -> tuple[str, str]:
    """Whether a token begins as a number and as a name, by its first character (tests of patterns cost more, for every token)."""
    first = f"ascii({token})"
    return f"({first} between 48 and 57 or {first} = 46)", f"({first} between 97 and 122 or {first} between 65 and 90 or {first} = 95)"


def _binding(operator: str) -> str:
    return f"(case when {operator} in ('+', '-') then 1 when {operator} in ('*', '/') then 2 when {operator} = 'neg' then 3 when {operator} = '**' then 4 else 0 end)"


def _parser(out: str = "s.out", waiting: str = "s.waiting", counts: str = "s.counts", due: str = "s.due", error: str = "s.error") -> str:
    """A state of the parser: what is out, what waits, the arguments of open calls, whether an operand is due, the error."""
    return f"named_struct('out', {out}, 'waiting', {waiting}, 'counts', {counts}, 'due', {due}, 'error', {error})"


def _staying(condition: str) -> str:
    """How many of the waiting stay: up to the last one (o) for which the condition holds."""
    return f"coalesce(array_max(transform(s.waiting, (o, i) -> if({condition}, i + 1, 0))), 0)"


def _drained(stay: str) -> str:
    """What is out, with all waiting beyond the first ``stay`` behind it, the last one first."""
    return f"concat(s.out, reverse(slice(s.waiting, {stay} + 1, size(s.waiting))))"


def _parse_token() -> str:
    """The state after one token: t.text, with the one ahead, and whether it opens the arguments of a call."""
    fail = {e: _parser(error=f"'{e}'") for e in ("not_allowed", "syntax")}
    bracket = _staying("o like '%('")
    first = "({o} > {t} or {o} = {t} and t.text <> '**')"
    looser = _staying(f"not {first.format(o=_binding('o'), t=_binding('t.text'))}")
    waits = first.format(o=_binding("get(s.waiting, size(s.waiting) - 1)"), t=_binding("t.text"))
    opened, before = f"element_at(s.waiting, {bracket})", f"slice(s.waiting, 1, {bracket} - 1)"
    one_more = "concat(slice(s.counts, 1, size(s.counts) - 1), array(element_at(s.counts, -1) + 1))"
    call = f"concat(substring_index({opened}, '(', 1), '#', element_at(s.counts, -1))"
    number, name = _begins("t.text")
    return f"""case
        when s.error is not null or t.opens then s
        when t.ahead = '(' and {name} and t.text not in ({_HELPERS}) then {fail["not_allowed"]}
        when {name} or {number} and try_cast(t.text as double) is not null then case
            when not s.due then {fail["syntax"]}
            when t.ahead = '(' and {name} then {_parser(waiting="concat(s.waiting, array(concat(t.text, '(')))", counts="concat(s.counts, array(1))")}
            else {_parser(out="concat(s.out, array(t.text))", due="false")} end
        when t.text = '(' then if(s.due, {_parser(waiting="concat(s.waiting, array('('))")}, {fail["syntax"]})
        when t.text in (',', ')') and (s.due or {bracket} = 0) then {fail["syntax"]}
        when t.text = ',' and {opened} = '(' then {fail["syntax"]}
        when t.text = ',' then {_parser(out=_drained(bracket), waiting=f"slice(s.waiting, 1, {bracket})", counts=one_more, due="true")}
        when t.text = ')' and {opened} = '(' then {_parser(out=_drained(bracket), waiting=before)}
        when t.text = ')' then {_parser(out=f"concat({_drained(bracket)}, array({call}))", waiting=before, counts="slice(s.counts, 1, size(s.counts) - 1)")}
        when t.text in ('+', '-') and s.due then {_parser(waiting="if(t.text = '-', concat(s.waiting, array('neg')), s.waiting)")}
        when t.text in {_BINARY} and not s.due and not coalesce({waits}, false) then {_parser(waiting="concat(s.waiting, array(t.text))", due="true")}
        when t.text in {_BINARY} then if(s.due, {fail["syntax"]}, {_parser(out=_drained(looser), waiting=f"concat(slice(s.waiting, 1, {looser}), array(t.text))", due="true")})
        else {fail["not_allowed"]} end"""


def postfix(formula: str) -> str:
    """SQL for a struct of tokens (postfix; a call shows how many arguments it has, as ``avg#3``) and error. ``formula`` is SQL for a text."""
    tokens = f"regexp_extract_all(coalesce({formula}, ''), '{TOKEN.replace(chr(92), chr(92) * 2)}', 0)"
    start = _parser("cast(array() as array<string>)", "cast(array() as array<string>)", "cast(array() as array<int>)", "true", "cast(null as string)")
    placed = f"transform(tokens, (x, i) -> named_struct('text', x, 'ahead', get(tokens, i + 1), 'opens', x = '(' and coalesce({_begins('get(tokens, i - 1)')[1]}, false)))"
    ends = "case when s.error is not null then s.error when size(s.out) = 0 and size(s.waiting) = 0 then 'empty' when s.due or exists(s.waiting, o -> o like '%(') then 'syntax' end"
    finish = f"named_struct('tokens', concat(s.out, reverse(s.waiting)), 'error', {ends})"
    return f"element_at(transform(array({tokens}), tokens -> aggregate({placed}, {start}, (s, t) -> {_parse_token()}, s -> {finish})), 1)"


def _machine(taken: str, value: str, name: str = "cast(null as string)") -> str:
    """A state of the machine after ``taken`` values made way for one."""
    return f"named_struct('stack', concat(slice(m.stack, 1, size(m.stack) - {taken}), array(named_struct('v', cast({value} as double), 'name', {name}))), 'error', m.error)"


def _stop(error: str) -> str:
    return f"named_struct('stack', m.stack, 'error', '{error}')"


def _run_token(operands: str) -> str:
    """The state after one postfix token x. Names go onto the stack with their values, as helpers take names."""
    a, b = "element_at(m.stack, -2).v", "element_at(m.stack, -1).v"
    helper, n = "substring_index(x, '#', 1)", "cast(substring_index(x, '#', -1) as int)"
    args = f"slice(m.stack, size(m.stack) - {n} + 1, {n})"
    values = f"transform({args}, y -> y.v)"
    periods = f"if({n} = 1, array('prev', 'current'), transform(slice({args}, 2, {n}), y -> y.name))"
    of_periods = f"transform({periods}, p -> {operands}[if(p = 'current', {args}[0].name, concat({args}[0].name, '__', p))])"
    total = f"aggregate({of_periods}, cast(0 as double), (t, y) -> t + y)"
    some_null = "exists({}, y -> y is null)"
    return f"""case
        when m.error is not null then m
        when x = 'neg' then if({b} is null, {_stop("missing_operand")}, {_machine("1", f"-{b}")})
        when x in {_BINARY} then case
            when {a} is null or {b} is null then {_stop("missing_operand")}
            when x = '/' and {b} = 0 then {_stop("zero_division")}
            else {_machine("2", f"case x when '+' then {a} + {b} when '-' then {a} - {b} when '*' then {a} * {b} when '/' then {a} / {b} else power({a}, {b}) end")} end
        when x like 'rank#%' or x like 'compare#%' then case
            when x like 'compare#%' and {n} <> 2 then {_stop("syntax")}
            when {some_null.format(values)} then {_stop("missing_operand")}
            when x like 'rank#%' then {_machine(n, f"array_position({values}, array_max({values}))")}
            else {_machine(n, f"sign({values}[0] - {values}[1])")} end
        when x like '%#%' then case
            when exists({args}, y -> y.name is null) or {helper} = 'prev' and {n} > 1 or {helper} = 'delta' and {n} = 2 then {_stop("syntax")}
            when {helper} = 'prev' then if({operands}[concat({args}[0].name, '__prev')] is null, {_stop("missing_operand")}, {_machine(n, f"{operands}[concat({args}[0].name, '__prev')]")})
            when {some_null.format(of_periods)} then {_stop("missing_operand")}
            when {helper} = 'delta' then {_machine(n, f"{of_periods}[1] - {of_periods}[0]")}
            when {helper} = 'avg' then {_machine(n, f"{total} / size({periods})")}
            else {_machine(n, total)} end
        when {_begins("x")[0]} then {_machine("0", "cast(x as double)")}
        else {_machine("0", f"{operands}[x]", "x")} end"""


def evaluated(parsed: str, operands: str) -> str:
    """SQL for a struct of value and error. ``parsed`` names a column of what ``postfix`` gives, ``operands`` one of maps from names to doubles."""
    start = f"named_struct('stack', cast(array() as array<struct<v: double, name: string>>), 'error', {parsed}.error)"
    value = "element_at(m.stack, -1).v"
    error = f"case when m.error is not null then m.error when {value} is null then 'missing_operand' when isnan({value}) or abs({value}) = double('infinity') then 'not_a_number' end"
    finish = f"named_struct('value', if({error} is null, {value}, null), 'error', {error})"
    return f"aggregate(if({parsed}.error is null, {parsed}.tokens, array()), {start}, (m, x) -> {_run_token(operands)}, m -> {finish})"


def with_values(rows: DataFrame, formula: str, operands: str, value: str = "value", error: str = "error", parsed: str | None = None) -> DataFrame:
    """Adds the value and the error of each row's formula (a column's name) over its operands (name of a map<string, double> column).

    ``parsed`` names a column of what ``postfix`` gives of the formula, where that is known already.
    """
    made = rows.withColumn("_parsed", F.col(parsed) if parsed else F.expr(postfix(f"`{formula}`"))).withColumn("_run", F.expr(evaluated("_parsed", f"`{operands}`")))
    return made.withColumns({value: F.col("_run.value"), error: F.col("_run.error")}).drop("_parsed", "_run")


def question_definition(question: Column) -> Column:
    """What a question says its measure is, or null."""
    body = F.regexp_replace(F.trim(F.regexp_extract(F.coalesce(question, F.lit("")), DEFINITION, 1)), r"\.+$", "")
    return F.when(body != "", body)


def with_operand_names(definition: Column) -> Column:
    """A definition in words as a formula: operands' phrases become their names, and a leading "the ratio of" or the like goes."""
    lowered = F.lower(definition)
    phrases = sorted((o for o in metrics.OPERANDS if "_" in o), key=lambda o: (-len(o), o))
    # One look for all of them first: most definitions have none.
    some = rf"\b(?:{'|'.join(o.replace('_', '[ -]') for o in phrases)})\b"
    named = F.when(lowered.rlike(some), reduce(lambda c, o: F.regexp_replace(c, rf"\b{o.replace('_', '[ -]')}\b", o), phrases, lowered)).otherwise(lowered)
    signs = ((r"\bdivided by\b", "/"), (r"\bless\b|\bminus\b", "-"), (r"\bplus\b", "+"), (r"\btimes\b", "*"), (r"\bthe\b", ""))
    return F.trim(reduce(lambda c, s: F.regexp_replace(c, *s), signs, named))


def choose_formula(questions: DataFrame, qid: str = "qid", question: str = "question") -> DataFrame:
    """qid, metric, source (``question`` or ``book``), definition, formula, period_rule and parsed; a definition in the question overrides the book.

    Where the definition is no formula, the book's formula of the metric named gives the shape. ``parsed`` is what
    ``postfix`` gives of the formula, or of the definition if there is no formula; each is parsed once.
    """
    book = F.create_map(*[F.lit(x) for name, (_, formula, *_rest) in metrics.METRICS.items() for x in (name, formula)])
    rows = questions.withColumn("metric", metrics.metric_named(F.col(question))).withColumn("definition", question_definition(F.col(question)))
    rows = rows.withColumn("own", with_operand_names(F.col("definition"))).withColumn("parsed", F.expr(postfix("own")))
    fits = F.col("definition").isNotNull() & F.col("parsed.error").isNull()
    formula = F.when(fits, F.col("own")).otherwise(F.try_element_at(book, F.col("metric")))
    source = F.when(F.col("definition").isNotNull(), "question").when(F.col("metric").isNotNull(), "book")
    rule = F.when(F.col("definition").rlike(AVERAGING), "average_of(prev, current)")
    rows = rows.select(qid, "metric", source.alias("source"), "definition", F.coalesce(formula, F.lit("")).alias("formula"), rule.alias("period_rule"), "parsed", fits.alias("fits"))
    parsed = F.when(F.col("fits") | (F.col("formula") == ""), F.col("parsed")).otherwise(F.expr(postfix("formula")))
    return rows.select(qid, "metric", "source", "definition", "formula", "period_rule", parsed.alias("parsed"))


def required_names(formula: str) -> str:
    """SQL for the operands that a formula (SQL for a text) may ask for: its names, and those of the period before if a helper may look there."""
    names = f"array_distinct(filter(coalesce({postfix(formula)}.tokens, array()), x -> x rlike {_NAME} and x not in ('prev', 'current', 'neg') and not x like '%#%'))"
    return f"if({formula} rlike '(avg|delta|prev|sum_range)', concat({names}, transform({names}, x -> concat(x, '__prev'))), {names})"
