"""Chat formatting by event-sourced reconstruction.

A log holds events of conversations: ``delta`` appends text to a turn's message, ``edit`` replaces a message and
drops the turns after it, ``regenerate`` clears a message and drops the turns after it so that later deltas build it
anew. The log is partitioned by conversation and sorted by sequence number. An event survives if no later edit or
regeneration concerns its turn or an earlier one; the survivors are folded into one message per turn and rendered.

The rendered conversation is a sequence of segments, one per message, whose concatenation is the formatted text:
turn mark, role, text mark, text, end mark. Control strings inside roles and texts are escaped reversibly. Each
segment carries the span of its text under the loss mask. Only one message is in memory at a time, so a conversation
of any length streams through its task.

A log may have several messages at one turn: columns ``copy`` and ``row`` tell them apart (any values; 0 where a log has
none). They are messages of their own, in the order of role, copy and row, and count as one after the other for edits
and regenerations.

Edge cases: null roles and texts count as empty; events with the same sequence number are ordered by turn, kind and
text; a turn whose events were all dropped has no message; null conversation ids form a conversation of their own;
plain turns that repeat a conversation and turn stay turns of their own, equal ones too; an empty log gives an empty
result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Emitter, arrow_schema, bound_batches

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that steer some chat template; inside a text each gets a backslash after its first character.
CONTROL = re.compile(r"<\||\|>|</?s>|\[/?INST\]|<</?SYS>>|\\")
_ESCAPED = re.compile(r"\\(\\?)")

SEGMENTS = "conv_id long, part long, role string, segment string, loss_start long, loss_end long"
EVENTS = ("delta", "edit", "regenerate")


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0] * 2 if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _place() -> Column:
    """Where an event's message stands in its conversation."""
    return F.struct("turn", "rank", "copy", "row")


def surviving(log: DataFrame) -> DataFrame:
    """Events that no later edit or regeneration undoes; the window spills, so long conversations are fine."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("seq"), F.desc("turn"), F.desc("event"), F.desc("text")).rowsBetween(Window.unboundedPreceding, -1)
    cut = F.min(F.when(F.col("event") != "delta", _place())).over(order)
    return log.withColumn("_cut", cut).filter(F.col("_cut").isNull() | (_place() < F.col("_cut"))).drop("_cut")


def segment(role: str, text: str) -> tuple[str, int, int]:
    """The rendered message, and the span of its text in it."""
    head = TURN + escape(role) + TEXT
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def render(log: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per message: conv_id, part (from 0), role, segment, loss_start and loss_end (within the segment; null
    where there is no loss). ``log`` has conv_id, seq (of any type that has an order), event, turn, role, text and perhaps
    rank, copy and row. Rows come out by conversation, in order."""
    schema = arrow_schema(SEGMENTS)
    unset = object()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Emitter(schema)
        at: list = [unset, None]  # conversation and message being folded
        role, pieces, part = "", [], 0

        def close() -> None:
            nonlocal part
            text = "".join(pieces)
            rendered, start, end = segment(role, text)
            trained = role == trained_role
            out.add(at[0], part, role, rendered, start if trained else None, end if trained else None, weight=len(rendered))
            part += 1

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(7)]
            for conv, turn, rank, copy, row, who, text in zip(*columns):
                message = (turn, rank, copy, row)
                if [conv, message] != at or at[0] is unset:
                    if at[0] is not unset:
                        close()
                        if conv != at[0]:
                            part = 0
                    at, role, pieces = [conv, message], "", []
                role = who or role
                pieces.append(text or "")
                if out.full:
                    yield out.take()
        if at[0] is not unset:
            close()
        yield from out.rest()

    marks = {c: F.lit(0).alias(c) for c in ("rank", "copy", "row")}
    full = bound_batches(log).select("conv_id", "seq", "event", "turn", *[F.col(c) if c in log.columns else mark for c, mark in marks.items()], "role", "text")
    # The window has brought each conversation together; it is sorted where it is.
    ordered = surviving(full).sortWithinPartitions("conv_id", "turn", "rank", "copy", "row", "seq", "event", "text")
    text = F.when(F.col("event") == "regenerate", F.lit("")).otherwise(F.col("text")).alias("text")
    return ordered.select(F.col("conv_id").cast("long"), "turn", "rank", "copy", "row", "role", text).mapInArrow(kernel, SEGMENTS)


def parse_segment(rendered: str) -> tuple[str, str]:
    """Role and text of a rendered message."""
    role, _, rest = rendered[len(TURN) :].partition(TEXT)
    return unescape(role), unescape(rest[: -len(END)])


def read_back(segments: DataFrame, in_order: bool = False) -> DataFrame:
    """Parses rendered conversations: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    ``in_order``: the rows are as ``render`` gives them, so nothing has to move.
    """
    ddl = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    schema = arrow_schema(ddl)
    unset = object()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Emitter(schema)
        conv: object = unset
        turns = loss = None
        count = loss_chars = chars = 0
        for batch in batches:
            convs, rendered, starts, ends = (batch.column(i).to_pylist() for i in range(4))
            for key, text, start, end in zip(convs, rendered, starts, ends):
                if key != conv:
                    if conv is not unset:
                        out.add(conv, count, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)
                    conv, turns, loss, count, loss_chars, chars = key, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                role, body = parse_segment(text)
                turns.update(f"{role}\n{body}\n".encode())
                count += 1
                chars += len(text)
                if start is not None:
                    trained = unescape(text[start:end])
                    loss.update(trained.encode())
                    loss_chars += len(trained)
            if out.full:
                yield out.take()
        if conv is not unset:
            out.add(conv, count, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)
        yield from out.rest()

    ordered = segments if in_order else segments.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.select("conv_id", "segment", "loss_start", "loss_end").mapInArrow(kernel, ddl)


def turns_as_log(turns: DataFrame, delta_chars: int = 400, drafts: bool = True) -> DataFrame:
    """A log of plain turns: each text streams in as deltas of at most ``delta_chars``.

    With ``drafts``, two of three messages (by the hash of what they say) come in twice: a draft first, which is then edited
    to the first piece of the text, or is generated anew. Turns that share conversation and number are told apart, those
    that say the same by their place in the input.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(text) - 1), F.lit(delta_chars))
    rows = turns.select("conv_id", "turn", "role", text.alias("_text"), F.coalesce("role", F.lit("")).alias("rank"), F.xxhash64(text).alias("copy"), F.monotonically_increasing_id().alias("row"), starts.alias("_starts"))

    def event(step: Column, kind: str, said: Column) -> Column:
        return F.struct(step.cast("int").alias("step"), F.lit(kind).alias("event"), said.alias("text"))

    def piece(start: Column) -> Column:
        return F.substring(F.col("_text"), start + 1, F.lit(delta_chars))

    plain = F.transform("_starts", lambda x: event(x + 2, "delta", piece(x)))
    draft = event(F.lit(0), "delta", F.concat(F.lit("Draft: "), F.substring("_text", 1, 40)))
    edited = F.concat(F.array(draft, event(F.lit(1), "edit", piece(F.lit(0)))), F.slice(plain, F.lit(2), F.greatest(F.size("_starts") - 1, F.lit(0))))
    again = F.concat(F.array(draft, event(F.lit(1), "regenerate", F.lit(None).cast("string"))), plain)
    kind = F.pmod(F.xxhash64("copy", "conv_id", "turn"), F.lit(3))
    events = F.when(kind == 0, edited).when(kind == 1, again).otherwise(plain) if drafts else plain
    cut = rows.select("conv_id", "turn", "role", "rank", "copy", "row", F.explode(events).alias("e"))
    seq = F.struct("turn", "rank", "copy", "row", "e.step")
    return cut.select("conv_id", seq.alias("seq"), "e.event", "turn", "rank", "copy", "row", "role", "e.text")


def samples(spark) -> DataFrame:
    """Conversation -1, whose texts are made of another template's control strings."""
    hard = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
