"""Chat formatting with typed content parts (operator 6).

A turn's content is a list of parts ``struct<type, text, ref, tokens>``.  A visitor, one expression for each type, flattens them
in order: text parts are escaped text; image, audio and document parts become placeholders
``<|image|>``, ``<|audio|>``, ``<|document|>``, and their references and expanded token counts are recorded in the
order of the placeholders.  A formatted turn is ``<|im_start|>role``, a line break, the body, ``<|im_end|>`` and a line break.

Control strings inside texts and roles are escaped reversibly: between ``<`` and ``|`` one backslash is added to however many
stand there, so no text can hold a control string; ``%`` and a line break in a role become ``%25`` and ``%0A``.
Reading undoes both.

The output is a table of formatted turns in order: (conv_id, turn_no, formatted, loss_start, loss_end, attachments,
attachment_tokens); the loss mask is a stretch of code points of the whole conversation and covers the body of every
assistant turn, without its end mark.  A conversation is streamed turn by turn, in writing and in reading: its length
is not limited by memory, however many rows one conversation has.

Cases: null text is empty; null role is empty; rows of a conversation that repeat a turn number are ordered by role and text;
rows with a null turn come first in their conversation;
null conv_id is a conversation of its own; very long texts are one turn each; unknown part types are an error; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.llm.common import shared_path

START, END = "<|im_start|>", "<|im_end|>"
PART = "struct<type:string,text:string,ref:string,tokens:bigint>"
ATTACHMENTS = ("image", "audio", "document")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
_ESCAPED = re.compile(r"<(\\*)\\\|")
FORMATTED = ("conv_id long, turn_no long, formatted string, loss_start long, loss_end long, "
             "attachments array<string>, attachment_tokens array<bigint>")


def escape(text: Column) -> Column:
    """``<`` and ``|`` with n backslashes between them get n + 1."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: Column) -> Column:
    """A role stays on its line."""
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: str) -> str:
    return unescape(role.replace("%0A", "\n").replace("%25", "%"))


def text_part(text: Column) -> Column:
    """Content of a plain text."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"),
                            F.lit(None).cast("bigint").alias("tokens")))


def visit(part: Column) -> Column:
    """What a part leaves in the body."""
    shown = F.when(part["type"] == "text", escape(F.coalesce(part["text"], F.lit(""))))
    for kind in ATTACHMENTS:
        shown = shown.when(part["type"] == kind, F.lit(f"<|{kind}|>"))
    return shown.otherwise(F.raise_error(F.concat(F.lit("unknown part type "), F.coalesce(part["type"], F.lit("null")))))


def flatten_parts(parts: Column) -> tuple[Column, Column, Column]:
    """(body, references, token counts) of a list of parts."""
    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    attached = F.filter(parts, lambda p: p["type"].isin(*ATTACHMENTS))
    return (F.array_join(F.transform(parts, visit), ""), F.transform(attached, lambda p: F.coalesce(p["ref"], F.lit(""))),
            F.transform(attached, lambda p: F.coalesce(p["tokens"], F.lit(0).cast("bigint"))))


def format_chat(turns: DataFrame, content: Column, trained_role: str = "assistant") -> DataFrame:
    """Formatted turns of ``turns (conv_id, turn, role)`` with the list of parts ``content``."""
    body, refs, counts = flatten_parts(content)
    role = F.coalesce(F.col("role"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        role.alias("role"), body.alias("body"), refs.alias("refs"), counts.alias("counts"))
    rows = rows.withColumn("head", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")))
    rows = rows.select(
        "conv_id", "turn", "role", "body", "refs", "counts",
        F.concat("head", "body", F.lit(END + "\n")).alias("formatted"), F.length("head").alias("head_chars"),
        F.length("body").alias("body_chars"), (F.col("role") == trained_role).alias("trained"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "body") \
        .select("conv_id", "formatted", "head_chars", "body_chars", "trained", "refs", "counts")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, number, at, begun = None, 0, 0, False
        for batch in batches:
            ids = batch.column(0).to_pylist()
            heads, bodies, trained = (batch.column(i).to_pylist() for i in (2, 3, 4))
            numbers, starts, ends = [], [], []
            for now, head, body, learn in zip(ids, heads, bodies, trained, strict=True):
                if not begun or now != conv:
                    conv, number, at, begun = now, 0, 0, True
                numbers.append(number)
                starts.append(at + head if learn else None)
                ends.append(at + head + body if learn else None)
                number += 1
                at += head + body + len(END) + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(numbers, pa.int64()), batch.column(1), pa.array(starts, pa.int64()),
                 pa.array(ends, pa.int64()), batch.column(5), batch.column(6)],
                names=["conv_id", "turn_no", "formatted", "loss_start", "loss_end", "attachments", "attachment_tokens"])

    return rows.mapInArrow(place, FORMATTED)


def read_chat(spark: SparkSession, path: str) -> DataFrame:
    """Digest of every conversation, parsed from the formatted output alone.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)
    """
    rows = spark.read.parquet(path).select("conv_id", "turn_no", "formatted", "loss_start", "loss_end")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, begun = None, False
        n = chars = learned = 0
        turns, loss = hashlib.sha256(), hashlib.sha256()

        def told() -> list:
            return [conv, n, turns.hexdigest(), learned, loss.hexdigest(), chars]

        for batch in batches:
            done = []
            for now, _, text, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or now != conv:
                    if begun:
                        done.append(told())
                    conv, begun = now, True
                    n = chars = learned = 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                parsed = _TURN.fullmatch(text)
                if parsed is None:
                    raise ValueError("not a formatted turn")
                role, body = unescape_role(parsed[1]), unescape(parsed[2])
                turns.update(f"{role}\n{body}\n".encode())
                if start is not None:
                    masked = unescape(text[start - chars:end - chars])
                    loss.update(masked.encode())
                    learned += len(masked)
                n, chars = n + 1, chars + len(text)
            yield _digests(done)
        if begun:
            yield _digests([told()])

    return rows.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                 "loss_sha256 string, formatted_chars long")


def _digests(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    columns = zip(*rows, strict=True) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
        names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def chat_round_trip(conversations: DataFrame, path: str | None = None) -> DataFrame:
    """Format text conversations, write them, and read the digests back (operator 6)."""
    spark = conversations.sparkSession
    path = path or shared_path(spark, "chat")
    format_chat(conversations, text_part(F.col("text"))).write.parquet(path)
    return read_chat(spark, path)
