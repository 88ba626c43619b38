"""Chat formatting as Spark expressions only.

Turn structs are collected per conversation and sorted, adjacent turns of one role are
merged by array functions (slices between the places where the role changes), and the blocks are
concatenated:

    <s>[INST]role[/INST]text[TURN]text</s><s>[INST]role...

The control strings all begin with ``<`` or ``[``. Inside roles and texts ``\\``, ``<`` and
``[`` are written ``\\\\``, ``\\l`` and ``\\b``, so no text can hold a control string, and the
texts can be read back exactly. ``loss`` holds one span (start, length in code points, start
from 1) for each assistant text; marks and separators lie outside. Starts are a running sum of
lengths over the turns. Formatting and reading back take time linear in a conversation's length.

Defined cases: a null text or role is empty; rows are ordered by turn (null first), then
role, then text; repeated rows are turns of their own; rows with a null conv_id make one
conversation; a conversation is one output string, so one conversation is held by one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.llm.common import columns_of

OPEN, HEAD, HEAD_END, NEXT, CLOSE = "<s>", "[INST]", "[/INST]", "[TURN]", "</s>"
LOSS_ROLE = "assistant"
#: Code points of the pieces that the loss mask is read from.
PIECE = 512


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("<"), F.lit("\\l"))
    return F.replace(text, F.lit("["), F.lit("\\b"))


def unescape(text: Column) -> Column:
    """The escapes are pairs, so cutting at each doubled backslash from the left is exact."""
    parts = F.split(text, r"\\\\", -1)
    plain = F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")),
                                                   F.lit("\\b"), F.lit("[")))
    return F.array_join(plain, "\\")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once for all places (and elements) that use it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted (string), loss (spans of the assistant texts in it)."""
    rows = columns_of(turns, "conv_id", "turn", "role", "text").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # one order for places, offsets and the collected structs; the grouping needs no further shuffle
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = rows.withColumn("place", F.row_number().over(order)).withColumn("before", F.lag("role").over(order)) \
        .withColumn("fresh", F.coalesce(F.col("role") != F.col("before"), F.lit(True))) \
        .withColumn("role", escape(F.col("role"))).withColumn("text", escape(F.col("text")))
    marks = F.when(~F.col("fresh"), len(NEXT)).otherwise(
        F.length("role") + len(OPEN + HEAD + HEAD_END) + F.when(F.col("before").isNull(), 0).otherwise(len(CLOSE)))
    until = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    length = F.length("text")
    placed = placed.withColumn("start", (F.sum((marks + length).cast("long")).over(until) - length + 1).cast("int"))
    grouped = placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "fresh", "role", "text", "start"))).alias("turns"))

    def block(turns: Column, begins: Column, at: Column, number: Column) -> Column:
        end = F.coalesce(F.get(begins, number + 1), F.size(turns))
        return F.struct(F.get(turns, at)["role"].alias("role"),
                        F.transform(F.slice(turns, at + 1, end - at), lambda t: t["text"]).alias("texts"))
    blocks = _let(F.col("turns"), lambda turns: _let(
        F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: F.get(turns, i)["fresh"]),
        lambda begins: F.transform(begins, lambda at, number: block(turns, begins, at, number))))
    line = F.transform(blocks, lambda b: F.concat(
        F.lit(OPEN + HEAD), b["role"], F.lit(HEAD_END), F.array_join(b["texts"], NEXT), F.lit(CLOSE)))
    loss = F.transform(F.filter("turns", lambda t: t["role"] == LOSS_ROLE), lambda t: F.struct(
        t["start"].alias("start"), F.length(t["text"]).alias("length")))
    return grouped.select("conv_id", F.array_join(line, "").alias("formatted"), loss.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted string, in order."""
    def turns(block: Column) -> Column:
        return _let(F.split(block, r"\[/INST\]", -1), lambda halves: _let(
            unescape(F.replace(F.get(halves, F.lit(0)), F.lit(OPEN + HEAD), F.lit(""))),
            lambda role: F.transform(F.split(F.get(halves, F.lit(1)), r"\[TURN\]", -1),
                                     lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))))
    blocks = _let(F.split(formatted, CLOSE, -1), lambda b: F.slice(b, F.lit(1), F.size(b) - 1))
    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, loss: Column) -> Column:
    """What the loss mask covers, unescaped, in order. The string is cut once into pieces of ``PIECE``
    code points, so that a span is read from its own pieces and not from the string's start."""
    def under(pieces: Column, span: Column) -> Column:
        at = span["start"] - 1
        first = F.floor(at / PIECE).cast("int")
        last = F.floor((at + span["length"]) / PIECE).cast("int")
        near = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
        return unescape(F.substring(near, at - first * PIECE + 1, span["length"]))
    pieces = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return _let(pieces, lambda p: F.array_join(F.transform(loss, lambda s: under(p, s)), ""))


def digest(chats: DataFrame) -> DataFrame:
    """Counts and digests read back from the formatted strings."""
    read = chats.withColumn("turns", read_turns(F.col("formatted"))) \
        .withColumn("under", loss_text(F.col("formatted"), F.col("loss")))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("under").cast("long").alias("loss_chars"),
        F.sha2(F.col("under"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
