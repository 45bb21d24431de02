"""Chat formatting: every assistant turn becomes an example with all turns before it as context and only that reply trainable.

A turn is written as `### role: text</turn>` and a line feed. Inside roles and texts the characters that could start a control
string are written as two characters (`FORMS`), so no text can forge a marker and reading back restores it exactly.

Defined cases: a null or empty text or role is the empty string; rows of one conversation are ordered by turn (null first),
then role, then text; repeated rows are turns of their own; a null conv_id is one conversation; other columns are ignored.
Turns after the last reply, or a conversation without any, give one more row without a trainable part, so that nothing is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SEP, CLOSE = "### ", ": ", "</turn>\n"
FORMS = (("\\", "\\s"), ("<", "\\l"), ("#", "\\h"), (":", "\\c"))
TRAINED = "assistant"


def escape(text: Column) -> Column:
    for plain, form in FORMS:
        text = F.replace(text, F.lit(plain), F.lit(form))
    return text


def unescape(text: Column) -> Column:
    for plain, form in reversed(FORMS):
        text = F.replace(text, F.lit(form), F.lit(plain))
    return text


def expand(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> conv_id, example (1 up, in turn order), formatted, loss_start and loss_end
    (code points of the trainable reply in formatted, end exclusive; null on a row without one).

    Turns meet by a partially aggregated list of a conversation; the prefixes are cut from its one formatted text.
    """
    empty = F.lit("")
    turns = conversations.select(
        "conv_id", F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")).alias("t"))
    turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    parts = turns.select("conv_id", F.transform("turns", lambda t: F.struct(
        (t["role"] == TRAINED).alias("trained"), escape(t["text"]).alias("body"),
        F.concat(F.lit(OPEN), escape(t["role"]), F.lit(SEP)).alias("head"))).alias("parts"))
    whole = parts.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "").alias("whole"),
        F.transform("parts", lambda p: F.struct(p["trained"].alias("trained"), F.length(p["body"]).alias("body"),
                                                (F.length(p["head"]) + F.length(p["body"]) + len(CLOSE)).alias("all"))).alias("sizes"))
    ends = whole.withColumn("ends", F.aggregate(
        "sizes", F.array(F.lit(0)), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s["all"]))))
    cuts = F.transform("sizes", lambda s, i: F.struct(
        s["trained"].alias("trained"), F.get("ends", i + 1).alias("end"),
        (F.get("ends", i + 1) - len(CLOSE)).alias("loss_end"), s["body"].alias("body"), (i + 1 == F.size("sizes")).alias("last")))
    cuts = F.filter(cuts, lambda c: c["trained"] | c["last"])
    rows = ends.select("conv_id", "whole", F.posexplode(cuts).alias("n", "c"))
    when = lambda value: F.when(F.col("c.trained"), value)
    return rows.select("conv_id", (F.col("n") + 1).alias("example"), F.substring("whole", F.lit(1), F.col("c.end")).alias("formatted"),
                       when(F.col("c.loss_end") - F.col("c.body")).alias("loss_start"), when(F.col("c.loss_end")).alias("loss_end"))


def read_turns(formatted: Column) -> Column:
    """The turns a formatted text holds: array<struct<role, text>>."""
    pieces = F.split(formatted, CLOSE)
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    inner = lambda p: F.substring(p, len(OPEN) + 1, 2147483647)
    role = lambda p: F.substring_index(inner(p), SEP, 1)
    return F.transform(pieces, lambda p: F.struct(
        unescape(role(p)).alias("role"), unescape(F.substring(inner(p), F.length(role(p)) + len(SEP) + 1, F.lit(2147483647))).alias("text")))


def read_loss(formatted: Column, loss_start: Column, loss_end: Column) -> Column:
    """The text under the loss mask, null where nothing is trainable."""
    return unescape(F.substring(formatted, loss_start + 1, loss_end - loss_start))
