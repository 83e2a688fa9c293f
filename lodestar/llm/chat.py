"""Chat formatting with DataFrame expressions only, and reading the format back.

A conversation is one string. A block of adjacent turns of one role is ``<turn role>``, a line feed, the texts with
``<part/>`` between them, and ``</turn>`` with a line feed. Control strings inside texts are escaped: each run of
backslashes between ``<`` and one of ``turn``, ``/turn`` or ``part`` gets one more, also where the run is empty. Unescaping takes
one away, so any text comes back as it was. In roles, backslash, ``>`` and line feed are written as ``\\\\``, ``\\g``, ``\\n``.
The loss mask is the list of places of assistant texts in the string, in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.expressions import prefix_sums

END, PART = "</turn>\n", "<part/>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"<(\\*)(/?turn|part)"), F.lit(r"<\\$1$2"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"<\\(\\*)(/?turn|part)"), F.lit("<$1$2"))


def _role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit(">"), F.lit("\\g")), F.lit("\n"), F.lit("\\n"))


def _role_back(role: Column) -> Column:
    """The inverse: halves are split at double backslashes first, so that no other pair is read across them."""
    halves = F.split(role, r"\\\\", -1)
    return F.array_join(F.transform(halves, lambda x: F.replace(F.replace(x, F.lit("\\g"), F.lit(">")), F.lit("\\n"), F.lit("\n"))), "\\")


def formatted(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """``(conv_id, formatted, loss)``: one row for each conversation; loss is ``array<struct<start,end>>``.

    Turns are sorted by turn, then role and text; a null turn comes first, and null roles and texts count as empty.
    Nothing says that rows with a null conv_id belong together, so each of them is a conversation of its own; they are
    not gathered, however many they are. Repeated rows are turns of their own. Other columns play no part. An empty
    table gives no rows.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    known, loose = turns.where("conv_id is not null"), turns.where("conv_id is null")
    sorted_turns = known.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("t")).unionByName(loose.select("conv_id", F.array(row).alias("t")))
    role_at = lambda i: F.get(F.col("t"), i)["role"]

    def pieces(x: Column, i: Column) -> Column:
        """What stands before the text, the text, and what stands after it."""
        first = (i == 0) | (role_at(i - 1) != x["role"])
        last = (i == F.size("t") - 1) | (role_at(i + 1) != x["role"])
        before = F.when(first, F.concat(F.lit("<turn "), _role(x["role"]), F.lit(">\n"))).otherwise(F.lit(PART))
        return F.struct(before.alias("before"), escaped(x["text"]).alias("text"), F.when(last, F.lit(END)).otherwise(F.lit("")).alias("after"), (x["role"] == trained).alias("loss"))

    made = sorted_turns.select("conv_id", F.transform("t", pieces).alias("p"))
    length = lambda c: F.length(c).cast("long")
    sized = made.withColumn("at", prefix_sums(F.transform("p", lambda x: length(x["before"]) + length(x["text"]) + length(x["after"]))))
    whole = F.array_join(F.transform("p", lambda x: F.concat(x["before"], x["text"], x["after"])), "")
    spans = F.transform(
        F.filter(F.arrays_zip(F.col("p").alias("p"), F.col("at").alias("at")), lambda x: x["p"]["loss"]),
        lambda x: F.struct((x["at"] + length(x["p"]["before"])).alias("start"), (x["at"] + length(x["p"]["before"]) + length(x["p"]["text"])).alias("end")),
    )
    return sized.select("conv_id", whole.alias("formatted"), spans.alias("loss"))


def parsed(whole: Column) -> Column:
    """``array<struct<role,text>>`` of the turns in a formatted string."""
    blocks = F.filter(F.split(whole, END, -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = _role_back(F.regexp_extract(block, r"^<turn ([^>\n]*)>\n", 1))
        body = F.regexp_replace(block, F.lit(r"^<turn [^>\n]*>\n"), F.lit(""))
        return F.transform(F.split(body, PART, -1), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def under_mask(whole: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substring(whole, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
