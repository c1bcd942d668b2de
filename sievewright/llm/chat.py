"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as
context, and only its text under the loss mask. Turns that no assistant turn
follows are kept in a last example without a target, so that reading the
examples back gives every turn.

A turn is written <|im_start|>role\\ntext<|im_end|>\\n. Inside texts and roles a
backslash is put before the bar of every "<" + backslashes + "|", which undoes
exactly; in roles line ends become a backslash and n, a backslash two.

Null text and null role count as empty. Turns are ordered by turn, then role,
then text; null turn numbers come first. Rows with a null conv_id are one
conversation. Repeated rows stay turns of their own. An empty table gives no
examples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    # one pass from left to right: a doubled backslash is one, a backslash before n is a line end
    marks = F.regexp_extract_all(unescape(role), F.lit(r"\\[\\n]|[^\\]+|\\"), F.lit(0))
    return F.array_join(F.transform(marks, lambda m: F.when(m == "\\\\", "\\").when(m == "\\n", "\n").otherwise(m)), "")


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id and its turns, in order, with escaped texts."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def examples(rows: DataFrame) -> DataFrame:
    """conv_id, example (from 0), text, and the loss mask loss_begin <= code point < loss_end (null: none)."""
    written = F.transform("turns", lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END)))
    lengths = F.transform("turns", lambda t: F.length(escape(t["text"])))
    numbers = F.sequence(F.lit(1), F.size("turns"))
    targets = F.filter(numbers, lambda i: F.element_at("turns", i)["role"] == "assistant")
    # a target of -n is context alone, up to turn n
    rest = F.when(F.coalesce(F.try_element_at("targets", F.lit(-1)), F.lit(0)) < F.size("turns"), F.array(-F.size("turns"))).otherwise(F.array().cast("array<int>"))
    laid = conversations(rows).select("conv_id", "turns", written.alias("written"), lengths.alias("lengths"), targets.alias("targets"))
    each = laid.select("conv_id", "written", "lengths", F.posexplode(F.concat("targets", rest)).alias("example", "target"))
    text = F.array_join(F.slice("written", F.lit(1), F.abs("target")), "")
    end = F.when(F.col("target") > 0, F.length("text") - len(END))
    return each.withColumn("text", text).select("conv_id", "example", "text", (end - F.element_at("lengths", F.abs("target"))).alias("loss_begin"), end.alias("loss_end"))


def read_turns(text: Column) -> Column:
    """array<struct<role, text>> of an example."""
    return F.transform(
        F.filter(F.split(text, r"<\|im_end\|>\n"), lambda t: t != ""),
        lambda t: F.struct(
            unescape_role(F.substring_index(F.substring(t, len(START) + 1, 1 << 30), "\n", 1)).alias("role"),
            unescape(F.substring(t, F.instr(t, "\n") + 1, F.lit(1 << 30))).alias("text"),
        ),
    )


def digests(rows: DataFrame) -> DataFrame:
    """What the contract asks of a conversation, read back from its examples."""
    reply = F.when(F.col("loss_end").isNotNull(), unescape(F.substring("text", F.col("loss_begin") + 1, F.col("loss_end") - F.col("loss_begin"))))
    read = examples(rows).select("conv_id", "example", reply.alias("reply"), F.length("text").cast("long").alias("chars"), "text")
    whole = read.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("text"),  # the last example holds every turn
        F.array_sort(F.collect_list(F.when(F.col("reply").isNotNull(), F.struct("example", "reply")))).alias("replies"),
        F.sum("chars").alias("formatted_chars"),
    )
    turns, loss = read_turns(F.col("text")), F.array_join(F.transform("replies", lambda r: r["reply"]), "")
    told = whole.select("conv_id", turns.alias("turns"), loss.alias("loss"), "formatted_chars")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return told.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
