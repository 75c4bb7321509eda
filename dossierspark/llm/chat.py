"""Operator 2: chat formatting, with Spark expressions only.

Turns of a conversation are collected as structs, sorted by turn (ties by raw role, then raw text),
adjacent turns of one role are merged by array aggregation, and the blocks are concatenated:

    <|im_start|>role<|im_sep|>text<|im_next|>text of the next merged turn<|im_end|>

In roles and texts a backslash is doubled and ``<|`` becomes ``<\\|``, so no marker can occur inside
them and reading back is exact. The loss mask is a list of spans (code points, end exclusive) over the
formatted text: the texts of assistant turns. Null texts and roles count as empty; a null turn sorts
first; rows with a null conversation id are one conversation; repeated rows are turns of their own. Very
long texts stay whole, an empty table gives an empty one, and columns other than conv_id, turn, role and
text are left aside, whatever their names. A conversation is one output row, so all its turns meet in one
task; that is inherent in one formatted text a conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEP, NEXT, END = "<|im_start|>", "<|im_sep|>", "<|im_next|>", "<|im_end|>"


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans array<struct<start, end>>.

    The places of the texts are running sums over the conversation's rows, taken before they are
    collected, so the spans grow with the turns and not with their square.
    """
    rows = turns.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")])
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    size = lambda c: F.length(c).cast("long")
    block = F.lit(len(START) + len(SEP)) + size(escaped(F.col("role")))
    head = F.when(F.lag("role").over(w) == F.col("role"), F.lit(len(NEXT))).otherwise(block)
    tail = F.when(F.lead("role").over(w) == F.col("role"), F.lit(0)).otherwise(F.lit(len(END)))
    measured = rows.withColumn("head", head).withColumn("tail", tail).withColumn("size", size(escaped(F.col("text"))))
    through = F.sum(F.col("head") + F.col("size") + F.col("tail")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tail")
    placed = measured.withColumn("end", through).withColumn("start", F.col("end") - F.col("size"))
    collected = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "start", "end"))).alias("turns"))

    def piece(t: Column, i: Column) -> Column:
        """A turn's text with what opens, joins or closes its block."""
        same = lambda j: F.coalesce((j >= 0) & (F.get("turns", j)["role"] == t["role"]), F.lit(False))
        opens = F.when(same(i - 1), F.lit(NEXT)).otherwise(F.concat(F.lit(START), escaped(t["role"]), F.lit(SEP)))
        return F.concat(opens, escaped(t["text"]), F.when(same(i + 1), F.lit("")).otherwise(F.lit(END)))

    return collected.select(
        "conv_id",
        F.array_join(F.transform("turns", piece), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: F.struct(t["start"], t["end"])).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role, text>> and loss_texts array<string>, from the output alone."""
    blocks = F.filter(F.split("formatted", r"<\|im_end\|>"), lambda b: b != "")

    def turns(block: Column) -> Column:
        parts = F.split(F.substring(block, len(START) + 1, 1 << 30), r"<\|im_sep\|>")
        role = unescaped(F.get(parts, F.lit(0)))
        return F.transform(F.split(F.get(parts, F.lit(1)), r"<\|im_next\|>"), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    loss = F.transform(
        "loss_spans",
        lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))),
    )
    return formatted.select("conv_id", F.flatten(F.transform(blocks, turns)).alias("turns"), loss.alias("loss_texts"), "formatted")


def formatted_digest(turns: DataFrame) -> DataFrame:
    back = read_back(format_conversations(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        digest(said).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        digest(loss).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
