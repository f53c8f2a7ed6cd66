"""Training examples of a chat model: one for each assistant message, its context masked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mentora.functions.prompts import masked_labels


def code_points(text: Column) -> Column:
    """A text as the numbers of its characters, the plainest tokens."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii)


def eligible(messages: DataFrame) -> DataFrame:
    """``messages`` (d, pos, role, content) of dialogues with two messages or more, one of an assistant after the first."""
    everything = Window.partitionBy("d")
    first = F.min("pos").over(everything)
    marked = messages.withColumns({"_n": F.count("*").over(everything), "_said": F.max(((F.col("role") == "assistant") & (F.col("pos") > first)).cast("int")).over(everything)})
    return marked.where("_n >= 2 and _said = 1").drop("_n", "_said")


def training_examples(messages: DataFrame, size: int = 1024, tokens: Callable[[Column], Column] = code_points) -> DataFrame:
    """(d, pos, ids, labels): every assistant message after the first of an eligible dialogue, behind all messages before it.

    ``ids`` are tokens of the context, rendered with a line for each message, and of the message; examples of ``size``
    tokens or more are left out. ``labels`` are the ids with the context masked, padded with the mask to ``size``.
    """
    line = F.concat("role", F.lit(": "), F.coalesce("content", F.lit("")), F.lit("\n"))
    before = Window.partitionBy("d").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = eligible(messages).withColumn("_context", F.array_join(F.collect_list(line).over(before), "")).withColumn("_k", F.row_number().over(Window.partitionBy("d").orderBy("pos")))
    rows = rows.where("role = 'assistant' and _k > 1").select("d", "pos", tokens(F.concat("_context", F.lit("assistant: "))).alias("prompt"), tokens(F.coalesce("content", F.lit(""))).alias("answer"))
    rows = rows.where(F.size("prompt") + F.size("answer") < size).select("d", "pos", F.concat("prompt", "answer").alias("ids"), F.size("prompt").alias("n"))
    return rows.select("d", "pos", "ids", masked_labels(F.col("ids"), F.col("n"), F.lit(size)).alias("labels"))
