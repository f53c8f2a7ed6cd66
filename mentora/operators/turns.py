"""Turns and observations: coalescing, label application, flattening."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mentora.functions.text import correct_to_str, fold_content, skills_to_str


def coalesce_turns(utterances: DataFrame) -> DataFrame:
    """(d, turn, teacher, student) of (d, pos, role, content).

    A new turn begins when the teacher speaks after the student; turn numbers start at 0 if the student opens, else
    at 1. A last turn without student text is dropped.
    """
    order = Window.partitionBy("d").orderBy("pos")
    flag = ((F.col("role") == "teacher") & (F.lag("role").over(order) == "student")).cast("int")
    base = F.when(F.first("role").over(order) == "student", 0).otherwise(1)
    numbered = utterances.withColumn("turn", base + F.sum(F.coalesce(flag, F.lit(0))).over(order))
    said = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("pos", "content")))), lambda x: x["content"])
    turns = numbered.groupBy("d", "turn").agg(fold_content(said("teacher")).alias("teacher"), fold_content(said("student")).alias("student"))
    last = F.max("turn").over(Window.partitionBy("d"))
    return turns.withColumn("last", last).where("turn < last or student != ''").drop("last")


def histories(turns: DataFrame, include_labels: bool = False, tag_wrapper: bool = True) -> DataFrame:
    """(d, turn, history) of coalesced turns: the whole text of all turns before and the turn's own teacher line.

    The turn's student line is withheld, as it gives the label away. ``include_labels`` adds the labels of the turns
    before and needs the columns correct and kcs.
    """
    line = lambda role: F.when(F.col(role.lower()) != "", F.concat(F.lit(f"{role} Turn "), F.col("turn").cast("string"), F.lit(": "), F.col(role.lower())))
    label = lambda start, end, value: F.concat(F.lit(start), F.col("turn").cast("string"), F.lit(end), value)
    labels = (label("Student Turn ", " Correct: ", correct_to_str(F.col("correct"))), label("Turn ", " Knowledge Components: ", skills_to_str(F.col("kcs"), " "))) if include_labels else ()
    before = Window.partitionBy("d").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    past = F.flatten(F.collect_list(F.array_compact(F.array(line("Teacher"), line("Student"), *labels))).over(before))
    text = F.array_join(F.concat(past, F.array_compact(F.array(line("Teacher")))), "\n")
    return turns.select("d", "turn", (F.concat(F.lit("[BEGIN DIALOGUE]\n"), text, F.lit("\n[END DIALOGUE]")) if tag_wrapper else text).alias("history"))


def apply_override(turns: DataFrame) -> DataFrame:
    """Adds ``correct``: on the last turn, if labelled, the dialogue's own outcome: solved, not solved, or revealed (null)."""
    outcome = F.when(F.col("status") == "F", True).when(F.col("status") == "O", False).when(F.col("status") == "P", None).otherwise(F.col("og"))
    return turns.withColumn("correct", F.when(F.col("is_last") & F.col("og").isNotNull(), outcome).otherwise(F.col("og")))


def tagged_turns(turns: DataFrame, at_least: int = 2) -> DataFrame:
    """Labelled turns with skills, of dialogues that have at least so many; ``n_tagged`` counts them."""
    tagged = apply_override(turns).where("correct is not null and size(kcs) > 0")
    return tagged.withColumn("n_tagged", F.count("*").over(Window.partitionBy("d"))).where(F.col("n_tagged") >= at_least)


def observations(turns: DataFrame) -> DataFrame:
    """(d, turn, pos, kc, correct, split): one row for each skill of each tagged turn."""
    rows = tagged_turns(turns).select("d", "turn", F.col("correct").cast("int").alias("correct"), F.posexplode("kcs").alias("pos", "kc"))
    return rows.withColumn("split", F.when(F.col("d") % 5 == 0, "test").otherwise("train"))


def skill_stats(obs: DataFrame) -> DataFrame:
    return obs.groupBy("kc").agg(F.count("correct").alias("n"), F.sum("correct").cast("long").alias("n_correct"))


def dialogue_texts(turns: DataFrame) -> DataFrame:
    """(d, text, last_turn) of coalesced turns: all of a dialogue's lines, in tags."""
    line = lambda role: F.when(F.col(role.lower()) != "", F.concat(F.lit(f"{role} Turn "), F.col("turn").cast("string"), F.lit(": "), F.col(role.lower())))
    lines = F.array_join(F.array_compact(F.array(line("Teacher"), line("Student"))), "\n")
    text = F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("turn", lines.alias("lines")))), lambda x: x["lines"] != ""), lambda x: x["lines"]), "\n")
    return turns.groupBy("d").agg(F.concat(F.lit("[BEGIN DIALOGUE]\n"), text, F.lit("\n[END DIALOGUE]")).alias("text"), F.max("turn").alias("last_turn"))


def first_of_last_turn(obs: DataFrame) -> DataFrame:
    """The first row of each dialogue's last turn: one skill, not the mean of the turn."""
    last = F.row_number().over(Window.partitionBy("d").orderBy(F.desc("turn"), "pos"))
    return obs.withColumn("_k", last).where("_k = 1").drop("_k")
