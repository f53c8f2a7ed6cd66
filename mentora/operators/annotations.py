"""Annotations of dialogues: merging two replies, usable ones, and their application to turns; the standards tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentora.functions.text import correct_from_str

# Errors in the order in which they are tested, and outcomes of a dialogue.
ERRORS = ("JSON parsing error", "Different number of standard and correctness output turns", "Different number of annotations and source turns")
OUTCOMES = {"Yes": True, "Yes, but I had to reveal the answer": None, "No": False}
ACCEPTED = "Answer Accepted"
LABEL = "struct<correct:boolean,kcs:array<string>>"


def merge_replies(replies: DataFrame) -> DataFrame:
    """Adds ``error`` and ``annotation`` to (turns, kcs, correctness): numbers of the source's turns in order, skills and
    labels by "turn N" (null where the reply could not be parsed). The first error that holds counts; without one,
    ``annotation`` maps each turn to (correct, kcs)."""
    turns, kcs, marks = F.col("turns"), F.col("kcs"), F.col("correctness")
    opening = F.when(F.get(turns, F.lit(0)) == 0, 1).otherwise(0)
    error = F.when(kcs.isNull() | marks.isNull(), ERRORS[0]).when(F.size(kcs) != F.size(marks), ERRORS[1]).when(F.size(turns) != F.size(marks) + opening, ERRORS[2])
    keys = F.when(F.size(marks) > 0, F.transform(F.sequence(F.lit(1), F.size(marks)), lambda i: F.concat(F.lit("turn "), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    entry = lambda k: F.struct(correct_from_str(F.element_at(marks, k)).alias("correct"), F.element_at(kcs, k).alias("kcs"))
    merged = F.map_from_arrays(keys, F.transform(keys, entry))
    return replies.withColumn("error", error).withColumn("annotation", F.when(F.col("error").isNull(), merged))


def usable(annotation: Column) -> Column:
    """Whether a JSON annotation has an entry with both keys ``correct`` and ``kcs``, whatever their values."""
    entries = F.map_values(F.from_json(annotation, "map<string,string>"))
    keys = lambda e: F.coalesce(F.json_object_keys(e), F.array().cast("array<string>"))
    return F.coalesce(F.exists(entries, lambda e: F.when(e.startswith("{"), F.array_contains(keys(e), "correct") & F.array_contains(keys(e), "kcs")).otherwise(False)), F.lit(False))


def label_turns(dialogues: DataFrame, outcome: str = "self_correctness", apply_na: bool = True, strict: bool = True) -> DataFrame:
    """(d, turn, og, correct, kcs, is_last) of dialogues (d, turns, annotation, error and the column ``outcome``).

    Failed dialogues are left out. Turn 0 has no label and no skill. With ``apply_na`` a turn without skills has no label
    and one without label no skills. A last turn with skills takes the dialogue's outcome: ``expected_result`` always,
    ``self_correctness`` where the turn has a label; outcomes other than the three known ones change nothing. A turn that
    the annotation lacks raises if ``strict``, else has no label.
    """
    rows = dialogues.where("error is null").select("d", "annotation", F.col(outcome).alias("outcome"), F.size("turns").alias("n"), F.posexplode("turns").alias("pos", "turn"))
    key = F.concat(F.lit("turn "), F.col("turn").cast("string"))
    have = F.map_contains_key("annotation", key)
    missing = F.raise_error(F.concat(F.lit("no annotation of "), key)).cast(LABEL) if strict else F.lit(None).cast(LABEL)
    rows = rows.withColumn("x", F.when(F.col("turn") == 0, F.lit(None).cast(LABEL)).when(have, F.element_at("annotation", key)).otherwise(missing))
    kcs, og = F.coalesce("x.kcs", F.array().cast("array<string>")), F.col("x.correct")
    if apply_na:
        og = F.when(F.size(kcs) > 0, og)
        kcs = F.when(og.isNotNull(), kcs).otherwise(F.array().cast("array<string>"))
    rows = rows.select("d", "turn", og.alias("og"), kcs.alias("kcs"), (F.col("pos") == F.col("n") - 1).alias("is_last"), "outcome")
    if outcome == "expected_result":
        final, when = F.coalesce(F.col("outcome") == ACCEPTED, F.lit(False)), F.lit(True)
    else:
        final, when = F.col("og"), F.col("og").isNotNull()
        for name, value in OUTCOMES.items():
            final = F.when(F.col("outcome") == name, F.lit(value).cast("boolean")).otherwise(final)
    return rows.withColumn("correct", F.when(F.col("is_last") & (F.size("kcs") > 0) & when, final).otherwise(F.col("og"))).drop("outcome")


def described_standards(tags: DataFrame, standards: DataFrame) -> DataFrame:
    """(d, turn, kcs): the ids of ``tags`` (d, turn, ids) replaced, in order, by the descriptions of ``standards`` (id, description)."""
    rows = tags.select("d", "turn", F.posexplode("ids").alias("pos", "id")).join(standards, "id")
    return rows.groupBy("d", "turn").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "description"))), lambda x: x["description"]).alias("kcs"))


def clusters_of(chosen: DataFrame, standards: DataFrame) -> DataFrame:
    """(d, id) of the Domain standards (id, level, parent) that belong to the categories of ``chosen`` (d, category): whose id
    ends with a full stop and the category, or whose parent it is. Both are equi-joins, on the id's last part and on the parent."""
    domains = standards.where("level = 'Domain'")
    ends = domains.select("id", F.explode(F.array_distinct(F.array(F.substring_index("id", ".", -1), F.col("parent")))).alias("category"), F.contains("id", F.lit(".")).alias("dotted"), "parent")
    return chosen.join(ends, "category").where("dotted or parent = category").select("d", "id").distinct()


def parent_sets(parents: DataFrame) -> DataFrame:
    """(d, ids): the sorted set of ``parents`` (d, id) of each ``d``."""
    return parents.groupBy("d").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def option_lists(sets: DataFrame, standards: DataFrame) -> DataFrame:
    """(ids, options): sorted lines of all children of the standards in ``ids``, for each set of ``sets`` (d, ids) that has any."""
    line = F.concat(F.lit("ID: "), F.col("id"), F.lit(", Description: "), F.col("description"))
    children = standards.groupBy(F.col("parent").alias("id")).agg(F.collect_list(line).alias("lines"))
    rows = sets.select("ids").distinct().select("ids", F.explode("ids").alias("id")).join(children, "id")
    return rows.groupBy("ids").agg(F.sort_array(F.flatten(F.collect_list("lines"))).alias("options"))


def options_of(parents: DataFrame, standards: DataFrame) -> DataFrame:
    """(d, options): sorted lines of all children of the standards ``parents`` (d, id), each parent once.

    Lists are made once for each set of parents, not for each ``d``, which gets that of its set."""
    sets = parent_sets(parents)
    return sets.join(option_lists(sets, standards), "ids").drop("ids")
