"""Annotation of dialogues by a language model: skills freely or down a tree of standards, and correctness.

Each level is a table of prompts and one pass of calls. A level whose reply can't be read makes its result null, and the
dialogue takes no part in the levels below.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentora.functions import prompts as P
from mentora.functions.text import lm_json
from mentora.operators import annotations as N
from mentora.operators import ranks
from mentora.operators.calls import Prompts
from mentora.sources.files import annotated_file, dictionary_file, stored, write_csv, write_ids

#: Gets rows (d, prompt) and the name of a step, and gives them back with a response. One that has a method ``late``, as
#: ``calls.CachedAsk``, gets rows (d, ...), what adds the prompt to them, and the name instead.
Ask = Callable[[DataFrame, str], DataFrame]
NAMES, BY_TURN, MARKS = "array<string>", "map<string,array<string>>", "map<string,string>"
#: Dialogues of one list of options are dealt to so many keys for each shuffle partition, if all have the same list.
SPREAD = 16


def _level(rows: DataFrame, prompts: Prompts, ask: Ask, step: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(d, ``step``_prompt, ``step``_raw, ``step``): prompt, reply and its value, null if it isn't of the ``kind``; and the same
    without prompts, for the levels below.

    Replies are written, prompts are not: with their lists of options they are long, and are made anew where they are read."""
    asked = ask.late(rows, prompts, step) if hasattr(ask, "late") else ask(prompts(rows).select("d", "prompt"), step)
    value = F.from_json(lm_json(F.col("response")), kind)
    replies = stored(asked.select("d", F.col("response").alias(f"{step}_raw"), value.alias(step)), f"level-{step}")
    return prompts(rows.join(replies, "d")).select("d", F.col("prompt").alias(f"{step}_prompt"), f"{step}_raw", step), replies


def _own_prompt(prompt: Column) -> Prompts:
    """Prompts of a row's own columns."""
    return lambda rows: rows.withColumn("prompt", prompt)


def _offered(dialogues: DataFrame, parents: DataFrame, standards: DataFrame) -> tuple[DataFrame, Prompts]:
    """``dialogues`` that have children of their ``parents`` (d, id) to choose from, and what adds these as ``options``, an
    array of one text that has all lines.

    A list is written once for each set of parents and meets a dialogue in the task that makes its prompt, so no shuffle has
    lists by dialogue. Sets of many dialogues are dealt to several tasks, each with a copy of the list.
    """
    sets = stored(N.parent_sets(parents), "option-sets")
    slots = int(dialogues.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(1, sets.count()) / (SPREAD * slots)
    copies = sets.groupBy("ids").agg(F.ceil(F.count("*") / F.lit(share)).cast("int").alias("copies"))
    lists = N.option_lists(sets, standards).join(copies, "ids")
    lists = stored(lists.select("ids", "copies", F.array(F.array_join("options", P.BULLET)).alias("options")), "option-lists")
    placed = stored(sets.join(lists.select("ids", "copies"), "ids").select("d", "ids", F.pmod(F.xxhash64("d"), "copies").cast("int").alias("copy")), "placed-sets")
    lists = lists.select("ids", "options", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    return dialogues.join(placed, "d"), lambda rows: rows.repartition(slots, "ids", "copy").join(lists.hint("merge"), ["ids", "copy"])


def tag_freely(dialogues: DataFrame, ask: Ask) -> DataFrame:
    """Skills and correctness of every turn in the model's own words; columns as of ``annotate``."""
    prompt = P.annotation_prompt(F.col("text"), F.col("last_turn"), F.col("context")) if "context" in dialogues.columns else P.annotation_prompt(F.col("text"), F.col("last_turn"))
    kcs, marks = (_level(dialogues, _own_prompt(prompt), ask, step, kind)[0] for step, kind in (("kcs", BY_TURN), ("correctness", MARKS)))
    return dialogues.join(kcs, "d", "left").join(marks, "d", "left")


def tag_by_standards(dialogues: DataFrame, groups: DataFrame, standards: DataFrame, ask: Ask) -> DataFrame:
    """Domains, clusters and standards from the lists of the tree, one level after the other, then correctness.

    ``groups`` (place, name, description, categories) are the domains to choose from, ``standards`` (id, description, level,
    parent) the tree. Chosen names and ids that the tree lacks lead to no options; a dialogue without options has no
    prompt at that level and null from there on. The standards' descriptions become the skills; unknown ids drop out.
    """
    context = F.col("context") if "context" in dialogues.columns else None
    told = dialogues.select("d", "text", "last_turn", *(["context"] if context is not None else []))
    line = F.concat(F.lit("Name: "), F.col("name"), F.lit(", Description: "), F.col("description"))
    # One row.
    names = groups.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]).alias("options"))

    def level(rows: DataFrame, offer: Prompts, step: str, kind: str) -> tuple[DataFrame, DataFrame]:
        prompt = _own_prompt(P.level_prompt(F.col("text"), step, F.col("options"), F.col("last_turn"), context))
        return _level(rows, lambda some: prompt(offer(some)), ask, step, kind)

    domains, picked = level(told, lambda rows: rows.crossJoin(F.broadcast(names)), "domain", NAMES)
    chosen = picked.select("d", F.explode("domain").alias("name")).join(groups.select("name", F.explode("categories").alias("category")), "name")
    parents = N.clusters_of(chosen.select("d", "category").distinct(), standards)
    clusters, picked = level(*_offered(told, parents, standards), "cluster", NAMES)
    ids = picked.select("d", F.explode("cluster").alias("id"))
    found, picked = level(*_offered(told, ids, standards), "standard", BY_TURN)
    tags = picked.select("d", F.explode("standard").alias("turn", "ids"))
    described = N.described_standards(tags, standards)
    turns = tags.select("d", "turn").join(described, ["d", "turn"], "left").groupBy("d").agg(F.map_from_entries(F.collect_list(F.struct("turn", F.coalesce("kcs", F.array().cast(NAMES))))).alias("kcs"))
    empty = F.map_from_arrays(F.array().cast(NAMES), F.array().cast("array<array<string>>"))
    found = found.join(turns, "d", "left").withColumn("kcs", F.when(F.col("standard").isNotNull(), F.coalesce("kcs", empty)))
    marks = _level(told, _own_prompt(P.annotation_prompt(F.col("text"), F.col("last_turn"), context)), ask, "correctness", MARKS)[0]
    out = dialogues
    for rows in (domains, clusters, found, marks):
        out = out.join(rows, "d", "left")
    return out


def annotate(dialogues: DataFrame, source: str, ask: Ask, groups: DataFrame | None = None, standards: DataFrame | None = None) -> DataFrame:
    """``dialogues`` (d, turns, text, last_turn, optionally context) with prompts, replies and values of every step, ``error``
    and ``annotation`` as of ``merge_replies``. ``source``: base, or atc with a tree; any other raises ValueError."""
    if source == "base":
        rows = tag_freely(dialogues, ask)
    elif source == "atc":
        rows = tag_by_standards(dialogues, groups, standards, ask)
    else:
        raise ValueError(f"unknown source of tags {source}")
    return N.merge_replies(rows)


def skill_dictionary(annotated: DataFrame) -> DataFrame:
    """(name, id) of all skills of annotations without error, numbered from 0 in order of first appearance by d and turn."""
    entries = annotated.where("error is null").select("d", F.explode("annotation").alias("key", "x"))
    rows = entries.select("d", F.regexp_extract("key", "([0-9]+)", 1).cast("int").alias("turn"), F.posexplode("x.kcs").alias("pos", "name"))
    return ranks.order_of_groups(rows, (), "name", "d", "turn", "pos").select("name", F.col("place").cast("int").alias("id"))


def save_annotations(annotated: DataFrame, dataset: str, source: str, split: str = "", folder: str = "data/annotated") -> None:
    """The annotated table as CSV and its skill dictionary as JSON, under the names that readers expect."""
    write_csv(annotated, annotated_file(dataset, source, split, folder))
    write_ids(skill_dictionary(annotated), dictionary_file(dataset, source, folder))
