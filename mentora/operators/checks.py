"""Statements about a population that are tested with the job that uses it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checked(facts: DataFrame, **conditions: Column) -> DataFrame:
    """``facts`` as they are, or an error of the running job that names the first condition that doesn't hold (or is null).

    The test is a filter, so no later selection of columns drops it.
    """
    passes = F.lit(True)
    for name, condition in reversed(conditions.items()):
        fails = F.raise_error(f"{name} does not hold").cast("boolean")
        passes = F.when(F.coalesce(condition, F.lit(False)), passes).otherwise(fails)
    return facts.where(passes)


def population_facts(obs: DataFrame) -> DataFrame:
    """One row of ``obs`` (d, turn, pos, kc, correct, split): dialogues, turns, observations, n_correct, the fewest turns of a
    dialogue, mixed_turns (more than one label), bad_labels (neither 0 nor 1) and shared_dialogues (in both splits)."""
    turns = obs.groupBy("d", "turn").agg(F.count("*").alias("n"), F.sum("correct").alias("c"), (F.min("correct") < F.max("correct")).cast("int").alias("mixed"), F.count(F.when(F.coalesce(F.col("correct").isin(0, 1), F.lit(False)), None).otherwise(1)).alias("bad"), F.min("split").alias("lo"), F.max("split").alias("hi"))
    dialogues = turns.groupBy("d").agg(F.count("*").alias("turns"), *[F.sum(c).alias(c) for c in ("n", "c", "mixed", "bad")], (F.min("lo") < F.max("hi")).cast("int").alias("shared"))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    return dialogues.agg(F.count("*").alias("dialogues"), total("turns", "turns"), total("n", "observations"), total("c", "n_correct"), F.min("turns").alias("least_turns"), total("mixed", "mixed_turns"), total("bad", "bad_labels"), total("shared", "shared_dialogues"))


def sound_population(obs: DataFrame, expected: dict[str, int] | None = None) -> DataFrame:
    """``population_facts``, or an error: every turn has one label, 0 or 1, every dialogue two turns and one split, and counts
    are as ``expected``."""
    none = {f"no {x.replace('_', ' ')}": F.col(x) == 0 for x in ("mixed_turns", "bad_labels", "shared_dialogues")}
    counts = {f"{k} = {v}": F.col(k) == v for k, v in (expected or {}).items()}
    return checked(population_facts(obs), **none, **{"two turns a dialogue": F.coalesce(F.col("least_turns"), F.lit(2)) >= 2}, **counts)
