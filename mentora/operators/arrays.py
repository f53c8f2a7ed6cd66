"""Arrays of a dialogue as a sequence model takes them: labels, skills and vectors by turn, and what stands at turn ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentora.sources.files import stored


def mean_vector(vectors: Column) -> Column:
    """Mean of an array of vectors of one length, element by element; null for an empty array."""

    def mean(v: Column) -> Column:
        zero = F.transform(F.get(v, F.lit(0)), lambda _: F.lit(0.0))
        total = F.aggregate(v, zero, lambda a, x: F.zip_with(a, x, lambda p, q: p + q.cast("double")))
        return F.when(F.size(v) > 0, F.transform(total, lambda x: x / F.size(v)))

    # Bound once as the only element of an array, so that it isn't computed for every use.
    return F.get(F.transform(F.array(vectors), mean), F.lit(0))


def dialogue_arrays(turns: DataFrame, ids: DataFrame, vectors: DataFrame | None = None, at_least: int = 2) -> DataFrame:
    """One row a dialogue of ``turns`` (d, turn, correct, kcs): turns, labels and kc_ids of its labelled turns, labels_flat and
    kc_ids_flat with an entry for each skill, turn_ends (the last flat entry of every turn) and, with ``vectors`` (kc_id,
    vector), the mean vector of each turn's skills as kc_means.

    ``ids`` (kc, kc_id) is the dictionary; a skill that it lacks raises. Dialogues with fewer than ``at_least`` labelled turns
    are left out. A turn without skills keeps its label, has no flat entry and no mean vector.

    The dictionary is sent to the tasks, as one row with its vectors, and has to fit a task, as in its file. Rows are grouped
    without vectors; these are looked up by place in the dictionary once a dialogue is one row.
    """
    labelled = turns.where("correct is not null").select("d", "turn", F.col("correct").cast("int").alias("correct"), F.posexplode_outer("kcs").alias("pos", "kc"))
    skills = ids.select("kc", F.col("kc_id").cast("int").alias("kc_id"))
    if vectors is not None:
        skills = skills.join(vectors.select("kc_id", "vector"), "kc_id", "left")
    held = stored(skills.agg(F.array_sort(F.collect_list(F.struct("kc_id", "kc", *(["vector"] if vectors is not None else [])))).alias("skills")), "dictionary")
    places = held.select(F.posexplode("skills").alias("place", "x")).select("place", "x.kc", "x.kc_id")
    known = labelled.join(F.broadcast(places), "kc", "left")
    missing = F.raise_error(F.concat(F.lit("no number of the skill "), F.col("kc"))).cast("int")
    known = known.withColumn("kc_id", F.when(F.col("kc").isNotNull() & F.col("kc_id").isNull(), missing).otherwise(F.col("kc_id")))
    by_turn = known.groupBy("d", "turn").agg(F.first("correct").alias("label"), F.array_sort(F.collect_list(F.when(F.col("kc_id").isNotNull(), F.struct("pos", "kc_id", "place")))).alias("x"))
    by_turn = by_turn.select("d", "turn", "label", F.transform("x", lambda v: v["kc_id"]).alias("ids"), F.transform("x", lambda v: v["place"]).alias("places"))
    rows = by_turn.groupBy("d").agg(F.array_sort(F.collect_list(F.struct("turn", "label", "ids", "places"))).alias("t")).where(F.size("t") >= at_least)
    each = lambda f: F.transform("t", f)
    ends = F.transform("t", lambda x, i: F.aggregate(F.slice("t", 1, i + 1), F.lit(-1), lambda n, y: n + F.size(y["ids"])))
    flat = {"labels_flat": F.flatten(each(lambda x: F.array_repeat(x["label"], F.size(x["ids"])))), "kc_ids_flat": F.flatten(each(lambda x: x["ids"])), "turn_ends": ends}
    means = {}
    if vectors is not None:
        rows = rows.crossJoin(F.broadcast(held.select(F.col("skills.vector").alias("vectors"))))
        means["kc_means"] = each(lambda x: mean_vector(F.transform(x["places"], lambda i: F.get("vectors", i))))
    named = {"turns": each(lambda x: x["turn"]), "labels": each(lambda x: x["label"]), "kc_ids": each(lambda x: x["ids"])} | flat | means
    return rows.select("d", *[c.alias(k) for k, c in named.items()])


def at_turn_ends(flat: Column, ends: Column, shifted: bool = False) -> Column:
    """Elements of an array of outputs, one for each skill of each turn, at the ``ends`` of turns; ``shifted``, at the entry
    after each, the first of the next turn, and for the last turn at its own end."""
    last = F.array_max(ends)
    return F.transform(ends, lambda i: F.get(flat, F.least(i + 1, last) if shifted else i))


def next_labels(outputs: Column, labels: Column) -> Column:
    """(prediction, label) pairs: each output but the last with the label of the turn after it."""
    n = F.greatest(F.size(labels) - 1, F.lit(0))
    return F.arrays_zip(F.slice(outputs, 1, n).alias("p"), F.slice(labels, 2, n).alias("label"))
