"""Exact positions over all rows without a window over all rows, and what is cut by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mentora.sources.files import stored


def with_position(rows: DataFrame, *order: str) -> DataFrame:
    """Adds ``position`` from 0 in the order of ``order``, and ``total``.

    Rows are dealt out by ranges of ``order``, which Spark takes from a sample, and sorted within a partition; the sorted
    table is written once, so that a repeated task can't number rows anew. Only the sizes of the partitions are summed
    over all, and only these are sent to the tasks.
    """
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = stored(sorted_rows.withColumns({"_part": F.spark_partition_id(), "_local": local}), "positions")
    run = Window.orderBy("_part")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_part", (F.sum("_n").over(run) - F.col("_n")).alias("_offset"), F.sum("_n").over(run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    # One row for each partition.
    return placed.join(F.broadcast(offsets), "_part").withColumn("position", F.col("_offset") + F.col("_local")).drop("_part", "_local", "_offset")


def order_of_groups(rows: DataFrame, by: tuple[str, ...], name: str, *order: str) -> DataFrame:
    """(*by, name, place): the place from 0 of every ``name`` within ``by`` in order of its first row by ``order``."""
    # Written, as the ranges of its positions are taken from a sample, for which ``rows`` would be computed once more.
    first = stored(rows.groupBy(*by, name).agg(F.min(F.struct(*order)).alias("_first")), "first-rows")
    placed = with_position(first, *by, "_first")
    start = placed.groupBy(*by).agg(F.min("position").alias("_start"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}"))
    joined = placed.alias("p").join(start.alias("s"), same) if by else placed.alias("p").crossJoin(start.alias("s"))
    return joined.select(*[f"p.{c}" for c in (*by, name)], (F.col("position") - F.col("_start")).alias("place"))


def fold_slices(placed: DataFrame, folds: int = 5) -> DataFrame:
    """Each row of ``with_position`` once for each fold (from 1), with its slice: the rows are rotated by
    int(n * (fold - 1) / folds), then cut into 65 % train, 15 % validation and 20 % test."""
    rows = placed.withColumn("fold", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(folds).cast("long"))))
    n = F.col("total")
    turned = F.pmod(F.col("position") - F.floor(n * ((F.col("fold") - 1) / folds)), n)
    return rows.withColumn("slice", F.when(turned < F.floor(n * F.lit(0.65).cast("double")), "train").when(turned < F.floor(n * F.lit(0.8).cast("double")), "validation").otherwise("test"))


def draw_shortfall(pool: DataFrame, used: DataFrame, target: int, order: str) -> DataFrame:
    """Of each family of ``pool`` (family, d, ...) the first min(max(0, target - have), rows) by ``order``, those in
    ``used`` (family, d) left out; ``have`` counts these, ``k`` numbers the drawn ones from 1."""
    have = used.groupBy("family").agg(F.count("*").alias("have"))
    fresh = pool.join(used.select("d"), "d", "left_anti").withColumn("k", F.row_number().over(Window.partitionBy("family").orderBy(order)).cast("long"))
    return fresh.join(have, "family", "left").withColumn("have", F.coalesce("have", F.lit(0))).where(F.col("k") <= target - F.col("have"))


def holdout(placed: DataFrame, test: Column) -> DataFrame:
    """Adds ``slice`` to rows of ``with_position``, which places the rows that are no test rows: the first 80 % of these are
    train, the rest validation. ``test`` marks the test rows, whose place doesn't count."""
    return placed.withColumn("slice", F.when(test, "test").when(F.col("position") < F.floor(F.col("total") * F.lit(0.8).cast("double")), "train").otherwise("validation"))


def best_setting(runs: DataFrame, score: str, ordinal: str) -> DataFrame:
    """The row with the greatest score, the first of equal ones."""
    return runs.orderBy(F.desc(score), ordinal).limit(1)


def unchanged_prefix(before: DataFrame, after: DataFrame, added: Column) -> DataFrame:
    """(lost, changed, added): rows of ``before`` that ``after`` lacks, and old rows of ``after`` that ``before`` lacks."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    old = after.where(~added)
    return count(before.exceptAll(old), "lost").crossJoin(count(old.exceptAll(before), "changed")).crossJoin(count(after.where(added), "added"))
