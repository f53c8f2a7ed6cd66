"""Turn-level metrics with exact AUC and rater agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Equal parts of 0 to 1 over which the running counts of an AUC are split.
SCORE_BUCKETS = 4096
METRICS = ("accuracy", "auc", "precision", "recall", "f1", "log_likelihood", "brier")


def turn_probabilities(predictions: DataFrame, mode: str = "mean-ar", by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, d, turn, correct, p): skill probabilities of a turn combined by prod, mean-ar or mean-geo."""
    modes = {"mean-ar": F.avg("p"), "prod": F.product("p"), "mean-geo": F.pow(F.product("p"), 1 / F.count("p"))}
    if mode not in modes:
        raise ValueError(f"unknown mode {mode}")
    return predictions.groupBy(*by, "d", "turn").agg(F.max("correct").alias("correct"), modes[mode].alias("p"))


def drop_first_turns(turns: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return turns.withColumn("k", F.row_number().over(Window.partitionBy(*by, "d").orderBy("turn"))).where("k > 1").drop("k")


def last_turns(turns: DataFrame) -> DataFrame:
    return turns.groupBy("d").agg(F.max(F.struct("turn", "correct", "p")).alias("x")).select("d", "x.*")


def scores(turns: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """n, accuracy, auc, precision, recall, f1, log_likelihood and brier in one row, or one for each value of ``by``.

    AUC counts pairs by distinct score: rows are summed by score, running counts go over the scores of one of
    SCORE_BUCKETS equal parts of 0 to 1, and the parts' sums over the parts. NaN rows drop out, as do rows without label.
    """
    # Rows with one score differ in their label alone, so all else follows from the counts of both.
    by_score = turns.where("correct is not null and not isnan(p)").groupBy(*by, "p").agg(F.count("*").alias("n"), F.sum("correct").alias("pos")).withColumn("part", F.floor(F.col("p") * SCORE_BUCKETS))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    misses = F.col("n") - F.col("pos")
    inside = by_score.withColumn("below", F.coalesce(F.sum(misses).over(before(*by, "part").orderBy("p")), F.lit(0)))
    eps, p, hard = 1e-12, F.col("p"), F.bround("p", 0)
    kept = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    sums = {
        "n": F.col("n"), "pos": F.col("pos"), "hits": F.when(hard == 1, F.col("pos")).when(hard == 0, misses).otherwise(0), "tp": F.when(hard == 1, F.col("pos")).otherwise(0), "said": F.when(hard == 1, F.col("n")).otherwise(0),
        "ll": F.col("pos") * F.ln(kept) + misses * F.ln(1 - kept), "sq": F.col("pos") * (p - 1) * (p - 1) + misses * p * p, "wins": F.col("pos") * (F.col("below") + misses / 2),
    }
    parts = inside.groupBy(*by, "part").agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    # At most SCORE_BUCKETS + 1 rows a group.
    below = F.coalesce(F.sum(misses).over(before(*by).orderBy("part")), F.lit(0))
    total = parts.withColumn("wins", F.col("wins") + F.col("pos") * below).groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n", "pos", "hits", "tp", "said", "ll", "sq", "wins")])
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    auc = F.when((F.col("pos") > 0) & (F.col("pos") < F.col("n")), F.col("wins") / (F.col("pos") * (F.col("n") - F.col("pos"))))
    per_row = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n"))
    out = {"accuracy": per_row("hits"), "auc": auc, "precision": ratio("tp", "said"), "recall": ratio("tp", "pos"), "f1": F.when(F.col("said") + F.col("pos") > 0, 2 * F.col("tp") / (F.col("said") + F.col("pos"))).otherwise(0.0), "log_likelihood": per_row("ll"), "brier": per_row("sq")}
    return total.select(*by, F.col("n").cast("long").alias("n"), *[F.round(c.cast("double"), 8).alias(x) for x, c in out.items()])


def pair_agreement(ratings: DataFrame, pairs: tuple[tuple[str, str], ...]) -> DataFrame:
    """(pair, accuracy, pearson, qwk) of rater columns; null where constant ratings leave no value."""
    parts = None
    for a, b in pairs:
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        qwk = 1 - F.try_divide(F.avg((x - y) * (x - y)), F.avg(x * x) + F.avg(y * y) - 2 * F.avg(x) * F.avg(y))
        row = ratings.agg(F.lit(f"{a}-{b}").alias("pair"), F.round(F.avg((x == y).cast("double")), 8).alias("accuracy"), F.round(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), 8).alias("pearson"), F.round(qwk, 8).alias("qwk"))
        parts = row if parts is None else parts.unionByName(row)
    return parts


def krippendorff_interval(ratings: DataFrame, raters: tuple[str, ...]) -> DataFrame:
    """Alpha at interval level for complete ratings; null where all ratings are equal or there are none."""
    values = F.array(*[F.col(r).cast("double") for r in raters])
    n = len(raters)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    within = F.aggregate(F.transform(values, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x) / (n - 1)
    rows = ratings.select(within.alias("w"), F.aggregate(values, F.lit(0.0), lambda a, x: a + x).alias("s"), F.aggregate(F.transform(values, lambda x: x * x), F.lit(0.0), lambda a, x: a + x).alias("q"))
    total = rows.agg(F.avg("w").alias("w"), F.sum("s").alias("s"), F.sum("q").alias("q"), (F.count("*") * n).alias("m"))
    return total.select(F.round(1 - F.try_divide(F.col("w"), F.try_divide(F.col("q") - F.try_divide(F.col("s") * F.col("s"), F.col("m")), F.col("m") - 1)), 8).alias("alpha"))
