"""Human ratings of annotated turns: cleaning, last turns, accuracy of raters and subjects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def clean_ratings(ratings: DataFrame, sources: DataFrame) -> DataFrame:
    """Rater rows (rater, d, turn, predicted, accuracy, rating) of turns above 0 with their source (d, subject, accepted).

    An accuracy of ``na`` counts as 0, a missing rating as 1. Rows without dialogue or source are left out.
    """
    rows = ratings.where("d is not null and turn > 0").withColumn("accuracy", F.when(F.col("accuracy") == "na", 0.0).otherwise(F.col("accuracy").cast("double")))
    return rows.withColumn("rating", F.coalesce(F.col("rating").cast("double"), F.lit(1.0))).join(sources, "d")


def without_last(rows: DataFrame) -> DataFrame:
    """All rows but the last turn's of each rater and dialogue."""
    last = F.row_number().over(Window.partitionBy("rater", "d").orderBy(F.desc("turn")))
    return rows.withColumn("_back", last).where("_back > 1").drop("_back")


def final_accuracy(rows: DataFrame) -> DataFrame:
    """(rater, n, rater_accuracy, ai_accuracy): how often the last turn's prediction, and what the rater makes of it, agree
    with the known outcome. The last value that is not null of a dialogue counts."""
    value = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("turn"))).alias(c)
    last = rows.groupBy("rater", "d").agg(value("accuracy"), value("predicted"), F.first("accepted").alias("accepted"))
    said = F.col("predicted") == "TRUE"
    share = lambda x: F.avg((x == F.col("accepted")).cast("double"))
    return last.groupBy("rater").agg(F.count("*").alias("n"), share((F.col("accuracy") != 0) == said).alias("rater_accuracy"), share(said).alias("ai_accuracy"))


def over_raters(accuracies: DataFrame) -> DataFrame:
    """Mean and population deviation of the raters' accuracy."""
    return accuracies.agg(F.avg("rater_accuracy").alias("mean"), F.stddev_pop("rater_accuracy").alias("std"))


def subject_means(rows: DataFrame) -> DataFrame:
    return rows.groupBy("subject").agg(F.avg("rating").alias("mean_rating"), F.count("*").alias("n"))
