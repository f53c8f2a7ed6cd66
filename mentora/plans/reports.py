"""Reports over turn probabilities, skills, splits and messages, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mentora.functions import text as T
from mentora.operators import bkt, metrics
from mentora.operators import turns as U
from mentora.plans.sql import _RATERS, _UTTER, PREDICT, TURNS
from mentora.sources import adapters as A

REPORTS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
REPORTS_SQL: dict[str, str] = {}


def report(sql: str):
    def keep(f):
        REPORTS[f.__name__], REPORTS_SQL[f.__name__] = f, sql
        return f

    return keep


def _probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To nine places, so that equal ones are equal in every engine."""
    return metrics.turn_probabilities(bkt.predict(U.observations(A.annotated_turns(spark, sf_dir)))).withColumn("p", F.round("p", 9))


_TP = f"WITH RECURSIVE {TURNS}, {PREDICT}, tp AS (SELECT d, turn, max(correct) AS correct, round(avg(p), 9) AS p FROM pred GROUP BY d, turn)"


@report(f"{_TP} SELECT CAST(count(*) AS BIGINT) AS n, round(avg(-(correct * greatest(ln(p), -100) + (1 - correct) * greatest(ln(1 - p), -100))), 8) AS loss FROM tp")
def cross_entropy(spark, sf_dir):
    """Mean binary cross-entropy of turns, each logarithm at least -100."""
    y, log = F.col("correct"), lambda x: F.greatest(F.ln(x), F.lit(-100.0))
    return _probabilities(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.avg(-(y * log(F.col("p")) + (1 - y) * log(1 - F.col("p")))), 8).alias("loss"))


@report(f"{_TP} SELECT CAST(sum(correct) AS BIGINT) AS true_labels, CAST(sum(1 - correct) AS BIGINT) AS false_labels, CAST(sum(round_even(p, 0)) AS BIGINT) AS true_predictions, CAST(sum(1 - round_even(p, 0)) AS BIGINT) AS false_predictions FROM tp")
def prediction_totals(spark, sf_dir):
    hard = F.bround("p", 0)
    parts = {"true_labels": F.col("correct"), "false_labels": 1 - F.col("correct"), "true_predictions": hard, "false_predictions": 1 - hard}
    return _probabilities(spark, sf_dir).agg(*[F.sum(c).cast("long").alias(name) for name, c in parts.items()])


@report("WITH x AS (SELECT l_quantity / 100 AS p FROM lineitem) SELECT CAST(sum(round_even(p, 0)) AS BIGINT) AS rounded, CAST(sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS at_threshold FROM x")
def hard_prediction_rules(spark, sf_dir):
    """Rounding half to even calls 0.5 wrong, the threshold calls it right."""
    p = F.col("l_quantity") / 100
    return A.table(spark, sf_dir, "lineitem").agg(F.sum(F.bround(p, 0)).cast("long").alias("rounded"), F.sum((p >= 0.5).cast("int")).alias("at_threshold"))


@report("SELECT l_returnflag, round(avg(1 / (1 + exp(l_tax - l_discount))), 8) AS p FROM lineitem GROUP BY 1")
def answer_softmax(spark, sf_dir):
    """Probability of one answer over the other from their two logits."""
    return A.table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(1 / (1 + F.exp(F.col("l_tax") - F.col("l_discount")))), 8).alias("p"))


@report(f"WITH {TURNS}, x AS (SELECT kc, count(*) AS n, min((d, turn, pos)) AS f FROM obs GROUP BY kc) SELECT kc, CAST(n AS BIGINT) AS n FROM x ORDER BY n DESC, f LIMIT 15")
def top_skills(spark, sf_dir):
    """The 15 most frequent skills, of equal ones the first seen."""
    rows = U.observations(A.annotated_turns(spark, sf_dir)).groupBy("kc").agg(F.count("*").alias("n"), F.min(F.struct("d", "turn", "pos")).alias("first"))
    return rows.orderBy(F.desc("n"), "first").limit(15).select("kc", "n")


@report(f"WITH {_RATERS}, x AS (SELECT unnest(['r1', 'r2', 'r3']) AS rater, unnest([r1, r2, r3]) AS score FROM r) SELECT rater, CAST(score AS BIGINT) AS score, CAST(count(*) AS BIGINT) AS n, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM r), 8) AS share FROM x GROUP BY 1, 2")
def score_proportions(spark, sf_dir):
    rows = A.raters(spark, sf_dir).select(F.explode(F.array(*[F.struct(F.lit(r).alias("rater"), F.col(r).cast("long").alias("score")) for r in ("r1", "r2", "r3")])).alias("x")).select("x.*")
    counts = rows.groupBy("rater", "score").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("rater")), 8))


@report(f"WITH {TURNS}, x AS (SELECT correct, lead(correct) OVER (PARTITION BY d ORDER BY turn) AS after FROM tag) SELECT correct, after, CAST(count(*) AS BIGINT) AS n FROM x WHERE after IS NOT NULL GROUP BY 1, 2")
def next_turn_labels(spark, sf_dir):
    """Each label with the label of the dialogue's next tagged turn."""
    rows = U.tagged_turns(A.annotated_turns(spark, sf_dir)).withColumn("after", F.lead("correct").over(Window.partitionBy("d").orderBy("turn")))
    return rows.where("after is not null").groupBy("correct", "after").agg(F.count("*").alias("n"))


@report(f"{_TP}, f AS (SELECT d % 5 AS fold, avg(CASE WHEN round_even(p, 0) = correct THEN 1.0 ELSE 0.0 END) AS a FROM tp GROUP BY 1) SELECT CAST(count(*) AS BIGINT) AS folds, round(avg(a), 8) AS mean, round(stddev_pop(a), 8) AS std FROM f")
def fold_accuracy(spark, sf_dir):
    """Mean and population deviation of the accuracy over five folds."""
    folds = _probabilities(spark, sf_dir).groupBy((F.col("d") % 5).alias("fold")).agg(F.avg((F.bround("p", 0) == F.col("correct")).cast("double")).alias("a"))
    return folds.agg(F.count("*").alias("folds"), F.round(F.avg("a"), 8).alias("mean"), F.round(F.stddev_pop("a"), 8).alias("std"))


@report(f"WITH {TURNS}, x AS (SELECT unnest(list_transform(kcs, lambda k, i: substr(CAST(i AS VARCHAR) || ') ' || k, 4))) AS kc, CASE WHEN og THEN 1.0 ELSE 0.0 END AS y FROM ann) SELECT kc, CAST(count(*) AS BIGINT) AS n, round(avg(y), 8) AS rate FROM x GROUP BY kc")
def tagged_skill_rates(spark, sf_dir):
    """Share of correct turns by skill, read back from the numbered skill lines."""
    rows = A.annotated_turns(spark, sf_dir).where("size(kcs) > 0").select("og", T.skills_to_str(F.col("kcs"), "\n").alias("lines"))
    rows = rows.select(F.explode(F.transform(F.split("lines", "\n"), lambda x: F.substring(x, 4, 1 << 30))).alias("kc"), F.coalesce("og", F.lit(False)).cast("double").alias("y"))
    return rows.groupBy("kc").agg(F.count("*").alias("n"), F.round(F.avg("y"), 8).alias("rate"))


@report(f"WITH {_UTTER}, x AS (SELECT d, string_agg(upper(role[1]) || role[2:] || ': ' || replace(content, chr(10), '\\n'), '|EOM|' ORDER BY pos) AS t FROM u GROUP BY d) SELECT d, CAST(length(t) AS BIGINT) AS chars, md5(t) AS digest FROM x")
def formatted_histories(spark, sf_dir):
    """Each dialogue as one delimited line of messages."""
    rows = A.utterances(spark, sf_dir).groupBy("d").agg(F.array_sort(F.collect_list(F.struct("pos", T.message(F.col("role"), F.col("content")).alias("m")))).alias("x"))
    text = F.array_join(F.col("x.m"), "|EOM|")
    return rows.select("d", F.length(text).cast("long").alias("chars"), F.md5(text).alias("digest"))


@report("WITH x AS (SELECT o_orderpriority AS subject, CAST(('0x' || substr(md5('221-' || CAST(o_orderkey AS VARCHAR)), 1, 4)) AS BIGINT) AS h FROM orders) SELECT f.subject AS held_out, CASE WHEN x.subject = f.subject THEN 'test' WHEN h < 52428 THEN 'train' ELSE 'validation' END AS split, CAST(count(*) AS BIGINT) AS n FROM x, (SELECT DISTINCT subject FROM x) f GROUP BY 1, 2")
def leave_one_subject_out(spark, sf_dir):
    """One subject is the test set, the others are parted 80 to 20 by hash; counted before the folds are laid out."""
    part = F.when(F.conv(F.substring(F.md5(F.concat(F.lit("221-"), F.col("o_orderkey").cast("string"))), 1, 4), 16, 10).cast("int") < 52428, "train").otherwise("validation")
    counts = A.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("subject"), part.alias("part")).agg(F.count("*").alias("n"))
    every = counts.withColumn("subjects", F.collect_set("subject").over(Window.partitionBy(F.lit(1)))).withColumn("held_out", F.explode("subjects"))
    return every.groupBy("held_out", F.when(F.col("subject") == F.col("held_out"), "test").otherwise(F.col("part")).alias("split")).agg(F.sum("n").alias("n"))
