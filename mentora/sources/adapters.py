"""Views of the driver's tables as tutoring data: utterances, annotated turns, observations, raters, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mentora.operators.rating import clean_ratings


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(d, pos, role, content) of ``conversations``; every role but user is the teacher."""
    role = F.when(F.col("role") == "user", "student").otherwise("teacher").alias("role")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("d"), F.col("turn").alias("pos"), role, F.col("text").alias("content"))


def annotated_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(d, turn, og, kcs, status, prio, cust, is_last) from line items: the label is the least return flag, the skills
    the distinct brands. A turn without label has no skills."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey")
    # Dealt out by dialogue once; everything below, and what groups by dialogue later, finds its rows together.
    lines = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).repartition("l_orderkey")
    turns = lines.groupBy(F.col("l_orderkey").alias("d"), F.col("l_linenumber").alias("turn")).agg(F.min("l_returnflag").alias("flag"), F.array_sort(F.collect_set("p_brand")).alias("kcs"))
    turns = turns.withColumn("og", F.when(F.col("flag") == "A", True).when(F.col("flag") == "R", False))
    turns = turns.withColumn("kcs", F.when(F.col("og").isNull(), F.array().cast("array<string>")).otherwise(F.col("kcs")))
    turns = turns.withColumn("is_last", F.col("turn") == F.max("turn").over(Window.partitionBy("d")))
    head = orders.select(F.col("o_orderkey").alias("d"), F.col("o_orderstatus").alias("status"), F.substring("o_orderpriority", 1, 1).cast("int").alias("confusion"), (F.col("o_custkey") % 5 + 1).cast("int").alias("interactions"))
    return turns.join(head, "d").drop("flag")


def raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, r1, r2, r3): three raters of each event."""
    r1 = (F.floor("value").cast("int") % 4 + 1).alias("r1")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", r1)
    return rows.select("event_id", "r1", F.when(F.col("event_id") % 5 == 0, F.col("r1") % 4 + 1).otherwise(F.col("r1")).alias("r2"), F.when(F.col("event_id") % 7 == 0, (F.col("user_id") % 4 + 1).cast("int")).otherwise(F.col("r1")).alias("r3"))


#: Phrases of the student profiles, one of them outside every family.
PROFILE_PHRASES = (
    "can not tell what the problem is asking", "knows no underlying ideas and principles", "takes irrelevant for relevant facts", "misses the correct operation",
    "does not know which steps or procedures come first", "can not recognize the problem type", "mixes several principles",
)


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(d, split, profile, confusion) from ``documents``; the whole text stands for the confusion, as its md5."""
    phrase = F.element_at(F.array(*map(F.lit, PROFILE_PHRASES)), (F.col("doc_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"), F.when(F.col("doc_id") % 4 == 0, "test").otherwise("train").alias("split"), F.concat(F.lit("Alex is a 7th grade student. Alex "), phrase, F.lit(".")).alias("profile"), F.md5("text").alias("confusion"))


def numeric_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(d, pos, role, content, answer): line items as utterances that name a quantity; the answer is the largest."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").withColumn("pos", F.row_number().over(order) - 1).withColumn("answer", F.max("l_quantity").over(Window.partitionBy("l_orderkey")).cast("int").cast("string"))
    role = F.when(F.col("pos") % 2 == 0, "Student").otherwise("Teacher")
    return rows.select(F.col("l_orderkey").alias("d"), "pos", role.alias("role"), F.concat(role, F.lit(": I get "), F.col("l_quantity").cast("int").cast("string")).alias("content"), "answer")


def annotation_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(d, turns, kcs, correctness, self_correctness): two model replies on each order's lines, with planted failures.

    Every 47th order has a reply that can't be parsed, every 41st lacks a label, every 43rd has one turn more in the
    source; orders with an even key open with a turn 0.
    """
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.groupBy(F.col("l_orderkey").alias("d"), F.col("l_linenumber").alias("line")).agg(F.min("l_returnflag").alias("flag"), F.array_sort(F.collect_set("p_brand")).alias("kcs"))
    rows = lines.groupBy("d").agg(F.array_sort(F.collect_list(F.struct("line", "flag", "kcs"))).alias("x"))
    key = lambda i: F.concat(F.lit("turn "), (i + 1).cast("string"))
    label = lambda x: F.when(x["flag"] == "A", "true").when(x["flag"] == "R", "false").otherwise("na")
    kcs = F.map_from_entries(F.transform("x", lambda x, i: F.struct(key(i).alias("k"), x["kcs"].alias("v"))))
    marks = F.map_from_entries(F.transform(F.when(F.col("d") % 41 == 0, F.slice("x", 1, F.size("x") - 1)).otherwise(F.col("x")), lambda x, i: F.struct(key(i).alias("k"), label(x).alias("v"))))
    turns = F.sequence(F.when(F.col("d") % 2 == 0, 0).otherwise(1), F.size("x") + F.when(F.col("d") % 43 == 0, 1).otherwise(0))
    status = F.when(F.col("o_orderstatus") == "F", "Yes").when(F.col("o_orderstatus") == "O", "No").otherwise("Yes, but I had to reveal the answer")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("d"), status.alias("self_correctness"))
    return rows.select("d", turns.alias("turns"), F.when(F.col("d") % 47 != 0, kcs).alias("kcs"), marks.alias("correctness")).join(orders, "d")


def event_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned ratings of events: three raters, dialogues of nine turns."""
    e = F.col("event_id")
    accuracy = F.when(e % 10 == 0, "na").when(e % 11 != 0, F.when(e % 3 > 0, "1").otherwise("0"))
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 3).cast("int").alias("rater"), F.floor(e / 9).alias("d"), (e % 9).alias("turn"), F.when(e % 2 == 0, "TRUE").otherwise("FALSE").alias("predicted"), accuracy.alias("accuracy"), F.when(e % 7 != 0, e % 4 + 1).alias("rating"))
    sources = rows.select("d").distinct().select("d", (F.col("d") % 4).alias("subject"), (F.col("d") % 3 == 0).alias("accepted"))
    return clean_ratings(rows, sources)
