"""All queries of the engine by name, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mentora.functions import text as T
from mentora.operators import bkt, metrics, ranks
from mentora.operators import turns as U
from mentora.plans.annotating import ANNOTATING, ANNOTATING_SQL
from mentora.plans.features import FEATURES, FEATURES_SQL
from mentora.plans.filing import FILING, FILING_SQL
from mentora.plans.flows import FLOWS, FLOWS_SQL
from mentora.plans.reports import REPORTS, REPORTS_SQL
from mentora.plans.sql import SQL
from mentora.plans.tracing import TRACING, TRACING_SQL
from mentora.sources import adapters as A
from mentora.sources.files import stored

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.observations(A.annotated_turns(spark, sf_dir))


def _count(condition) -> object:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def _md5(prefix: str, column: str):
    return F.md5(F.concat(F.lit(prefix), F.col(column).cast("string")))


@query
def turns_coalesced(spark, sf_dir):
    return U.coalesce_turns(A.utterances(spark, sf_dir)).select("d", F.col("turn").cast("long").alias("turn"), "teacher", "student")


@query
def turn_counts_by_dialogue(spark, sf_dir):
    return U.coalesce_turns(A.utterances(spark, sf_dir)).groupBy("d").agg(F.count("*").alias("n_turns"))


@query
def role_transitions(spark, sf_dir):
    rows = A.utterances(spark, sf_dir).withColumn("after", F.lead("role").over(Window.partitionBy("d").orderBy("pos")))
    return rows.where("after is not null").groupBy("role", "after").agg(F.count("*").alias("n"))


@query
def dialogue_text_prefix(spark, sf_dir):
    """Length and md5 of the whole history that each turn's prompt begins with; dialogue_histories has the texts."""
    return dialogue_histories(spark, sf_dir).select("d", "turn", F.length("history").cast("long").alias("chars"), F.md5("history").alias("history_md5"))


@query
def dialogue_histories(spark, sf_dir):
    """History of each turn: whole texts before it and its teacher line, its student line withheld."""
    return U.histories(U.coalesce_turns(A.utterances(spark, sf_dir))).select("d", F.col("turn").cast("long").alias("turn"), "history")


@query
def chat_contexts(spark, sf_dir):
    """One row for each assistant message after the first: how much stands before it."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = A.table(spark, sf_dir, "conversations").withColumn("n_before", F.count("*").over(before)).withColumn("chars", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)))
    return rows.where("role = 'assistant' and n_before > 0").select("conv_id", "turn", "n_before", F.col("chars").cast("long").alias("chars_before"))


@query
def prompt_batches(spark, sf_dir):
    """Size, first and last prompt of each batch of prompt_batch_members."""
    return prompt_batch_members(spark, sf_dir).groupBy("batch").agg(F.count("*").alias("n"), F.min("h").alias("first_h"), F.max("h").alias("last_h"))


@query
def prompt_batch_members(spark, sf_dir):
    """Distinct user prompts in batches of 64, by order of md5 over all."""
    rows = A.table(spark, sf_dir, "conversations").where("role = 'user'").select(F.md5("text").alias("h")).distinct()
    placed = ranks.with_position(rows, "h")
    return placed.select("h", F.floor(F.col("position") / 64).cast("long").alias("batch"), (F.col("position") % 64).alias("place"))


@query
def observations_long(spark, sf_dir):
    return _obs(spark, sf_dir).select("d", "turn", F.col("pos").cast("long").alias("pos"), "kc", F.col("correct").cast("long").alias("correct"), "split")


@query
def apply_final_override(spark, sf_dir):
    rows = U.apply_override(A.annotated_turns(spark, sf_dir)).where("is_last")
    return rows.select("d", "turn", T.correct_to_str(F.col("og")).alias("og"), T.correct_to_str(F.col("correct")).alias("correct"))


@query
def final_override_audit(spark, sf_dir):
    rows = U.apply_override(A.annotated_turns(spark, sf_dir)).where("is_last and og is not null")
    name = F.concat(T.correct_to_str(F.col("og")), F.lit(" -> "), T.correct_to_str(F.col("correct")))
    return rows.groupBy(name.alias("transition")).agg(F.count("*").alias("n"))


@query
def population_audit(spark, sf_dir):
    """Dialogues, turns and observations are summed by dialogue, skills by skill, so no row is expanded for them."""
    obs = _obs(spark, sf_dir)
    by_dialogue = obs.groupBy("split", "d", "turn").agg(F.count("*").alias("n"), F.sum("correct").alias("c")).groupBy("split", "d").agg(F.count("*").alias("turns"), F.sum("n").alias("n"), F.sum("c").alias("c"))
    out = by_dialogue.groupBy("split").agg(F.count("*").alias("dialogues"), F.sum("turns").alias("turns"), F.sum("n").alias("observations"), F.sum("c").cast("long").alias("n_correct"))
    return out.join(obs.select("split", "kc").distinct().groupBy("split").agg(F.count("*").alias("kcs")), "split")


@query
def typicality_retention(spark, sf_dir):
    rows = A.annotated_turns(spark, sf_dir).select("d", "confusion", "interactions").distinct()
    cut = spark.range(1, 6).select(F.col("id").alias("cutoff"))
    return rows.groupBy("confusion", "interactions").agg(F.count("*").alias("n")).crossJoin(F.broadcast(cut)).groupBy("cutoff").agg(F.sum("n").alias("total"), F.sum(F.when((F.col("confusion") >= F.col("cutoff")) & (F.col("interactions") >= F.col("cutoff")), F.col("n")).otherwise(0)).alias("kept"))


@query
def length_sensitivity(spark, sf_dir):
    sizes = U.tagged_turns(A.annotated_turns(spark, sf_dir)).groupBy("d").agg(F.count("*").alias("n")).groupBy("n", F.when(F.col("d") % 5 == 0, "test").otherwise("train").alias("split")).agg(F.count("*").alias("dialogues"))
    cut = spark.range(2, 7).select(F.col("id").alias("least"))
    out = sizes.crossJoin(F.broadcast(cut)).where("n >= least").groupBy("least").pivot("split", ["train", "test"]).agg(F.sum("dialogues"))
    return out.na.fill(0, ["train", "test"])


@query
def kc_stats(spark, sf_dir):
    return U.skill_stats(_obs(spark, sf_dir))


@query
def kc_degenerate(spark, sf_dir):
    return U.skill_stats(_obs(spark, sf_dir).where("split = 'train'").withColumn("kc", F.concat("kc", F.lit("-"), (F.col("d") % 97).cast("string")))).where("n_correct = 0 or n_correct = n")


@query
def kc_rare_thresholds(spark, sf_dir):
    stats = U.skill_stats(_obs(spark, sf_dir).withColumn("kc", F.concat("kc", F.lit("-"), (F.col("d") % 997).cast("string"))))
    return stats.agg(*[_count(F.col("n") <= k).alias(f"at_most_{k}") for k in (1, 2, 5, 10)], F.count("*").alias("kcs"))


def _keep(spark, sf_dir, least=900):
    obs = _obs(spark, sf_dir)
    stats = U.skill_stats(obs.where("split = 'train'"))
    return obs, stats, stats.where((F.col("n") >= least) & (F.col("n_correct") > 0) & (F.col("n_correct") < F.col("n")))


@query
def kc_keep_set(spark, sf_dir):
    return _keep(spark, sf_dir)[2]


@query
def kc_keep_apply(spark, sf_dir):
    obs, _, keep = _keep(spark, sf_dir)
    return obs.join(keep.select("kc"), "kc", "left_semi").groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("kc").alias("kcs"))


@query
def kc_keep_report(spark, sf_dir):
    _, stats, _ = _keep(spark, sf_dir)
    bad, few = (F.col("n_correct") == 0) | (F.col("n_correct") == F.col("n")), F.col("n") < 900
    return stats.agg(F.count("*").alias("kcs"), _count(bad).alias("degenerate"), _count(few).alias("too_few"), _count(bad | few).alias("dropped"), F.sum("n").alias("observations"), F.sum(F.when(bad | few, F.col("n")).otherwise(0)).alias("dropped_observations"))


@query
def kc_dictionary(spark, sf_dir):
    """Dense ids in order of first appearance."""
    rows = A.annotated_turns(spark, sf_dir).select("d", "turn", F.posexplode("kcs").alias("pos", "kc"))
    return ranks.order_of_groups(rows, (), "kc", "d", "turn", "pos").select("kc", F.col("place").alias("kc_id"))


@query
def kc_split_overlap(spark, sf_dir):
    obs = _obs(spark, sf_dir).withColumn("kc", F.concat("kc", F.lit("-"), (F.col("d") % 401).cast("string")))
    seen = obs.groupBy("kc").agg(F.max((F.col("split") == "train").cast("int")).alias("train"), F.max((F.col("split") == "test").cast("int")).alias("test"), F.sum((F.col("split") == "test").cast("long")).alias("rows"))
    only = (F.col("test") == 1) & (F.col("train") == 0)
    return seen.agg(_count((F.col("train") == 1) & (F.col("test") == 1)).alias("both"), _count((F.col("train") == 1) & (F.col("test") == 0)).alias("train_only"), _count(only).alias("test_only"), F.sum(F.when(only, F.col("rows")).otherwise(0)).alias("test_only_rows"))


@query
def kcs_per_turn_hist(spark, sf_dir):
    return A.annotated_turns(spark, sf_dir).groupBy(F.size("kcs").cast("long").alias("n_kcs")).agg(F.count("*").alias("turns"))


@query
def shape_summary(spark, sf_dir):
    per = U.tagged_turns(A.annotated_turns(spark, sf_dir)).groupBy("d").agg(F.count("*").alias("n"), F.sum(F.size("kcs")).alias("k"), F.sum(F.col("correct").cast("int")).alias("c"))
    share = F.sum("c") / F.sum("n")
    return per.agg(F.count("*").alias("dialogues"), F.round(F.avg("n"), 8).alias("mean_turns"), F.percentile("n", F.lit(0.5)).alias("median_turns"), F.min("n").alias("min_turns"), F.max("n").alias("max_turns"), F.round(F.sum("k") / F.sum("n"), 8).alias("kcs_per_turn"), F.round(F.greatest(share, 1 - share), 8).alias("majority"))


@query
def corpus_statistics(spark, sf_dir):
    rows = U.apply_override(A.annotated_turns(spark, sf_dir))
    return rows.agg(F.count("*").alias("turns"), F.countDistinct("d").alias("dialogues"), _count(F.col("correct")).alias("n_true"), _count(~F.col("correct")).alias("n_false"), _count(F.col("correct").isNull()).alias("n_na"), _count(F.size("kcs") > 1).alias("multi_kc"), F.round(F.avg(F.when(F.col("correct"), F.size("kcs"))), 8).alias("kcs_true"), F.round(F.avg(F.when(~F.col("correct"), F.size("kcs"))), 8).alias("kcs_false"))


@query
def family_counts_pivot(spark, sf_dir):
    rows = A.profiles(spark, sf_dir).withColumn("family", T.misconception_family(F.col("profile")))
    return rows.groupBy("family").pivot("split", ["train", "test"]).count().na.fill(0, ["train", "test"])


@query
def family_loose_counts(spark, sf_dir):
    return A.profiles(spark, sf_dir).groupBy(T.loose_family(F.col("profile")).alias("family")).agg(F.count("*").alias("n"))


@query
def family_text_shares(spark, sf_dir):
    rows = A.profiles(spark, sf_dir).withColumn("family", T.misconception_family(F.col("profile")))
    return rows.groupBy("family").agg(F.count("*").alias("n"), F.countDistinct("confusion").alias("distinct_texts"), F.round(F.countDistinct("confusion") / F.count("*"), 8).alias("share"))


@query
def order_ids(spark, sf_dir):
    """The order number of each observation in its dialogue, and the dialogue's offset over all."""
    local = F.row_number().over(Window.partitionBy("d").orderBy("turn", "pos")) - 1
    rows = global_order_ids(spark, sf_dir).withColumn("order_in_dialogue", local.cast("long"))
    return rows.select("d", "turn", "pos", "order_in_dialogue", (F.col("order_id") - F.col("order_in_dialogue")).alias("dialogue_offset"))


@query
def global_order_ids(spark, sf_dir):
    """A dense order number over all observations by dialogue, turn and skill."""
    placed = ranks.with_position(_obs(spark, sf_dir), "d", "turn", "pos")
    return placed.select("d", "turn", F.col("pos").cast("long").alias("pos"), F.col("position").alias("order_id"))


@query
def turn_ranges(spark, sf_dir):
    rows = U.tagged_turns(A.annotated_turns(spark, sf_dir))
    end = F.sum(F.size("kcs")).over(Window.partitionBy("d").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("d", "turn", (end - F.size("kcs")).cast("long").alias("start"), end.cast("long").alias("end"))


@query
def bkt_forward_fixed(spark, sf_dir):
    return bkt.predict(_obs(spark, sf_dir)).select("d", "turn", "kc", F.col("correct").cast("long").alias("correct"), F.round("p", 9).alias("p"))


def _turns_of(spark, sf_dir, mode="mean-ar"):
    """Turn probabilities to nine places, so that equal ones are equal in every engine."""
    return metrics.turn_probabilities(bkt.predict(_obs(spark, sf_dir)), mode).withColumn("p", F.round("p", 9))


def _shown(turns):
    return turns.select("d", "turn", F.col("correct").cast("long").alias("correct"), "p")


@query
def turn_prob_mean(spark, sf_dir):
    return _shown(_turns_of(spark, sf_dir))


@query
def turn_prob_prod(spark, sf_dir):
    return _shown(_turns_of(spark, sf_dir, "prod"))


@query
def turn_prob_geo(spark, sf_dir):
    return _shown(_turns_of(spark, sf_dir, "mean-geo"))


@query
def turn_metrics(spark, sf_dir):
    return metrics.scores(metrics.drop_first_turns(_turns_of(spark, sf_dir)))


@query
def final_turn_metrics(spark, sf_dir):
    return metrics.scores(metrics.last_turns(_turns_of(spark, sf_dir)))


@query
def bkt_fit_params(spark, sf_dir):
    return bkt.fit(bkt.label_sequences(_obs(spark, sf_dir).where("split = 'train'")))


@query
def bkt_fit_eval(spark, sf_dir):
    """Fit on train, predict test, first turns left out."""
    obs = _obs(spark, sf_dir)
    predictions = bkt.fit_predict(obs.where("split = 'train'"), obs.where("split = 'test'"))
    return metrics.scores(metrics.drop_first_turns(metrics.turn_probabilities(predictions)).withColumn("p", F.round("p", 9)))


@query
def weighted_fallback(spark, sf_dir):
    parameters = U.skill_stats(_obs(spark, sf_dir)).select("kc", *[(F.col("n_correct") / F.col("n") / k).alias(x) for k, x in enumerate(bkt.DEFAULTS, 1)])
    out = bkt.weighted_fallback(parameters, U.skill_stats(_obs(spark, sf_dir)).select("kc", "n"))
    return out.select(*[F.round(x, 8).alias(x) for x in bkt.DEFAULTS])


@query
def majority_baseline(spark, sf_dir):
    rows = U.tagged_turns(A.annotated_turns(spark, sf_dir)).agg(F.avg(F.col("correct").cast("int")).alias("share"), F.count("*").alias("n"))
    return rows.select("n", F.when(F.col("share") >= 0.5, 1).otherwise(0).cast("long").alias("majority"), F.round(F.greatest("share", 1 - F.col("share")), 8).alias("accuracy"))


@query
def rotating_folds(spark, sf_dir):
    """Sizes of the slices of each rotation, and the sum of its test orders."""
    rows = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("d"), _md5("221-", "o_orderkey").alias("h"))
    slices = ranks.fold_slices(ranks.with_position(rows, "h", "d"))
    sizes = [_count(F.col("slice") == x).alias(f"n_{x}") for x in ("train", "validation", "test")]
    return slices.groupBy("fold").agg(*sizes, F.sum(F.when(F.col("slice") == "test", F.col("d")).otherwise(0)).alias("test_d_sum"))


@query
def rotating_fold_slices(spark, sf_dir):
    """Train, validation and test slice of each of five rotations of the orders in md5 order."""
    rows = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("d"), _md5("221-", "o_orderkey").alias("h"))
    slices = ranks.fold_slices(ranks.with_position(rows, "h", "d"))
    return slices.groupBy("fold", "slice").agg(F.count("*").alias("n"), F.sum("d").alias("d_sum"))


@query
def stratified_topup(spark, sf_dir, target=13):
    """By family: how many dialogues are used, how many are in the pool, and how many are drawn to reach the target."""
    rows = A.profiles(spark, sf_dir).where("split = 'train'").withColumn("family", T.misconception_family(F.col("profile"))).withColumn("h", _md5("draw-", "d"))
    used = rows.where("d % 11 = 0").select("family", "d")
    drawn = ranks.draw_shortfall(rows, used, target, "h").groupBy("family").agg(F.count("*").alias("drawn"))
    have = F.col("d") % 11 == 0
    counts = rows.groupBy("family").agg(_count(have).alias("have"), _count(~have).alias("pool"))
    return counts.join(drawn, "family", "left").select("family", "have", "pool", F.coalesce("drawn", F.lit(0)).alias("drawn"))


@query
def stratified_shortfall(spark, sf_dir, target=13):
    """As many dialogues of each family by md5 order as the used ones fall short of the target."""
    rows = A.profiles(spark, sf_dir).where("split = 'train'").withColumn("family", T.misconception_family(F.col("profile"))).withColumn("h", _md5("draw-", "d"))
    return ranks.draw_shortfall(rows, rows.where("d % 11 = 0").select("family", "d"), target, "h").select("family", "d", "k")


@query
def standards_options(spark, sf_dir):
    """Sorted option lines of each domain of a two-level tree."""
    tree = A.table(spark, sf_dir, "nation").join(A.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    line = F.concat(F.lit("ID: "), F.col("n_nationkey").cast("string"), F.lit(", Description: "), F.col("n_name"))
    return tree.groupBy(F.col("r_name").alias("domain")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("options"))


@query
def lm_output_extract(spark, sf_dir):
    rows = A.table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("first ```json{\"a\": 0}``` then ```json{\"result\": \\(\\pi"), F.col("n_nationkey").cast("string"), F.lit("\\)}```")).alias("t"))
    return rows.select("n_nationkey", T.lm_result(F.col("t")).alias("result"))


@query
def response_cache_misses(spark, sf_dir):
    prompts = A.table(spark, sf_dir, "conversations").where("role = 'user'").select("text").distinct()
    cached = A.table(spark, sf_dir, "conversations").where("role = 'user' and conv_id % 3 = 0").select("text").distinct()
    return prompts.join(cached, "text", "left_anti").agg(F.count("*").alias("misses"), F.sum(F.length("text")).cast("long").alias("chars"))


@query
def success_at_k(spark, sf_dir):
    rows = A.numeric_dialogues(spark, sf_dir)
    order = Window.partitionBy("d", "role").orderBy("pos")
    rows = rows.withColumn("nth", F.row_number().over(order) - 1).withColumn("hit", T.names_answer(F.col("content"), F.col("answer")))
    first = rows.groupBy("d").agg(F.min(F.when((F.col("role") == "Student") & F.col("hit"), F.col("nth"))).alias("s"), F.min(F.when((F.col("role") == "Teacher") & F.col("hit"), F.col("nth"))).alias("t"))
    ks = spark.range(1, 8).select(F.col("id").alias("k"))
    grid = first.groupBy("s", "t").agg(F.count("*").alias("n")).crossJoin(F.broadcast(ks))
    success = F.coalesce(F.col("s") <= F.col("k"), F.lit(False))
    telling = F.coalesce(F.col("t") <= F.least(F.coalesce("s", "k"), F.col("k")), F.lit(False))
    return grid.groupBy("k").agg(F.round(F.sum(F.when(success, F.col("n")).otherwise(0)) / F.sum("n"), 8).alias("success"), F.round(F.sum(F.when(telling, F.col("n")).otherwise(0)) / F.sum("n"), 8).alias("telling"))


@query
def rater_agreement(spark, sf_dir):
    return metrics.pair_agreement(A.raters(spark, sf_dir), (("r1", "r2"), ("r1", "r3"), ("r2", "r3")))


@query
def rater_alpha(spark, sf_dir):
    return metrics.krippendorff_interval(A.raters(spark, sf_dir), ("r1", "r2", "r3"))


@query
def rater_overlap(spark, sf_dir):
    rows = A.raters(spark, sf_dir)
    return rows.agg(F.round(F.avg(((F.col("r2") == F.col("r1")) & (F.col("r3") == F.col("r1"))).cast("double")), 8).alias("overlap"), F.count("*").alias("n"))


@query
def learning_curve(spark, sf_dir):
    rows = bkt.predict(_obs(spark, sf_dir))
    order = Window.partitionBy("d", "kc").orderBy("turn", "pos")
    rows = rows.withColumn("occurrence", F.row_number().over(order)).withColumn("delta", F.col("p") - F.first("p").over(order))
    return rows.groupBy("kc", F.col("occurrence").cast("long").alias("occurrence")).agg(F.count("*").alias("n"), F.round(F.avg("delta"), 8).alias("mean_delta"), F.round(F.stddev_pop("delta"), 6).alias("std_delta"))


@query
def qual_report(spark, sf_dir):
    turns = _turns_of(spark, sf_dir)
    return turns.groupBy("d").agg(F.count("*").alias("n"), F.round(F.avg((F.bround("p", 0) == F.col("correct")).cast("double")), 8).alias("dialogue_accuracy"))


@query
def embedding_kc_mean(spark, sf_dir):
    """Mean vector of each group, position by position."""
    rows = A.table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    return rows.groupBy("label", F.col("i").cast("long").alias("i")).agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("v"))


@query
def reload_parity(spark, sf_dir):
    """Skill rates written to the shared folder and read back, against the computed ones; a rate on one side only counts 1."""
    own = U.skill_stats(_obs(spark, sf_dir)).select("kc", (F.col("n_correct") / F.col("n")).alias("rate"))
    both = own.withColumnRenamed("rate", "own").join(stored(own, "rates"), "kc", "full")
    return both.agg(F.count("*").alias("n"), F.max(F.coalesce(F.abs(F.col("own") - F.col("rate")), F.lit(1.0))).alias("max_diff"))


def catalogue() -> dict[str, Query]:
    return _QUERIES | REPORTS | FLOWS | TRACING | ANNOTATING | FEATURES | FILING


def catalogue_sql() -> dict[str, str]:
    return SQL | REPORTS_SQL | FLOWS_SQL | TRACING_SQL | ANNOTATING_SQL | FEATURES_SQL | FILING_SQL
