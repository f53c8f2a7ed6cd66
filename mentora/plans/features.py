"""Arrays, training examples, invariants and statistics over the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentora.functions.prompts import IGNORED
from mentora.operators import arrays, bkt, checks, examples, ranks
from mentora.operators import turns as U
from mentora.plans.sql import PREDICT, TURNS
from mentora.sources import adapters as A

FEATURES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
FEATURES_SQL: dict[str, str] = {}


def feature(sql: str):
    def add(f):
        FEATURES[f.__name__], FEATURES_SQL[f.__name__] = f, sql
        return f

    return add


def _dictionary(rows: DataFrame) -> DataFrame:
    """(kc, kc_id) of ``rows`` (d, turn, kcs) in order of first appearance."""
    each = rows.select("d", "turn", F.posexplode("kcs").alias("pos", "kc"))
    return ranks.order_of_groups(each, (), "kc", "d", "turn", "pos").select("kc", F.col("place").cast("int").alias("kc_id"))


_LABELLED = f"""{TURNS}, lt AS (SELECT d, turn, CAST(correct AS INT) AS label, kcs FROM (SELECT *, count(*) OVER (PARTITION BY d) AS n FROM ov WHERE correct IS NOT NULL) WHERE n >= 2),
pk AS (SELECT d, turn, unnest(kcs) AS kc, unnest(range(len(kcs))) AS pos FROM ann),
ids AS (SELECT kc, CAST(row_number() OVER (ORDER BY first) - 1 AS INT) AS kc_id FROM (SELECT kc, min(struct_pack(d := d, turn := turn, pos := pos)) AS first FROM pk GROUP BY kc)),
fl AS (SELECT lt.d, lt.turn, lt.label, kc_id, pos, embedding FROM (SELECT *, unnest(kcs) AS kc, unnest(range(len(kcs))) AS pos FROM lt) lt JOIN ids USING (kc) LEFT JOIN embeddings ON vec_id = kc_id)"""


@feature(f"""WITH {_LABELLED},
a AS (SELECT d, turn, max(label) AS label, string_agg(kc_id, ',' ORDER BY pos) AS kc_ids, count(*) AS n, avg(embedding[1]) AS mean_first, avg(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))) AS mean_sum FROM fl GROUP BY ALL)
SELECT d, CAST(turn AS BIGINT) AS turn, CAST(row_number() OVER w - 1 AS BIGINT) AS k, CAST(label AS BIGINT) AS label, kc_ids, CAST(sum(n) OVER w - 1 AS BIGINT) AS turn_end, round(mean_first, 6) AS mean_first, round(mean_sum, 5) AS mean_sum FROM a WINDOW w AS (PARTITION BY d ORDER BY turn)""")
def dialogue_arrays(spark, sf_dir):
    """The arrays of every dialogue, shown turn by turn: label, skill numbers, end in the flat arrays and mean vector."""
    turns = U.apply_override(A.annotated_turns(spark, sf_dir))
    vectors = A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("kc_id"), F.col("embedding").alias("vector"))
    rows = arrays.dialogue_arrays(turns, _dictionary(A.annotated_turns(spark, sf_dir)), vectors)
    rows = rows.select("d", F.posexplode(F.arrays_zip("turns", "labels", "kc_ids", "turn_ends", "kc_means")).alias("k", "x"))
    total = F.aggregate("x.kc_means", F.lit(0.0), lambda a, v: a + v)
    return rows.select("d", F.col("x.turns").cast("long").alias("turn"), F.col("k").cast("long").alias("k"), F.col("x.labels").cast("long").alias("label"), F.array_join(F.transform("x.kc_ids", lambda i: i.cast("string")), ",").alias("kc_ids"), F.col("x.turn_ends").cast("long").alias("turn_end"), F.round(F.get("x.kc_means", F.lit(0)), 6).alias("mean_first"), F.round(total, 5).alias("mean_sum"))


@feature(f"""WITH RECURSIVE {TURNS}, {PREDICT}, f AS (SELECT d, turn, correct, p, row_number() OVER (PARTITION BY d ORDER BY turn, pos) - 1 AS i FROM pred),
e AS (SELECT d, turn, max(correct) AS label, max(i) AS i, row_number() OVER (PARTITION BY d ORDER BY turn) - 1 AS k FROM f GROUP BY d, turn), l AS (SELECT d, max(i) AS last FROM f GROUP BY d),
n AS (SELECT *, lead(label) OVER (PARTITION BY d ORDER BY k) AS next_label FROM e)
SELECT n.d, CAST(k AS BIGINT) AS k, round(a.p, 9) AS at_end, round(b.p, 9) AS shifted, CAST(next_label AS BIGINT) AS next_label FROM n JOIN l ON l.d = n.d JOIN f a ON a.d = n.d AND a.i = n.i JOIN f b ON b.d = n.d AND b.i = least(n.i + 1, last) WHERE next_label IS NOT NULL""")
def turn_end_gather(spark, sf_dir):
    """Outputs at turn ends, and at the entry after them, each with the label of the next turn."""
    rows = bkt.predict(U.observations(A.annotated_turns(spark, sf_dir)))
    flat = rows.groupBy("d").agg(F.array_sort(F.collect_list(F.struct("turn", "pos", "correct", "p"))).alias("x")).select("d", "x.turn", "x.correct", "x.p")
    last = lambda i: (i == F.size("turn") - 1) | (F.get("turn", i) != F.get("turn", i + 1))
    flat = flat.withColumn("ends", F.filter(F.sequence(F.lit(0), F.size("turn") - 1), last)).withColumn("labels", F.transform("ends", lambda i: F.get("correct", i)))
    own, shifted = (arrays.next_labels(arrays.at_turn_ends(F.col("p"), F.col("ends"), s), F.col("labels")) for s in (False, True))
    rows = flat.select("d", F.posexplode(F.arrays_zip(own.alias("own"), shifted.alias("shifted"))).alias("k", "x"))
    return rows.select("d", F.col("k").cast("long").alias("k"), F.round("x.own.p", 9).alias("at_end"), F.round("x.shifted.p", 9).alias("shifted"), F.col("x.own.label").cast("long").alias("next_label"))


@feature(f"""WITH {TURNS}, t AS (SELECT d, turn, count(*) AS n, sum(correct) AS c FROM obs GROUP BY d, turn), x AS (SELECT d, count(*) AS turns, sum(n) AS n, sum(c) AS c FROM t GROUP BY d)
SELECT count(*) AS dialogues, CAST(sum(turns) AS BIGINT) AS turns, CAST(sum(n) AS BIGINT) AS observations, CAST(sum(c) AS BIGINT) AS n_correct, min(turns) AS least_turns, CAST(0 AS BIGINT) AS mixed_turns, CAST(0 AS BIGINT) AS bad_labels, CAST(0 AS BIGINT) AS shared_dialogues FROM x""")
def population_invariants(spark, sf_dir):
    """Counts of the population; the query fails if one of its invariants doesn't hold."""
    return checks.sound_population(U.observations(A.annotated_turns(spark, sf_dir)))


@feature(f"""WITH m AS (SELECT conv_id AS d, turn AS pos, role, coalesce(text, '') AS text, row_number() OVER w AS k, coalesce(string_agg(role || ': ' || coalesce(text, '') || chr(10), '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS context FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT d, pos, CAST(length(context) + 11 + length(text) AS BIGINT) AS n_ids, CAST(length(text) AS BIGINT) AS n_scored, CAST(coalesce(list_sum(list_transform(regexp_extract_all(text, '(?s).'), lambda c: CAST(unicode(c) AS BIGINT))), 0) AS BIGINT) AS scored_sum, CAST(1024 AS BIGINT) AS n_labels
FROM m WHERE role = 'assistant' AND k > 1 AND length(context) + 11 + length(text) < 1024""")
def sft_examples(spark, sf_dir):
    """Examples of fewer than 1024 tokens, one for each assistant message: tokens, scored ones and their sum."""
    messages = A.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("d"), F.col("turn").alias("pos"), "role", F.col("text").alias("content"))
    scored = F.filter("labels", lambda x: x != IGNORED)
    return examples.training_examples(messages).select("d", "pos", F.size("ids").cast("long").alias("n_ids"), F.size(scored).cast("long").alias("n_scored"), F.aggregate(scored, F.lit(0).cast("long"), lambda a, x: a + x).alias("scored_sum"), F.size("labels").cast("long").alias("n_labels"))
