"""Annotation, prompt, rating, split and tracing flows over the driver's tables, each with DuckDB SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mentora.functions import prompts as P
from mentora.functions import text as T
from mentora.operators import annotations as N
from mentora.operators import bkt, ranks, rating
from mentora.operators import turns as U
from mentora.plans.sql import SQL, TURNS
from mentora.sources import adapters as A
from mentora.sources.files import stored

FLOWS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
FLOWS_SQL: dict[str, str] = {}


def flow(sql: str | None):
    def add(f):
        FLOWS[f.__name__] = f
        if sql is not None:
            FLOWS_SQL[f.__name__] = sql
        return f

    return add


def _obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.observations(A.annotated_turns(spark, sf_dir))


def _rounded(x: Column, name: str) -> Column:
    return F.round(x, 8).alias(name)


REPLIES = """
WITH t AS (SELECT l_orderkey AS d, l_linenumber AS ln, min(l_returnflag) AS flag, count(DISTINCT p_brand) AS nk FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
r AS (SELECT t.*, row_number() OVER (PARTITION BY d ORDER BY ln) AS turn, count(*) OVER (PARTITION BY d) AS n, o_orderstatus AS status FROM t JOIN orders ON d = o_orderkey),
ok AS (SELECT * FROM r WHERE d % 47 <> 0 AND d % 41 <> 0 AND d % 43 <> 0)
"""


@flow(f"""{REPLIES}, e AS (SELECT DISTINCT d, n, CASE WHEN d % 47 = 0 THEN 'JSON parsing error' WHEN d % 41 = 0 THEN 'Different number of standard and correctness output turns'
  WHEN d % 43 = 0 THEN 'Different number of annotations and source turns' ELSE 'ok' END AS outcome FROM r)
SELECT outcome, count(*) AS n, CAST(sum(CASE WHEN outcome = 'ok' THEN n ELSE 0 END) AS BIGINT) AS annotated FROM e GROUP BY outcome""")
def annotation_merge(spark, sf_dir):
    rows = N.merge_replies(A.annotation_replies(spark, sf_dir))
    return rows.groupBy(F.coalesce("error", F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.size("annotation"), F.lit(0))).cast("long").alias("annotated"))


@flow(f"""{REPLIES}, o AS (SELECT d, turn, CASE flag WHEN 'A' THEN true WHEN 'R' THEN false END AS og, nk, turn = n AS is_last, status FROM ok
  UNION ALL SELECT DISTINCT d, 0, NULL, 0, false, status FROM ok WHERE d % 2 = 0)
SELECT d, CAST(turn AS BIGINT) AS turn, og, CASE WHEN is_last AND og IS NOT NULL THEN CASE status WHEN 'F' THEN true WHEN 'O' THEN false WHEN 'P' THEN NULL END ELSE og END AS correct,
  CASE WHEN og IS NULL THEN 0 ELSE CAST(nk AS BIGINT) END AS n_kcs FROM o""")
def label_application(spark, sf_dir):
    rows = N.label_turns(N.merge_replies(A.annotation_replies(spark, sf_dir)))
    return rows.select("d", F.col("turn").cast("long").alias("turn"), "og", "correct", F.size("kcs").cast("long").alias("n_kcs"))


_KINDS = ("{}", '{"error": "Different number of annotations and source turns"}', '{"turn 1": {"correct": null, "kcs": []}}', '{"turn 1": {"correct": true}}', "broken{", '{"turn 1": 3, "turn 2": {"kcs": [], "correct": false}}')


@flow("SELECT o_orderkey % 6 IN (2, 5) AS usable, count(*) AS n FROM orders GROUP BY 1")
def usable_annotations(spark, sf_dir):
    text = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    rows = A.table(spark, sf_dir, "orders").select(text.alias("annotation"))
    return rows.groupBy(N.usable(F.col("annotation")).alias("usable")).agg(F.count("*").alias("n"))


_CONTEXT = "[BEGIN PROBLEM]\nTwo and two?\n[END PROBLEM]\n\n[BEGIN CORRECT SOLUTION]\n4\n[END CORRECT SOLUTION]\n\n[BEGIN INCORRECT STUDENT SOLUTION]\n5\n[END INCORRECT STUDENT SOLUTION]"


def _context() -> Column:
    return P.problem_context(F.lit(" Two and two?\n"), F.lit("\t4"), F.lit("5 "))


def _coalesced(spark, sf_dir) -> DataFrame:
    return U.coalesce_turns(A.utterances(spark, sf_dir))


def _skills() -> Column:
    return F.when(F.col("d") % 2 == 0, F.array(F.lit("add"), F.lit("carry"))).otherwise(F.array(F.lit("read")))


_HISTORY = f"h0 AS (SELECT * FROM ({SQL['dialogue_histories']}))"


@flow(f"""WITH {_HISTORY}, k AS (SELECT *, unnest(CASE WHEN d % 2 = 0 THEN ['add', 'carry'] ELSE ['read'] END) AS kc FROM h0)
SELECT d, turn, kc, md5('{_CONTEXT}' || chr(10) || chr(10) || history || chr(10) || chr(10) || 'Knowledge Component: ' || kc) AS prompt_md5 FROM k""")
def tracing_prompts(spark, sf_dir):
    """One prompt for each turn and skill."""
    rows = U.histories(_coalesced(spark, sf_dir)).withColumn("kc", F.explode(_skills()))
    return rows.select("d", F.col("turn").cast("long").alias("turn"), "kc", F.md5(P.tracing_prompt(F.col("history"), F.col("kc"), _context())).alias("prompt_md5"))


@flow(f"""WITH {_HISTORY} SELECT d, turn, md5(history || chr(10) || chr(10) || 'Knowledge Component:') AS prompt_md5,
  CASE WHEN d % 2 = 0 THEN ' add| carry' ELSE ' read' END AS continuations FROM h0""")
def packed_prompts(spark, sf_dir):
    """One open prompt a turn and the continuations of all its skills."""
    rows = U.histories(_coalesced(spark, sf_dir))
    return rows.select("d", F.col("turn").cast("long").alias("turn"), F.md5(P.tracing_prompt(F.col("history"))).alias("prompt_md5"), F.array_join(F.transform(_skills(), lambda k: F.concat(F.lit(" "), k)), "|").alias("continuations"))


_TEXTS = f"""c0 AS (SELECT * FROM ({SQL['turns_coalesced']})),
x0 AS (SELECT d, max(turn) AS last_turn, '[BEGIN DIALOGUE]' || chr(10) || coalesce(string_agg(nullif(concat_ws(chr(10), CASE WHEN teacher <> '' THEN 'Teacher Turn ' || turn || ': ' || teacher END, CASE WHEN student <> '' THEN 'Student Turn ' || turn || ': ' || student END), ''), chr(10) ORDER BY turn), '') || chr(10) || '[END DIALOGUE]' AS text FROM c0 GROUP BY d)"""


@flow(f"""WITH {_TEXTS} SELECT d, md5('{_CONTEXT}' || chr(10) || chr(10) || text || chr(10) || chr(10) || 'Your final response should have an entry for exactly ' || last_turn || ' turn' || CASE WHEN last_turn > 1 THEN '''s (1-' || last_turn || ')' ELSE '' END || '.') AS prompt_md5 FROM x0""")
def annotation_prompts(spark, sf_dir):
    rows = U.dialogue_texts(_coalesced(spark, sf_dir))
    return rows.select("d", F.md5(P.annotation_prompt(F.col("text"), F.col("last_turn"), _context())).alias("prompt_md5"))


@flow(f"""WITH {_TEXTS} SELECT d, md5(text || chr(10) || chr(10) || '[BEGIN STANDARDS]' || chr(10) || '- ID: 1, Description: a' || chr(10) || '- ID: 2, Description: b' || chr(10) || '[END STANDARDS]' || chr(10) || chr(10)
  || 'There should be exactly ' || last_turn || ' turn' || CASE WHEN last_turn > 1 THEN 's' ELSE '' END || ' in your final result.') AS prompt_md5 FROM x0""")
def level_prompts(spark, sf_dir):
    options = F.array(F.lit("ID: 1, Description: a"), F.lit("ID: 2, Description: b"))
    rows = U.dialogue_texts(_coalesced(spark, sf_dir))
    return rows.select("d", F.md5(P.level_prompt(F.col("text"), "standard", options, F.col("last_turn"))).alias("prompt_md5"))


_PAIR = P.TURN_PAIR.replace("'", "''")


@flow(f"""SELECT d, turn, md5('{_PAIR}' || teacher || chr(10) || 'Student: ' || student || chr(10) || 'Knowledge Components: ' || CASE WHEN d % 2 = 0 THEN '1) add 2) carry' ELSE '1) read' END
  || chr(10) || 'Student Correct: ' || CASE turn % 3 WHEN 0 THEN 'na' WHEN 1 THEN 'true' ELSE 'False' END) AS prompt_md5 FROM ({SQL['turns_coalesced']})""")
def turn_prompts(spark, sf_dir):
    correct = F.when(F.col("turn") % 3 == 1, True).when(F.col("turn") % 3 == 2, False)
    return _coalesced(spark, sf_dir).select("d", F.col("turn").cast("long").alias("turn"), F.md5(P.turn_prompt(F.col("teacher"), F.col("student"), _skills(), correct)).alias("prompt_md5"))


@flow("""WITH m AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n,
  min(CASE WHEN role = 'system' THEN turn END) OVER (PARTITION BY conv_id) AS first_system, turn FROM conversations),
w AS (SELECT conv_id, n, k, role, CASE WHEN role = 'system' AND turn = first_system THEN text || chr(10) || 'The correct solution is as follows:' || chr(10) || '4' || chr(10) ELSE text END AS c FROM m WHERE n >= 2),
a AS (SELECT conv_id, k * 2 AS p, role || ': ' || c AS line FROM w UNION ALL SELECT DISTINCT conv_id, 3, 'user: five' FROM w)
SELECT conv_id, count(*) AS n_messages, md5(string_agg(line, chr(10) ORDER BY p)) AS messages_md5 FROM a GROUP BY conv_id""")
def chat_messages(spark, sf_dir):
    """Prepared training messages of each conversation."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    rows = A.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(ordered.alias("m"))
    rows = rows.withColumn("m", P.prepared_messages(F.col("m"), F.lit("Ana is a 7th grade student."), F.lit("4"), F.lit("five"))).where("m is not null")
    text = F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n")
    return rows.select("conv_id", F.size("m").cast("long").alias("n_messages"), F.md5(text).alias("messages_md5"))


@flow("""WITH s AS (SELECT 'K.' || r_name AS id, r_name AS description, 'Domain' AS level, 'G' || r_regionkey % 2 AS parent FROM region
  UNION ALL SELECT 'K.' || r_name || '.' || n_nationkey, n_name, 'Cluster', 'K.' || r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
c AS (SELECT s_suppkey AS d, CASE s_suppkey % 3 WHEN 0 THEN 'G0' WHEN 1 THEN 'ASIA' ELSE 'G1' END AS cat FROM supplier UNION SELECT s_suppkey, 'EUROPE' FROM supplier),
p AS (SELECT DISTINCT d, id FROM c JOIN s ON level = 'Domain' AND (ends_with(id, '.' || cat) OR parent = cat))
SELECT d, string_agg('ID: ' || s.id || ', Description: ' || s.description, '; ' ORDER BY 'ID: ' || s.id || ', Description: ' || s.description) AS options FROM p JOIN s ON s.parent = p.id GROUP BY d""")
def cluster_options(spark, sf_dir):
    region, nation = A.table(spark, sf_dir, "region"), A.table(spark, sf_dir, "nation")
    name = F.concat(F.lit("K."), F.col("r_name"))
    domains = region.select(name.alias("id"), F.col("r_name").alias("description"), F.lit("Domain").alias("level"), F.concat(F.lit("G"), (F.col("r_regionkey") % 2).cast("string")).alias("parent"))
    clusters = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(name, F.lit("."), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("description"), F.lit("Cluster").alias("level"), name.alias("parent"))
    standards, key = domains.unionByName(clusters), F.col("s_suppkey")
    category = F.explode(F.array(F.when(key % 3 == 0, "G0").when(key % 3 == 1, "ASIA").otherwise("G1"), F.lit("EUROPE")))
    chosen = A.table(spark, sf_dir, "supplier").select(key.alias("d"), category.alias("category"))
    return N.options_of(N.clusters_of(chosen, standards), standards).select("d", F.array_join("options", "; ").alias("options"))


_RATED = """WITH r AS (SELECT CAST(user_id % 3 AS INT) AS rater, event_id // 9 AS d, event_id % 9 AS turn, CASE WHEN event_id % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END AS predicted,
  CASE WHEN event_id % 10 = 0 THEN 0.0 WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id % 3 > 0 AS INT) END AS accuracy, CASE WHEN event_id % 7 = 0 THEN 1 ELSE event_id % 4 + 1 END AS rating FROM events),
s AS (SELECT *, d % 4 AS subject, d % 3 = 0 AS accepted FROM r WHERE turn > 0)"""


@flow(f"""{_RATED}, l AS (SELECT rater, d, arg_max(accuracy, turn) FILTER (accuracy IS NOT NULL) AS a, arg_max(predicted, turn) AS p, any_value(accepted) AS accepted FROM s GROUP BY 1, 2)
SELECT rater, count(*) AS n, round(avg(CASE WHEN a IS NULL THEN NULL ELSE CAST(((a <> 0) = (p = 'TRUE')) = accepted AS INT) END), 8) AS rater_accuracy, round(avg(CAST((p = 'TRUE') = accepted AS INT)), 8) AS ai_accuracy FROM l GROUP BY rater""")
def rater_final_accuracy(spark, sf_dir):
    rows = rating.final_accuracy(A.event_ratings(spark, sf_dir))
    return rows.select("rater", "n", _rounded(F.col("rater_accuracy"), "rater_accuracy"), _rounded(F.col("ai_accuracy"), "ai_accuracy"))


@flow(f"""{_RATED}, l AS (SELECT rater, d, arg_max(accuracy, turn) FILTER (accuracy IS NOT NULL) AS a, arg_max(predicted, turn) AS p, any_value(accepted) AS accepted FROM s GROUP BY 1, 2),
g AS (SELECT rater, avg(CASE WHEN a IS NULL THEN NULL ELSE CAST(((a <> 0) = (p = 'TRUE')) = accepted AS INT) END) AS x FROM l GROUP BY rater) SELECT round(avg(x), 8) AS mean, round(stddev_pop(x), 8) AS std FROM g""")
def rater_accuracy_summary(spark, sf_dir):
    return rating.over_raters(rating.final_accuracy(A.event_ratings(spark, sf_dir))).select(_rounded(F.col("mean"), "mean"), _rounded(F.col("std"), "std"))


@flow(f"{_RATED} SELECT subject, round(avg(rating), 8) AS mean_rating, count(*) AS n FROM s GROUP BY subject")
def rater_subject_means(spark, sf_dir):
    return rating.subject_means(A.event_ratings(spark, sf_dir)).select("subject", _rounded(F.col("mean_rating"), "mean_rating"), "n")


@flow(f"{_RATED}, k AS (SELECT *, row_number() OVER (PARTITION BY rater, d ORDER BY turn DESC) AS back FROM s) SELECT rater, count(*) AS n, round(avg(rating), 8) AS mean_rating FROM k WHERE back > 1 GROUP BY rater")
def rater_without_last(spark, sf_dir):
    rows = rating.without_last(A.event_ratings(spark, sf_dir))
    return rows.groupBy("rater").agg(F.count("*").alias("n"), _rounded(F.avg("rating"), "mean_rating"))


_FAMILY_NAMES = [name for name, _ in T.STRICT_FAMILIES] + ["OTHER"]
_FAMILY_SQL = "CASE d % 7 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_FAMILY_NAMES)) + " END"


def _families(spark, sf_dir) -> DataFrame:
    return A.profiles(spark, sf_dir).withColumn("family", T.misconception_family(F.col("profile")))


@flow(f"""WITH x AS (SELECT doc_id AS d, quality, CASE WHEN doc_id % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM labels WHERE doc_id IN (SELECT doc_id FROM documents))
SELECT {_FAMILY_SQL} AS family, round(avg(CASE WHEN split = 'train' THEN quality END), 8) AS train, round(avg(CASE WHEN split = 'test' THEN quality END), 8) AS test FROM x GROUP BY 1""")
def family_correctness(spark, sf_dir):
    """Mean label by family and split."""
    rows = _families(spark, sf_dir).join(A.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("d"), "quality"), "d")
    return rows.groupBy("family").pivot("split", ["train", "test"]).agg(F.round(F.avg("quality"), 8))


@flow(f"""WITH f AS (SELECT unnest([{', '.join(f"'{x}'" for x in _FAMILY_NAMES)}]) AS family, unnest(range({len(_FAMILY_NAMES)})) AS place), c AS (SELECT {_FAMILY_SQL} AS family, count(*) AS n FROM (SELECT doc_id AS d FROM documents WHERE doc_id % 7 < 3) GROUP BY 1)
SELECT place, f.family, coalesce(n, 0) AS n FROM f LEFT JOIN c ON f.family = c.family""")
def family_coverage(spark, sf_dir):
    """All families in their order, with 0 where none of the chosen dialogues has it."""
    names = spark.createDataFrame([(i, x) for i, x in enumerate(_FAMILY_NAMES)], "place long, family string")
    counts = _families(spark, sf_dir).where("d % 7 < 3").groupBy("family").agg(F.count("*").alias("n"))
    return names.join(counts, "family", "left").select("place", "family", F.coalesce("n", F.lit(0)).alias("n"))


@flow("""WITH g AS (SELECT p_size AS a, ascii(p_brand[-1]) AS b, min(p_partkey) AS ordinal, round(avg(p_retailprice % 7), 2) AS auc FROM part GROUP BY 1, 2)
SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, auc FROM g ORDER BY auc DESC, ordinal LIMIT 1""")
def grid_argmax(spark, sf_dir):
    """Best setting of a grid; the earliest of equal ones."""
    runs = A.table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("long").alias("a"), F.ascii(F.right("p_brand", F.lit(1))).cast("long").alias("b")).agg(F.min("p_partkey").alias("ordinal"), F.round(F.avg(F.col("p_retailprice") % 7), 2).alias("auc"))
    return ranks.best_setting(runs, "auc", "ordinal").select("a", "b", "auc")


@flow("""WITH o AS (SELECT o_orderkey AS d, md5('221-' || o_orderkey) AS h FROM orders), t AS (SELECT d, row_number() OVER (ORDER BY h, d) - 1 AS p, count(*) OVER () AS n FROM o WHERE d % 5 <> 0),
s AS (SELECT d, CASE WHEN p < floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'validation' END AS slice FROM t UNION ALL SELECT d, 'test' FROM o WHERE d % 5 = 0)
SELECT slice, count(*) AS n, CAST(sum(d) AS BIGINT) AS d_sum FROM s GROUP BY slice""")
def holdout_split(spark, sf_dir):
    """The train file in 80 % train and 20 % validation, the test file as it is."""
    rows = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("d"), F.md5(F.concat(F.lit("221-"), F.col("o_orderkey").cast("string"))).alias("h"))
    placed = ranks.with_position(rows.where("d % 5 != 0"), "h", "d")
    out = ranks.holdout(placed, F.lit(False)).select("d", "slice").unionByName(rows.where("d % 5 = 0").select("d", F.lit("test").alias("slice")))
    return out.groupBy("slice").agg(F.count("*").alias("n"), F.sum("d").alias("d_sum"))


@flow(f"""WITH f AS (SELECT doc_id AS d, {_FAMILY_SQL.replace('d %', 'doc_id %')} AS family FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 11 <> 0),
k AS (SELECT family, d, row_number() OVER (PARTITION BY family ORDER BY md5('draw-' || d)) AS k FROM f) SELECT family, d, k FROM k WHERE k <= 7""")
def stratified_draw(spark, sf_dir):
    """Seven new dialogues of each family; raises if one of them is already used."""
    rows = _families(spark, sf_dir).where("split = 'train'").withColumn("h", F.md5(F.concat(F.lit("draw-"), F.col("d").cast("string"))))
    used = rows.where("d % 11 = 0").select("d")
    drawn = rows.join(used, "d", "left_anti").withColumn("k", F.row_number().over(Window.partitionBy("family").orderBy("h")).cast("long")).where("k <= 7")
    both = drawn.join(used.withColumn("again", F.lit(True)), "d", "left")
    return both.select("family", "d", F.when(F.col("again"), F.raise_error("drawn twice").cast("long")).otherwise(F.col("k")).alias("k"))


@flow("SELECT 0 AS lost, 0 AS changed, count(*) FILTER (o_orderkey % 10 = 0) AS added FROM orders")
def append_check(spark, sf_dir):
    rows = A.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return ranks.unchanged_prefix(rows.where("o_orderkey % 10 != 0"), rows, F.col("o_orderkey") % 10 == 0)


_PARAMETERS = "kp AS (SELECT kc, sum(correct) / count(*) AS share FROM obs GROUP BY kc), par AS (SELECT kc, share AS prior, share / 4 AS learns, share / 3 AS guesses, share / 5 AS slips FROM kp)"


def _parameters(obs: DataFrame) -> DataFrame:
    share = U.skill_stats(obs).select("kc", (F.col("n_correct") / F.col("n")).alias("share"))
    return share.select("kc", F.col("share").alias("prior"), (F.col("share") / 4).alias("learns"), (F.col("share") / 3).alias("guesses"), (F.col("share") / 5).alias("slips"))


@flow(f"""WITH RECURSIVE {TURNS}, {_PARAMETERS}, seq AS (SELECT *, row_number() OVER (PARTITION BY d, kc ORDER BY turn, pos) AS k FROM obs),
walk AS (SELECT s.*, p.prior AS b, learns, guesses, slips FROM seq s JOIN par p ON s.kc = p.kc WHERE k = 1
 UNION ALL SELECT s.*, (CASE WHEN w.correct = 1 THEN w.b * (1 - slips) / (w.b * (1 - slips) + (1 - w.b) * guesses) ELSE w.b * slips / (w.b * slips + (1 - w.b) * (1 - guesses)) END) * (1 - learns) + learns, learns, guesses, slips
 FROM walk w JOIN seq s ON s.d = w.d AND s.kc = w.kc AND s.k = w.k + 1)
SELECT kc, count(*) AS n, round(avg(b * (1 - slips) + (1 - b) * guesses), 8) AS mean_p FROM walk GROUP BY kc""")
def bkt_forward_param_table(spark, sf_dir):
    """Forward predictions with each skill's own parameters."""
    obs = _obs(spark, sf_dir)
    return bkt.predict(obs, _parameters(obs)).groupBy("kc").agg(F.count("*").alias("n"), _rounded(F.avg("p"), "mean_p"))


@flow(f"""WITH {TURNS}, {_PARAMETERS}, u AS (UNPIVOT par ON prior, learns, guesses, slips INTO NAME parameter VALUE v)
SELECT parameter, count(*) AS n, round(avg(v), 8) AS mean, round(stddev_samp(v), 8) AS std, round(min(v), 8) AS least, round(quantile_cont(v, 0.25), 8) AS q25, round(median(v), 8) AS median, round(quantile_cont(v, 0.75), 8) AS q75, round(max(v), 8) AS most,
 count(*) FILTER (abs(v - 0.5) <= 1e-8 + 1e-5 * 0.5) AS at_bound FROM u GROUP BY parameter""")
def parameter_summary(spark, sf_dir):
    return bkt.summary(_parameters(_obs(spark, sf_dir)), 0.5).select("parameter", "n", *[_rounded(F.col(c), c) for c in ("mean", "std", "least", "q25", "median", "q75", "most")], "at_bound")


@flow(f"WITH {TURNS}, {_PARAMETERS} SELECT count(*) AS n, 0 AS missing, CAST(0 AS DOUBLE) AS max_diff FROM par")
def parameter_reload(spark, sf_dir):
    """Parameters written to the shared folder and read back, against the computed ones."""
    own = _parameters(_obs(spark, sf_dir))
    back = stored(own, "parameters")
    both = own.withColumnsRenamed({x: f"own_{x}" for x in bkt.DEFAULTS}).withColumn("here", F.lit(1)).join(back.withColumn("there", F.lit(1)), "kc", "full")
    gap = F.greatest(*[F.abs(F.col(f"own_{x}") - F.col(x)) for x in bkt.DEFAULTS])
    return both.agg(F.count("*").alias("n"), F.sum(F.when(F.col("here").isNull() | F.col("there").isNull(), 1).otherwise(0)).cast("long").alias("missing"), F.max(gap).alias("max_diff"))


@flow(f"WITH {TURNS}, k AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY turn DESC, pos) AS r FROM obs) SELECT kc, count(*) AS n, CAST(sum(correct) AS BIGINT) AS n_correct FROM k WHERE r = 1 GROUP BY kc")
def final_pseudo_rows(spark, sf_dir):
    rows = U.first_of_last_turn(_obs(spark, sf_dir))
    return rows.groupBy("kc").agg(F.count("*").alias("n"), F.sum("correct").cast("long").alias("n_correct"))


@flow(f"WITH {TURNS}, t AS (SELECT d, turn, min(correct) AS lo, max(correct) AS hi FROM obs GROUP BY 1, 2), a AS (SELECT count(*) AS turns, round(avg(lo), 8) AS by_turn, bool_and(lo = hi) AS constant FROM t), b AS (SELECT count(*) AS observations, round(avg(correct), 8) AS by_observation FROM obs) SELECT * FROM a, b")
def correctness_units(spark, sf_dir):
    """Mean correctness by turn and by observation, and whether every turn has one label."""
    obs = _obs(spark, sf_dir)
    turns = obs.groupBy("d", "turn").agg(F.min("correct").alias("lo"), F.max("correct").alias("hi"), F.count("*").alias("n"), F.sum("correct").alias("c"))
    out = turns.agg(F.count("*").alias("turns"), _rounded(F.avg("lo"), "by_turn"), F.bool_and(F.col("lo") == F.col("hi")).alias("constant"), F.sum("n").alias("observations"), F.sum("c").alias("c"))
    return out.select("turns", "by_turn", "constant", "observations", _rounded(F.col("c") / F.col("observations"), "by_observation"))


@flow("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '\"pi' || n_nationkey || '\"' ELSE '{\"turn 1\":' || n_nationkey || '}' END AS result FROM nation")
def lm_output_parse(spark, sf_dir):
    """JSON of a model's answer: broken, under ``result``, and bare."""
    key = F.col("n_nationkey").cast("string")
    broken, wrapped = F.concat(F.lit("```json{\"result\": "), key, F.lit("```")), F.concat(F.lit("so ```json{\"result\": \"\\(\\pi"), key, F.lit("\\)\"}```"))
    text = F.when(F.col("n_nationkey") % 3 == 0, broken).when(F.col("n_nationkey") % 3 == 1, wrapped).otherwise(F.concat(F.lit("result = {\"turn 1\": "), key, F.lit("}")))
    return A.table(spark, sf_dir, "nation").select("n_nationkey", T.lm_json(text).alias("result"))
