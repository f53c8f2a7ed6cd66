"""Files made from the driver's tables, written to the shared folder and read back, with SQL of what has to come back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentora.operators import annotations as N
from mentora.operators import bkt, metrics
from mentora.operators import turns as U
from mentora.plans.sql import SQL, TURNS
from mentora.plans.tracing import TRACING, TRACING_SQL
from mentora.sources import adapters as A
from mentora.sources import datasets, files, reports

FILING: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
FILING_SQL: dict[str, str] = {}


def filing(sql: str):
    def add(f):
        FILING[f.__name__], FILING_SQL[f.__name__] = f, sql
        return f

    return add


def _text(rows: DataFrame, path: str) -> str:
    rows.coalesce(1).write.text(path)
    return path


@filing(f"WITH c AS ({SQL['turns_coalesced']}) SELECT c.d AS index, turn, teacher, student, CASE WHEN c.d % 3 = 0 THEN 'Algebra' ELSE 'Elementary' END AS level FROM c WHERE c.d % 5 <> 1")
def array_source(spark, sf_dir):
    """Conversations as one JSON array, every fifth of a level that is left out, read as the data set comta."""
    folder, level = files.new_path(spark, "src"), F.when(F.col("conv_id") % 5 == 1, "Calculus").when(F.col("conv_id") % 3 == 0, "Algebra").otherwise("Elementary")
    said = A.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("data"))
    sample = F.struct("conv_id", F.struct("data", F.lit("Answer Accepted").alias("expected_result"), level.alias("math_level")).alias("x"))
    holes = spark.range(said.agg(F.max("conv_id")).head()[0] + 1).select(F.col("id").alias("conv_id")).join(said, "conv_id", "left")  # the index is the number
    array = holes.agg(F.to_json(F.transform(F.array_sort(F.collect_list(sample)), lambda s: s["x"])).alias("value"))
    _text(array, f"{folder}/CoMTA_dataset.json")
    rows = datasets.load_dialogues(spark, "comta", folder).select("index", F.explode("dialogue").alias("t"), "meta_data.math_level")
    return rows.select("index", F.col("t.turn").cast("long").alias("turn"), "t.teacher", "t.student", F.col("math_level").alias("level"))


@filing("""WITH x AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS index, o_custkey % 4 AS a, o_custkey % 3 AS b FROM orders)
SELECT CAST(index AS BIGINT) AS index, CAST(1 AS BIGINT) AS turn, 'Why ' || o_orderkey || '?' AS teacher, 'I see. Ok' AS student, CAST(a AS INT) AS confusion, CAST(b AS INT) AS interactions FROM x WHERE a > 0 AND b > 0""")
def lines_source(spark, sf_dir):
    """Orders as delimited conversations, one JSON line each, with missing typicality scores, read as the data set mathdial."""
    folder, key = files.new_path(spark, "src"), F.col("o_orderkey").cast("string")
    talk = F.concat(F.lit("Teacher: (probing)Why "), key, F.lit("?|EOM|Sam: I see|EOM|Sam:  Ok "))
    score = lambda k: F.when(F.col("o_custkey") % k != 0, (F.col("o_custkey") % k).cast("int"))
    rows = A.table(spark, sf_dir, "orders").select("o_orderkey", talk.alias("conversation"), F.lit("q").alias("question"), score(4).alias("self-typical-confusion"), score(3).alias("self-typical-interactions"))
    rows.orderBy("o_orderkey").drop("o_orderkey").write.json(f"{folder}/mathdial/data/train.jsonl")
    rows = datasets.load_dialogues(spark, "mathdial", folder, "train").select("index", F.explode("dialogue").alias("t"), "meta_data")
    return rows.select("index", F.col("t.turn").cast("long").alias("turn"), "t.teacher", "t.student", F.col("meta_data.self_typical_confusion").alias("confusion"), F.col("meta_data.self_typical_interactions").alias("interactions"))


_ANNOTATED = "x AS (SELECT o_orderkey AS d, CAST(o_orderkey AS VARCHAR) AS i, md5('221-' || o_orderkey) AS h, o_custkey % 4 AS a, o_custkey % 3 AS b, o_orderkey % 5 = 0 AS test FROM orders)"


@filing(f"""WITH {_ANNOTATED}, t AS (SELECT d, row_number() OVER (ORDER BY h, i) - 1 AS p, count(*) OVER () AS n FROM x WHERE NOT test AND a >= 2 AND b >= 2)
SELECT d, CASE WHEN p < floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'validation' END AS slice, '["k' || d || '",7]' AS kcs FROM t UNION ALL SELECT d, 'test', '["k' || d || '",7]' FROM x WHERE test AND a >= 2 AND b >= 2""")
def annotated_source(spark, sf_dir):
    """Orders as annotated train and test files with Python literals, read back as slices, literals as JSON."""
    folder, key = files.new_path(spark, "annotated"), F.col("o_orderkey").cast("string")
    meta = F.to_json(F.struct((F.col("o_custkey") % 4).cast("string").alias("self_typical_confusion"), (F.col("o_custkey") % 3).cast("string").alias("self_typical_interactions")))
    rows = A.table(spark, sf_dir, "orders").select(key.alias("index"), meta.alias("meta_data"), F.concat(F.lit("['k"), key, F.lit("', 7]")).alias("kcs"))
    for split, part in (("train", rows.where("index % 5 != 0")), ("test", rows.where("index % 5 = 0"))):
        files.write_csv(part, files.annotated_file("mathdial", "base", split, folder))
    back = datasets.load_annotated(spark, "mathdial", "base", folder, typical_cutoff=2)
    literal = files.parse_literals(back.select("index", "slice", "kcs"), {"kcs": "array<string>"})
    kcs = F.concat(F.lit('["'), F.get("kcs", F.lit(0)), F.lit('",'), F.get("kcs", F.lit(1)), F.lit("]"))
    return literal.select(F.col("index").cast("long").alias("d"), "slice", kcs.alias("kcs"))


@filing(f"WITH {TURNS}, t AS (SELECT d, turn, count(*) AS n, list(kc ORDER BY pos) AS kcs FROM obs WHERE split = 'test' GROUP BY d, turn) SELECT d, CAST(count(*) AS BIGINT) AS turns, CAST(sum(n) AS BIGINT) AS skills, CAST(CASE WHEN d % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS fold, string_agg(array_to_string(kcs, '+'), ';' ORDER BY turn) AS kcs FROM t GROUP BY d")
def kc_probability_files(spark, sf_dir):
    """Probabilities of skills as files of two folds, the second with every other dialogue again; the later file counts."""
    rows = bkt.predict(U.observations(A.annotated_turns(spark, sf_dir)).where("split = 'test'"))
    paths = [f"{files.new_path(spark, 'kc-results')}-{i}" for i in (0, 1)]
    reports.write_kc_probabilities(rows.withColumn("p", F.lit(0.5)), paths[0])
    reports.write_kc_probabilities(rows.where("d % 2 = 0"), paths[1])
    back = reports.read_kc_probabilities(spark, *paths)
    return back.select("d", F.size("turns").cast("long").alias("turns"), F.aggregate("turns", F.lit(0), lambda n, t: n + F.size(t)).cast("long").alias("skills"), F.col("fold").cast("long").alias("fold"), F.array_join(F.transform("turns", lambda t: F.array_join(F.map_keys(t), "+")), ";").alias("kcs"))


@filing(f"""WITH c AS ({SQL['turns_coalesced']}), r AS (SELECT d, d + 1 AS k, turn, CAST(d + 1 AS VARCHAR) AS id, CAST(turn AS VARCHAR) AS t, CASE WHEN teacher = '' THEN '--' ELSE teacher END AS q, student AS a, CASE WHEN turn = 0 THEN '1' ELSE '' END AS m FROM c WHERE d % 3 = 0)
SELECT id, t, md5(q) AS question, md5(a) AS answer, m AS mark, CAST(count(*) AS BIGINT) AS n FROM (SELECT id, t, q, a, m FROM r UNION ALL SELECT '', '', '', '', '' FROM (SELECT DISTINCT d FROM r)) GROUP BY ALL""")
def human_evaluation_file(spark, sf_dir):
    """Every third dialogue as a table for people to rate, an empty row after each, written as CSV and read back."""
    turns = U.coalesce_turns(A.utterances(spark, sf_dir)).where("d % 3 = 0").withColumns({"og": F.lit(None).cast("boolean"), "kcs": F.array(F.lit("a"), F.lit("b"))})
    path = files.new_path(spark, "human-eval")
    reports.write_table_csv(reports.human_table(turns), path)
    back = files.read_csv_strings(spark, path)
    names = {"Dialogue ID": "id", "Turn": "t", "Correctness Accuracy": "mark"}
    return back.select(*[F.col(k).alias(v) for k, v in names.items()], F.md5("Tutor Question").alias("question"), F.md5("Student Response").alias("answer")).groupBy("id", "t", "question", "answer", "mark").agg(F.count("*").alias("n"))


@filing(f"SELECT 'Overall (' || n || chr(32) || 'samples):' AS head, printf('Acc: %.2f, AUC: %.2f, Prec: %.2f, Rec: %.2f, F1: %.2f', accuracy * 100, auc * 100, \"precision\" * 100, recall * 100, f1 * 100) AS metrics FROM ({SQL['turn_metrics']})")
def metric_report(spark, sf_dir):
    """The metrics of turns as a text file, read back."""
    turns = metrics.turn_probabilities(bkt.predict(U.observations(A.annotated_turns(spark, sf_dir)))).withColumn("p", F.round("p", 9))
    path = files.new_path(spark, "metrics")
    reports.write_text(reports.metric_lines(metrics.scores(metrics.drop_first_turns(turns))), path)
    lines = spark.read.text(path, wholetext=True).select(F.split(F.rtrim("value"), "\n").alias("x"))
    return lines.select(F.get("x", F.lit(0)).alias("head"), F.get("x", F.lit(1)).alias("metrics"))


_TEX = "CASE metric WHEN 'accuracy' THEN 'Acc' WHEN 'auc' THEN 'AUC' WHEN 'precision' THEN 'Prec' WHEN 'recall' THEN 'Rec' ELSE 'F1' END"


@filing(f"SELECT {_TEX} || printf(': $%.2f_{{\\pm %.2f}}$', mean * 100, std * 100) AS line FROM ({TRACING_SQL['crossval_metrics']}) WHERE metric IN ('accuracy', 'auc', 'precision', 'recall', 'f1')")
def crossval_report(spark, sf_dir):
    """Mean and deviation of metrics over folds as a text file, read back line by line."""
    path = files.new_path(spark, "crossval")
    reports.write_text(reports.fold_lines(TRACING["crossval_metrics"](spark, sf_dir)), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@filing("WITH p AS (SELECT o_orderkey AS d FROM orders WHERE o_orderkey % 7 = 0) SELECT 'file' AS source, CAST(count(*) AS BIGINT) AS n, CAST(sum(d) AS BIGINT) AS d_sum FROM p UNION ALL SELECT '1', CAST(count(*) AS BIGINT), CAST(sum(o_orderkey) AS BIGINT) FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'table', CAST(count(*) AS BIGINT), CAST(sum(d) AS BIGINT) FROM p")
def pinned_id_chain(spark, sf_dir):
    """Ids from a pinned file, from memory where there is none, and the table written once beside it."""
    orders = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("d"))
    path = files.new_path(spark, "pinned")
    reports.write_pinned_ids(orders.where("d % 7 = 0"), path, seed=23)
    reports.write_once(orders.where("d % 7 = 0"), f"{path}-table")
    found = [reports.pinned_ids(spark, path, orders), reports.pinned_ids(spark, f"{path}-missing", None, orders.where("d % 2 = 0")), (files.read_csv_strings(spark, f"{path}-table"), "table")]
    out = None
    for rows, source in found:
        one = rows.agg(F.lit(source).alias("source"), F.count("*").alias("n"), F.sum(F.col("d").cast("long")).alias("d_sum"))
        out = one if out is None else out.unionByName(one)
    return out


@filing("SELECT s_suppkey AS d, 'Nation ' || n_name || ' of ' || r_name AS kc FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def standards_file(spark, sf_dir):
    """Nations as standards in JSON lines, with a line of grades that is cut off; suppliers' ids become descriptions."""
    nations = A.table(spark, sf_dir, "nation").join(A.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    text = F.concat(F.lit("Nation "), F.col("n_name"), F.lit("\nof "), F.col("r_name"), F.lit("\nGrade 3\nmore"))
    path = files.new_path(spark, "standards")
    files.write_jsonl(nations.select(F.col("n_nationkey").cast("string").alias("id"), text.alias("description"), F.lit("Standard").alias("level"), F.col("r_name").alias("parent")), path)
    tags = A.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("d"), F.lit(1).alias("turn"), F.array(F.col("s_nationkey").cast("string")).alias("ids"))
    return N.described_standards(tags, files.read_standards(spark, path)).select("d", F.get("kcs", F.lit(0)).alias("kc"))


@filing("SELECT CAST(user_id % 3 AS INT) AS rater, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS events, count(*) FILTER (event_id % 4 = 0) AS blanks FROM events GROUP BY 1")
def rater_files(spark, sf_dir):
    """Events as three rater files with blank fields, read as one table with the rater from the file's name."""
    folder = files.new_path(spark, "raters")
    rows = A.table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("r"), "event_id", F.when(F.col("event_id") % 4 != 0, "x").alias("note"))
    for i in range(3):
        files.write_csv(rows.where(F.col("r") == i).select("event_id", "note"), f"{folder}/rater_{i}.csv")
    # Spark names the parts of a written file itself, so the rater is the folder's.
    back = spark.read.csv([f"{folder}/rater_{i}.csv" for i in range(3)], header=True, inferSchema=False).withColumn("rater", F.regexp_extract(F.input_file_name(), r"rater_([0-9]+)\.csv", 1).cast("int"))
    return back.groupBy("rater").agg(F.count("*").alias("n"), F.sum(F.col("event_id").cast("long")).alias("events"), F.count(F.when(F.col("note").isNull(), 1)).alias("blanks"))
