"""Result files: metric texts, probabilities of skills, tables for reading by people, pinned ids."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentora.functions.text import correct_to_str, skills_to_str
from mentora.sources.files import separated

# Names of metrics in reports and column names of the tables.
METRIC_NAMES = {"accuracy": "Acc", "auc": "AUC", "precision": "Prec", "recall": "Rec", "f1": "F1"}
HUMAN_COLUMNS = ("Dialogue ID", "Turn", "Tutor Question", "Student Response", "Predicted Correctness", "Correctness Accuracy", "Predicted Standards", "Standards Rating")


def metric_lines(scores: DataFrame) -> DataFrame:
    """(value) of one-row ``scores``: a line of counts and one of percentages with two places."""
    shown = F.concat_ws(", ", *[F.concat(F.lit(f"{name}: "), F.format_string("%.2f", F.col(c) * 100)) for c, name in METRIC_NAMES.items()])
    return scores.select(F.concat(F.lit("Overall ("), F.col("n").cast("string"), F.lit(" samples):\n"), shown).alias("value"))


def fold_lines(folds: DataFrame) -> DataFrame:
    """(value) of ``over_folds``: one line a metric, mean and deviation in percent as a TeX formula, in report order."""
    order = F.array(*map(F.lit, METRIC_NAMES))
    names = F.create_map(*[F.lit(x) for kv in METRIC_NAMES.items() for x in kv])
    line = F.format_string("%s: $%.2f_{\\pm %.2f}$", names[F.col("metric")], F.col("mean") * 100, F.col("std") * 100)
    rows = folds.where(F.col("metric").isin(*METRIC_NAMES)).select(F.array_position(order, F.col("metric")).alias("k"), line.alias("line"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("value"))


def write_text(lines: DataFrame, path: str) -> None:
    """A report of one value as text; the value has to fit a task."""
    lines.select("value").coalesce(1).write.text(path)


def write_kc_probabilities(predictions: DataFrame, path: str) -> None:
    """JSON lines {"d": ..., "turns": [{skill: probability}, ...]} of predictions (d, turn, pos, kc, p), in order."""
    turn = predictions.groupBy("d", "turn").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("pos", "kc", "p"))), lambda x: F.struct(x["kc"].alias("k"), x["p"].alias("v")))).alias("kcs"))
    turn.groupBy("d").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.to_json("kcs").alias("kcs")))), lambda x: F.from_json(x["kcs"], "map<string,double>")).alias("turns")).write.json(path)


def read_kc_probabilities(spark: SparkSession, *paths: str) -> DataFrame:
    """(d, turns, fold) of the files of several folds, numbered as given; of a dialogue that stands in more, the last."""
    schema, out = "d long, turns array<map<string,double>>", None
    for fold, path in enumerate(paths):
        rows = spark.read.schema(schema).json(path).withColumn("fold", F.lit(fold))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("d").agg(F.max_by("turns", "fold").alias("turns"), F.max("fold").alias("fold"))


def human_table(turns: DataFrame) -> DataFrame:
    """Rows for people to rate, of labelled turns (d, turn, teacher, student, og, kcs), dialogues apart by an empty row."""
    first = F.col("turn") == 0
    columns = (F.col("d") + 1, F.col("turn"), F.coalesce(F.nullif("teacher", F.lit("")), F.lit("--")), F.col("student"), correct_to_str(F.col("og")), F.when(first, "1").otherwise(""), skills_to_str(F.col("kcs"), "\n"), F.when(first, "4").otherwise(""))
    return separated(turns.select(*[c.alias(name) for c, name in zip(columns, HUMAN_COLUMNS, strict=True)]), "Dialogue ID", "Turn")


def write_table_csv(rows: DataFrame, path: str) -> None:
    """A report as CSV with header in the order of its rows."""
    rows.write.csv(path, header=True, quote='"', escape='"', emptyValue="")


def write_once(rows: DataFrame, path: str, write: bool = True) -> bool:
    """A CSV that is never replaced: where there is one already the write fails. Says whether it was written."""
    if write:
        rows.write.mode("errorifexists").csv(path, header=True, quote='"', escape='"')
    return write


def write_pinned_ids(ids: DataFrame, path: str, **facts: int) -> None:
    """{"dialogue_ids": [...], ...} of ids (d), sorted, each once, in one file; it is never replaced. The ids have to fit a task."""
    listed = F.array_sort(F.collect_set("d")).alias("dialogue_ids")
    ids.agg(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in facts.items()], listed)).alias("value")).coalesce(1).write.mode("errorifexists").text(path)


def pinned_ids(spark: SparkSession, path: str, *others: DataFrame | None) -> tuple[DataFrame, str]:
    """(d) of the pinned file and "file"; where there is none, of the first of ``others`` (d, ...) that is given, and its
    number. Nothing at all raises ValueError."""
    try:
        rows = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        return rows.select(F.explode(F.from_json("value", "dialogue_ids array<long>")["dialogue_ids"]).alias("d")), "file"
    for number, frame in enumerate(others):
        if frame is not None:
            return frame.select(F.col("d").cast("long").alias("d")).distinct(), str(number)
    raise ValueError(f"no ids at {path} and none in memory")
