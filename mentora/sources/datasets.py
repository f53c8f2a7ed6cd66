"""Whole data sets by name: source files as dialogues, annotated files as slices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentora.operators import ranks
from mentora.operators.turns import coalesce_turns
from mentora.sources.files import annotated_file, read_csv_strings, read_json_array, split_conversation, stored, typical

# Fields of the source files and the level that is left out.
ARRAY_SCHEMA = "data array<struct<role:string,content:string>>, expected_result string, math_level string"
LINES_SCHEMA = "question string, ground_truth string, student_incorrect_solution string, `self-correctness` string, `self-typical-confusion` int, `self-typical-interactions` int, conversation string"
LEFT_OUT = {"math_level": "Calculus"}
META = {"question": "question", "correct_solution": "ground_truth", "incorrect_solution": "student_incorrect_solution", "self_correctness": "self-correctness", "self_typical_confusion": "self-typical-confusion", "self_typical_interactions": "self-typical-interactions"}


def with_line_index(spark: SparkSession, path: str) -> DataFrame:
    """(index, value) of all lines of the files at ``path``, numbered from 0 by file name and place in the file."""
    place = {"_path": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"), "_line": F.monotonically_increasing_id()}
    rows = stored(spark.read.text(path).select("value", *[c.alias(k) for k, c in place.items()]), "lines")
    return ranks.with_position(rows, "_path", "_start", "_line").select(F.col("position").alias("index"), "value")


def _turns(said: DataFrame) -> DataFrame:
    """(d, dialogue) of utterances: the coalesced turns as one array; a dialogue without turns has an empty one."""
    turns = coalesce_turns(said).groupBy("d").agg(F.array_sort(F.collect_list(F.struct("turn", "teacher", "student"))).alias("dialogue"))
    return said.select("d").distinct().join(turns, "d", "left").select("d", F.coalesce("dialogue", F.array().cast(turns.schema["dialogue"].dataType)).alias("dialogue"))


def comta(spark: SparkSession, folder: str, split: str = "") -> DataFrame:
    """The one array file; every role but user is the teacher. It has no splits, so ``split`` counts for nothing."""
    rows = stored(read_json_array(spark, f"{folder}/CoMTA_dataset.json", ARRAY_SCHEMA, LEFT_OUT), "array")
    role = F.when(F.col("x.role") == "user", "student").otherwise("teacher")
    said = rows.select(F.col("index").alias("d"), F.posexplode("data").alias("pos", "x")).select("d", "pos", role.alias("role"), F.col("x.content").alias("content"))
    meta = rows.select(F.col("index").alias("d"), F.struct("expected_result", "math_level").alias("meta_data"))
    return meta.join(_turns(said), "d").select(F.col("d").cast("long").alias("index"), "dialogue", "meta_data")


def mathdial(spark: SparkSession, folder: str, split: str = "") -> DataFrame:
    """The line file of a ``split``, rows that lack a typicality score left out; ``index`` counts all its lines."""
    lines = with_line_index(spark, f"{folder}/mathdial/data/{split}.jsonl").select("index", F.from_json("value", LINES_SCHEMA).alias("x")).select("index", "x.*")
    rows = stored(typical(lines, "self-typical-confusion", "self-typical-interactions"), "lines")
    meta = rows.select(F.col("index").alias("d"), F.struct(*[F.col(f"`{c}`").alias(k) for k, c in META.items()]).alias("meta_data"))
    return meta.join(_turns(split_conversation(rows, "index", "conversation")), "d").select(F.col("d").alias("index"), "dialogue", "meta_data")


DATASETS: dict[str, Callable[[SparkSession, str, str], DataFrame]] = {f.__name__: f for f in (comta, mathdial)}


def load_dialogues(spark: SparkSession, dataset: str, folder: str = "data/src", split: str = "") -> DataFrame:
    """(index, dialogue, meta_data) of a data set by name; an unknown name raises ValueError. A null or empty conversation has
    an empty dialogue in which nobody speaks and is left out."""
    if dataset not in DATASETS:
        raise ValueError(f"no loader of the data set {dataset}")
    return DATASETS[dataset](spark, folder, split)


def load_annotated(spark: SparkSession, dataset: str, tags: str, folder: str = "data/annotated", fold: int | str = 1, typical_cutoff: int = 1) -> DataFrame:
    """The annotated files of a data set as strings, ``meta`` as a map, and ``slice``: train, validation or test.

    comta: the rotation ``fold`` of 1 to 5, or the subject ``fold`` as test and 80 % of the rest as train. mathdial: 80 % of
    the train file as train and the test file, rows of both below ``typical_cutoff`` left out. Order is that of md5 of
    the index. An unknown data set or fold raises ValueError.
    """
    def read(split: str) -> DataFrame:
        rows = read_csv_strings(spark, annotated_file(dataset, tags, split, folder))
        return rows.withColumns({"meta": F.from_json("meta_data", "map<string,string>"), "_h": F.md5(F.concat(F.lit("221-"), F.col("index")))})

    if dataset == "comta":
        rows = read("")
        if fold in range(1, 6):
            out = ranks.fold_slices(ranks.with_position(rows, "_h", "index")).where(F.col("fold") == fold)
        elif isinstance(fold, str):
            subject = F.coalesce(F.col("meta")["math_level"] == fold, F.lit(False))
            out = ranks.holdout(ranks.with_position(rows.where(~subject), "_h", "index"), F.lit(False)).select(*rows.columns, "slice").unionByName(rows.where(subject).withColumn("slice", F.lit("test")))
        else:
            raise ValueError(f"no fold {fold}")
    elif dataset == "mathdial":
        enough = F.lit(True)
        for x in ("self_typical_confusion", "self_typical_interactions"):
            enough = enough & (F.coalesce(F.col("meta")[x].try_cast("int"), F.lit(0)) >= typical_cutoff)
        # The cut at 80 % comes after the filter.
        rows, test = read("train").where(enough), read("test").where(enough)
        out = ranks.holdout(ranks.with_position(rows, "_h", "index"), F.lit(False)).select(*rows.columns, "slice").unionByName(test.withColumn("slice", F.lit("test")), allowMissingColumns=True)
    else:
        raise ValueError(f"no annotated files of the data set {dataset}")
    return out.drop("_h", "position", "total", "fold")
