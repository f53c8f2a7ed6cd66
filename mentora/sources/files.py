"""Dialogue files: JSON lines, JSON documents and CSV in and out, delimited conversations as utterances."""

from __future__ import annotations

import ast
import json
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only for local sessions that name no shared folder.
LOCAL_SHARED = "file:///tmp/checkpoints"
# The end of a message and the speaker with an optional act in brackets.
END_OF_MESSAGE = "[|]EOM[|]"
SPEAKER = r"^[a-zA-Z]+: (\([a-z]+\))?"


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """With a schema the file is read once; without, Spark reads it all first to find one."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def typical(df: DataFrame, confusion: str, interactions: str) -> DataFrame:
    """Rows with both typicality scores; null and 0 count as missing."""
    return df.where((F.coalesce(F.col(confusion), F.lit(0)) != 0) & (F.coalesce(F.col(interactions), F.lit(0)) != 0))


def split_conversation(df: DataFrame, key: str, conversation: str) -> DataFrame:
    """(d, pos, role, content) of conversations whose messages are joined by ``|EOM|``.

    A message that begins with Teacher is the teacher's, any other the student's. Its speaker and a lower-case act
    in brackets are cut off.
    """
    rows = df.select(F.col(key).alias("d"), F.posexplode(F.split(conversation, END_OF_MESSAGE)).alias("pos", "m"))
    role = F.when(F.startswith("m", F.lit("Teacher")), "teacher").otherwise("student")
    return rows.select("d", "pos", role.alias("role"), F.regexp_replace("m", SPEAKER, "").alias("content"))


def read_json_array(spark: SparkSession, path: str, schema: str, without: dict[str, str] | None = None) -> DataFrame:
    """Rows of a file that is one JSON array, with their place in it as ``index``; rows with a value of ``without`` go.

    The file is one value and has to fit a task; larger data come as JSON lines.
    """
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", f"array<struct<{schema}>>")).alias("index", "x")).select("index", "x.*")
    for column, value in (without or {}).items():
        rows = rows.where(F.col(column) != value)
    return rows


def literal_to_json(values: pd.Series) -> pd.Series:
    def one(text):
        try:
            return None if text is None else json.dumps(ast.literal_eval(text), ensure_ascii=False)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None

    return values.map(one)


def parse_literals(df: DataFrame, schemas: dict[str, str]) -> DataFrame:
    """Columns that hold Python literals as typed values; a text that is no literal gives null. No built-in function
    reads such literals, so they become JSON in Arrow batches."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{c: literal_to_json(frame[c]) for c in schemas})

    return df.mapInPandas(batches, df.schema).withColumns({c: F.from_json(c, t) for c, t in schemas.items()})


def read_csv_strings(spark: SparkSession, *paths: str) -> DataFrame:
    """CSV files with a header as one table of strings; quotes are doubled inside quotes and blank fields are ''."""
    rows = spark.read.csv(list(paths), header=True, inferSchema=False, multiLine=True, quote='"', escape='"', nullValue="\u0000", emptyValue="")
    return rows.na.fill("")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nested columns as JSON."""
    nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct")]
    df.withColumns({c: F.to_json(c) for c in nested}).write.csv(path, header=True, quote='"', escape='"')


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(name, id) of a JSON object of numbers, such as the dictionary of skills."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,int>")).alias("name", "id"))


def write_ids(df: DataFrame, path: str) -> None:
    """(name, id) as one JSON object by id, non-ASCII characters kept. The dictionary is one value and has to fit a task."""
    entries = F.transform(F.array_sort(F.collect_list(F.struct("id", "name"))), lambda x: F.struct(x["name"].alias("key"), x["id"].alias("value")))
    df.agg(F.to_json(F.map_from_entries(entries)).alias("value")).coalesce(1).write.text(path)


def read_standards(spark: SparkSession, path: str) -> DataFrame:
    """(id, description, level, parent) of JSON lines; a description ends before its line of grades and has no line breaks."""
    rows = read_jsonl(spark, path, "id string, description string, level string, parent string")
    return rows.withColumn("description", F.replace(F.substring_index("description", "\nGrade", 1), F.lit("\n"), F.lit(" ")))


def read_raters(spark: SparkSession, *paths: str) -> DataFrame:
    """Rater files (CSV) as one table with the rater's number, from the end of the file's name."""
    rows = spark.read.csv(list(paths), header=True, inferSchema=False)
    return rows.withColumn("rater", F.regexp_extract(F.input_file_name(), r"([0-9]+)\.csv[^/]*$", 1).cast("int"))


def read_label_cache(spark: SparkSession, path: str) -> DataFrame:
    """(d, turn, label, reason) of files dialogue_N.json, each a map from "turn N" to label and reason."""
    d = F.regexp_extract(F.input_file_name(), r"dialogue_([0-9]+)\.json", 1).cast("long").alias("d")
    rows = spark.read.text(path, wholetext=True).select(d, F.explode(F.from_json("value", "map<string,struct<label:string,reason:string>>")).alias("turn", "x"))
    return rows.select("d", F.regexp_extract("turn", "([0-9]+)", 1).cast("int").alias("turn"), "x.label", "x.reason")


def later_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: that with the greatest ``order``, such as the last fold that gives a result."""
    names = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*names), order).alias("x")).select(key, "x.*")


def separated(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Report rows as strings with an empty row after each dialogue, in order of ``key`` and ``order``."""
    texts = [F.col(c).cast("string").alias(c) for c in rows.columns]
    blank = rows.select(key).distinct().select(F.col(key).alias("_key"), F.lit(1).alias("_end"), F.lit(None).cast("long").alias("_order"), *[F.lit("").alias(c) for c in rows.columns])
    named = rows.select(F.col(key).alias("_key"), F.lit(0).alias("_end"), F.col(order).cast("long").alias("_order"), *texts)
    return named.unionByName(blank).orderBy("_key", "_end", "_order").drop("_key", "_end", "_order")


def annotated_file(dataset: str, tags: str, split: str = "", folder: str = "data/annotated") -> str:
    return f"{folder}/{dataset}{f'_{split}' if split else ''}_{tags}.csv"


def dictionary_file(dataset: str, tags: str, folder: str = "data/annotated") -> str:
    return f"{folder}/kc_dict_{dataset}_{tags}.json"


def new_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder ``spark.checkpoint.dir``; local sessions may leave that unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "local")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = LOCAL_SHARED
    return f"{root}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it from there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
