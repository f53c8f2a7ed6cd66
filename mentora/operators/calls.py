"""Calls of a language model, or of any function of a prompt, through a cache table that several runs share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mentora.sources.files import stored

CACHE = "key string, system string, prompt string, response string, model string"
#: Files of the cache table also have the prompts without answer, their errors and the run of each row.
ATTEMPTS = f"{CACHE}, error string, run string"
#: A task asks at least so many prompts where there are as many, as each task writes a file.
TASK_PROMPTS = 500
#: A provider gets a prompt and a system message (or None) and gives the answer, or raises.
Provider = Callable[[str, str | None], str]
#: Adds the column prompt to rows, next to what they have.
Prompts = Callable[[DataFrame], DataFrame]


@dataclass
class Calls:
    """Answered rows, and what was done for them. ``failures`` has the prompts without answer and their errors."""

    rows: DataFrame
    asked: int
    answered: int
    failures: DataFrame


class CallsFailed(RuntimeError):
    """Some prompts have no answer; all answers are in the cache, so another run asks only for the rest."""

    def __init__(self, calls: Calls):
        super().__init__(f"{calls.asked - calls.answered} of {calls.asked} prompts were not answered")
        self.calls = calls


def _key(model: str, system: str | None, prompt: Column) -> Column:
    return F.sha2(F.concat_ws("\0", F.lit(model), F.lit("null" if system is None else system), prompt), 256)


def _answers(provider: Provider, system: str | None, batch: int, keep: bool = True) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds response and error to rows with a prompt, ``batch`` calls of a task at a time; takes the prompt away unless ``keep``."""

    def one(prompt: str) -> tuple[str | None, str | None]:
        try:
            return provider(prompt, system), None
        except Exception as error:  # whatever a provider raises is this prompt's failure
            return None, f"{type(error).__name__}: {error}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(batch) as pool:
            for rows in batches:
                for first in range(0, rows.num_rows, batch):
                    part = rows.slice(first, batch)
                    found = list(pool.map(one, part.column("prompt").to_pylist()))
                    part = part if keep else part.drop_columns("prompt")
                    yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([x[i] for x in found], pa.string()) for i in (0, 1))], [*part.schema.names, "response", "error"])

    return run


def _attempts(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(ATTEMPTS).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ATTEMPTS)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache table at ``path``; empty where there is none yet."""
    return _attempts(spark, path).where("response is not null").drop("error", "run")


def cached_calls(rows: DataFrame, provider: Provider, cache: str, model: str, system: str | None = None, batch: int = 10, wave: int = 100_000, tasks: int | None = None, strict: bool = True, by: str | None = None, prompts: Prompts | None = None) -> Calls:
    """``rows`` (prompt, ...) with a ``response`` for each non-null prompt.

    Only distinct prompts that the cache lacks for this model and system message are sent, each task with ``batch`` calls at
    a time. A task's answers are appended to the cache when it ends, whatever becomes of the others; a prompt whose call
    raises counts as failed and the others go on. All prompts are one job, whose tasks have about ``wave`` prompts for each
    ``spark.sql.shuffle.partitions`` of them, but TASK_PROMPTS at least. With ``tasks``, no more than so many run at a time,
    and the prompts go in jobs of about ``wave``. At the end failures raise CallsFailed unless not ``strict``. A task that
    Spark repeats asks its prompts again. A null prompt gets no response.

    ``by`` and ``prompts`` are for long prompts: a column without nulls that tells all rows apart, and what adds the prompt to
    rows that lack it. Then prompts are neither shuffled nor written: they are made for their keys, and once more, of the
    rows that are sent, in the tasks that send them. The cache has null in their place, and ``rows`` of the result lack them.
    """
    spark, run = rows.sparkSession, uuid.uuid4().hex
    make = prompts or (lambda some: some)
    keyed = make(rows).withColumn("_key", _key(model, system, F.col("prompt")))
    have = read_cache(spark, cache).where(F.col("model") == model)
    keys = keyed.where("prompt is not null")
    keys = stored(keys.select("_key", by), "prompt-keys") if by else keys
    distinct = keys.groupBy(F.col("_key").alias("key")).agg(F.min(by or "prompt").alias(by or "prompt"))
    wanted = stored(distinct.join(have.select("key"), "key", "left_anti"), "wanted-prompts")
    asked, slots = wanted.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    waves = max(1, -(-asked // wave)) if tasks else 1
    width = tasks or max(slots, -(-asked // max(TASK_PROMPTS, wave // slots)))
    for number in range(waves if asked else 0):
        part = wanted.where(F.pmod(F.xxhash64("key"), F.lit(waves)) == number) if waves > 1 else wanted
        if by:
            sent = make(rows.join(part.withColumnRenamed("key", "_key"), by)).select(F.col("_key").alias("key"), "prompt")
            sent = sent.coalesce(tasks) if tasks else sent
        else:
            sent = part.repartition(width, "key")
        found = sent.mapInArrow(_answers(provider, system, batch, keep=not by), f"key string, {'' if by else 'prompt string, '}response string, error string")
        prompt = F.lit(None).cast("string").alias("prompt") if by else F.col("prompt")
        named = found.select("key", F.lit(system).cast("string").alias("system"), prompt, "response", "error", F.lit(run).alias("run"), F.lit(model).alias("model"))
        # Version 2 moves a task's file into the table when the task ends, not when all have ended.
        named.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("model").parquet(cache)
    own = _attempts(spark, cache).where((F.col("model") == model) & (F.col("run") == run))
    answered = own.where("response is not null").count() if asked else 0
    failures = own.where("response is null").select("key", "prompt", F.coalesce("error", F.lit("no response")).alias("error"))
    if by:
        failures = make(rows.join(failures.join(wanted, "key").select(by, F.col("error").alias("_error")), by)).select("prompt", F.col("_error").alias("error"))
    # Runs that overlap may have asked the same.
    known = read_cache(spark, cache).where(F.col("model") == model).groupBy(F.col("key").alias("_key")).agg(F.min("response").alias("response"))
    if by:
        answers = rows.join(keys.join(known, "_key").select(by, "response"), by, "left").select(*rows.columns, "response")
    else:
        answers = keyed.join(known, "_key", "left").drop("_key")
    out = Calls(answers, asked, answered, failures.select("prompt", "error"))
    if answered < asked and strict:
        raise CallsFailed(out)
    return out


@dataclass
class CachedAsk:
    """Asks a provider about rows with an id d, through a cache table; the step is the system message."""

    provider: Provider
    cache: str
    model: str

    def __call__(self, rows: DataFrame, step: str) -> DataFrame:
        """``rows`` (d, prompt) with a response."""
        return cached_calls(rows, self.provider, self.cache, self.model, step).rows

    def late(self, rows: DataFrame, prompts: Prompts, step: str) -> DataFrame:
        """``rows`` (d, ...) with a response to the prompts that ``prompts`` adds to them."""
        return cached_calls(rows, self.provider, self.cache, self.model, step, by="d", prompts=prompts).rows


def uncached_calls(rows: DataFrame, provider: Provider, system: str | None = None, batch: int = 10, tasks: int | None = None) -> DataFrame:
    """``rows`` (prompt, ...) with response and error, one call for each row, equal prompts too: for sampled answers and
    prompts that continue a history. The answers are written once, so that later steps don't ask again."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "response string", "error string"])
    spread = rows.repartition(tasks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return stored(spread.mapInArrow(_answers(provider, system, batch), schema), "answers")
