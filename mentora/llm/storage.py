"""Shared storage for tables and array files that outlive a task.

Everything goes below ``spark.checkpoint.dir``, the folder that the driver and all executors see. A table
written there cuts the lineage, so a lost executor costs a read instead of a recomputation.
"""

from __future__ import annotations

import ctypes
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Only for sessions of one machine, such as tests, that name no shared folder.
LOCAL_DEFAULT = "file:///tmp/checkpoints"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Lets a table in buckets by ``part`` join on part and further keys where it lies, and be written without a sort.
CO_LOCATED = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.maxConcurrentOutputFileWriters": "4"}
#: Bytes of a row group of a table in buckets, whose rows are large.
GROUP_BYTES = 16 << 20
#: Bytes of a file of a table whose size is known to be small.
FILE_BYTES = 8 << 20


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``; where that is unset, a local default for local sessions only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "local")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = LOCAL_DEFAULT
    if "://" not in root:
        root = f"file://{os.path.abspath(root.removeprefix('file:'))}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read from there."""
    return Scratch(df.sparkSession).write(df, name)


class Scratch:
    """Tables in the shared folder that one operator writes; those that its result doesn't read are deleted at the end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.tables = spark, [], []

    def write(self, df: DataFrame, name: str, files: int = 0) -> DataFrame:
        """The table in as many files as tasks, or in ``files`` where these are given and fewer."""
        path = shared_dir(self.spark, name)
        (df.coalesce(files) if files else df).write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def files_for(self, *tables: DataFrame) -> int:
        """Files that suffice for a table no larger than ``tables`` of this object, FILE_BYTES each."""
        total = 0
        for folder in {os.path.dirname(f) for df in tables for f in df.inputFiles()}:
            path = next((p for p in self.paths if folder.rstrip("/").endswith(p.rsplit("/", 1)[1])), None)
            if path:
                fs, where = file_system(path)
                total += sum(x.size for x in fs.get_file_info(pafs.FileSelector(where)) if x.is_file)
        return max(1, -(-total // FILE_BYTES))

    def write_parts(self, df: DataFrame, name: str) -> DataFrame:
        """Like ``write``, in buckets by the column ``part``, which is one number a task, so nothing is shuffled.

        Within ``co_located``, joins on part and other columns shuffle the other side alone.
        """
        path, table = shared_dir(self.spark, name), f"spark_catalog.default.parts_{uuid.uuid4().hex}"
        buckets = 2 * int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        with session_conf(self.spark, CO_LOCATED):
            df.write.option("path", path).option("compression", "zstd").option("parquet.block.size", GROUP_BYTES).bucketBy(buckets, "part").saveAsTable(table)
        self.paths.append(path)
        self.tables.append(table)
        return self.spark.table(table)

    def drop_all_but(self, *kept: DataFrame, tables: bool = True) -> None:
        """``kept`` are tables of this object. Files that can't be deleted stay, as they do no harm.

        Names of tables in buckets go as well, unless ``tables`` is false.
        """
        read = {os.path.dirname(f) for df in kept for f in df.inputFiles()}
        while tables and self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop()}")
        for path in self.paths:
            if not any(x.rstrip("/").endswith(path.rsplit("/", 1)[1]) for x in read):
                fs, where = file_system(path)
                try:
                    fs.delete_dir(where)
                except OSError:
                    continue
        self.paths = [p for p in self.paths if any(x.rstrip("/").endswith(p.rsplit("/", 1)[1]) for x in read)]


@contextmanager
def session_conf(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Jobs run inside see ``wanted``; afterwards the settings are as before."""
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@contextmanager
def co_located(spark: SparkSession) -> Iterator[None]:
    """Tables of ``write_parts`` are joined where they lie."""
    with session_conf(spark, CO_LOCATED):
        yield


@contextmanager
def arrow_batches(spark: SparkSession, rows: int, size: int = 1 << 20) -> Iterator[None]:
    """Jobs run inside hand their Python functions at most ``rows`` rows, and about ``size`` bytes, at a time."""
    had = int(spark.conf.get(BATCH_ROWS))
    with session_conf(spark, {BATCH_ROWS: str(min(rows, had) if had > 0 else rows), BATCH_BYTES: str(size)}):
        yield


def small_batches(spark: SparkSession, rows: int = 512, size: int = 1 << 20) -> None:
    """The same from now on, for results that are computed after their operator has returned. Large batches stay with the
    executors as fragments of native memory."""
    had = int(spark.conf.get(BATCH_ROWS))
    spark.conf.set(BATCH_ROWS, str(min(rows, had) if had > 0 else rows))
    spark.conf.set(BATCH_BYTES, str(size))


def lean(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``function``, which at the end of a task gives unused memory back, as its worker waits for other tasks.

    That is Arrow's pool and, where the C library can (``malloc_trim``), what numpy and the tokenizer have freed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return run


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The pyarrow file system of a shared path, for files that tasks write themselves."""
    return pafs.FileSystem.from_uri(uri)


def write_bytes(uri: str, name: str, write) -> None:
    """Let ``write(sink)`` fill a file and show it under its name only when complete; a retried task replaces it."""
    fs, path = file_system(uri)
    fs.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as sink:
        write(sink)
    fs.move(part, f"{path}/{name}")


def local_copy(uri: str, name: str, folder: list[str]) -> str:
    """A path that can be memory-mapped: the file itself on a mounted folder, else a copy in the worker's own temp folder.

    ``folder`` keeps the temp folder for ``drop_copies``.
    """
    fs, path = file_system(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return f"{path}/{name}"
    if not folder:
        folder.append(tempfile.mkdtemp())
    with fs.open_input_stream(f"{path}/{name}") as source, open(f"{folder[0]}/{name}", "wb") as out:
        shutil.copyfileobj(source, out)
    return f"{folder[0]}/{name}"


def drop_copies(folder: list[str]) -> None:
    for x in folder:
        shutil.rmtree(x, ignore_errors=True)
    folder.clear()
