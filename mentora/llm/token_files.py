"""Token ids as Parquet list columns, written in document order and read back.

Each range of doc_id is one file. Ids are dictionary-encoded with zstd pages, doc_id and the running token
position are delta-encoded, row groups hold about ``group_tokens`` ids and a page index is written, so a reader can
fetch some documents, or the metadata columns alone, without touching the rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mentora.llm.bpe import default_vocabulary, encoder
from mentora.llm.storage import shared_dir, write_bytes, write_table

FILE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("position", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _with_end(ids: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The end id after every row."""
    ends = at[1:]
    return np.insert(ids, ends, np.uint32(end_id)), at + np.arange(len(at))


def write_token_files(docs: DataFrame, path: str, end_id: int = 0, vocabulary: str | None = None, group_tokens: int = 1 << 20) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) to files below ``path``, in ascending doc_id order over all files.

    Returns the manifest: file, part, n_docs, n_tokens. A null or empty text has the end id alone; rows without
    doc_id come first; repeated rows are written each; an empty table writes no file; other columns are ignored.
    """
    vocabulary = vocabulary or default_vocabulary()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, name, docs_n, total, rest = TaskContext.get().partitionId(), "", 0, 0, iter(batches)
        head = next((b for b in rest if b.num_rows), None)
        if head is None:
            return
        name = f"tokens-{part:08d}.parquet"

        def fill(sink) -> None:
            nonlocal docs_n, total
            encode, held, held_tokens = encoder(vocabulary), [], 0
            with pq.ParquetWriter(sink, FILE_SCHEMA, compression="zstd", compression_level=1, use_dictionary=["ids.list.element"], column_encoding={"doc_id": "DELTA_BINARY_PACKED", "position": "DELTA_BINARY_PACKED", "n_tokens": "DELTA_BINARY_PACKED"}, data_page_size=1 << 18, write_page_index=True) as out:
                for batch in (x for y in ([head], rest) for x in y):
                    for first, end, ids, at in encode.column_ids(batch.column("text")):
                        ids, at = _with_end(ids, at, end_id)
                        held.append(pa.Table.from_arrays([batch.column("doc_id").slice(first, end - first), pa.array(total + at[:-1]), pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.view(np.int32)))], schema=FILE_SCHEMA))
                        docs_n, total, held_tokens = docs_n + end - first, total + int(at[-1]), held_tokens + int(at[-1])
                        if held_tokens >= group_tokens:
                            out.write_table(pa.concat_tables(held), row_group_size=1 << 30)
                            held, held_tokens = [], 0
                if held:
                    out.write_table(pa.concat_tables(held), row_group_size=1 << 30)

        write_bytes(path, name, fill)
        yield pa.RecordBatch.from_pydict({"file": [name], "part": [part], "n_docs": [docs_n], "n_tokens": [total]}, schema=pa.schema([("file", pa.string()), ("part", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return ordered.mapInArrow(write, "file string, part int, n_docs long, n_tokens long")


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None, ids: bool = True) -> DataFrame:
    """(file, doc_id, position, n_tokens[, ids]) of token files, of documents with ``low`` <= doc_id <= ``high`` alone.

    The bounds reach the files' statistics and page indexes, so groups and pages outside are not read; without ``ids``
    only the metadata columns are. Rows without doc_id are in no range, but are read where none is given. The order is
    that of the files.
    """
    rows = spark.read.schema("doc_id long, position long, n_tokens long, ids array<int>").parquet(path)
    for bound, test in ((low, F.col("doc_id") >= F.lit(low)), (high, F.col("doc_id") <= F.lit(high))):
        rows = rows if bound is None else rows.where(test)
    return rows.select(F.col("_metadata.file_name").alias("file"), "doc_id", "position", "n_tokens", *(["ids"] if ids else []))


def token_table(docs: DataFrame, end_id: int = 0, vocabulary: str | None = None) -> DataFrame:
    """Write ``docs`` as token files, read them back and return doc_id, start, n_tokens and ids_crc32 from the files.

    A null or empty text has the end id alone, a null doc_id stays null, repeated rows come back each, an empty table
    gives no rows, other columns are ignored and texts are taken whole.
    """
    spark = docs.sparkSession
    path = shared_dir(spark, "tokens")
    manifest = write_table(write_token_files(docs, path, end_id, vocabulary), "token-manifest")
    if not manifest.head(1):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = manifest.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            at, ids = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<i4", copy=False)
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("doc_id"), batch.column("position"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["file", "doc_id", "position", "n_tokens", "ids_crc32"])

    files = spark.read.schema("doc_id long, position long, n_tokens long, ids array<int>").parquet(path)
    read = files.select(F.col("_metadata.file_name").alias("file"), "doc_id", "position", "ids").mapInArrow(digest, "file string, doc_id long, position long, n_tokens long, ids_crc32 long")
    return read.join(bases, "file").select("doc_id", (F.col("base") + F.col("position")).alias("start"), "n_tokens", "ids_crc32")
