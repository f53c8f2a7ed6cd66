"""Best-fit decreasing packing of token pieces into fixed-length sequences.

Best-fit decreasing looks only at lengths, and pieces of one length are alike. So the distributed part counts
pieces by length, the driver packs that histogram (at most ``capacity`` numbers, whatever the corpus) with a
segment tree over remaining capacities, and every piece finds its place from its rank among equal lengths. The
result is what packing all pieces one by one gives.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mentora.llm.bpe import default_vocabulary, encoder
from mentora.llm.storage import lean, write_table

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, local_rank long"


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity; a leaf holds how many groups of bins have that much left."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, remaining: int, n: int) -> None:
        i = remaining + self.leaves
        while i:
            self.count[i] += n
            i >>= 1

    def tightest(self, need: int) -> int | None:
        """The least remaining capacity of at least ``need`` that some bin has."""
        i = need + self.leaves
        if self.count[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit_plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, end rank, first bin, pieces a bin, offset), by length and rank.

    Bins with the same content form one group, so a whole run of equal pieces goes in one step. A bin that takes a
    piece is the tightest for the next one as long as it fits, so each bin of a group takes all it can in turn.
    """
    tree, open_groups, bins, plan = CapacityTree(capacity), {}, 0, []

    def put(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            open_groups.setdefault(remaining, []).append((first, n))
            tree.add(remaining, 1)

    for length in sorted(counts, reverse=True):
        rank, total = 0, counts[length]
        while rank < total:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining = capacity
                first, n = bins, -(-(total - rank) // (capacity // length))
                bins += n
            else:
                first, n = open_groups[remaining].pop()
                tree.add(remaining, -1)
            each, left = remaining // length, total - rank
            full = min(n, left // each)
            over = left - full * each if full < n else 0
            if full:
                plan.append((length, rank, rank + full * each, first, each, capacity - remaining))
                put(remaining - each * length, first, full)
                rank += full * each
            if over:
                plan.append((length, rank, rank + over, first + full, each, capacity - remaining))
                put(remaining - over * length, first + full, 1)
                rank += over
            used = full + (over > 0)
            put(remaining, first + used, n - used)
    return np.array(sorted(plan), np.int64).reshape(-1, 6)


def token_pieces(docs: DataFrame, capacity: int, end_id: int, vocabulary: str) -> DataFrame:
    """Pieces of every document with their checksum and their rank among equal lengths of the same task."""

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        encode = encoder(vocabulary)
        for batch in batches:
            ids_of_doc = batch.column("doc_id").to_pylist()
            for first, end, ids, at in encode.column_ids(batch.column("text")):
                rows = []
                for row in range(end - first):
                    own = np.append(ids[at[row] : at[row + 1]], np.uint32(end_id)).astype("<u4")
                    size = len(own)
                    cuts = [0, *range(size % capacity or capacity, size + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        rows.append((ids_of_doc[first + row], k, a, b - a, zlib.crc32(own[a:b].tobytes()), task, int(seen[b - a])))
                        seen[b - a] += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "local_rank"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2, vocabulary: str | None = None) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    A document is its BPE ids and ``end_id``. Only one longer than ``capacity`` is cut, into pieces of that length,
    of which the first may be shorter. Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset.
    A null or empty text is one piece with the end id alone; a null doc_id stays null; repeated rows are packed each;
    an empty table gives no rows; other columns are ignored.
    """
    vocabulary = vocabulary or default_vocabulary()
    pieces = write_table(token_pieces(docs, capacity, end_id, vocabulary), "pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = best_fit_plan(counts, capacity)
    ranked = pieces.join(bases.drop("n"), ["task", "length"]).withColumn("rank", F.col("base") + F.col("local_rank"))

    @lean
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = int(plan[:, 2].max()) + 1 if len(plan) else 1
        keys = [plan[plan[:, 0] == x] for x in range(capacity + 1)]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            bin_id, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                of = np.flatnonzero(length == x)
                own = keys[x]
                step = own[np.searchsorted(own[:, 1], np.minimum(rank[of], top), "right") - 1]
                nth = rank[of] - step[:, 1]
                bin_id[of], offset[of] = step[:, 3] + nth // step[:, 4], step[:, 5] + nth % step[:, 4] * x
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(bin_id), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
