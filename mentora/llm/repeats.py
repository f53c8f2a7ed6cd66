"""Word runs that stand in more than one place, by fixed-block anchors.

The index holds blocks of (window + 1) // 2 words that lie end to end in every document, so each window of a document
contains a whole block of it, its anchor. All rolling windows of block length probe the index. A block that is found
elsewhere too is a hit and is extended to both sides: every window around it whose words stand elsewhere belongs to a
repeat, and neighbouring ones make up the maximal repeats.

Documents lie in blocks of a few megabytes, which stay where they are. What blocks exchange are arrays of hashes, one
row for each block and cell of the hash space, without places: the answer is a bitmap in the same order. Each array holds
a hash once, so a passage of very many documents counts once a block, and cells are even. Blocks are found by 32 bits of
the hash and the cell, whose number grows with the data; windows are decided by 64 more bits than the cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentora.llm.lm import range_of
from mentora.llm.ngram_join import _groups
from mentora.llm.storage import Scratch, arrow_batches, co_located, lean
from mentora.llm.words import POWER_BASE, mix, text_slices, word_hashes

#: Bytes of text in a block of documents; a longer text stands alone.
BLOCK_BYTES = 2 << 20
#: Bytes of text for one word, by which cells are planned to hold CELL_WORDS hashes.
WORD_BYTES = 6
CELL_WORDS = 1 << 21
SECOND_BASE = np.uint64(0xD6E8FEB86659FD93)
#: Blocks, or arrays of one cell, that a Python function gets at a time.
BLOCK_ROWS = 2
ARRAY_ROWS = 64


def run_hashes(words: np.ndarray, starts: np.ndarray, length: int, base: np.uint64 = POWER_BASE) -> np.ndarray:
    """Hash of the ``length`` words from each of ``starts``, from prefix sums of a polynomial modulo 2 ** 64."""
    power = np.full(len(words) + 1, base)
    power[0] = 1
    back = np.full(len(words) + 1, np.uint64(pow(int(base), -1, 1 << 64)))
    back[0] = 1
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words * np.cumprod(power, dtype=np.uint64)[:-1])])
    return mix((sums[starts + length] - sums[starts]) * np.cumprod(back, dtype=np.uint64)[starts])


class Block:
    """The words of a block of texts and, for texts of at least one window, its anchors and probes."""

    def __init__(self, texts: pa.Array, window: int):
        self.window, self.anchor = window, (window + 1) // 2
        self.slices, hashes, counts = [], [], []
        for first, end, data, at in text_slices(texts):
            words, offsets, begin, stop = word_hashes(data, at, fold=False, places=True)
            self.slices.append((first, end, data, begin, stop))
            hashes.append(words)
            counts.append(np.diff(offsets))
        self.words = np.concatenate([np.zeros(0, np.uint64), *hashes])
        self.count = np.concatenate([np.zeros(0, np.int64), *counts])
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        place = np.arange(len(self.words)) - np.repeat(self.first[:-1], self.count)
        left = np.repeat(self.count, self.count) - place
        long = np.repeat(self.count >= window, self.count)
        self.probes = np.flatnonzero(long & (left >= self.anchor))
        self.windows = np.flatnonzero(long & (left >= window))
        self.anchor_of = self.windows + (-place[self.windows]) % self.anchor
        aligned = place[self.probes] % self.anchor == 0
        self.anchors = self.probes[aligned]
        # Distinct hashes; those of an anchor come first within their cell.
        self.value, inverse, self.times = np.unique(run_hashes(self.words, self.probes, self.anchor), return_inverse=True, return_counts=True)
        self.value_of_anchor = inverse[aligned]
        self.is_anchor = np.zeros(len(self.value), bool)
        self.is_anchor[self.value_of_anchor] = True

    def probe_rows(self, cells: int) -> tuple[np.ndarray, np.ndarray]:
        """(order of the distinct hashes by cell, cell of each in that order)."""
        cell = range_of(self.value, cells)
        order = np.argsort(2 * cell.astype(np.int64) + ~self.is_anchor, kind="stable")
        return order, cell[order]

    def candidates(self, hits: dict[int, bytes], cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows whose anchor is a hit: their starts, distinct hashes, cells of these, which each window has, how often
        each hash occurs here, and the hashes' order by cell. ``hits`` are bits of the anchors' hashes by cell."""
        order, cell = self.probe_rows(cells)
        found = self.times > 1
        order, cell = order[self.is_anchor[order]], cell[self.is_anchor[order]]
        for c, bits in hits.items():
            a, b = np.searchsorted(cell, [c, c + 1])
            found[order[a:b]] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        good = np.zeros(len(self.words) + 1, bool)
        good[self.anchors] = found[self.value_of_anchor]
        starts = self.windows[good[self.anchor_of]]
        value, at, which, times = np.unique(run_hashes(self.words, starts, self.window), return_index=True, return_inverse=True, return_counts=True)
        cell = range_of(run_hashes(self.words, starts[at], self.window, SECOND_BASE), cells)
        return starts, value, cell, which, times, np.argsort(cell, kind="stable")

    def covered(self, hits: dict[int, bytes], verified: dict[int, bytes], cells: int) -> np.ndarray:
        """Which words lie in a window that stands elsewhere too."""
        starts, value, cell, which, times, order = self.candidates(hits, cells)
        found = times > 1
        cell = cell[order]
        for c, bits in verified.items():
            a, b = np.searchsorted(cell, [c, c + 1])
            found[order[a:b]] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        edge = np.zeros(len(self.words) + 1, np.int64)
        starts = starts[found[which]]
        edge[starts] += 1
        edge[starts + self.window] -= 1
        return np.cumsum(edge)[:-1] > 0

    def kept_texts(self, covered: np.ndarray) -> pa.Array:
        """The words of every text that are not covered, joined by one space."""
        out, done = [], 0
        for first, end, data, begin, stop in self.slices:
            keep = ~covered[done : done + len(begin)]
            row = np.repeat(np.arange(end - first), self.count[first:end])[keep]
            done += len(begin)
            begin, size = begin[keep], (stop - begin)[keep] + 1  # one more byte, the space after a word
            at = np.concatenate([[0], np.cumsum(size)])
            chars = np.append(data, np.uint8(32))[np.minimum(np.repeat(begin - at[:-1], size) + np.arange(at[-1]), len(data))]
            chars[at[1:] - 1] = 32
            last = np.ones(len(row), bool)
            last[:-1] = row[1:] != row[:-1]
            ends = at[np.searchsorted(row, np.arange(end - first), "right")]
            gone = np.zeros(len(chars), bool)
            gone[at[1:][last] - 1] = True
            offsets = np.concatenate([[0], ends - np.cumsum(np.bincount(row[last], minlength=end - first))])
            out.append(pa.Array.from_buffers(pa.large_string(), end - first, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(chars[~gone]))]))
        return pa.concat_arrays(out) if out else pa.array([], pa.large_string())


def _maximal(covered: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of covered words of every row, first word and end counted within the row, and the rows' offsets."""
    held = np.concatenate([[False], covered, [False]])
    edge = np.zeros(len(covered) + 1, bool)
    edge[first] = True
    starts = np.flatnonzero(held[1:-1] & (~held[:-2] | edge[:-1]))
    ends = np.flatnonzero(held[1:-1] & (~held[2:] | edge[1:])) + 1
    row = np.searchsorted(first, starts, "right") - 1
    return starts - first[row], ends - first[row], np.searchsorted(starts, first)


def _lists(cell: np.ndarray, values: np.ndarray, kind: pa.DataType) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(cells, offsets of their rows, list of values) from values ordered by cell."""
    numbers, at = np.unique(cell, return_index=True)
    offsets = np.append(at, len(cell))
    return numbers, offsets, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def repeated_spans(docs: DataFrame, window: int = 35) -> DataFrame:
    """Maximal word runs of every text of ``docs`` (doc_id, text) that windows standing elsewhere too make up.

    A word is a run of characters other than the space and the control characters 9 to 13. A window is ``window`` words
    of one document; it counts if the same words start anywhere else, the same document included. Returns doc_id,
    n_words, spans (start, end in words, end exclusive) and kept, the other words joined by one space. All copies count
    alike, repeated rows too. A null, empty or blank text has no words and keeps an empty text; a text of fewer words
    than a window has no spans; a null doc_id stays null; an empty table gives no rows; other columns, whatever their
    names, are ignored; texts are taken whole. At least two words make a window.
    """
    if window < 2:
        raise ValueError("a window has at least two words")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    @lean
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            for first, end, data, _ in text_slices(batch.column("text"), BLOCK_BYTES):
                n = end - first
                lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), batch.column(c).slice(first, n)) for c in ("doc_id", "text")]
                yield pa.RecordBatch.from_arrays([batch.column("part").slice(first, 1), pa.array([number], pa.int32()), pa.array([len(data)], pa.int64()), *lists], ["part", "block", "bytes", "ids", "texts"])
                number += 1

    with arrow_batches(spark, 4096, BLOCK_BYTES):
        blocks = scratch.write_parts(rows.mapInArrow(pack, "part int, block int, bytes long, ids array<long>, texts array<string>"), "repeat-blocks")
    cells = max(1, -(-(blocks.agg(F.sum("bytes")).head()[0] or 0) // (WORD_BYTES * CELL_WORDS)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, Block]]:
        for batch in batches:
            texts = batch.column("texts")
            for i in range(batch.num_rows):
                yield batch, i, Block(texts[i].values, window)

    def bits_of(batch: pa.RecordBatch, column: str, i: int) -> dict[int, bytes]:
        return {x["cell"]: x["bits"] for x in batch.column(column)[i].as_py() or ()}

    def sent(batch: pa.RecordBatch, i: int, numbers: np.ndarray, asked: np.ndarray, lists: pa.Array) -> pa.RecordBatch:
        own = [pa.array(np.full(len(numbers), batch.column(c)[i].as_py(), np.int32)) for c in ("part", "block")]
        return pa.RecordBatch.from_arrays([pa.array(numbers.astype(np.int32)), *own, pa.array(asked.astype(np.int32)), lists], ["cell", "part", "block", "asked", "hashes"])

    @lean
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, block in each(batches):
            order, cell = block.probe_rows(cells)
            numbers, offsets, lists = _lists(cell, block.value[order].astype(np.uint32).view(np.int32), pa.int32())
            yield sent(batch, i, numbers, np.add.reduceat(block.is_anchor[order], offsets[:-1], dtype=np.int64) if len(order) else offsets[:-1], lists)

    @lean
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, block in each(batches):
            _, value, cell, _, _, order = block.candidates(bits_of(batch, "hits", i), cells)
            numbers, offsets, lists = _lists(cell[order], value[order].view(np.int64), pa.int64())
            yield sent(batch, i, numbers, np.diff(offsets), lists)

    @lean
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For the first ``asked`` hashes of every array of a cell, which of them another array has too."""
        for table in _groups(batches, ("cell",)):
            lists = table.column("hashes").combine_chunks()
            _, which, times = np.unique(lists.values.to_numpy()[lists.offsets[0].as_py() : lists.offsets[-1].as_py()], return_inverse=True, return_counts=True)
            shared = times[which] > 1
            at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            asked = table.column("asked").to_numpy()
            some = [k for k, (a, n) in enumerate(zip(at[:-1].tolist(), asked.tolist(), strict=True)) if shared[a : a + n].any()]
            if some:
                bits = pa.array([np.packbits(shared[at[k] : at[k] + asked[k]]).tobytes() for k in some], pa.binary())
                yield pa.RecordBatch.from_arrays([*(pa.array(table.column(c).to_numpy()[some]) for c in ("part", "block", "cell")), bits], ["part", "block", "cell", "bits"])

    def answers(from_blocks: DataFrame, function: Callable, kind: str, name: str) -> DataFrame:
        """Blocks send arrays to the cells; (part, block, ``name``) comes back, cells and bits of each block."""
        arrays = from_blocks.mapInArrow(function, f"cell int, part int, block int, asked int, hashes array<{kind}>")
        with arrow_batches(spark, ARRAY_ROWS):
            met = scratch.write(arrays.repartition("cell").sortWithinPartitions("cell").mapInArrow(meet, "part int, block int, cell int, bits binary"), name)
        return scratch.write(met.groupBy("part", "block").agg(F.collect_list(F.struct("cell", "bits")).alias(name)), name)

    def joined(table: DataFrame, answer: DataFrame) -> DataFrame:
        return table.join(answer.hint("shuffle_hash"), ["part", "block"], "left")

    @lean
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, block in each(batches):
            covered = block.covered(bits_of(batch, "hits", i), bits_of(batch, "verified", i), cells)
            starts, ends, at = _maximal(covered, block.first)
            spans = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.StructArray.from_arrays([pa.array(starts.astype(np.int32)), pa.array(ends.astype(np.int32))], ["start", "end"]))
            texts = block.kept_texts(covered)
            yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(block.count), spans, pc.cast(texts, pa.string())], ["doc_id", "n_words", "spans", "kept"])

    with co_located(spark), arrow_batches(spark, BLOCK_ROWS):
        hits = answers(blocks.drop("ids"), probe, "int", "hits")
        verified = answers(joined(blocks.drop("ids"), hits), verify, "long", "verified")
        out = scratch.write(joined(joined(blocks, hits), verified).mapInArrow(finish, "doc_id long, n_words long, spans array<struct<start:int,end:int>>, kept string"), "repeats")
    scratch.drop_all_but(out)
    return out


def repeat_digests(spans: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of the rows of ``repeated_spans``."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return spans.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
