"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

The CGK random walk writes out a word at each step and moves on, or stays, by a random bit that depends on step and
word. Sequences a small edit distance apart fall into step again after each edit, so their embeddings have a small
Hamming distance and agree on a few sampled steps with fair probability. Each repetition has its own walk and sample;
windows of a document that agree with a part of an item in any repetition are verified by word edit distance.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentora.llm.storage import file_system, lean, shared_dir, write_bytes, write_table
from mentora.llm.words import NO_LETTER, mix, text_slices, word_hashes

#: Items of an index. A worker keeps so many indexes; with more it reads each again for every batch of documents.
ITEM_BLOCK = 20_000
KEPT_INDEXES = 2
TABLE_BITS = 20
PART_WORDS = 39
MATCHES = "doc_id long, item_id long, distance int, start_word long, item_words int"


def prefix_distance(item: np.ndarray, text: np.ndarray) -> int:
    """Least word edit distance between ``item`` and a prefix of ``text``."""
    if len(text) >= len(item) and np.array_equal(text[: len(item)], item):
        return 0
    ramp = np.arange(len(text) + 1)
    row = ramp.copy()
    for i, word in enumerate(item.tolist(), 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (text != np.uint64(word)))
        row = np.minimum.accumulate(new - ramp) + ramp
    return int(row.min())


def nearest_window(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least word edit distance between ``item`` and a window of ``text``, and the window's first possible start."""
    ramp = np.arange(len(text) + 1)
    row, back = np.zeros_like(ramp), text[::-1]
    for i, word in enumerate(item[::-1].tolist(), 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (back != np.uint64(word)))
        row = np.minimum.accumulate(new - ramp) + ramp
    row = row[::-1]  # by start
    start = int(row.argmin())
    return int(row[start]), start


class ItemIndex:
    """LSH tables of the parts of a block of items, in classes of similar length.

    Items of more than PART_WORDS words are cut into equal parts. By pigeonhole at least one part of a window within the
    edit bound keeps the bound itself, wherever the edits are, so walks never get longer and recall doesn't fall with length.
    Target recall at the bound of 15 % is 0.99; 16 repetitions of 3 steps reach it (README).
    """

    def __init__(self, item_ids: list[int], items: list[np.ndarray], edit_ratio: float, repetitions: int, samples: int, seed: int = 11):
        self.ids, self.items, self.edit_ratio = item_ids, items, edit_ratio
        rng = np.random.default_rng(seed)
        parts = [(i, int(a), items[i][a:b]) for i in range(len(items)) for cuts in [np.linspace(0, len(items[i]), -(-len(items[i]) // PART_WORDS) + 1).astype(np.int64)] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.part_item, self.part_start = np.array([x[0] for x in parts], np.int64), np.array([x[1] for x in parts], np.int64)
        words_of = [x[2] for x in parts]
        lengths = np.array([len(x) for x in words_of], np.int64)
        self.vocabulary = np.zeros(1 << TABLE_BITS, np.uint64)
        self.classes = []
        low = 1
        while low <= lengths.max(initial=0):
            high = max(low, int(low * 1.5))
            of = np.flatnonzero((lengths >= low) & (lengths <= high))
            if len(of):
                low_here, high_here = int(lengths[of].min()), int(lengths[of].max())
                steps = max(samples, int(1.5 * low_here))
                walks = []
                for r in range(repetitions):
                    coin = rng.integers(0, 2**63, steps, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
                    at = np.sort(rng.choice(steps, samples, replace=False))
                    walks.append((coin, at, np.uint64(rng.integers(0, 2**63))))
                words = np.concatenate([words_of[i] for i in of])
                self.vocabulary[(words >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] |= np.uint64(1 << min(len(self.classes), 63))
                tables = []
                for walk in walks:
                    keys = np.concatenate([self._keys(np.concatenate([words_of[i], np.full(steps, words_of[i][-1])]), np.zeros(1, np.int64), walk, len(words_of[i]) - 1) for i in of])
                    order = np.argsort(keys, kind="stable")
                    tables.append((walk, keys[order], of[order]))
                self.classes.append((low_here, low_here - int(edit_ratio * high_here), tables))
            low = high + 1

    @staticmethod
    def _keys(words: np.ndarray, starts: np.ndarray, walk: tuple, last: int | None = None) -> np.ndarray:
        """Hash of the sampled steps of the walks that begin at ``starts``."""
        coin, at, salt = walk
        place, key, k = starts.copy(), np.full(len(starts), salt, np.uint64), 0
        for j in range(int(at[-1]) + 1):
            if last is not None:
                place = np.minimum(place, last)
            word = words[place]
            if j == at[k]:
                key = mix(key + word)
                k += 1
            place += ((word * coin[j]) >> np.uint64(63)).astype(np.int64)
        return key

    def matches(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item_id, distance, start word, item words), the nearest window for each row and item.

        A window within the edit bound shares all but so many words with its item; windows with fewer words of
        the items' vocabulary are left out before the walks, which loses none.
        """
        if not len(words) or not self.classes:
            return []
        marks = self.vocabulary[(words >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
        longest = max(int(walk[0].size) for _, _, tables in self.classes for walk, _, _ in tables)
        padded = np.concatenate([words, np.zeros(longest + 1, np.uint64)])
        row_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        begins: dict[tuple[int, int], set[int]] = {}
        for number, (low, need, tables) in enumerate(self.classes):
            running = np.concatenate([[0], np.cumsum((marks >> np.uint64(min(number, 63))) & np.uint64(1), dtype=np.int64)])
            end = np.minimum(np.arange(len(words)) + low, first[1:][row_of])
            starts = np.flatnonzero(running[end] - running[:-1] >= max(need, 1))
            if not len(starts):
                continue
            for walk, keys, of in tables:
                own = self._keys(padded, starts, walk)
                a, b = np.searchsorted(keys, own), np.searchsorted(keys, own, "right")
                for i in np.flatnonzero(b > a).tolist():
                    for x in of[a[i] : b[i]].tolist():
                        begins.setdefault((int(row_of[starts[i]]), int(self.part_item[x])), set()).add(int(starts[i] - self.part_start[x]))
        out = []
        for (row, x), at in begins.items():
            distance, start = self._nearest(self.items[x], words[first[row] : first[row + 1]], sorted(k - int(first[row]) for k in at))
            if distance <= int(self.edit_ratio * len(self.items[x])):
                out.append((row, self.ids[x], distance, start, len(self.items[x])))
        return out

    def _nearest(self, item: np.ndarray, text: np.ndarray, begins: list[int]) -> tuple[int, int]:
        """Distance and start of the nearest window that begins near one of ``begins``, the first of equal ones."""
        for k in begins:
            if k >= 0 and np.array_equal(text[k : k + len(item)], item):
                return 0, k
        most, spans = int(self.edit_ratio * len(item)), []
        for k in begins:
            low, high = max(k - most, 0), min(k + len(item) + 2 * most, len(text))
            if spans and low <= spans[-1][1]:
                spans[-1][1] = max(high, spans[-1][1])
            elif low < high:
                spans.append([low, high])
        best = (most + 1, 0)
        for low, high in spans:
            distance, start = nearest_window(item, text[low:high])
            best = min(best, (distance, low + start))
        return best


class ItemIndexes:
    """Index files in the shared folder, read by the tasks that search with them."""

    def __init__(self, path: str, names: list[str]):
        self.path, self.names, self.held = path, names, {}

    def __iter__(self) -> Iterator[ItemIndex]:
        for name in self.names:
            if name not in self.held:
                fs, path = file_system(f"{self.path}/{name}")
                with fs.open_input_stream(path) as source:
                    index = pickle.loads(source.read())
                if len(self.held) == KEPT_INDEXES:
                    yield index
                    continue
                self.held[name] = index
            yield self.held[name]

    def __getstate__(self):
        return self.__dict__ | {"held": {}}

    def matches(self, column: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
        """What ``ItemIndex.matches`` gives for all indexes; the texts are cut into words once."""
        slices = [(first, *word_hashes(data, at, NO_LETTER)) for first, _, data, at in text_slices(column)]
        for index in self:
            for first, words, offsets in slices:
                for row, *rest in index.matches(words, offsets):
                    yield first + row, *rest


def item_indexes(benchmark: DataFrame, edit_ratio: float, repetitions: int, samples: int) -> ItemIndexes:
    """Indexes of ``benchmark`` (item_id, text), the stated query set, built by tasks of about ITEM_BLOCK items each.

    Only the names of the index files come to the driver.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    path = shared_dir(spark, "benchmark-index")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = [], []
        for batch in batches:
            ids += batch.column("item_id").to_pylist()
            texts += batch.column("text").to_pylist()
        if ids:
            name = f"{uuid.uuid4().hex}.index"
            index = _index(ids, texts, edit_ratio, repetitions, samples)
            write_bytes(path, name, lambda sink: sink.write(pickle.dumps(index, 5)))
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    blocks = max(1, -(-items.count() // ITEM_BLOCK))
    names = write_table(items.repartition(blocks).mapInArrow(build, "name string"), "index-names")
    return ItemIndexes(path, sorted(r[0] for r in names.collect()))


def _index(ids: list[int], texts: list[str], edit_ratio: float, repetitions: int, samples: int) -> ItemIndex:
    kept_ids, items = [], []
    for _, _, data, at in text_slices(pa.array(texts), 1 << 40):
        words, first = word_hashes(data, at, NO_LETTER)
        for k, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
            if b > a:
                kept_ids.append(ids[k])
                items.append(words[a:b])
    return ItemIndex(kept_ids, items, edit_ratio, repetitions, samples)


def contamination(docs: DataFrame, benchmark: DataFrame, edit_ratio: float = 0.15, repetitions: int = 16, samples: int = 3) -> DataFrame:
    """Documents of ``docs`` (doc_id, text) with a window near an item of ``benchmark`` (item_id, text).

    Words are runs of letters, digits and non-ASCII characters, A-Z as a-z. A window matches if its word edit distance
    to the item is at most ``edit_ratio`` of the item's words. Returns one row for each document row and item:
    doc_id, item_id, distance, start_word, item_words. Null or empty texts and items match nothing; a null doc_id stays
    null; repeated document rows and equal items match each; empty tables give no rows; other columns are ignored.
    """
    indexes = item_indexes(benchmark, edit_ratio, repetitions, samples)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            rows = [(doc_ids[row], *rest) for row, *rest in indexes.matches(batch.column("text"))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()), strict=True)], ["doc_id", "item_id", "distance", "start_word", "item_words"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(search, MATCHES)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, edit_ratio: float = 0.15, repetitions: int = 16, samples: int = 3) -> DataFrame:
    """The rows of ``docs`` without a window near an item, with all their columns, whatever their names.

    Rows with a null or empty text stay; repeated rows stay or go together; an empty table stays empty, and an empty
    ``benchmark`` removes nothing. Texts are searched whole.
    """
    indexes = item_indexes(benchmark, edit_ratio, repetitions, samples)

    @lean
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for row, *_ in indexes.matches(batch.column("text")):
                keep[row] = False
            for first, end, *_ in text_slices(batch.column("text")):
                yield batch.slice(first, end - first).filter(pa.array(keep[first:end]))

    return docs.mapInArrow(clean, docs.schema)
