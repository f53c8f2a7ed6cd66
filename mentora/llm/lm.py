"""Interpolated modified Kneser-Ney bigram model, counted in Spark and scored from memory-mapped sorted arrays.

Counts live in files of sorted 64-bit keys with values beside them, one file for each range of keys. Words are
numbered by the rank of their hash in the vocabulary; a bigram key is a bijective mix of its two numbers, so equal
keys mean equal bigrams and ranges are even however frequent a word is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentora.llm.storage import drop_copies, local_copy, shared_dir, write_bytes, write_table
from mentora.llm.words import mix, text_slices, word_hashes

END_HASH = np.uint64(0x6A09E667F3BCC909)
_TOP = np.uint64(1 << 63)
#: Keys that a task gathers before it sends their counts.
GATHERED = 3_000_000
#: Tokens for one range of bigram keys, so that a task's range stays as large however much text there is.
RANGE_TOKENS = 4_000_000
#: Word numbers take 32 bits, of which two values mark the start of a text and an unknown word.
MOST_WORDS = (1 << 32) - 2


def _tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of every row, each row closed by the end token, and the row offsets."""
    hashes, first = word_hashes(data, at)
    return np.insert(hashes, first[1:], END_HASH), first + np.arange(len(first))


def unmix(h: np.ndarray) -> np.ndarray:
    """The inverse of ``mix``."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(pow(0xC4CEB9FE1A85EC53, -1, 1 << 64))
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(pow(0xFF51AFD7ED558CCD, -1, 1 << 64))
    return h ^ (h >> np.uint64(33))


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Even ranges of the key space, in key order."""
    return (((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int32)


def _rows(keys: np.ndarray, ranges: int, **values: np.ndarray) -> pa.RecordBatch:
    """Keys as signed numbers in the same order."""
    return pa.RecordBatch.from_arrays([pa.array(range_of(keys, ranges)), pa.array((keys ^ _TOP).view(np.int64)), *(pa.array(v.astype(np.int64)) for v in values.values())], ["range", "key", *values])


class _Gather:
    """Counts keys of a task and gives them out, sorted, whenever many have come together."""

    def __init__(self, ranges: int):
        self.ranges, self.parts, self.n = ranges, [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(keys)
        self.n += len(keys)
        if self.n >= GATHERED:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            keys, n = np.unique(np.concatenate(self.parts), return_counts=True)
            self.parts, self.n = [], 0
            for i in range(0, len(keys), 100_000):
                yield _rows(keys[i : i + 100_000], self.ranges, n=n[i : i + 100_000])


def write_arrays(rows: DataFrame, path: str, values: list[str], ranges: int) -> list[dict]:
    """Sum ``values`` of ``rows`` (range, key, values) by key and write sorted arrays below ``path``, two files a range.

    Each range is one task, which sums neighbours of its sorted rows.

    Values take the fewest bytes that hold the largest. Returns file facts: range, size, bytes of a value, how many
    first values are 1, 2, 3, 4 and not 0, and their sum. Their number is the number of ranges.
    """
    spark = rows.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(number: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            key = np.concatenate([x.column("key").to_numpy().view(np.uint64) for x in parts]) ^ _TOP
            value = np.concatenate([np.stack([x.column(v).to_numpy() for v in values], 1) for x in parts])
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            key, value = key[new], np.add.reduceat(value, new, axis=0)
            size = next(x for x in (2, 4, 8) if int(value.max()) < 1 << (8 * x - (x == 8)))
            write_bytes(path, f"{number:08d}.keys", lambda sink: sink.write(key.tobytes()))
            write_bytes(path, f"{number:08d}.values", lambda sink: sink.write(value.astype(f"<u{size}").tobytes()))
            first = value[:, 0]
            return pa.RecordBatch.from_pydict({"range": [number], "n": [len(key)], "size": [size], **{f"n{k}": [int((first == k).sum())] for k in (1, 2, 3, 4)}, "some": [int((first > 0).sum())], "total": [int(first.sum())]}, schema=facts)

        facts = pa.schema([("range", pa.int32()), *((x, pa.int64()) for x in ("n", "size", "n1", "n2", "n3", "n4", "some", "total"))])
        now, parts = -1, []
        for batch in batches:
            number = batch.column("range").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a < b:
                    if number[a] != now and parts:
                        yield done(now, parts)
                        parts = []
                    now = int(number[a])
                    parts.append(batch.slice(a, b - a))
        if parts:
            yield done(now, parts)

    by_range = rows.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "key")
    facts = write_table(by_range.mapInArrow(write, "range int, n long, size long, n1 long, n2 long, n3 long, n4 long, some long, total long"), "array-files")
    return [r.asDict() for r in facts.collect()]


class MappedTable:
    """Lookup in the files of ``write_arrays``; a worker memory-maps each on first use."""

    def __init__(self, path: str, files: list[dict], ranges: int, width: int):
        self.path, self.width, self.ranges = path, width, ranges
        self.files = sorted(files, key=lambda x: x["range"])
        self.base = np.concatenate([[0], np.cumsum([x["n"] for x in self.files])]).astype(np.int64)
        self.numbers = np.array([x["range"] for x in self.files], np.int64)
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.folder: list[str] = []

    def total(self, what: str) -> int:
        return sum(x[what] for x in self.files)

    def _file(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in self.open:
            x = self.files[i]
            keys, values = (local_copy(self.path, f"{x['range']:08d}.{kind}", self.folder) for kind in ("keys", "values"))
            self.open[i] = np.memmap(keys, np.uint64, "r"), np.memmap(values, f"<u{x['size']}", "r").reshape(x["n"], self.width)
        return self.open[i]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted ``keys``: the rank of each in the whole table, -1 where absent, and its values (0 where absent)."""
        rank, out = np.full(len(keys), -1, np.int64), np.zeros((len(keys), self.width), np.int64)
        number = range_of(keys, self.ranges)
        cut = np.searchsorted(number, self.numbers), np.searchsorted(number, self.numbers, "right")
        for i in np.flatnonzero(cut[1] > cut[0]).tolist():
            a, b = int(cut[0][i]), int(cut[1][i])
            have, values = self._file(i)
            at = np.minimum(np.searchsorted(have, keys[a:b]), len(have) - 1)
            hit = np.flatnonzero(have[at] == keys[a:b])
            rank[a + hit] = self.base[i] + at[hit]
            out[a + hit] = values[at[hit]]
        return rank, out

    def close(self) -> None:
        self.open.clear()
        drop_copies(self.folder)

    def __getstate__(self):
        return self.__dict__ | {"open": {}, "folder": []}


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and more; where counts of counts are missing, 0.5, 1 and 1.5."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(x, 0.0), float(k)) for k, x in zip((1, 2, 3), d, strict=True))


class BigramModel:
    """Counts and discounts; ``score`` needs only the mapped files."""

    def __init__(self, vocabulary: MappedTable, bigrams: MappedTable, words: MappedTable):
        self.vocabulary, self.bigrams, self.words = vocabulary, bigrams, words
        self.size, self.tokens, self.types = vocabulary.total("n"), vocabulary.total("total"), bigrams.total("n")
        self.high = np.array([0.0, *discounts(*(bigrams.total(f"n{k}") for k in (1, 2, 3, 4)))])
        self.low = np.array([0.0, *discounts(*(words.total(f"n{k}") for k in (1, 2, 3, 4)))])
        n1, n2, some = words.total("n1"), words.total("n2"), words.total("some")
        self.rest = (self.low[1] * n1 + self.low[2] * n2 + self.low[3] * (some - n1 - n2)) / max(self.types, 1)

    def close(self) -> None:
        for x in (self.vocabulary, self.bigrams, self.words):
            x.close()

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct word numbers (``size`` + 1 if unknown), their counts, and which of them each token has."""
        seen, which = np.unique(hashes, return_inverse=True)
        rank, values = self.vocabulary.find(seen)
        return np.where(rank < 0, self.size + 1, rank).astype(np.uint64), values[:, 0], which

    def pairs(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bigram keys, and the number of the word before each token (``size`` at the start of a row)."""
        before = np.empty(len(ids), np.uint64)
        before[1:] = ids[:-1]
        before[first[:-1]] = self.size
        return mix((before << np.uint64(32)) | ids), before

    def score(self, data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
        hashes, first = _tokens(data, at)
        distinct, counts, which = self.ids(hashes)
        ids = distinct[which]
        keys, before = self.pairs(ids, first)
        numbers, number_of = np.unique(np.concatenate([distinct, [np.uint64(self.size)]]), return_inverse=True)
        mixed = mix(numbers)
        order = np.argsort(mixed)
        stats = np.zeros((len(numbers), self.words.width), np.int64)
        stats[order] = self.words.find(mixed[order])[1]
        follow = stats[number_of[:-1], 0]
        lower = np.maximum(follow - self.low[np.minimum(follow, 3)], 0) / max(self.types, 1) + self.rest / (self.size + 1)
        wanted, of = np.unique(keys, return_inverse=True)
        n = self.bigrams.find(wanted)[1][:, 0][of]
        context = stats[np.searchsorted(numbers, before)]
        total = context[:, 1]
        weight = context[:, 2:5] @ self.high[1:]
        p = lower[which]
        seen = total > 0
        p[seen] = (np.maximum(n[seen] - self.high[np.minimum(n[seen], 3)], 0) + weight[seen] * p[seen]) / total[seen]
        sums = lambda x: np.add.reduceat(x, first[:-1]) if len(first) > 1 else x[:0]
        base = np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.size + 1)))
        return {"n_tokens": np.diff(first), "n_known": sums((counts > 0)[which].astype(np.int64)), "base_score": sums(base[which]), "score": sums(np.log10(p))}


def train(docs: DataFrame) -> BigramModel:
    """Count the words and bigrams of ``docs`` (text) into mapped files in the shared folder.

    A null, empty or blank text counts with its end alone; repeated rows count each; other columns are ignored; an empty
    table gives a model that knows no word.
    """
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("text").cast("string"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = _Gather(ranges)
        for batch in batches:
            for _, _, data, at in text_slices(batch.column("text")):
                yield from gather.add(_tokens(data, at)[0])
        yield from gather.flush()

    path = shared_dir(spark, "lm-words")
    vocabulary = MappedTable(path, write_arrays(texts.mapInArrow(words, "range int, key long, n long"), path, ["n"], ranges), ranges, 1)
    if vocabulary.total("n") > MOST_WORDS:
        raise ValueError(f"{vocabulary.total('n')} distinct words, more than {MOST_WORDS}")
    pair_ranges = max(ranges, -(-vocabulary.total("total") // RANGE_TOKENS))
    counting = BigramModel(vocabulary, MappedTable(path, [], ranges, 1), MappedTable(path, [], ranges, 5))

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = _Gather(pair_ranges)
        for batch in batches:
            for _, _, data, at in text_slices(batch.column("text")):
                hashes, first = _tokens(data, at)
                distinct, _, which = counting.ids(hashes)
                yield from gather.add(counting.pairs(distinct[which], first)[0])
        yield from gather.flush()
        counting.close()

    pair_path = shared_dir(spark, "lm-bigrams")
    pairs = MappedTable(pair_path, write_arrays(texts.mapInArrow(bigrams, "range int, key long, n long"), pair_path, ["n"], pair_ranges), pair_ranges, 1)

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each file has of every word: contexts before it; as a context: tokens, and followers seen once, twice, more."""
        for batch in batches:
            for i in batch.column("id").to_pylist():
                keys, values = pairs._file(i)
                both, n = unmix(np.array(keys)), values[:, 0].astype(np.int64)
                before, word = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
                names, of = np.unique(np.concatenate([before, word]), return_inverse=True)
                own, after = of[: len(both)], of[len(both) :]
                count = lambda x, w=None: np.bincount(x, w, len(names)).astype(np.int64)
                yield _rows(mix(names), ranges, follow=count(after), total=count(own, n), n1=count(own[n == 1]), n2=count(own[n == 2]), n3=count(own[n > 2]))
        pairs.close()

    word_path = shared_dir(spark, "lm-stats")
    files = spark.range(0, len(pairs.files), 1, max(1, len(pairs.files)))
    names = ["follow", "total", "n1", "n2", "n3"]
    word_stats = write_arrays(files.mapInArrow(stats, "range int, key long, follow long, total long, n1 long, n2 long, n3 long"), word_path, names, ranges)
    return BigramModel(vocabulary, pairs, MappedTable(word_path, word_stats, ranges, 5))


def held_out(doc_id: Column, fold: int) -> Column:
    """Rows whose crc32 of the doc_id as text leaves ``fold`` modulo 5; a null doc_id is in no such fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == fold, F.lit(False))


def lm_scores(docs: DataFrame, fold: int = 1) -> DataFrame:
    """Log10 probabilities of all texts of ``docs`` (doc_id, text) under a bigram model trained without fold ``fold``.

    Tokens are lower-cased words between ASCII white space and an end token for each text; a null, empty or blank text
    has the end token alone. Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-0.5 unigrams)
    and score (the model). With no training rows every word is unknown and equally likely. A null doc_id counts as
    training; repeated rows count each; an empty table gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("held_out", held_out(F.col("doc_id"), fold))
    model = train(docs.where("not held_out"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, at in text_slices(batch.column("text")):
                got = model.score(data, at)
                n = end - first
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, n), batch.column("held_out").slice(first, n), pa.array(got["n_tokens"]), pa.array(got["n_known"]), pa.array(np.full(n, model.tokens, np.int64)), pa.array(got["base_score"]), pa.array(got["score"])], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        model.close()

    return docs.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
