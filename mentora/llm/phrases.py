"""Collocations by contiguous pattern growth from occurrence pointers.

A frequent word is a prefix; its projected database is the list of its occurrences, each with the words that follow in
the same piece, as numbers, up to the longest phrase and the first infrequent word. Each prefix goes to one task, which
keeps pointers into its occurrences, counts the words that come next, and goes on with every frequent one depth-first.
Equal occurrences of a task are sent once with their count. The occurrences of a very frequent prefix go to several
tasks by their following words, so a whole phrase stays together, and the tasks' counts of its shorter ones are added up.

Words are numbered by language through sorted arrays in the shared folder, which workers map into memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mentora.llm.lm import MappedTable, _rows, write_arrays
from mentora.llm.ngram_join import _groups
from mentora.llm.storage import Scratch, arrow_batches, lean, shared_dir
from mentora.llm.words import BLANK, mix, text_slices, word_hashes

#: Bytes besides white space at which a text is cut into pieces.
PIECE_MARKS = b".,;:!?\x0a\x0b\x0c\x0d"
#: Occurrences that a task gathers before it sends them, and those planned for one cell of prefixes.
GATHERED = 2_000_000
CELL = 2_000_000
#: A prefix with more occurrences is dealt to so many more cells.
PREFIX = 1_000_000
ARRAY_ROWS = 64
#: Words that a task remembers in order to send the text of each once.
REMEMBERED = 500_000
NO_WORD = np.uint32(0xFFFFFFFF)

_CUT = np.zeros(256, bool)
_CUT[list(PIECE_MARKS)] = True
_BLANK = _CUT.copy()
_BLANK[[9, 32]] = True
assert (BLANK | _CUT == _BLANK).all()


def piece_words(data: np.ndarray, at: np.ndarray, salts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key of every word (its lower-cased text and the salt of its row), its first byte and end, and whether the next
    word belongs to the same piece."""
    words, first, starts, ends = word_hashes(data, at, _BLANK, places=True)
    keys = mix(words + np.repeat(salts, np.diff(first)))
    cuts = np.concatenate([[0], np.cumsum(_CUT[data])])
    goes_on = np.zeros(len(words), bool)
    goes_on[:-1] = cuts[starts[1:]] == cuts[ends[:-1]]
    ends_here = first[1:] - 1
    goes_on[ends_here[ends_here >= first[:-1]]] = False
    return keys, starts, ends, goes_on


def occurrences(ids: np.ndarray, goes_on: np.ndarray, length: int) -> np.ndarray:
    """One row for every word that is known and followed by a known one in its piece: its number and those of the
    following words, ``length`` together, NO_WORD from the first unknown word or the end of the piece on."""
    columns, alive = [ids], ids != NO_WORD
    for k in range(1, length):
        more = np.zeros(len(ids), bool)
        more[: len(ids) - k] = alive[: len(ids) - k] & goes_on[k - 1 : len(ids) - 1] & (ids[k:] != NO_WORD)
        column = np.full(len(ids), NO_WORD)
        column[: len(ids) - k][more[: len(ids) - k]] = ids[k:][more[: len(ids) - k]]
        columns.append(column)
        alive = more
    rows = np.stack(columns, 1) if len(ids) else np.zeros((0, length), np.uint32)
    return rows[columns[1] != NO_WORD]


def distinct(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct rows and their summed counts."""
    if not len(rows):
        return rows, counts
    # Two columns make one sort key.
    even = rows if rows.shape[1] % 2 == 0 else np.concatenate([rows, np.zeros((len(rows), 1), np.uint32)], 1)
    keys = [(even[:, k].astype(np.uint64) << np.uint64(32)) | even[:, k + 1] for k in range(0, even.shape[1], 2)]
    order = np.lexsort(keys[::-1])
    new = np.ones(len(rows), bool)
    new[1:] = np.logical_or.reduce([x[order[1:]] != x[order[:-1]] for x in keys])
    at = np.flatnonzero(new)
    return rows[order[at]], np.add.reduceat(counts[order], at)


def grow(rows: np.ndarray, counts: np.ndarray, least: int, partial: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Phrases of two words or more that begin with the one prefix of ``rows`` (sorted): (phrases, counts) in batches.

    Goes to the right depth-first, over frequent phrases. Where the prefix's occurrences are only ``partial``, shorter
    phrases are given with whatever count.
    """
    width = rows.shape[1]
    pointers = [(0, len(rows), 1)]
    while pointers:
        a, b, depth = pointers.pop()
        word = rows[a:b, depth]
        cuts = a + np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        n = np.add.reduceat(counts[a:b], cuts - a)
        wanted = rows[cuts, depth] != NO_WORD
        if not partial or depth == width - 1:
            wanted &= n >= least
        if wanted.any():
            phrases = rows[cuts[wanted]].copy()
            phrases[:, depth + 1 :] = NO_WORD
            yield phrases, n[wanted]
            if depth < width - 1:
                ends = np.append(cuts[1:], b)
                go = wanted & ((n >= least) | partial)
                pointers += [(int(x), int(y), depth + 1) for x, y in zip(cuts[go][::-1], ends[go][::-1], strict=True)]


class _Projection:
    """Gathers occurrences of a task and sends distinct ones, by cell."""

    def __init__(self, width: int, cells: int):
        self.width, self.cells, self.parts, self.n = width, cells, [], 0

    def add(self, rows: np.ndarray, total: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``total``: the number of occurrences of each row's prefix in the corpus."""
        self.parts.append((rows, total))
        self.n += len(rows)
        if self.n >= GATHERED:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        rows = np.concatenate([r for r, _ in self.parts])
        spread = -(-np.concatenate([t for _, t in self.parts]) // PREFIX)
        self.parts, self.n = [], 0
        with_spread = np.concatenate([rows, np.minimum(spread, self.cells).astype(np.uint32)[:, None]], 1)
        with_spread, counts = distinct(with_spread, np.ones(len(rows), np.int64))
        rows, spread = with_spread[:, :-1], with_spread[:, -1].astype(np.uint64)
        after = np.zeros(len(rows), np.uint64)
        for k in range(1, self.width):
            after = mix(after + rows[:, k].astype(np.uint64))
        cell = ((mix(rows[:, 0].astype(np.uint64) + np.uint64(11)) + after % spread) % np.uint64(self.cells)).astype(np.int32)
        order = np.argsort(cell, kind="stable")
        numbers, at = np.unique(cell[order], return_index=True)
        offsets = pa.array(np.append(at, len(order)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(rows[order, k]).view(np.int32))) for k in range(self.width)]
        lists += [pa.ListArray.from_arrays(offsets, pa.array((spread[order] > 1).astype(np.int8))), pa.ListArray.from_arrays(offsets, pa.array(counts[order].astype(np.int32)))]
        yield pa.RecordBatch.from_arrays([pa.array(numbers), *lists], ["cell", *(f"w{k}" for k in range(self.width)), "partial", "n"])


def _exact_score(a: Column, left: Column, right: Column, scale: int) -> Column:
    """floor(scale * a * a / (left * right)) in decimals of 38 digits."""
    wide = lambda x: x.cast("decimal(19,0)")
    product = (wide(a) * wide(a)).cast("decimal(30,0)") * F.lit(scale).cast("decimal(8,0)")
    return F.call_function("div", product, (wide(left) * wide(right)).cast("decimal(30,0)"))


def phrases(docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, top: int = 2000, scale: int = 1_000_000) -> DataFrame:
    """Each language's ``top`` collocations of 2 to ``longest`` words in ``docs`` (text, lang).

    Texts are lower-cased (A-Z) and cut at full stops, commas, semicolons, colons, exclamation and question marks and
    line ends into pieces, these at spaces and tabs into words. A candidate occurs ``least`` times or more within pieces,
    overlaps included; ``a`` is that number. Cut in two it has l and r occurrences of its parts and the score
    floor(scale * a * a / (l * r)); the lowest-scoring cut, of equal ones the leftmost, counts. Candidates inside a longer
    one with at least ``share`` percent of their occurrences are dropped. Returns lang, rank, phrase, a, l, r, n (all
    words of the language) and score, by score and a descending, then phrase in byte order.

    A null lang counts as ``und``; a null, empty or blank text has no words; repeated rows count each; texts are taken
    whole; an empty table gives no rows; other columns, whatever their names, are ignored. Counts up to 10 ** 15 are exact;
    larger ones raise an error. A language and word pair takes one of 2 ** 32 - 1 numbers; more raise an error.
    """
    if longest < 2:
        raise ValueError("a phrase has at least two words")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    texts = docs.select(F.col("text").cast("string").alias("text"), lang.alias("lang"), F.xxhash64(lang).alias("salt")).where("text is not null")

    def slices(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for first, end, data, at in text_slices(batch.column("text")):
                yield batch.slice(first, end - first), data, *piece_words(data, at, batch.column("salt").to_numpy()[first:end].view(np.uint64)), at

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words of a task with their counts; the text of each only where it is new to the task."""
        seen: set[int] = set()
        for batch, data, keys, starts, ends, _, at in slices(batches):
            value, first, n = np.unique(keys, return_index=True, return_counts=True)
            new = np.array([x not in seen for x in value.tolist()], bool)
            row = np.searchsorted(at, starts[first], "right") - 1
            a, b = starts[first], ends[first]
            word = pa.array([data[x:y].tobytes().lower().decode() if z else None for x, y, z in zip(a.tolist(), b.tolist(), new.tolist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), batch.column("lang").take(pa.array(row)), word, pa.array(n)], ["key", "lang", "word", "n"])
            if len(seen) > REMEMBERED:
                seen.clear()
            seen.update(value[new].tolist())

    with arrow_batches(spark, 4096):
        counted = scratch.write(texts.mapInArrow(count, "key long, lang string, word string, n long").groupBy("key", "lang").agg(F.sum("n").alias("n"), F.min("word").alias("word")), "words")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = counted.where(F.col("n") >= least)
    path = shared_dir(spark, "phrase-words")
    top_bit = F.lit(-(1 << 63))
    by_range = frequent.select(F.expr(f"cast(shiftright(shiftrightunsigned(key, 32) * {ranges}, 32) as int)").alias("range"), F.col("key").bitwiseXOR(top_bit).alias("key"), "n")
    known = MappedTable(path, write_arrays(by_range, path, ["n"], ranges), ranges, 1)
    if known.total("n") >= int(NO_WORD):
        raise ValueError(f"{known.total('n')} frequent words, more than there are numbers")
    cells = max(1, -(-known.total("total") // CELL))

    @lean
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("key").to_numpy().view(np.uint64)
            order = np.argsort(key)
            rank = np.empty(len(key), np.int64)
            rank[order] = known.find(key[order])[0]
            yield pa.RecordBatch.from_arrays([pa.array(rank), *(batch.column(c) for c in ("lang", "word", "n"))], ["id", "lang", "word", "n"])
        known.close()

    vocabulary = scratch.write(frequent.mapInArrow(number, "id long, lang string, word string, n long"), "vocabulary")

    @lean
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Projection(longest, cells)
        for _, _, keys, _, _, goes_on, _ in slices(batches):
            value, which = np.unique(keys, return_inverse=True)
            rank, n = known.find(value)
            ids = np.where(rank < 0, int(NO_WORD), rank).astype(np.uint32)[which]
            rows = occurrences(ids, goes_on, longest)
            of_id = dict(zip(rank.tolist(), n[:, 0].tolist(), strict=True))
            prefix, at = np.unique(rows[:, 0], return_inverse=True)
            yield from out.add(rows, np.array([of_id[x] for x in prefix.tolist()], np.int64)[at])
        yield from out.flush()
        known.close()

    columns = [f"w{k}" for k in range(longest)]

    @lean
    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, ("cell",)):
            flat = lambda c: pa.concat_arrays([x.flatten() for x in table.column(c).chunks]).to_numpy()
            rows = np.stack([*(flat(c).view(np.uint32) for c in columns), flat("partial").astype(np.uint32)], 1)
            rows, counts = distinct(rows, flat("n").astype(np.int64))
            partial, rows = rows[:, -1] > 0, np.ascontiguousarray(rows[:, :-1])
            cuts = [*np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]])).tolist(), len(rows)]
            found = [x for a, b in zip(cuts[:-1], cuts[1:], strict=True) for x in grow(rows[a:b], counts[a:b], least, bool(partial[a]))]
            if found:
                phrase, n = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
                used = phrase != NO_WORD
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(used.sum(1))]).astype(np.int32)), pa.array(phrase[used].astype(np.int64)))
                for i in range(0, len(n), 50_000):
                    yield pa.RecordBatch.from_arrays([lists.slice(i, 50_000), pa.array(n[i : i + 50_000])], ["words", "a"])

    kinds = ", ".join(f"{c} array<int>" for c in columns)
    with arrow_batches(spark, 4096):
        projected = texts.mapInArrow(project, f"cell int, {kinds}, partial array<tinyint>, n array<int>")
        with arrow_batches(spark, ARRAY_ROWS):
            grown = projected.repartition("cell").sortWithinPartitions("cell").mapInArrow(extend, "words array<long>, a long")
            found = scratch.write(grown.groupBy("words").agg(F.sum("a").alias("a")).where(F.col("a") >= least), "phrases")

    # Every part of a frequent phrase is frequent, so it is a word of the vocabulary or a phrase itself.
    parts = vocabulary.select(F.array("id").alias("part"), F.col("n").alias("part_n")).union(found.select("words", "a"))
    cut = found.select("words", "a", F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k"))
    for side, words in (("l", F.expr("slice(words, 1, k)")), ("r", F.expr("slice(words, k + 1, size(words) - k)"))):
        cut = cut.withColumn("part", words).join(parts, "part").withColumnRenamed("part_n", side).drop("part")
    cut = cut.withColumn("score", _exact_score(F.col("a"), F.col("l"), F.col("r"), scale))
    best = cut.groupBy("words").agg(F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("best")).select("words", "a", "best.score", "best.l", "best.r")
    inner = found.where(F.size("words") > 2).select(F.col("a").alias("longer"), "words", F.explode(F.expr("sequence(2, size(words) - 1)")).alias("size"))
    inner = inner.select("longer", "words", "size", F.explode(F.expr("sequence(1, size(words) - size + 1)")).alias("at")).select(F.expr("slice(words, at, size)").alias("words"), "longer")
    covering = inner.groupBy("words").agg(F.max("longer").alias("longer"))
    kept = best.join(covering, "words", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).drop("longer")
    kept = scratch.write(kept.withColumn("id", F.col("words")[0]).join(vocabulary.select("id", "lang"), "id").drop("id"), "candidates")

    # Groups of a ranking before the last, so many that theirs and the last one are about as large.
    groups = max(1, math.isqrt(kept.count() // top))
    by_number = (F.desc("score"), F.desc("a"))
    salt = F.pmod(F.xxhash64("words"), F.lit(groups))
    # A phrase that ``top`` others of its group pass by numbers alone can't be among the first.
    near = kept.withColumn("place", F.rank().over(Window.partitionBy("lang", salt).orderBy(*by_number))).where(F.col("place") <= top).drop("place")
    at = near.select("words", F.posexplode("words").alias("at", "id")).join(vocabulary.select("id", "word"), "id")
    named = at.groupBy("words").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    near = near.join(named, "words")
    in_order = (*by_number, F.asc("phrase"))
    if groups > 1:
        near = near.withColumn("place", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*in_order))).where(F.col("place") <= top).drop("place")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*in_order))).where(F.col("rank") <= top)
    out = scratch.write(ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")
    scratch.drop_all_but(out)
    return out
