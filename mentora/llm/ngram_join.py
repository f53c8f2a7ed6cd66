"""N-gram Jaccard self-join in size-banded tiles with hashed bitmap signatures.

Two sets with Jaccard similarity of at least t differ in at most D = (1 - t) / (1 + t) * (n1 + n2) elements. Sizes are
cut into bands; a tile holds the sets of one band and those larger ones that can still be similar, and has one D. Each
tile splits the hash space into D + 1 + z cells, so similar sets agree on at least z + 1 whole cells; sets meet where
such a cell agrees. z exceeds the cells that a set usually leaves empty; sets with more empty cells meet on these too.
So no similar pair is missed, and sets that merely share a common passage rarely meet.

Where sets meet, hashed bitmaps of four to eight bits an element bound the overlap from above: first of each set with the
least set there, then, where a place still holds sets that nothing connects, of the rest in blocks. Only pairs that
connect something new are given out, n - 1 at most from n sets, so the candidates are a forest over all pairs that the
bitmaps allow. Its trees are clusters; two similar sets always lie in the same one. The sorted arrays of a cluster then
go to one task (a large cluster's to several, in parts of bounded size), which decides by exact intersection, again
only for sets that nothing links yet.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from mentora.llm.components import connected_components
from mentora.llm.storage import Scratch, arrow_batches, lean
from mentora.llm.words import distinct_rows, mix, shingle_hashes, text_slices, word_hashes

BITS_PER_ELEMENT = 4
LEAST_BITS = 256
#: A meeting place with more sets, or more bytes of bitmaps, is cut into blocks, and every two blocks meet in a task.
BLOCK = 2048
BLOCK_BYTES = 8 << 20
#: A cluster with more elements in all its arrays is cut into parts.
PART_ELEMENTS = 2 << 20
#: Distinct sets that a task remembers in order to send each once.
REMEMBERED = 200_000
FILTER_BITS = 1 << 24
#: Rows of a batch of texts.
TEXT_ROWS = 512
#: Rows of a batch of bitmaps or arrays.
SET_ROWS = 1024


class Tiles:
    """Bands of set sizes with the greatest difference D, cells and expected empty cells of each tile."""

    def __init__(self, num: int, den: int, largest: int = 1 << 31):
        self.num, self.den = num, den
        ratio, low, rows = max(1.5, den / num), 1, []
        while low <= largest:
            high = max(low, math.floor(low * ratio))
            differ = (high + high * den // num) * (den - num) // (den + num)
            cells = differ + 1
            spare = 0
            for _ in range(4):
                empty = cells * math.exp(-low / cells)
                spare = math.ceil(empty + 2 * math.sqrt(empty))
                cells = differ + 1 + spare
            rows.append((low, cells if differ else 0, spare))
            low = high + 1
        self.low, self.cells, self.spare = (np.array(x, np.int64) for x in zip(*rows, strict=True))

    def of(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tile of a set as the smaller one, and as the larger one of the smallest similar set (-1 if none)."""
        own = np.searchsorted(self.low, sizes, "right") - 1
        smallest = -(-sizes * self.num // self.den)
        below = np.searchsorted(self.low, np.maximum(smallest, 1), "right") - 1
        return own, np.where(below < own, below, -1)


def document_sets(data: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, the row offsets and a hash of each row's whole set."""
    hashes, first = word_hashes(data, at)
    values, offsets = distinct_rows(*shingle_hashes(hashes, first, words))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(values))])
    size = np.diff(offsets)
    return values, offsets, mix(sums[offsets[1:]] - sums[offsets[:-1]] + mix(size.astype(np.uint64)))


def meeting_keys(values: np.ndarray, at: np.ndarray, tiles: Tiles) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the places where each set meets others."""
    size = np.diff(at)
    rows_out, keys_out = [], []
    for tile in tiles.of(size):
        cells = np.where((tile >= 0) & (size > 0), tiles.cells[np.maximum(tile, 0)], 0)
        use = np.flatnonzero(cells)
        if not len(use):
            continue
        take = np.repeat(cells > 0, size)
        own, row = values[take], np.repeat(use, size[use])
        cell = ((own >> np.uint64(32)) * cells[row].astype(np.uint64)) >> np.uint64(32)
        new = np.ones(len(own), bool)
        new[1:] = (row[1:] != row[:-1]) | (cell[1:] != cell[:-1])
        begin = np.flatnonzero(new)
        content = np.add.reduceat(mix(own), begin)
        rows, cell = row[begin], cell[begin]
        salt = mix(tile[rows].astype(np.uint64) * np.uint64(0x1F123BB5) + np.uint64(1))
        rows_out.append(rows)
        keys_out.append(mix(content + mix(cell + salt)))
        empty = cells - np.bincount(rows, minlength=len(size))
        for x in np.flatnonzero(empty > np.where(cells > 0, tiles.spare[np.maximum(tile, 0)], np.iinfo(np.int64).max)).tolist():
            missing = np.setdiff1d(np.arange(cells[x], dtype=np.uint64), cell[rows == x])
            rows_out.append(np.full(len(missing), x))
            keys_out.append(mix(mix(missing + mix(np.array([tile[x]], np.uint64) * np.uint64(0x1F123BB5) + np.uint64(1))) + np.uint64(7)))
    if not rows_out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows_out), np.concatenate(keys_out)


def bitmap(values: np.ndarray) -> np.ndarray:
    """Bit h mod m is set for every hash h; m is the power of two next above BITS_PER_ELEMENT bits an element."""
    size = max(LEAST_BITS, 1 << (BITS_PER_ELEMENT * max(len(values), 1) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[(values % np.uint64(size)).astype(np.int64)] = True
    return np.packbits(bits)


def folded(bits: bytes, words: int) -> np.ndarray:
    """A bitmap as 64-bit words, folded to as many: what it would be with that many bits."""
    return np.bitwise_or.reduce(np.frombuffer(bits, np.uint64).reshape(-1, words), axis=0)


def most_overlap(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Upper bound of the intersection: each bit in which two bitmaps differ comes from an element of one set alone."""
    return (size_a + size_b - np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)) // 2


def _enough(overlap, size_a, size_b, num: int, den: int):
    """den * intersection >= num * union."""
    return den * overlap >= num * (size_a + size_b - overlap)


def _ids_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of hashed ids with a fixed size, FILTER_BITS, to leave out most documents that have no part in a pair.

    It grows no larger with the data; a join afterwards removes those that it lets through by chance.
    """
    bits = ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).cast("int").alias("bit"))
    words = bits.groupBy(F.expr("bit div 32").alias("w")).agg(F.expr("bit_or(shiftleft(1L, bit % 32))").alias("b")).toPandas()
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[words["w"].to_numpy()] = words["b"].to_numpy().astype(np.uint32)
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys in a sorted stream, each whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(k).to_numpy() for k in keys], 1)
        cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and any(held[-1].column(k)[0] != batch.column(k)[a] for k in keys):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def shared_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, pivot) of keys with two different nodes or more, each node once, from rows (key, node) sorted so.

    The pivot is a key's least node. Of a key that goes on in the next batch only its pivot and last node are kept.
    """
    held: tuple[int, int, int, bool] | None = None  # key, pivot, last node and whether the pivot's row is out
    for batch in batches:
        key, node = (batch.column(c).to_numpy() for c in ("key", "node"))
        if not len(key):
            continue
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        fresh = new.copy()
        fresh[1:] |= node[1:] != node[:-1]
        goes_on = held is not None and key[0] == held[0]
        if goes_on:
            new[0], fresh[0] = False, node[0] != held[2]
        key, node, new = key[fresh], node[fresh], new[fresh]
        if not len(key):
            continue
        group = np.cumsum(new)
        pivots = np.concatenate([[held[1] if goes_on else 0], node[new]])
        pivot = pivots[group]
        several = np.bincount(group[~new], minlength=len(pivots)) > 0
        out = ~new | several[group]
        rows = [key[out], node[out], pivot[out]]
        if goes_on and several[0] and not held[3]:
            rows = [np.append(x, v) for x, v in zip(rows, (held[0], held[1], held[1]), strict=True)]
        whole = (goes_on and held[3]) if group[-1] == 0 else False
        held = int(key[-1]), int(pivot[-1]), int(node[-1]), bool(whole or several[group[-1]])
        if len(rows[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["key", "node", "pivot"])


def joining_links(component: np.ndarray, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links that join different components, at most one fewer than there are components.

    ``linked(x, rest)`` marks which of ``rest`` link with x. Every x is compared with what nothing has reached yet, so
    the links connect all that links connect.
    """
    out: list[tuple[int, int]] = []
    rest = np.arange(len(component))
    while len(rest) > 1:
        own = component[rest] == component[rest[0]]
        queue, rest = rest[own].tolist(), rest[~own]
        while queue and len(rest):
            x = queue.pop()
            reached = rest[linked(x, rest)]
            if len(reached):
                names, at = np.unique(component[reached], return_index=True)
                out += [(x, int(y)) for y in reached[at]]
                own = np.isin(component[rest], names)
                queue += rest[own].tolist()
                rest = rest[~own]
    return out


def _possible_links(tile: pa.Table, num: int, den: int) -> list[tuple[int, int]]:
    """Joining links of a tile by bitmaps; between its two blocks, or within its one."""
    size, component, block = (tile.column(c).to_numpy() for c in ("size", "component", "own"))
    raw = tile.column("bits").to_pylist()
    words = min(map(len, raw)) // 8
    bits = np.stack([folded(x, words) for x in raw])
    within = bool(tile.column("i")[0] == tile.column("j")[0])

    def linked(x: int, rest: np.ndarray) -> np.ndarray:
        near = np.minimum(size[rest], size[x]) * den >= num * np.maximum(size[rest], size[x])
        if not within:
            near &= block[rest] != block[x]
        y = rest[near]
        near[near] = _enough(most_overlap(bits[x], bits[y], size[x], size[y]), size[x], size[y], num, den)
        return near

    return joining_links(component, linked)


class _Overlaps:
    """Exact intersection sizes of one sorted array with many."""

    def __init__(self, values: np.ndarray, at: np.ndarray):
        self.size, n = np.diff(at), len(at) - 1
        _, ids, counts = np.unique(values, return_inverse=True, return_counts=True)
        self.common = int((counts == n).sum())
        use = (counts > 1) & (counts < n)  # the rest overlap with no set, or with every set
        names = np.cumsum(use) - 1
        keep = use[ids]
        self.ids, self.at = names[ids[keep]], np.concatenate([[0], np.cumsum(keep)])[at]
        self.marked = np.zeros(int(use.sum()), bool)
        self._gather(np.arange(n))

    def _gather(self, rows: np.ndarray) -> None:
        length = self.at[rows + 1] - self.at[rows]
        self.rows, self.ends = rows, np.concatenate([[0], np.cumsum(length)])
        self.held = self.ids[np.repeat(self.at[rows] - self.ends[:-1], length) + np.arange(self.ends[-1])]

    def of(self, x: int, rest: np.ndarray) -> np.ndarray:
        """Intersection sizes of set x with the sets ``rest``, which are among those of the call before."""
        if len(rest) < 0.7 * len(self.rows):
            self._gather(rest)
        own = self.ids[self.at[x] : self.at[x + 1]]
        self.marked[own] = True
        hits = np.concatenate([[0], np.cumsum(self.marked[self.held])])
        self.marked[own] = False
        both = hits[self.ends[1:]] - hits[self.ends[:-1]]
        return self.common + both[np.searchsorted(self.rows, rest)]


def _exact_links(tile: pa.Table, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, least set reached by links) of a tile's sets that links reach; between its two parts, or within its one."""
    node, component, part = (tile.column(c).to_numpy() for c in ("node", "component", "own"))
    lists = tile.column("hashes").combine_chunks()
    at = lists.offsets.to_numpy()
    overlaps = _Overlaps(lists.values.to_numpy()[at[0] : at[-1]], (at - at[0]).astype(np.int64))
    size, within = overlaps.size, bool(tile.column("i")[0] == tile.column("j")[0])

    def linked(x: int, rest: np.ndarray) -> np.ndarray:
        found = _enough(overlaps.of(x, rest), size[x], size[rest], num, den)
        return found if within else found & (part[rest] != part[x])

    parent = list(range(len(node)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = joining_links(component, linked)
    for x, y in links:
        a, b = root(x), root(y)
        if node[a] <= node[b]:
            parent[b] = a
        else:
            parent[a] = b
    moved = sorted({x for link in links for x in link if root(x) != x})
    return node[moved], node[[root(x) for x in moved]]


def _sets_and_groups(docs: DataFrame, words: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, node) of every row, and (node, component) of the sets that links reach."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    tiles = Tiles(num, den)

    @lean
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, at in text_slices(batch.column("text")):
                _, offsets, whole = document_sets(data, at, words)
                size = np.diff(offsets)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, end - first), pa.array(size), pa.array(whole.view(np.int64), mask=size == 0)], ["doc_id", "n_shingles", "node"])

    @lean
    def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, at in text_slices(batch.column("text")):
                values, offsets, whole = document_sets(data, at, words)
                fresh = np.zeros(len(whole), bool)
                for row, x in enumerate(whole.tolist()):
                    if x not in seen:
                        fresh[row] = True
                        seen.add(x)
                if len(seen) > REMEMBERED:
                    seen.clear()
                size = np.diff(offsets)
                values = values[np.repeat(fresh, size)]
                rows, keys = meeting_keys(values, np.concatenate([[0], np.cumsum(size[fresh])]), tiles)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(whole[fresh][rows].view(np.int64))], ["key", "node"])

    with arrow_batches(spark, TEXT_ROWS):
        base = scratch.write(docs.mapInArrow(sets, "doc_id long, n_shingles long, node long"), "sets")
        raw = docs.mapInArrow(meetings, "key long, node long")
        met = scratch.write(raw.repartition("key").sortWithinPartitions("key", "node").mapInArrow(lean(shared_places), "key long, node long, pivot long"), "meetings")

    owners = base.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    # Without repeated rows each set has one owning row, and no sort of whole sets is needed to make them distinct.
    repeated = bool(base.where("node is not null").groupBy("doc_id", "node").count().where("count > 1").head(1))

    def from_texts(wanted: DataFrame, make, schema: str) -> DataFrame:
        """``wanted`` with more columns for its sets (node), made anew from the one text of each that owns it."""
        wanted = scratch.write(wanted.join(owners, "node"), "wanted-sets")
        chosen = spark.sparkContext.broadcast(_ids_filter(wanted))

        @lean
        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bit = batch.column("bit").to_numpy()
                batch = batch.filter(pa.array((chosen.value[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1 > 0))
                for first, end, data, at in text_slices(batch.column("text")):
                    values, offsets, whole = document_sets(data, at, words)
                    columns = {"doc_id": batch.column("doc_id").slice(first, end - first), "node": pa.array(whole.view(np.int64)), **make(values, offsets)}
                    yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

        rows = docs.withColumn("bit", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))).mapInArrow(read, f"doc_id long, node long, {schema}")
        if repeated:
            rows = rows.dropDuplicates(["doc_id", "node"])
        # A set whose every row lacks a doc_id is owned by such a row.
        same = F.col("r.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("r.node") == F.col("w.node"))
        return rows.alias("r").join(wanted.alias("w"), same).select("r.*", *[f"w.{c}" for c in wanted.columns if c not in ("doc_id", "node")]).drop("doc_id")

    def bitmaps(values: np.ndarray, at: np.ndarray) -> dict[str, pa.Array]:
        return {"size": pa.array(np.diff(at)), "bits": pa.array([bitmap(values[a:b]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())}

    def arrays(values: np.ndarray, at: np.ndarray) -> dict[str, pa.Array]:
        return {"hashes": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))}

    @lean
    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column("a_size").to_numpy(), batch.column("b_size").to_numpy()
            overlap = np.zeros(batch.num_rows, np.int64)
            for k, (a, b) in enumerate(zip(batch.column("a_bits").to_pylist(), batch.column("b_bits").to_pylist(), strict=True)):
                words_here = min(len(a), len(b)) // 8
                overlap[k] = most_overlap(folded(a, words_here), folded(b, words_here), n[k], m[k])
            kept = pa.array(_enough(overlap, n, m, num, den))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(kept), batch.column("b").filter(kept)], ["a", "b"])

    @lean
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()
        for tile in _groups(batches, ("key", "i", "j")):
            node = tile.column("node").to_numpy()
            found = [(max(a, b), min(a, b)) for a, b in ((int(node[x]), int(node[y])) for x, y in _possible_links(tile, num, den))]
            if new := [x for x in found if x not in sent]:
                sent.update(new)
                if len(sent) > REMEMBERED:
                    sent.clear()
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*new, strict=True)], ["a", "b"])

    @lean
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _groups(batches, ("cluster", "i", "j")):
            a, b = _exact_links(tile, num, den)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def tiled(rows: DataFrame, key: str, others: Column) -> DataFrame:
        """Rows (own: their block) copied to every tile of their block with the blocks ``others``, each tile in one task."""
        rows = rows.withColumn("other", F.explode(others)).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other")
        return rows.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")

    def block_of(blocks: str) -> Column:
        return F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")

    with arrow_batches(spark, TEXT_ROWS):
        of_nodes = scratch.write(from_texts(met.select("node").distinct(), bitmaps, "size long, bits binary"), "bitmaps")
    # Each set of a place with the least one.
    star = met.where("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    for x in ("a", "b"):
        star = star.join(of_nodes.select(F.col("node").alias(x), F.col("size").alias(f"{x}_size"), F.col("bits").alias(f"{x}_bits")), x)
    with arrow_batches(spark, SET_ROWS):
        candidates = scratch.write(star.mapInArrow(possible, "a long, b long"), "candidates")
    # Nothing below that is not made of texts has more rows than the meetings.
    few = scratch.files_for(met)
    cluster = scratch.write(connected_components(candidates), "clusters", few)

    # Places whose sets the candidates leave apart. Facts of a place are summed up before they are shuffled.
    named = met.join(cluster, "node", "left").join(of_nodes.select("node", F.length("bits").alias("bytes")), "node")
    named = scratch.write(named.select("key", "node", "pivot", "bytes", F.coalesce("component", "node").alias("component")), "places", few)
    facts = {"n": F.count("*"), "all": F.bit_xor(F.xxhash64("node")), "pivot": F.min("pivot"), "bytes": F.sum("bytes"), "least": F.min("component"), "most": F.max("component")}
    apart = named.groupBy("key").agg(*[v.alias(k) for k, v in facts.items()]).where("least != most and n > 2")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    # Of places with the same sets one is enough.
    apart = apart.groupBy("n", "all", "pivot").agg(F.min(F.struct("key", blocks.alias("blocks"))).alias("x")).select("x.*")
    apart = scratch.write(apart, "split-places", few)
    tiles_of = named.select("key", "node", "component").join(apart, "key").withColumn("own", block_of("blocks")).join(of_nodes, "node")
    with arrow_batches(spark, SET_ROWS):
        more = scratch.write(tiled(tiles_of, "key", F.sequence(F.lit(0), F.col("blocks") - 1)).drop("blocks").mapInArrow(compare, "a long, b long"), "candidates")
    if more.head(1):
        cluster = scratch.write(connected_components(candidates.union(more)), "clusters", few)

    # Clusters: their arrays, once each, and in every part of a large cluster also those of its least set.
    total = cluster.join(of_nodes.select("node", "size"), "node").groupBy("component").agg(F.ceil(F.sum("size") / PART_ELEMENTS).cast("int").alias("blocks"))
    total = scratch.write(total, "cluster-sizes", few)
    members = cluster.join(total, "component").select("node", F.col("component").alias("cluster"), "blocks").withColumn("own", block_of("blocks"))
    members = members.withColumn("others", F.when(F.col("node") == F.col("cluster"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own")))
    members = members.withColumn("component", F.col("node"))

    def decided(wanted: DataFrame, alone: bool) -> DataFrame:
        rows = from_texts(wanted, arrays, "hashes array<long>")
        if alone:
            rows = rows.withColumn("own", F.explode("others")).withColumn("others", F.array("own"))
        with arrow_batches(spark, TEXT_ROWS):
            return scratch.write(tiled(rows, "cluster", F.col("others")).drop("others").mapInArrow(decide, "a long, b long"), "links")

    links = decided(members.drop("blocks"), True)
    component = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    if total.where("blocks > 1").head(1):
        component = scratch.write(connected_components(links), "components", few)
        apart = members.where("blocks > 1").drop("component", "others").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
        open_ones = apart.groupBy("cluster").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least != most").select("cluster")
        apart = apart.join(open_ones, "cluster").withColumn("others", F.expr("filter(sequence(0, blocks - 1), x -> x != own)")).drop("blocks")
        component = scratch.write(connected_components(links.union(decided(apart, False))), "components", few)
    else:
        component = scratch.write(component, "components", few)
    scratch.drop_all_but(base, component)
    return base, component


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """Groups of ``docs`` (doc_id, text) linked by Jaccard similarity of at least num / den of their word shingles.

    Returns doc_id, n_shingles and component_id, the least doc_id reachable by links. A-Z count as a-z and words end at
    ASCII white space; a text with fewer words than ``words`` is one shingle. A null, empty or blank text has no
    shingle and no link. A null doc_id stays null with its own or its group's component; repeated rows are kept each;
    an empty table gives no rows; other columns, whatever their names, are ignored; long texts are taken whole.
    """
    base, component = _sets_and_groups(docs, words, num, den)
    owner = base.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = owner.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = owner.join(least, "component").select("node", "component_id")
    return base.join(named, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row of each group of ``docs``, with all its columns: that with the least doc_id, a null one last.

    Rows are judged by their own text, so a doc_id that stands on different texts keeps each text that has no near
    copy. Of rows equal in doc_id and set one stays, whichever. Rows without a word are in no group and all stay.
    Columns keep their names and types; an empty table stays empty.
    """
    base, component = _sets_and_groups(docs, words, num, den)
    rows = base.where("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first"))
    rows = rows.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    chosen = rows.groupBy("component").agg(F.min(F.struct("first", "node")).alias("x")).select(F.col("x.first.doc_id").alias("doc"), F.col("x.node").alias("set"), F.lit(True).alias("first"))
    own = {"row": F.struct(*[F.col(f"`{c}`") for c in docs.columns]), "doc": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")}
    packed = docs.select(*[v.alias(k) for k, v in own.items()])

    @lean
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, at in text_slices(batch.column("text")):
                _, offsets, whole = document_sets(data, at, words)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, end - first) for c in ("row", "doc")), pa.array(whole.view(np.int64), mask=np.diff(offsets) == 0)], ["row", "doc", "set"])

    with_sets = packed.mapInArrow(name, StructType([packed.schema["row"], packed.schema["doc"], StructField("set", LongType())]))
    marked = with_sets.alias("r").join(chosen.alias("c"), (F.col("r.set") == F.col("c.set")) & F.col("r.doc").eqNullSafe(F.col("c.doc")), "left").where("r.set is null or c.first").select("r.*")
    if base.where("node is not null").groupBy("doc_id", "node").count().where("count > 1").head(1):
        marked = marked.where("set is null").unionByName(marked.where("set is not null").dropDuplicates(["doc", "set"]))
    with arrow_batches(docs.sparkSession, TEXT_ROWS):
        return Scratch(docs.sparkSession).write(marked.select("row.*"), "kept")
