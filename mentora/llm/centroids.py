"""Lloyd's clustering of integer vectors by differences between rounds.

Vectors lie in blocks that are written once. Of each round only the assignments (owner and distance) are kept and
the sums and counts of all clusters, as integers. The next round compares a vector with the centroids that have changed,
or with all of them where its own has; every other centroid is as far as before. From vectors whose owner has moved the
blocks form transfers, minus to the old and plus to the new cluster, which Spark adds up to the new sums. So each round
gives exactly what a full one would.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentora.llm.storage import Scratch, arrow_batches, co_located, lean

#: Vectors of a block.
BLOCK_ROWS = 4096
#: Blocks that a Python function gets at a time.
BATCH_BLOCKS = 4
NO_OWNER = -1


def exact(dims: int, largest: int, limit: int) -> bool:
    """Whether all squared distances of vectors with components of at most ``largest`` stay below ``limit``."""
    return dims * (2 * largest) ** 2 < limit


def squared_distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances; by matrix products where floating point holds every term exactly."""
    largest = max((int(abs(x).max()) for x in (vectors, centroids) if x.size), default=0)
    if not exact(vectors.shape[1], largest, 1 << 63):
        raise ValueError(f"components of {largest} are too large for exact distances of {vectors.shape[1]} dimensions")
    if exact(vectors.shape[1], largest, 1 << 53):
        a, b = vectors.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((vectors - c) ** 2).sum(1) for c in centroids], 1)


def reassign(vectors: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroids, smaller numbers first, from those before and from which centroids have ``changed``."""
    owner, distance = owner.copy(), distance.copy()
    lost = (owner == NO_OWNER) | changed[owner]
    if lost.any():
        all_of = squared_distances(vectors[lost], centroids)
        owner[lost] = all_of.argmin(1)
        distance[lost] = all_of.min(1)
    kept, new = np.flatnonzero(~lost), np.flatnonzero(changed)
    if len(kept) and len(new):
        some = squared_distances(vectors[kept], centroids[new])
        best = some.argmin(1)
        near, number = some[np.arange(len(kept)), best], new[best]
        better = (near < distance[kept]) | ((near == distance[kept]) & (number < owner[kept]))
        owner[kept[better]], distance[kept[better]] = number[better], near[better]
    return owner, distance


def transfers(vectors: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(clusters, signed sums of components and, last, signed counts) of the vectors whose owner has moved."""
    moved = np.flatnonzero(before != after)
    rows = np.concatenate([vectors[moved], np.ones((len(moved), 1), np.int64)], 1)
    cluster = np.concatenate([before[moved], after[moved]])
    signed = np.concatenate([-rows, rows])[cluster != NO_OWNER]
    cluster = cluster[cluster != NO_OWNER]
    order = np.argsort(cluster, kind="stable")
    numbers, at = np.unique(cluster[order], return_index=True)
    return numbers, np.add.reduceat(signed[order], at, axis=0) if len(at) else signed


def digest(centroid: list[int]) -> str:
    """Hexadecimal sha256 of the components, as decimal integers joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def delta_lloyd(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """Clusters of ``vectors`` (vec_id, embedding) after ``rounds`` rounds of exact integer arithmetic.

    Only vectors of ``dims`` components, none null or non-finite, count; components become floor(scale * x). The first
    centroids are the ``k`` vectors with the smallest sha256 of ``<seed>:<vec_id>``; with fewer vectors there are as many
    centroids, and a vector without vec_id starts one only if the others don't suffice. Every round assigns each vector
    to the nearest centroid (ties: smaller number) and moves centroids that have vectors to the floor of their mean; at
    last vectors are assigned once more. It ends early once no centroid moves. Returns vec_id, cluster, distance
    (squared), cluster_inertia, inertia and centroid_sha256. Repeated rows count each; a null vec_id stays null; an empty
    table gives no rows; other columns, whatever their names, are ignored. Components for which squared distances might
    pass 63 bits, and sums of distances that do, raise an error. The driver holds k sums of ``dims`` components, whatever the number of vectors.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    whole = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = vectors.select(F.spark_partition_id().alias("part"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    rows = rows.where((F.size("x") == dims) & F.forall("x", whole)).withColumn("x", F.transform("x", lambda x: F.floor(x * F.lit(float(scale)))))

    @lean
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            n = batch.num_rows
            if n:
                ids, x = batch.column("vec_id"), batch.column("x").flatten()
                one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
                yield pa.RecordBatch.from_arrays([batch.column("part").slice(0, 1), pa.array([number], pa.int32()), one(ids), one(x)], ["part", "block", "ids", "x"])
                number += 1

    with arrow_batches(spark, BLOCK_ROWS, 4 << 20):
        blocks = scratch.write_parts(rows.mapInArrow(pack, "part int, block int, ids array<long>, x array<long>"), "vector-blocks")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last()
    centroids = np.array([r.x for r in rows.orderBy(order, "x").limit(k).select("x").collect()], np.int64).reshape(-1, dims)
    k = len(centroids)

    def assigned(now: DataFrame | None, centroids: np.ndarray, changed: np.ndarray) -> DataFrame:
        """(part, block, owner, distance, clusters, sums) of all blocks; the last two are its transfers."""
        fresh = now is None

        @lean
        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    x = batch.column("x")[i].values.to_numpy().reshape(-1, dims)
                    if fresh:
                        owner, distance = np.full(len(x), NO_OWNER, np.int64), np.zeros(len(x), np.int64)
                    else:
                        owner, distance = (batch.column(c)[i].values.to_numpy().astype(np.int64) for c in ("owner", "distance"))
                    new, far = reassign(x, owner, distance, centroids, changed)
                    numbers, sums = transfers(x, owner, new)
                    lists = [pa.array([v], pa.list_(t)) for v, t in ((new, pa.int32()), (far, pa.int64()), (numbers, pa.int32()), (sums.ravel(), pa.int64()))]
                    yield pa.RecordBatch.from_arrays([batch.column("part").slice(i, 1), batch.column("block").slice(i, 1), *lists], ["part", "block", "owner", "distance", "clusters", "sums"])

        source = blocks.select("part", "block", "x")
        if not fresh:
            source = source.join(now.select("part", "block", "owner", "distance").hint("shuffle_hash"), ["part", "block"])
        with co_located(spark), arrow_batches(spark, BATCH_BLOCKS):
            return scratch.write(source.mapInArrow(assign, "part int, block int, owner array<int>, distance array<long>, clusters array<int>, sums array<long>"), "assignments")

    def total(now: DataFrame) -> np.ndarray:
        """Transfers of all blocks: k rows of ``dims`` signed sums and a signed count, as Python integers."""
        each = now.select("clusters", F.posexplode("sums").alias("at", "value"))
        each = each.groupBy(F.element_at("clusters", (F.col("at") / (dims + 1)).cast("int") + 1).alias("cluster"), (F.col("at") % (dims + 1)).alias("component"))
        out = np.zeros((k, dims + 1), object)
        for r in each.agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
            out[r.cluster, r.component] = int(r.value)
        return out

    now, sums = None, np.zeros((k, dims + 1), object)
    changed = np.ones(k, bool)
    for step in range(rounds + 1):
        if step:
            new = centroids.copy()
            for c in np.flatnonzero(sums[:, dims] > 0).tolist():
                new[c] = [x // sums[c, dims] for x in sums[c, :dims]]
            changed = (new != centroids).any(1)
            centroids = new
        if not changed.any():
            break
        now = assigned(now, centroids, changed)
        sums = sums + total(now)
        scratch.drop_all_but(blocks, now, tables=False)
    if now is None:
        now = assigned(None, centroids.reshape(-1, dims), changed)
    with co_located(spark):
        lists = blocks.select("part", "block", "ids").join(now.select("part", "block", "owner", "distance").hint("shuffle_hash"), ["part", "block"])
        flat = lists.select(F.explode(F.arrays_zip("ids", "owner", "distance")).alias("v")).select(F.col("v.ids").alias("vec_id"), F.col("v.owner").alias("cluster"), F.col("v.distance").alias("distance"))
        out = scratch.write(flat, "clusters")
    own = {r.cluster: int(r.inertia) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
    facts = spark.createDataFrame([(c, own.get(c, 0), sum(own.values()), digest(centroids[c].tolist())) for c in range(k)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    scratch.drop_all_but(out)
    # One row for each centroid, k at most.
    return out.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
