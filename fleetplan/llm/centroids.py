"""Centroid clustering of integer vectors with the equal-average equal-variance search.

Centroids are sorted by the sum of their components. A vector starts at the centroid whose sum is nearest to its own
and looks outward to both sides. With d components, S their sum and V the root of their squared deviations from the mean, the squared
distance is at least (S - S')**2 / d + (V - V')**2. The first term alone ends a side for good, both together skip a
centroid; those left get their exact distance in integers. Bounds are lowered by more than the rounding of doubles, so
that no centroid is rejected that is nearest or ties with the nearest.

Vectors are made integers once and stored. A round is one pass over them: each task adds up its vectors by cluster and sends k * (d + 1)
numbers, whatever its size; the sums of all, as many again, come to the driver, which divides them. Both numbers are parameters, so
nothing grows with the data.

Null or odd input: vectors that are null, of another length, or hold null or non-finite components are left out. A component's integer is held
within +-2**27, so that any squared distance of ``DIMENSIONS`` components fits 63 bits. Repeated rows are vectors each; a null id is an id, which
comes last among the first centroids; ids that are equal follow each other by their vectors. Of equally near centroids the one
of smaller number counts. With fewer vectors than centroids each vector starts one; without vectors there are no rows. Sums of
distances end at 2**63 - 1. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetplan.llm.texts import short_batches
from fleetplan.session import stage

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, "1"
#: Largest absolute value of an integer component.
BOUND = 1 << 27
#: Vectors searched together: their differences from one centroid each are held at a time.
BLOCK_ROWS = 2048


def _integers(vectors: DataFrame, key: str, vector: str, dimensions: int, scale: int) -> DataFrame:
    """(id, v): the kept vectors, ``v`` as little-endian 64-bit integers."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            values = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
            values = np.clip(np.floor(values * float(scale)), -BOUND, BOUND).astype("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in values], pa.binary())], names=["id", "v"])

    usable = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") == dimensions) & F.forall("v", usable))
    return rows.mapInArrow(convert, f"id {rows.schema['id'].dataType.simpleString()}, v binary")


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, dimensions)


class Search:
    """Nearest of a few centroids, exactly, for blocks of integer vectors."""

    def __init__(self, centroids: np.ndarray):
        self.number = np.argsort(centroids.sum(1), kind="stable")
        self.centroids = centroids[self.number]
        self.sums = self.centroids.sum(1)
        self.spread = _spread(self.centroids)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Numbers and squared distances of the nearest centroids, and how many distances were computed."""
        n, k, d = len(vectors), len(self.centroids), vectors.shape[1]
        sums, spread = vectors.sum(1), _spread(vectors)
        best = np.full(n, np.iinfo(np.int64).max)
        number = np.full(n, k, np.int64)
        computed = 0
        # places of the next centroid below and above the vector's own sum
        above = np.searchsorted(self.sums, sums)
        below = above - 1
        low, high = below >= 0, above < k
        while low.any() or high.any():
            gap_low = np.where(low, np.abs(sums - self.sums[np.maximum(below, 0)]), np.iinfo(np.int64).max)
            gap_high = np.where(high, np.abs(sums - self.sums[np.minimum(above, k - 1)]), np.iinfo(np.int64).max)
            down = low & (gap_low <= gap_high)
            going = np.flatnonzero(low | high)
            place = np.where(down, below, above)[going]
            gap = np.where(down, gap_low, gap_high)[going].astype(float)
            reach = best[going].astype(float)
            by_mean = gap * gap / d
            margin = 1 - 1e-9
            ended = by_mean * margin > reach
            apart = spread[going] - self.spread[place]
            # spreads are roots of numbers up to 2**62: their error is far below the margin and one unit
            wide = np.maximum(np.abs(apart) - 1e-6 * (1 + spread[going] + self.spread[place]), 0)
            skipped = (by_mean + wide * wide) * margin > reach
            near = np.flatnonzero(~ended & ~skipped)
            rows, at = going[near], place[near]
            difference = vectors[rows] - self.centroids[at]
            distance = np.einsum("ij,ij->i", difference, difference)
            computed += len(rows)
            better = (distance < best[rows]) | ((distance == best[rows]) & (self.number[at] < number[rows]))
            best[rows[better]], number[rows[better]] = distance[better], self.number[at[better]]
            # all further centroids of a side are at least as far off by their mean
            is_down = down[going]
            below[going[is_down]] -= 1
            above[going[~is_down]] += 1
            low[going[ended & is_down]] = False
            high[going[ended & ~is_down]] = False
            low &= below >= 0
            high &= above < k
        return number, best, computed


def _spread(rows: np.ndarray) -> np.ndarray:
    """Root of the summed squared deviations from the mean."""
    values = rows.astype(float)
    return np.sqrt(((values - values.mean(1, keepdims=True)) ** 2).sum(1))


def _first(vectors: DataFrame, clusters: int, seed: str, dimensions: int) -> np.ndarray:
    """The vectors with the smallest hashes of their ids; at most ``clusters`` rows."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.orderBy(order.asc_nulls_last(), "v").select("v").limit(clusters).collect()
    return np.array([np.frombuffer(r.v, "<i8") for r in rows], np.int64).reshape(-1, dimensions)


def _sums(vectors: DataFrame, centroids: np.ndarray) -> dict[tuple[int, int], int]:
    """Summed components by (cluster, component), and counts as component -1."""
    dimensions = centroids.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        total = np.zeros((len(centroids), dimensions + 1), object)
        for batch in batches:
            values = _matrix(batch.column(0), dimensions)
            for at in range(0, len(values), BLOCK_ROWS):
                block = values[at : at + BLOCK_ROWS]
                number, _, _ = search.nearest(block)
                part = np.zeros(total.shape, np.int64)
                np.add.at(part[:, 1:], number, block)
                part[:, 0] = np.bincount(number, minlength=len(centroids))
                total = total + part.astype(object)
        cluster, component = np.nonzero(total != 0)
        text = [str(x) for x in total[cluster, component]]
        yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(component - 1, pa.int32()), pa.array(text, pa.string())], names=["cluster", "component", "s"])

    parts = vectors.select("v").mapInArrow(add, "cluster int, component int, s string")
    rows = parts.groupBy("cluster", "component").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    return {(r.cluster, r.component): int(r.s) for r in rows}


def _moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid at the floor of the mean of its vectors; where it has none, it stays."""
    sums = _sums(vectors, centroids)
    moved = centroids.copy()
    for c in range(len(centroids)):
        if n := sums.get((c, -1), 0):
            moved[c] = [sums.get((c, i), 0) // n for i in range(centroids.shape[1])]
    return moved


def _assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    dimensions = centroids.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        for batch in batches:
            values = _matrix(batch.column(1), dimensions)
            found = [search.nearest(values[at : at + BLOCK_ROWS])[:2] for at in range(0, len(values), BLOCK_ROWS)]
            number, distance = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    return vectors.mapInArrow(assign, f"id {vectors.schema['id'].dataType.simpleString()}, cluster int, distance bigint")


def cluster_vectors(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
    seed: str = SEED,
) -> tuple[DataFrame, DataFrame]:
    """Vectors (``key``, cluster, distance) and clusters (cluster, centroid, n, cluster_inertia, inertia).

    ``distance`` is the squared distance to the centroid, inertia its sum over the cluster or over all. A cluster without vectors has no sums.
    """
    spark = vectors.sparkSession
    short_batches(spark)
    held = stage(_integers(vectors, key, vector, dimensions, scale), "integer-vectors")
    centroids = _first(held, clusters, seed, dimensions)
    for _ in range(rounds if len(centroids) else 0):
        centroids = _moved(held, centroids)
    assigned = stage(_assigned(held, centroids), "clustered")
    own = assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    own = own.collect()  # a row for each cluster
    total = sum(int(r.s) for r in own)
    held_in = lambda x: min(int(x), (1 << 63) - 1)
    sums = {r.cluster: (r.n, held_in(r.s)) for r in own}
    rows = [(c, centroids[c].tolist(), *sums.get(c, (0, None)), held_in(total)) for c in range(len(centroids))]
    table = spark.createDataFrame(rows, "cluster int, centroid array<bigint>, n bigint, cluster_inertia bigint, inertia bigint")
    return assigned.withColumnRenamed("id", key), table


def centroid_digest(centroid: Column) -> Column:
    """Hash of the components as decimal numbers, joined by commas."""
    return F.sha2(F.array_join(F.transform(centroid, lambda x: x.cast("string")), ","), 256)
