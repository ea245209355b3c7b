"""Approximate nearest neighbours by cosine with a forest of hash prefixes.

A tree gives each vector a long string of bits, the signs of its products with random directions, and keeps
the strings sorted. A query descends each tree to its longest matching prefix; then all trees ascend together,
one bit at a time, until the rows below the query's prefixes are enough. Those are compared exactly, in double
precision on the original vectors.

Vectors are dealt into shards of bounded size by a hash of their id, each with a forest of its own; every query
asks every shard, and the shards' best are merged. Of equal vectors only the ``k`` + 1 with the smallest ids
enter the forest: no other can be among the nearest ``k``, because ties go to the smaller id.

Null or odd input: vectors that are null, zero, or hold null, infinite or NaN components take no part, neither as queries nor as
candidates; vectors of another dimension than the query's are no candidates; rows that repeat an id are one
candidate each if their vectors differ, and queries each; a null id takes no part; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetplan.llm.texts import short_batches

#: Trees of a forest, and bits of a string.
TREES, BITS = 16, 24
#: Vectors of a shard, and rows below the query's prefixes (with repeats over trees) at which the ascent ends.
SHARD_ROWS, ENOUGH = 20_000, 12_000


class Forest:
    """Sorted strings of one shard's vectors, for each tree."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS):
        self.bits = bits
        draw = np.random.Generator(np.random.PCG64(11))
        self.directions = draw.standard_normal((trees, vectors.shape[1], bits))
        codes = self.codes(vectors)
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, 1)

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """The strings as integers: one row for each tree."""
        place = (1 << np.arange(self.bits - 1, -1, -1)).astype(np.int64)
        return np.stack([(vectors @ d > 0) @ place for d in self.directions])

    def candidates(self, queries: np.ndarray, enough: int = ENOUGH):
        """For each query the rows below its prefixes at the depth where the ascent ends."""
        codes = self.codes(queries)
        trees, n = codes.shape
        low, high = np.zeros((trees, n), np.int64), np.zeros((trees, n), np.int64)
        going = np.ones(n, bool)
        for depth in range(self.bits, -1, -1):
            width = self.bits - depth
            floor = codes[:, going] >> width << width
            for t in range(trees):
                low[t, going] = np.searchsorted(self.sorted[t], floor[t], "left")
                high[t, going] = np.searchsorted(self.sorted[t], floor[t] + (1 << width), "left")
            going &= (high - low).sum(0) < enough
            if not going.any():
                break
        for i in range(n):
            below = np.zeros(self.order.shape[1], bool)
            for t in range(trees):
                below[self.order[t, low[t, i] : high[t, i]]] = True
            yield np.flatnonzero(below)


def cosines(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines in double precision, components added in order."""
    dots = np.cumsum(vectors * query, axis=1)[:, -1]
    norms = np.cumsum(vectors * vectors, axis=1)[:, -1]
    return dots / (np.sqrt(np.cumsum(query * query)[-1]) * np.sqrt(norms))


def _leading(query: np.ndarray, vectors: np.ndarray, norms: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Those of the candidates ``at`` that can be among the nearest ``k``: by products in any order of terms, with a
    margin far above their rounding. Where products leave the range of doubles, all of them."""
    if len(at) <= k:
        return at
    with np.errstate(all="ignore"):
        rough = vectors[at] @ query / norms[at]
        margin = 1e-9 * np.sqrt(query @ query)
    if not (np.isfinite(rough).all() and np.isfinite(margin)):
        return at
    return at[rough >= np.partition(rough, len(at) - k)[len(at) - k] - margin]


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", enough: int = ENOUGH, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """(query_id, rank, ``key``, score): the ``k`` nearest found for each query, its own id left out."""
    short_batches(vectors.sparkSession)
    form = lambda df: df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & _usable(F.col("v")))
    same = Window.partitionBy("v").orderBy("id")
    # rows of one id and vector are one candidate, and must not take the places of other ids
    rows = form(vectors).distinct().withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1).select("id", "v")
    shards = vectors.count() // shard_rows + 1
    held = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    # rows of one id and vector are one query
    asked = form(queries).distinct().withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))))

    def matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
        return np.stack(column.combine_chunks().flatten().to_numpy().reshape(n, -1)) if n else np.zeros((0, 0))

    def search(index: pa.Table, query: pa.Table) -> pa.Table:
        found = {"query_id": [], "id": [], "score": [], "v": []}
        sizes = lambda t: np.diff(t.column("v").combine_chunks().offsets.to_numpy()) if len(t) else np.zeros(0, int)
        for dim in np.unique(sizes(query)).tolist():
            own, ask = index.filter(pa.array(sizes(index) == dim)), query.filter(pa.array(sizes(query) == dim))
            if not len(own):
                continue
            ids, values = own.column("id").to_numpy(), matrix(own.column("v"), len(own))
            forest = Forest(values)
            norms = np.sqrt(np.einsum("ij,ij->i", values, values))
            q_ids, q_values = ask.column("id").to_numpy(), matrix(ask.column("v"), len(ask))
            for i, at in enumerate(forest.candidates(q_values, enough)):
                at = _leading(q_values[i], values, norms, at[ids[at] != q_ids[i]], k)
                score = cosines(q_values[i], values[at])
                best = np.lexsort((ids[at], -score))[:k]
                found["query_id"] += [int(q_ids[i])] * len(best)
                found["id"] += ids[at[best]].tolist()
                found["score"] += score[best].tolist()
                found["v"] += [q_values[i].tobytes()] * len(best)
        return pa.table([pa.array(found["query_id"], pa.int64()), pa.array(found["id"], pa.int64()), pa.array(found["score"], pa.float64()), pa.array(found["v"], pa.binary())], names=list(found))

    found = asked.groupBy("shard").cogroup(held.groupBy("shard")).applyInArrow(lambda q, i: search(i, q), "query_id bigint, id bigint, score double, v binary")
    best = Window.partitionBy("query_id", "v").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")
