"""Connected components of a table of links, and groups of rows streamed through Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetplan.session import stage


def contracted(links: DataFrame) -> DataFrame:
    """Fewer links (a, b) with the same components: each node keeps one of its b, the smallest, and its
    other ones are linked to that. Members of a large group name few b, so most links become equal."""
    links = stage(links.select("a", "b").distinct(), "all-links")
    one = links.groupBy("a").agg(F.min("b").alias("m"))
    others = links.join(one, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    return one.select("a", F.col("m").alias("b")).union(others)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b: bigint): the smallest node it is connected to.

    Links are contracted first. Then each round takes the smallest label of a node's neighbours and then the label of that label, so
    labels travel along chains in strides that double. Each round is a stored table.
    """
    links = stage(contracted(links), "contracted-links")
    both = stage(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        nearer = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("next"))
        upper = labels.select(F.col("node").alias("next"), F.col("root").alias("above"))
        labels = stage(nearer.join(upper, "next", "left").select("node", "old", F.least("next", "above").alias("root")), "labels")
        if labels.where("old <> root").isEmpty():
            return labels.select("node", "root")


def sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The groups of rows with equal first column, of batches that are sorted by it."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        keys = table.column(0).to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        at = 0
        for cut in cuts.tolist():
            yield table.slice(at, cut - at)
            at = cut
        rest = table.slice(at)
    if rest is not None and len(rest):
        yield rest


def roots(linked: np.ndarray) -> np.ndarray:
    """The smallest place connected to each place of a symmetric matrix of links."""
    n = len(linked)
    linked = linked | np.eye(n, dtype=bool)
    label = np.arange(n)
    while True:
        new = np.where(linked, label, n).min(1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def cells(members: DataFrame, group: str, node: str, size: str, block: int) -> DataFrame:
    """Deal the members of groups to cells in which each two of a group meet exactly once.

    A group of up to ``block`` members is one cell. A larger one is dealt into blocks by the hash of the node,
    and each pair of blocks is a cell, so no task ever holds more than two blocks. Adds ``cell`` (bigint) and
    ``side``: 0 or 1 in a cell of two blocks, where only members of different sides are to be compared; -1 else.
    """
    blocks = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64(node, F.lit(3)), blocks).cast("int")
    dealt = members.withColumn("__blocks", blocks).withColumn("__own", own)
    dealt = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    low, high = F.least("__own", "__other"), F.greatest("__own", "__other")
    side = F.when(low == high, -1).when(F.col("__own") == low, 0).otherwise(1)
    return dealt.withColumn("cell", F.xxhash64(group, low, high)).withColumn("side", side).drop("__blocks", "__own", "__other")
