"""Regression forests from sums over cells, for many rows.

A forest looks at a feature only through its bins, at most 32, so rows whose features fall into the same bins are one *cell*
to it. For each tree a cell's rows are summed up: their number in the tree's bootstrap sample, and for each target the sums of
its values and of their squares. That is all that variance splits ask for, so the trees grow from the cells and read the rows
once, where MLlib's own training passes over all rows for each level of each forest. Bins, splits, gains and leaves are MLlib's.

How often a row is in a tree's sample is a Poisson draw, as in MLlib. It is taken from a hash of the row, so it depends neither on
how the rows are partitioned nor on their order. Sums may differ in their last places, and by that the choice between equal splits.
"""

from __future__ import annotations

import math
import sys
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetplan.session import shared_dir, stage

# Tasks get these functions with their code: workers need not find the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of MLlib: rows from which candidates for splits are taken, and the impurity that counts as none.
SPLIT_ROWS = 10_000
PURE = 2.0**-52
#: Sums that a task keeps: (cell, tree) pairs of 56 bytes each for three targets. More cells leave fewer trees to a task.
MAX_SUMS = 1 << 20
#: Each task has so many trees at least, as it reads its rows for them.
LEAST_TREES = 8
#: With fewer rows for each cell MLlib passes over the rows.
ROWS_A_CELL = 8
#: Rows that are brought into the order of their cells, and rows whose draws are in memory at a time.
SORTED, CHUNK = 1 << 19, 1 << 14

_GOLDEN = 0x9E3779B97F4A7C15
# The chance of at most k draws, in units of 2^-32.
_POISSON = np.array([min(2**32 - 1, math.floor(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)))) for k in range(12)], np.uint32)

_NODE = """struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,gain:double,leftChild:int,
rightChild:int,split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>"""
_NODES = (
    "target int, tree int, id int, prediction double, impurity double, stats array<double>, n bigint, gain double, "
    "left int, right int, feature int, threshold double"
)


def find_splits(values: np.ndarray, bins: int) -> np.ndarray:
    """MLlib's thresholds between the bins of one feature, by its (sampled) values."""
    at, weights = np.unique(values + 0.0, return_counts=True)
    middles = (at[:-1] + at[1:]) / 2.0
    most = min(bins, len(values)) - 1
    if len(middles) <= most:
        return middles
    stride = len(values) / (most + 1)
    found, seen, target = [], weights[0], stride
    for middle, weight in zip(middles, weights[1:]):
        before, seen = seen, seen + weight
        if abs(before - target) < abs(seen - target):
            found.append(middle)
            target += stride
    return np.array(found)


def bootstrap(keys: np.ndarray, first: int, trees: int) -> np.ndarray:
    """How often each row is in the sample of each of ``trees`` trees from ``first`` (even) on: Poisson draws of mean 1, from the hashes of the rows."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64)[:, None] + np.uint64(_GOLDEN) * np.arange(first // 2 + 1, (first + trees + 1) // 2 + 1, dtype=np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return np.searchsorted(_POISSON, x.astype("<u8").view("<u4")[:, :trees], side="right")


def _cells(columns: list[np.ndarray], splits: list[np.ndarray]) -> np.ndarray:
    """The cell of each row: its bins, as digits of one number."""
    cell = np.zeros(len(columns[0]), np.int64)
    for values, at in zip(columns, splits):
        cell = cell * (len(at) + 1) + np.searchsorted(at, values, side="left")
    return cell


def _digits(cells: np.ndarray, splits: list[np.ndarray]) -> np.ndarray:
    """The bins of the features, one row each."""
    bins = []
    for at in reversed(splits):
        bins.append(cells % (len(at) + 1))
        cells = cells // (len(at) + 1)
    return np.array(bins[::-1])


def _numbers(rows: pa.RecordBatch | pa.Table, names: list[str]) -> list[np.ndarray]:
    return [np.asarray(rows.column(n)) for n in names]


def _sums(keys: np.ndarray, slots: np.ndarray, targets: list[np.ndarray], totals: np.ndarray, first: int) -> None:
    """Add rows to ``totals`` (cell; one, each target and its square; tree from ``first`` on)."""
    order = np.argsort(slots, kind="stable")
    parts = [np.ones(len(keys)), *[z for y in targets for z in (y, y * y)]]
    values = np.stack(parts, axis=1)[order]
    keys, slots = keys[order], slots[order]
    for at in range(0, len(keys), CHUNK):
        cell = slots[at : at + CHUNK]
        drawn = bootstrap(keys[at : at + CHUNK], first, totals.shape[2]).astype(float)
        cuts = np.flatnonzero(np.diff(cell, prepend=-1)).tolist()
        for low, high in zip(cuts, [*cuts[1:], len(cell)]):
            totals[cell[low]] += values[at + low : at + high].T @ drawn[low:high]


def _variance(n, s, q):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 0, (q - s * s / n) / n, 0.0)


def grow(bins: np.ndarray, sums: np.ndarray, splits: list[np.ndarray], depth: int) -> dict[str, np.ndarray]:
    """One tree, level by level: from the bins (feature, cell) and (count, sum, sum of squares) of each cell. Children follow
    their parents."""
    used = sums[0] > 0
    bins, sums = bins[:, used], sums[:, used]
    width = max(len(at) for at in splits) + 1
    real = np.arange(width - 1)[None, :] < np.array([len(at) for at in splits])[:, None]
    node = np.zeros(bins.shape[1], np.int64)  # of the cells that have not come to a leaf, among the nodes of this level
    parents = sums.sum(axis=1)[:, None]
    levels, first = [], 0
    for level in range(depth + 1):
        m = parents.shape[1]
        impurity = _variance(*parents)
        level_nodes = {
            "id": first + np.arange(m), "prediction": parents[1] / parents[0], "impurity": impurity, "stats": parents.T, "n": parents[0].astype(np.int64),
            "gain": np.full(m, -1.0), "left": np.full(m, -1), "right": np.full(m, -1), "feature": np.full(m, -1), "threshold": np.full(m, np.nan),
        }
        levels.append(level_nodes)
        if level == depth or not real.any():
            break
        # (sum, feature, node, split): what lies left of each split
        left = np.array([[np.bincount(node * width + b, weights=s, minlength=m * width).reshape(m, width) for b in bins] for s in sums]).cumsum(axis=3)
        right = left[..., -1:] - left[..., :-1]
        left = left[..., :-1]
        whole = left[0] + right[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = impurity[None, :, None] - left[0] / whole * _variance(*left) - right[0] / whole * _variance(*right)
        gain = np.where((left[0] >= 1) & (right[0] >= 1) & real[:, None, :], gain, -np.inf)
        flat = gain.transpose(1, 0, 2).reshape(m, -1)
        best = flat.argmax(axis=1)
        gains = flat[np.arange(m), best]
        feature, split = np.divmod(best, width - 1)
        open_ = (gains > 0) & (np.abs(impurity) >= PURE)
        k = int(open_.sum())
        if not k:
            break
        f, s, n = feature[open_], split[open_], np.flatnonzero(open_)
        children = first + m + 2 * np.arange(k)
        level_nodes["gain"][n] = gains[n]
        level_nodes["left"][n], level_nodes["right"][n] = children, children + 1
        level_nodes["feature"][n] = f
        level_nodes["threshold"][n] = [splits[a][b] for a, b in zip(f, s)]
        parents = np.stack([left[:, f, n, s], right[:, f, n, s]], axis=2).reshape(3, 2 * k)
        rank = np.cumsum(open_) - 1
        on = open_[node]
        bins, sums, node = bins[:, on], sums[:, on], node[on]
        node = 2 * rank[node] + (bins[feature[node], np.arange(len(node))] > split[node])
        first += m
    return {c: np.concatenate([x[c] for x in levels]) for c in levels[0]}


def _nodes(target: int, tree: int, grown: dict[str, np.ndarray]) -> pa.Table:
    n = len(grown["id"])
    columns = {"target": np.full(n, target, np.int32), "tree": np.full(n, tree, np.int32)}
    for name, values in grown.items():
        columns[name] = list(values) if name == "stats" else values.astype(np.int32) if name in ("id", "left", "right", "feature") else values
    return pa.table(columns)


def cell_forests(rows: DataFrame, features: list[str], targets: list[str], trees: int, depth: int, bins: int) -> tuple[DataFrame, list[np.ndarray]] | None:
    """The nodes of a forest for each target and the thresholds of each feature, or None where MLlib's own training is the one to take: rows with missing
    values, which it refuses, and rows of which few share a cell. ``rows`` have ``key``, a hash of the row, and are read three times."""
    spark = rows.sparkSession
    missing = F.lit(False)
    for c in [*features, *targets]:
        missing = missing | F.col(c).isNull() | F.isnan(c)
    n, gaps = rows.agg(F.count("*"), F.count_if(missing)).first()
    if not n or gaps or n < ROWS_A_CELL:
        return None
    few = F.lit(True) if n <= SPLIT_ROWS else F.pmod(F.xxhash64("key", F.lit("splits")), F.lit(n)) < SPLIT_ROWS
    drawn = rows.where(few).select(*features).limit(2 * SPLIT_ROWS).toArrow()
    if not drawn.num_rows:
        return None
    splits = [find_splits(drawn.column(c).to_numpy(), bins) for c in features]

    most = min(MAX_SUMS // LEAST_TREES, int(n / ROWS_A_CELL))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(0, np.int64)
        for batch in batches:
            found = np.union1d(found, _cells(_numbers(batch, features), splits))
            if len(found) > most:
                break  # too many already
        yield pa.record_batch({"cell": found})

    found = rows.select(*features).mapInArrow(count, "cell bigint").distinct().limit(most + 1).toArrow().column(0).to_numpy()
    if len(found) > most:
        return None
    cells = np.sort(found)
    # Tasks are parts of the rows by blocks of trees; each gives sums for all cells, so the rows are in no more parts than
    # it takes to keep all cores busy.
    block = max(2, MAX_SUMS // len(cells) // 2 * 2)
    blocks = range(0, trees, block)
    numbers = rows.select("key", *[F.col(c).cast("double").alias(c) for c in [*features, *targets]])
    parted = numbers.coalesce(-(-2 * spark.sparkContext.defaultParallelism // len(blocks)))

    def add_up(first: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals = np.zeros((len(cells), 2 * len(targets) + 1, min(block, trees - first)))
            held: list[pa.RecordBatch] = []

            def add() -> None:
                rows = pa.Table.from_batches(held)
                slots = np.searchsorted(cells, _cells(_numbers(rows, features), splits))
                _sums(_numbers(rows, ["key"])[0], slots, _numbers(rows, targets), totals, first)
                held.clear()

            for batch in batches:
                held.append(batch)
                if sum(b.num_rows for b in held) >= SORTED:
                    add()
            if held:
                add()
            for tree in range(totals.shape[2]):
                yield pa.record_batch({"tree": pa.array([first + tree], pa.int32()), "sums": pa.array([totals[:, :, tree].T.tobytes()], pa.binary())})

        return parted.mapInArrow(run, "tree int, sums binary")

    def grow_all(group: pa.Table) -> pa.Table:
        totals = sum(np.frombuffer(b.as_buffer()).reshape(2 * len(targets) + 1, len(cells)) for b in group.column("sums"))
        codes, tree = _digits(cells, splits), group.column("tree")[0].as_py()
        forests = [grow(codes, totals[[0, 2 * i + 1, 2 * i + 2]], splits, depth) for i in range(len(targets))]
        return pa.concat_tables([_nodes(i, tree, grown) for i, grown in enumerate(forests)])

    sums = reduce(DataFrame.union, [add_up(first) for first in blocks])
    return sums.groupBy("tree").applyInArrow(grow_all, _NODES), splits


def as_model(estimator: RandomForestRegressor, nodes: DataFrame, features: int) -> RandomForestRegressionModel:
    """MLlib's model with these nodes (of one target). A model of one row gives the form in which it is stored."""
    spark = nodes.sparkSession
    label, vector = estimator.getLabelCol(), estimator.getFeaturesCol()
    form = estimator.fit(spark.createDataFrame([(Vectors.dense([0.0] * features), 0.0)], [vector, label]))
    path = f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}/forest-{uuid.uuid4().hex}"
    form.write().save(path)
    leaf = F.col("feature") < 0
    split = F.struct(F.col("feature"), F.when(leaf, F.array().cast("array<double>")).otherwise(F.array("threshold")), F.lit(-1))
    data = F.struct("id", "prediction", "impurity", "stats", "n", "gain", "left", "right", split).cast(_NODE)
    nodes.select(F.col("tree").alias("treeID"), data.alias("nodeData")).coalesce(1).write.mode("overwrite").parquet(f"{path}/data")
    return RandomForestRegressionModel.load(path)


class Forests(PipelineModel):
    """An assembler and forests grown from cells. Rows of one cell have the same predictions, so one row of each
    is walked down the trees; the others look its predictions up. Stored and loaded, it is a plain pipeline."""

    def __init__(self, stages: list, splits: list[np.ndarray]):
        super().__init__(stages)
        self.splits = splits

    def _transform(self, dataset: DataFrame) -> DataFrame:
        assembler, *forests = self.stages
        features, splits = assembler.getInputCols(), self.splits

        def place(*columns: pd.Series) -> pd.Series:
            missing = np.logical_or.reduce([c.isna() for c in columns])
            return pd.Series(np.where(missing, -1, _cells([c.to_numpy() for c in columns], splits)))

        cell = F.pandas_udf(place, "bigint")(*[F.col(c).cast("double") for c in features])
        rows = dataset.withColumn("__cell", cell)
        # The least values of a cell lie in it. Rows with missing values are left to the assembler, which refuses them.
        least = [F.when(F.col("__cell") >= 0, F.min(F.col(c).cast("double"))).alias(c) for c in features]
        asked = PipelineModel(self.stages).transform(rows.groupBy("__cell").agg(*least))
        predictions = stage(asked.select("__cell", *[f.getPredictionCol() for f in forests]), "predictions")
        return assembler.transform(rows).join(predictions, "__cell", "left").drop("__cell")
