"""Random-forest training and scoring on point-in-time features."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from operator import and_

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetplan import schemas as S
from fleetplan.functions import image_hash
from fleetplan.operators import forest
from fleetplan.operators.history import rolling_image_history
from fleetplan.session import spread, stage

FEATURES = ["image_hash", "hist_cpu_m", "hist_mem_mib", "hist_duration_s"]
TARGETS = ["actual_cpu_m", "actual_mem_mib", "duration_s"]


def training_set(executions: DataFrame, days: int = S.HISTORY_DAYS) -> DataFrame:
    """Successful runs with the statistics of their image at that time.

    Runs without any earlier history are left out: the model is only asked when
    there is some.
    """
    features = rolling_image_history(executions, days).where(F.col("n_samples") > 0)
    return (
        executions.where("succeeded")
        .join(features, ["image", "completed_at"])
        .withColumn("image_hash", image_hash(F.col("image")))
        .select("workflow_name", "task_name", "image", "completed_at", *FEATURES, *TARGETS)
    )


def row_key(df: DataFrame) -> list[str]:
    return [c for c in ("workflow_name", "task_name", "image", "completed_at", "sample_id") if c in df.columns]


def split_train_test(df: DataFrame, fraction: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Split by a hash of the row key: the same rows land on the same side
    however the data is partitioned."""
    key = F.concat_ws("|", F.lit(str(seed)), *[_as_text(df, c) for c in row_key(df)])
    # A missing key part would let two sides disagree; nulls become ''.
    share = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint") % 100
    in_train = share < int(round(fraction * 100))
    return df.where(in_train), df.where(~in_train)


def _as_text(df: DataFrame, name: str):
    column = F.col(name)
    if dict(df.dtypes)[name] == "timestamp":
        column = F.unix_micros(column)
    return F.coalesce(column.cast("string"), F.lit(""))


def train_forest(df: DataFrame, trees: int = 100, depth: int = 10, seed: int = 42) -> PipelineModel:
    """One pipeline with a forest per target. Where many rows share the bins of their features, the trees grow from sums over
    these (:mod:`fleetplan.operators.forest`), else MLlib passes over the rows; both are the same kind of forest, on other draws."""
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forests = [
        RandomForestRegressor(
            featuresCol="features", labelCol=target, predictionCol=f"p_{target}",
            numTrees=trees, maxDepth=depth, seed=seed,
            # Every tree sees all features, as usual for regression forests.
            featureSubsetStrategy="all",
            # Each row keeps the node it has reached in every tree: else every level walks all trees down from their
            # roots once more. The splits are the same. Some dozen narrow steps need no checkpoint.
            cacheNodeIds=True, checkpointInterval=-1,
        )
        for target in TARGETS
    ]
    # Rows are read several times: they are written out once.
    key = F.xxhash64(F.lit(seed), *row_key(df), *FEATURES, *TARGETS)
    rows = stage(df.select(key.alias("key"), *FEATURES, *TARGETS), "training")
    grown = forest.cell_forests(rows, FEATURES, TARGETS, trees, depth, forests[0].getMaxBins())
    if grown is None:
        return Pipeline(stages=[assembler, *forests]).fit(spread(rows.drop("key")))
    nodes, splits = stage(grown[0], "forest-nodes"), grown[1]
    with ThreadPoolExecutor(len(forests)) as pool:
        fitted = list(pool.map(lambda i: forest.as_model(forests[i], nodes.where(F.col("target") == i), len(FEATURES)), range(len(forests))))
    return forest.Forests([assembler, *fitted], splits)


def evaluate_r2(model: PipelineModel, df: DataFrame) -> DataFrame:
    """R2 per target and their mean, on held-out rows. All targets are judged in one pass over the rows."""
    spark = df.sparkSession
    aggregates = [F.count("*").alias("n")]
    for t in TARGETS:
        actual = F.col(t).cast("double")
        missed = actual - F.col(f"p_{t}")
        aggregates += [F.count(missed).alias(f"n_{t}"), F.sum(missed * missed).alias(f"e_{t}"), F.var_pop(actual).alias(f"v_{t}")]
    sums = model.transform(df).agg(*aggregates).first()
    if not sums["n"] or any(sums[f"n_{t}"] < sums["n"] for t in TARGETS):
        raise ValueError("R2 needs rows, each with all targets")

    def r2(t: str) -> float:
        missed, total = sums[f"e_{t}"], sums[f"v_{t}"] * sums["n"]
        if total == 0:
            return float("-inf") if missed > 0 else float("nan")
        return 1 - missed / total

    rows = [(t, r2(t)) for t in TARGETS]
    rows.append(("mean", sum(r for _, r in rows) / len(rows)))
    return spark.createDataFrame(rows, "target string, r2 double")


def score_forest(model: PipelineModel, enriched: DataFrame) -> DataFrame:
    """Add ml_cpu_m, ml_mem_mib, ml_duration_s and ml_confidence.

    Fixed values: 10% headroom, floors 10 / 8 / 1, confidence from the number
    of samples.
    """
    # Statistics are those of the image: tasks that share an image and its statistics have one prediction.
    shared = ["image", *FEATURES[1:]]
    asked = stage(enriched.select(*shared).distinct(), "to-score").withColumn("image_hash", image_hash(F.col("image")))
    found = stage(model.transform(asked).select(*[F.col(c).alias(f"__{c}") for c in shared], *[f"p_{t}" for t in TARGETS]), "scores")
    scored = enriched.join(found, reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in shared]))
    cpu, mem, duration = (F.col(f"p_{t}") for t in TARGETS)
    return scored.select(
        *enriched.columns,
        F.greatest(F.lit(10).cast("bigint"), (cpu * 1.1).cast("bigint")).alias("ml_cpu_m"),
        F.greatest(F.lit(8).cast("bigint"), (mem * 1.1).cast("bigint")).alias("ml_mem_mib"),
        F.greatest(F.lit(1.0), duration).alias("ml_duration_s"),
        F.least(F.lit(0.9), F.lit(0.5) + F.col("n_samples") * 0.05).alias("ml_confidence"),
    )
