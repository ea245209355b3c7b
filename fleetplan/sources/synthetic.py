"""Synthetic execution samples for training."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetplan.functions import image_hash

# Image -> base (cpu_m, mem_mib, duration_s).
PROFILES = {
    "alpine:latest": (50, 32, 5),
    "busybox:latest": (30, 16, 3),
    "python:3.12-slim": (200, 256, 30),
    "node:20-slim": (150, 192, 25),
    "golang:1.22": (300, 512, 45),
    "tensorflow/tensorflow:latest": (1000, 2048, 120),
    "pytorch/pytorch:latest": (800, 1536, 100),
    "redis:7-alpine": (100, 64, 10),
    "nginx:latest": (80, 48, 8),
    "ubuntu:22.04": (120, 128, 15),
    "gcc:latest": (400, 384, 60),
    "openjdk:21-slim": (250, 320, 35),
}
# Relative noise of history and targets, floors per dimension.
HISTORY_NOISE = 0.20
TARGET_NOISE = 0.15
FLOORS = (10, 8, 1)


def generate_executions(spark: SparkSession, n: int = 5000, seed: int = 42) -> DataFrame:
    """``n`` samples: a uniformly drawn image, noisy history, noisy targets."""
    return sample_executions(spark.range(n).withColumnRenamed("id", "sample_id"), seed)


def _drawn(rows: DataFrame, seed: int) -> DataFrame:
    """``rows`` with ``u``: sixteen uniform draws in (0, 1) per row, taken from hashes of its key.

    Unlike a seeded generator, which counts rows per partition, they do not
    depend on how the rows are partitioned or in which order they arrive.
    """
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in rows.columns])
    heads = [f"{seed}|{block}|".encode() for block in range(2)]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A digest is eight words. Sixteen conversions from hex text in an expression take twenty times as long.
        for batch in batches:
            keys = [k.encode() for k in batch.column("__key").to_pylist()]
            digests = b"".join([hashlib.sha256(head + k).digest() for k in keys for head in heads])
            values = pa.array((np.frombuffer(digests, ">u4") + 0.5) / 2.0**32)
            u = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, 16, dtype=np.int32)), values)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], u], names=[*batch.schema.names[:-1], "u"])

    schema = T.StructType([*rows.schema.fields, T.StructField("u", T.ArrayType(T.DoubleType()))])
    return rows.withColumn("__key", key).mapInArrow(draw, schema)


def sample_executions(rows: DataFrame, seed: int = 42) -> DataFrame:
    """One synthetic sample per row of ``rows``, whose columns are its key."""
    images = F.array(*[F.lit(image) for image in PROFILES])
    # The profile table has one entry per image above: twelve literals, no join.
    bases = F.array(*[F.array(*[F.lit(float(b)) for b in base]) for base in PROFILES.values()])
    drawn = _drawn(rows, seed)
    pick = (F.floor(F.col("u")[0] * len(PROFILES)) + 1).cast("int")
    drawn = drawn.select(
        "*", F.element_at(images, pick).alias("image"), F.element_at(bases, pick).alias("base")
    )

    def noisy(dimension: int, noise: float, first: int) -> Column:
        # Two uniform draws make one normal draw (Box-Muller).
        normal = F.sqrt(-2 * F.log(F.col("u")[first])) * F.cos(2 * math.pi * F.col("u")[first + 1])
        base = F.col("base")[dimension]
        return F.greatest(F.lit(float(FLOORS[dimension])), base + base * noise * normal)

    return drawn.select(
        *rows.columns,
        "image",
        image_hash(F.col("image")).alias("image_hash"),
        noisy(0, HISTORY_NOISE, 1).alias("hist_cpu_m"),
        noisy(1, HISTORY_NOISE, 3).alias("hist_mem_mib"),
        noisy(2, HISTORY_NOISE, 5).alias("hist_duration_s"),
        noisy(0, TARGET_NOISE, 7).alias("actual_cpu_m"),
        noisy(1, TARGET_NOISE, 9).alias("actual_mem_mib"),
        noisy(2, TARGET_NOISE, 11).alias("duration_s"),
    )
