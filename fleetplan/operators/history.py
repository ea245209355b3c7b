"""Execution history: image statistics, now and at each point in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetplan.functions.frames import instant, micros
from fleetplan.schemas import HISTORY_DAYS
from fleetplan.session import stage

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000


def recent(executions: DataFrame, as_of, days: int = HISTORY_DAYS) -> DataFrame:
    """Successful runs of the last ``days`` days before ``as_of``."""
    clock = instant(as_of)
    start = clock - F.make_dt_interval(days=F.lit(days))
    rows = executions.where(
        F.col("succeeded") & (F.col("completed_at") > start) & (F.col("completed_at") <= clock)
    )
    if "completed_date" in executions.columns:
        rows = rows.where(F.col("completed_date").between(F.to_date(start), F.to_date(clock)))
    return rows


def image_history(executions: DataFrame, as_of, days: int = HISTORY_DAYS) -> DataFrame:
    """Averages and count per image over the recent successful runs."""
    return (
        recent(executions, as_of, days)
        .groupBy("image")
        .agg(
            F.avg("actual_cpu_m").alias("hist_cpu_m"),
            F.avg("actual_mem_mib").alias("hist_mem_mib"),
            F.avg("duration_s").alias("hist_duration_s"),
            F.count("*").alias("n_samples"),
        )
    )


def enrich_with_history(tasks: DataFrame, history: DataFrame) -> DataFrame:
    """Attach image statistics, zeros where an image has none.

    The statistics, one row per image, are stored first. Their size is then known when the join is
    planned: while they are few they are broadcast and the tasks stay where they are. No
    broadcast hint: the number of images has no bound, so the size decides.
    """
    history = stage(history, "image-history")
    zeros = {"hist_cpu_m": 0.0, "hist_mem_mib": 0.0, "hist_duration_s": 0.0, "n_samples": 0}
    return tasks.join(history, "image", "left").na.fill(zeros)


def _sum_of(column: str) -> Column:
    return F.sum(column).alias(column)


def rolling_image_history(
    executions: DataFrame, days: int = HISTORY_DAYS, bucket_us: int = HOUR_US
) -> DataFrame:
    """Image statistics as they stood at each execution's own time.

    Counts successful runs of the same image that are strictly earlier and less
    than ``days`` days older. Output: one row per (image, completed_at) with
    the averages and ``n_samples``.

    An image is not one window partition, however popular. Runs are first summed
    per (image, instant). For an instant t with window (t - W, t) the sum has
    three parts, each over a small cell (image, time bucket):

    * runs before t in t's bucket: running sum from the left;
    * runs after t - W in the bucket of t - W: running sum from the right,
      taken at a probe row placed at t - W;
    * all buckets strictly between: a window over bucket totals.

    Running frames cost one pass, where a sliding frame would rescan its rows,
    and nothing is subtracted, so doubles keep their precision.
    """
    span = days * DAY_US
    parts = ["s_cpu", "s_mem", "s_dur", "s_n"]
    at = micros(F.col("completed_at"))
    measured = executions.select(
        "image",
        at.alias("t"),
        F.when(F.col("succeeded"), F.col("actual_cpu_m")).alias("c"),
        F.when(F.col("succeeded"), F.col("actual_mem_mib")).alias("m"),
        F.when(F.col("succeeded"), F.col("duration_s")).alias("d"),
        F.when(F.col("succeeded"), 1).alias("k"),
    )
    instants = measured.groupBy("image", "t").agg(
        *[
            F.coalesce(F.sum(src), F.lit(0)).alias(dst)
            for src, dst in zip(["c", "m", "d", "k"], parts)
        ]
    )
    # Every instant plays two roles: its own sums at t, and a probe at t - W.
    roles = F.array(
        F.struct(F.lit(0).alias("probe"), F.col("t").alias("pos")),
        F.struct(F.lit(1).alias("probe"), (F.col("t") - span).alias("pos")),
    )
    rows = instants.withColumn("r", F.explode(roles)).select(
        "image",
        "t",
        F.col("r.probe").alias("probe"),
        F.col("r.pos").alias("pos"),
        F.floor(F.col("r.pos") / F.lit(bucket_us)).alias("cell"),
        *[F.when(F.col("r.probe") == 0, F.col(p)).alias(p) for p in parts],
    )
    cell = Window.partitionBy("image", "cell")
    # Strictly earlier than t: rows of the same instant are already one row, and
    # a probe carries no sums, so row frames are exact.
    left = cell.orderBy("pos", "probe").rowsBetween(Window.unboundedPreceding, -1)
    # Strictly later than t - W: the probe comes first from the right only after
    # every run at its own position has been left out.
    right = cell.orderBy(F.desc("pos"), F.desc("probe")).rowsBetween(Window.unboundedPreceding, -1)
    edges = rows.select(
        "image",
        "t",
        *[
            F.when(F.col("probe") == 0, F.sum(p).over(left))
            .otherwise(F.sum(p).over(right))
            .alias(p)
            for p in parts
        ],
    )
    totals = (
        instants.groupBy("image", F.floor(F.col("t") / F.lit(bucket_us)).alias("cell"))
        .agg(*[_sum_of(p) for p in parts])
    )
    # Whole buckets between the two edge buckets, for each (image, bucket of t,
    # bucket of t - W): the two differ by W/bucket or, off the grid, by one more.
    whole = span // bucket_us
    inner = Window.partitionBy("image").orderBy("cell").rangeBetween(-(whole - 1), -1)
    middle = totals.select(
        "image", "cell", *[F.sum(p).over(inner).alias(p) for p in parts]
    )
    if span % bucket_us:
        raise ValueError("the window must be a whole number of buckets")
    placed = instants.select(
        "image", "t", F.floor(F.col("t") / F.lit(bucket_us)).alias("cell")
    ).join(middle, ["image", "cell"])
    pieces = edges.unionByName(placed.drop("cell"))
    n = F.col("s_n")
    mean = lambda p: F.when(n > 0, F.col(p) / n).otherwise(0.0)
    return (
        pieces.groupBy("image", "t")
        .agg(*[F.coalesce(F.sum(p), F.lit(0)).alias(p) for p in parts])
        .select(
            "image",
            F.timestamp_micros("t").alias("completed_at"),
            mean("s_cpu").alias("hist_cpu_m"),
            mean("s_mem").alias("hist_mem_mib"),
            mean("s_dur").alias("hist_duration_s"),
            n.cast("long").alias("n_samples"),
        )
    )


def recent_executions(executions: DataFrame, n: int | None = None) -> DataFrame:
    """Newest first; with ``n`` only the first ``n`` (a top-k, not a full sort)."""
    ordered = executions.orderBy(
        F.desc("completed_at"), "workflow_name", "task_name", "image", "duration_s"
    )
    return ordered if n is None else ordered.limit(n)


def executions_of(executions: DataFrame, workflow: str, task: str) -> DataFrame:
    return executions.where(
        (F.col("workflow_name") == workflow) & (F.col("task_name") == task)
    )
