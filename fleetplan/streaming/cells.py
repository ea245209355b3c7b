"""Image statistics kept up to date: sums and counts per (image, hour), so that planning reads cells and not runs.

A batch of history rows adds its own cells; a reader adds up the cells of an hour, whichever batches they came with, so a
run that is told late counts from then on. Batch N also rolls the images of bucket N mod ``buckets``: their cells become
one for each hour, and hours that have left the window for good are dropped. So a table holds at most one cell for each image
and hour of the window and bucket, and the batches since the last roll.

Only the first and the last hour of a window are cut by it. Their runs are read from the history, at most two hours of it.

Sums of durations are exact (decimals of nine places, see ``functions.exact``); nulls do not count in an average, as in
``image_history``. Runs without a time, and those that failed, make no cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetplan import schemas as S
from fleetplan.functions.exact import value_of
from fleetplan.functions.frames import instant, micros
from fleetplan.operators.history import HOUR_US, recent
from fleetplan.streaming.rolling import BUCKETS, Rolled

CELL = ["image", "hour"]
_MEASURES = {"cpu": "actual_cpu_m", "mem": "actual_mem_mib", "duration": "duration_s"}
SUMS = [f"{kind}_{m}" for m in _MEASURES for kind in ("sum", "n")] + ["n"]


def hour_of(time: Column) -> Column:
    return F.floor(micros(time) / F.lit(HOUR_US)).cast("bigint")


def cells_of(executions: DataFrame) -> DataFrame:
    """Sums and counts of the successful runs per (image, hour)."""
    parts = []
    for name, column in _MEASURES.items():
        parts += [F.sum(F.when(F.col(column).isNotNull(), value_of(F.col(column)))).alias(f"sum_{name}"), F.count(column).alias(f"n_{name}")]
    rows = executions.where(F.col("succeeded") & F.col("completed_at").isNotNull())
    return rows.groupBy("image", hour_of(F.col("completed_at")).alias("hour")).agg(*parts, F.count("*").alias("n"))


def _added(cells: DataFrame, *keys: str) -> DataFrame:
    return cells.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS])


class CellTable(Rolled):
    """The cells of a history that grows by batches."""

    KEY = ["image"]

    def __init__(self, spark, path: str, keep_days: int = S.HISTORY_DAYS, buckets: int = BUCKETS):
        self.spark = spark
        self.path = path
        self.keep_days = keep_days
        self.buckets = buckets
        sums = ", ".join(f"{c} {'decimal(38,9)' if c.startswith('sum') else 'bigint'}" for c in SUMS)
        self.schema = f"image string, hour bigint, {sums}, batch bigint"

    def _stored(self, cells: DataFrame, batch: int) -> DataFrame:
        sums = [F.col(c).cast("decimal(38,9)" if c.startswith("sum") else "bigint").alias(c) for c in SUMS]
        return cells.select(*CELL, *sums, F.lit(batch).cast("bigint").alias("batch"))

    def write(self, executions: DataFrame, batch: int, as_of) -> None:
        """Add the runs of a batch. A batch that is run again replaces its cells. No reader will ask for a window that ends
        before ``as_of``, the clock of the batch; clocks do not go back."""
        self._stored(cells_of(executions), batch).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        first = hour_of(instant(as_of) - F.make_dt_interval(days=F.lit(self.keep_days)))
        base = _added(self._mine(batch).where(F.col("hour") >= first), *CELL)
        self._stored(base, batch).write.mode("overwrite").parquet(f"{self.path}-base/roll={batch}")
        self._prune(batch - self.buckets)

    def history(self, executions: DataFrame, as_of, days: int | None = None, before_batch: int | None = None) -> DataFrame:
        """What ``image_history`` gives for the same runs. ``executions`` is asked for two hours alone."""
        days = self.keep_days if days is None else days
        if days > self.keep_days:
            raise ValueError(f"cells are kept for {self.keep_days} days")
        clock = instant(as_of)
        start = clock - F.make_dt_interval(days=F.lit(days))
        first, last = hour_of(start), hour_of(clock)
        inside = self.log(before_batch).where((F.col("hour") > first) & (F.col("hour") < last)).select("image", *SUMS)
        # bounds as times, so that the scan skips what lies between
        cut = lambda hour: F.timestamp_micros(hour * F.lit(HOUR_US))
        at = F.col("completed_at")
        ends = recent(executions, as_of, days).where((at < cut(first + 1)) | (at >= cut(last)))
        if "completed_date" in executions.columns:
            day = F.col("completed_date")
            ends = ends.where((day <= F.to_date(cut(first + 1))) | (day >= F.to_date(cut(last))))
        found = _added(inside.unionByName(cells_of(ends).select("image", *SUMS)), "image")
        mean = lambda m: F.when(F.col(f"n_{m}") > 0, F.col(f"sum_{m}").cast("double") / F.col(f"n_{m}"))
        return found.select(
            "image", mean("cpu").alias("hist_cpu_m"), mean("mem").alias("hist_mem_mib"), mean("duration").alias("hist_duration_s"),
            F.col("n").alias("n_samples"),
        )
