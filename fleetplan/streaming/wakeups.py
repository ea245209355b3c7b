"""Which tasks are ready, kept up to date: each waiting task knows how many of its dependencies have not succeeded.

A row of a :class:`WakeTable` is a task that has not ended: its phase, the number of its different unmet dependencies and the
names of the tasks that depend on it. When a task succeeds, each of its dependents loses one; at none it is woken. So a batch
of pod events reads and writes the tasks that moved and those that depend on them, and no whole workflow. A task leaves
the table when it has ended, since its dependents then know; the table holds what is still to be done.

* A repeated or late event moves nothing twice: phases go forward alone, and a task that has left takes no events.
* A dependency listed twice counts once. One that is no task of the workflow has a row of its own, which an event may
  end; until then its dependents wait.
* A failed task wakes nothing.
* Tasks without a name take no part. Names repeated within a workflow are one task.
* Names of dependents are an array, no longer than the workflow's document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetplan import schemas as S
from fleetplan.session import stage
from fleetplan.streaming.phases import TASK, ChangeTable, _started, fold_phases
from fleetplan.streaming.rolling import BUCKETS, Rolled


def _is(*phases: str) -> Column:
    return F.col("phase").isin(*phases)


def counters(tasks: DataFrame, edges: DataFrame, status: DataFrame) -> DataFrame:
    """The rows of a :class:`WakeTable` for whole workflows as they stand. ``unmet`` is null where a name is no task."""
    named_arcs = edges.where(F.col("task_name").isNotNull())
    # Grouped by the key they are joined on, by one exchange for both uses; a set holds each arc once.
    arcs = named_arcs.where(F.col("dep").isNotNull()).groupBy("wf_id", "dep").agg(F.collect_set("task_name").alias("dependents"))
    unnamed = named_arcs.where(F.col("dep").isNull()).select(*TASK).distinct()
    phase = (
        F.when(F.bool_or(_is(S.SUCCEEDED)), S.SUCCEEDED)
        .when(F.bool_or(_is(S.FAILED)), S.FAILED)
        .when(F.bool_or(F.col("phase") != S.PENDING), S.RUNNING)
        .otherwise(S.PENDING)
    )
    phases = status.groupBy(*TASK).agg(phase.alias("phase"))
    met = phases.where(_is(S.SUCCEEDED)).select("wf_id", F.col("task_name").alias("dep"))
    waiting = arcs.join(met, ["wf_id", "dep"], "left_anti").select("wf_id", F.explode("dependents").alias("task_name"))
    unmet = waiting.unionByName(unnamed).groupBy(*TASK).agg(F.count("*").alias("unmet"))
    named = tasks.where(F.col("task_name").isNotNull()).select(*TASK).distinct()
    needed = named.join(unmet, TASK, "left").select(*TASK, F.coalesce("unmet", F.lit(0)).alias("unmet"))
    behind = arcs.select("wf_id", F.col("dep").alias("task_name"), "dependents")
    rows = needed.join(behind, TASK, "full").join(phases, TASK, "left").withColumn("phase", F.coalesce("phase", F.lit(S.PENDING)))
    return rows.where(~_is(S.SUCCEEDED, S.FAILED)).select(*TASK, "phase", "unmet", "dependents")


class WakeTable(Rolled, ChangeTable):
    """Tasks that have not ended, with their unmet dependencies."""

    BODY = {"phase": "string", "unmet": "bigint", "dependents": "array<string>"}

    def __init__(self, spark, path: str, id_type: str = "bigint", buckets: int = BUCKETS):
        super().__init__(spark, path, id_type)
        self.buckets = buckets

    def load(self, tasks: DataFrame, edges: DataFrame, status: DataFrame) -> None:
        """The workflows that are there before the first batch."""
        rows = stage(counters(tasks, edges, status), "counters").withColumn("batch", F.lit(-1).cast("bigint"))
        for n in range(-self.buckets, 0):
            rows.where(self._bucket() == n % self.buckets).write.mode("overwrite").parquet(f"{self.path}-base/roll={n}")

    def take(self, events: DataFrame, batch: int, fresh: DataFrame | None = None) -> None:
        """Fold the pod events of a batch into the table. ``fresh`` are the counters of workflows that have come
        since; each workflow is given once. A batch that is run again replaces what it wrote."""

        def state(keys: DataFrame) -> DataFrame:
            rows = self.current(batch, keys)
            return rows if fresh is None else rows.unionByName(fresh.join(keys, TASK, "left_semi").select(*rows.columns))

        known = state(events.select(*TASK).distinct())
        folded = fold_phases(known.select(*TASK, "phase"), events)
        # kept for two uses; a lost block is folded again from the same events and the same earlier batches
        moved = folded.where(F.col("known") & (F.col("phase") != F.col("before"))).select(*TASK, F.col("phase").alias("now")).persist()
        try:
            done = moved.where(F.col("now") == S.SUCCEEDED)
            told = known.join(done, TASK, "left_semi").select("wf_id", F.explode("dependents").alias("task_name"))
            fewer = told.groupBy(*TASK).agg(F.count("*").alias("met"))
            change = moved.join(fewer, TASK, "full")
            rows = state(change.select(*TASK)).join(change, TASK).select(
                *TASK,
                F.coalesce("now", "phase").alias("phase"),
                (F.col("unmet") - F.coalesce("met", F.lit(0))).alias("unmet"),
                "dependents",
            )
            if fresh is not None:
                rows = rows.unionByName(fresh.join(change, TASK, "left_anti").select(*rows.columns))
            self.write(rows, batch)
        finally:
            moved.unpersist()

    def write(self, changes: DataFrame, batch: int) -> None:
        rows = changes.select(*TASK, *self.BODY, F.lit(batch).cast("bigint").alias("batch"))
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        last = F.max_by(F.struct(*self.BODY, "batch"), F.col("batch")).alias("l")
        base = self._mine(batch).groupBy(*TASK).agg(last).select(*TASK, "l.*")
        base.where(~_is(S.SUCCEEDED, S.FAILED)).write.mode("overwrite").parquet(f"{self.path}-base/roll={batch}")
        self._prune(batch - self.buckets)

    def ready(self, before_batch: int | None = None) -> DataFrame:
        """(wf_id, task_name) of the Pending tasks whose dependencies have all Succeeded."""
        return _ready(self.current(before_batch))

    def woken(self, batch: int) -> DataFrame:
        """The tasks that a batch has made ready: those of ``ready`` that it wrote."""
        return _ready(self.changes(batch))


def _ready(rows: DataFrame) -> DataFrame:
    return rows.where(_is(S.PENDING) & (F.col("unmet") == 0)).select(*TASK)


def wake_stream(
    pod_events: DataFrame,
    table: WakeTable,
    checkpoint: str,
    interval: str | None = None,
    fresh: Callable[[int], DataFrame | None] | None = None,
    on_batch: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Keep a :class:`WakeTable` up to date from a stream of pod events.

    ``fresh`` gives the counters of the workflows that come with a batch. ``on_batch`` receives the tasks that each
    batch has woken; it may be called again for the same batch and must then replace what it stored. Without ``interval``
    the available input is processed and the query ends.
    """

    def fold(events: DataFrame, batch: int) -> None:
        table.take(events, batch, fresh(batch) if fresh is not None else None)
        if on_batch is not None:
            on_batch(table.woken(batch), batch)

    writer = pod_events.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return _started(writer, interval)
