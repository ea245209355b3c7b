"""Planning and history recording on streams."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetplan import schemas as S
from fleetplan.functions import pod_name
from fleetplan.plans.cycle import plan_cycle
from fleetplan.sources.history import append_history
from fleetplan.streaming.cells import CellTable
from fleetplan.streaming.events import event_log
from fleetplan.streaming.phases import ChangeTable, _started, task_phase_stream, transitions


@dataclass
class PlanTables:
    """Readers of the tables a planning cycle needs, called once per batch so
    that each cycle sees their present state.

    ``ready`` reads kept names of ready tasks (``streaming.wakeups``), ``statistics`` kept image statistics at a
    clock (``streaming.cells``). With them a cycle reads neither the edges nor the history of the fleet.
    """

    tasks: Callable[[], DataFrame]
    edges: Callable[[], DataFrame]
    status: Callable[[], DataFrame]
    limits: Callable[[], DataFrame]
    executions: Callable[[], DataFrame]
    ready: Callable[[], DataFrame] | None = None
    statistics: Callable[[object], DataFrame] | None = None


class StartTable(ChangeTable):
    """Sizes of the tasks that a planning stream has started."""

    BODY = {"cpu_request_m": "bigint", "mem_request_mib": "bigint"}


def with_started(status: DataFrame, started: DataFrame) -> DataFrame:
    """``status`` in which tasks that were started, but still count as Pending or have no row,
    are Running with the sizes they were started with."""
    task = ["wf_id", "task_name"]
    late = F.coalesce("phase", F.lit(S.PENDING)) == S.PENDING
    known = status.select(*task, "phase", "alloc_cpu_m", "alloc_mem_mib")
    pick = lambda new, old: F.when(F.col("__started") & late, new).otherwise(F.col(old)).alias(old)
    return known.join(started.withColumn("__started", F.lit(True)), task, "full").select(
        *task,
        pick(F.lit(S.RUNNING), "phase"),
        pick(F.col("cpu_request_m"), "alloc_cpu_m"),
        pick(F.col("mem_request_mib"), "alloc_mem_mib"),
    )


def plan_changed(changed: DataFrame, tables: PlanTables, as_of, **options) -> DataFrame:
    """One planning cycle for the workflows named in ``changed``.

    Every input is cut down to these workflows first, so the cost of a cycle
    follows the number of changes, not the size of the fleet.
    """
    ids = changed.select("wf_id").distinct()
    only = lambda df: df.join(ids, "wf_id", "left_semi")
    return plan_cycle(
        only(tables.tasks()),
        only(tables.edges()),
        only(tables.status()),
        only(tables.limits()),
        tables.executions(),
        as_of,
        ready=None if tables.ready is None else only(tables.ready()),
        statistics=None if tables.statistics is None else tables.statistics(as_of),
        **options,
    )


def plan_stream(
    changes: DataFrame,
    tables: PlanTables,
    path: str,
    checkpoint: str,
    clock: Callable[[int], object],
    interval: str | None = "10 seconds",
    **options,
) -> StreamingQuery:
    """Plan the changed workflows of each micro-batch into ``path/batch=N``.

    ``clock`` gives the planning time of a batch. A batch that is run again
    replaces its own folder, so each plan is stored once. With ``interval`` None
    the available input is planned and the query ends.

    What earlier batches have started counts as Running until the status says
    more, so that a task is started once however late the status follows; the
    starts are kept in a :class:`StartTable` beside the plans.
    """
    spark = changes.sparkSession
    starts = StartTable(spark, f"{path}-started", changes.schema["wf_id"].dataType.simpleString())

    def cycle(rows: DataFrame, batch: int) -> None:
        ids = rows.select("wf_id").distinct()
        started = starts.current(batch).join(ids, "wf_id", "left_semi")
        seen = replace(tables, status=lambda: with_started(tables.status(), started))
        if tables.ready is not None:
            seen = replace(seen, ready=lambda: tables.ready().join(started, ["wf_id", "task_name"], "left_anti"))
        plan_changed(rows, seen, clock(batch), **options).write.mode("overwrite").parquet(f"{path}/batch={batch}")
        plan = spark.read.parquet(f"{path}/batch={batch}")
        last = F.max_by(F.struct("cpu_request_m", "mem_request_mib"), "admit_seq").alias("p")
        starts.write(plan.groupBy("wf_id", "task_name").agg(last).select("wf_id", "task_name", "p.*"), batch)

    writer = changes.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint)
    return _started(writer, interval)


def success_rows(folded: DataFrame, status: DataFrame, tasks: DataFrame) -> DataFrame:
    """History rows of the tasks that succeeded, with requested sizes as usage."""
    task = ["wf_id", "task_name"]
    done = folded.where((F.col("phase") == S.SUCCEEDED) & (F.col("before") != S.SUCCEEDED))
    # cut down to the tasks of the batch before anything is grouped
    only = lambda df: df.join(done.select(*task), task, "left_semi")
    sizes = only(status).select(*task, "alloc_cpu_m", "alloc_mem_mib")
    # of a repeated name the first in the document counts
    first = F.min_by(F.struct("workflow_name", "image"), F.col("idx"))
    names = only(tasks).groupBy(*task).agg(first.alias("t")).select(*task, "t.*")
    seconds = (F.unix_micros("ended_at") - F.unix_micros("started_at")) / F.lit(1e6)
    return (
        done.join(names, task)
        .join(sizes, task, "left")
        .select(
            "workflow_name",
            "task_name",
            F.coalesce("image", F.lit("unknown")).alias("image"),
            F.coalesce("alloc_cpu_m", F.lit(0)).cast("bigint").alias("actual_cpu_m"),
            F.coalesce("alloc_mem_mib", F.lit(0)).cast("bigint").alias("actual_mem_mib"),
            F.coalesce(seconds, F.lit(0.0)).alias("duration_s"),
            F.lit(True).alias("succeeded"),
            F.col("ended_at").alias("completed_at"),
        )
    )


def metrics_stream(
    pod_events: DataFrame,
    table_path: str,
    history_path: str,
    checkpoint: str,
    status: Callable[[], DataFrame],
    tasks: Callable[[], DataFrame],
    interval: str | None = None,
    label: str = "stream",
    cells: CellTable | None = None,
    clock: Callable[[int], object] | None = None,
) -> StreamingQuery:
    """Track phases and append each success to the history table, exactly once.

    A micro-batch writes under its own name, ``label`` and number; running it
    again after a failure replaces its rows. Streams that share a history table
    need different labels. With ``cells`` the image statistics follow the history; ``clock`` then gives the time of
    a batch.
    """
    if cells is not None and clock is None:
        raise ValueError("cells need a clock")

    def append(folded: DataFrame, batch: int) -> None:
        rows = success_rows(folded, status(), tasks())
        append_history(rows, history_path, f"{label}-{batch}")
        if cells is not None:
            cells.write(rows, batch, clock(batch))

    return task_phase_stream(pod_events, table_path, checkpoint, interval, append)


def event_stream(
    pod_events: DataFrame,
    table_path: str,
    events_path: str,
    checkpoint: str,
    names: Callable[[], DataFrame] | None = None,
    interval: str | None = None,
) -> StreamingQuery:
    """Track phases and append the event record of each transition.

    ``names`` gives (wf_id, workflow_name) for the pod names; a workflow without
    a name goes by its id.
    """

    def append(folded: DataFrame, batch: int) -> None:
        named = folded.withColumn("workflow_name", F.lit(None).cast("string"))
        if names is not None:
            named = folded.join(names().select("wf_id", "workflow_name"), "wf_id", "left")
        workflow = F.coalesce("workflow_name", F.col("wf_id").cast("string"))
        named = named.withColumn("pod_name", pod_name(workflow, F.col("task_name")))
        event_log(transitions(named)).write.mode("overwrite").parquet(
            f"{events_path}/batch={batch}"
        )

    return task_phase_stream(pod_events, table_path, checkpoint, interval, append)
