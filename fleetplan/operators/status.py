"""Readiness, status folding and workflow-level summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetplan import schemas as S
from fleetplan.functions import format_mib, format_millicores, pod_name
from fleetplan.functions.frames import instant, micros, optional

TASK = ["wf_id", "task_name"]


def ready_tasks(tasks: DataFrame, edges: DataFrame, status: DataFrame) -> DataFrame:
    """Pending tasks whose dependencies have all Succeeded.

    A task without a status row is Pending; a dependency without one is unmet.
    Both reasons for leaving a task out are keyed by (workflow, task), so one
    anti-join removes them and the tasks are shuffled once, on a key that a
    large workflow does not make hot.
    """
    started = status.where(F.col("phase") != S.PENDING).select(*TASK)
    succeeded = status.where(F.col("phase") == S.SUCCEEDED).select(
        "wf_id", F.col("task_name").alias("dep")
    )
    blocked = edges.join(succeeded, ["wf_id", "dep"], "left_anti").select(*TASK)
    return tasks.join(started.unionByName(blocked), TASK, "left_anti")


def sync_pod_status(
    status: DataFrame, pods: DataFrame, as_of, with_id: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Fold pod phases into task statuses; returns (status, executions).

    Only Running tasks move. Pods without a task label and pods of unknown tasks
    do not match. Of several finished pods of one task the first by name counts.
    A success yields one history row with the requested sizes as usage; ``with_id`` puts its wf_id in front.
    """
    finished = (
        pods.where(F.col("task_name").isNotNull() & F.col("pod_phase").isin(S.SUCCEEDED, S.FAILED))
        .groupBy(*TASK)
        .agg(
            F.min_by(
                F.struct(
                    "pod_phase",
                    "workflow_name",
                    "image",
                    F.coalesce("started_at", "created_at").alias("since"),
                ),
                F.col("pod_name"),
            ).alias("pod")
        )
    )
    running = F.col("phase") == S.RUNNING
    joined = status.join(finished, TASK, "left")
    phase = F.when(running & F.col("pod").isNotNull(), F.col("pod.pod_phase")).otherwise(F.col("phase"))
    synced = joined.select(
        *[phase.alias("phase") if c == "phase" else F.col(c) for c in status.columns]
    )
    clock = instant(as_of)
    executions = (
        status.where(running)
        .join(finished.where(F.col("pod.pod_phase") == S.SUCCEEDED), TASK)
        .select(
            *(["wf_id"] if with_id else []),
            F.col("pod.workflow_name").alias("workflow_name"),
            "task_name",
            F.coalesce("pod.image", F.lit("unknown")).alias("image"),
            F.coalesce("alloc_cpu_m", F.lit(0)).cast("long").alias("actual_cpu_m"),
            F.coalesce("alloc_mem_mib", F.lit(0)).cast("long").alias("actual_mem_mib"),
            ((micros(clock) - micros(F.col("pod.since"))) / F.lit(1e6)).alias("duration_s"),
            F.lit(True).alias("succeeded"),
            clock.alias("completed_at"),
        )
    )
    return synced, executions


def pods_to_create(pod_specs: DataFrame, pods: DataFrame) -> DataFrame:
    """Pod rows that do not exist yet, each name once."""
    known = pods.select("namespace", "pod_name")
    fresh = pod_specs.join(known, ["namespace", "pod_name"], "left_anti")
    columns = [c for c in fresh.columns if c not in ("namespace", "pod_name")]
    # Two allocations of one task name share a pod: the first admitted one makes it.
    # (Maps cannot be compared; without a number the smallest sizes come first.)
    body = F.struct(*columns)
    number = ["admit_seq"] if "admit_seq" in columns else []
    order = F.struct("wf_id", "task_name", *number, "cpu_request_m", "mem_request_mib")
    return (
        fresh.groupBy("namespace", "pod_name")
        .agg(F.min_by(body, order).alias("b"))
        .select("namespace", "pod_name", "b.*")
    )


def status_report(tasks: DataFrame, status: DataFrame) -> DataFrame:
    """The tasks of the document with phase, pod and sizes as text cells."""
    cell = lambda c: F.coalesce(c, F.lit("-"))
    pod = optional(status, "pod_name", "string")
    entries = status.select(*TASK, "phase", pod.alias("pod"), "alloc_cpu_m", "alloc_mem_mib")
    return tasks.join(entries, TASK, "left").select(
        "wf_id",
        "idx",
        "task_name",
        F.coalesce("phase", F.lit("Unknown")).alias("phase"),
        cell(F.when(F.col("pod") != "", F.col("pod"))).alias("pod"),
        cell(F.when(F.col("alloc_cpu_m").isNotNull(), format_millicores(F.col("alloc_cpu_m")))).alias("cpu"),
        cell(F.when(F.col("alloc_mem_mib").isNotNull(), format_mib(F.col("alloc_mem_mib")))).alias("mem"),
    )


def _usage_aggregates() -> list[Column]:
    running = F.col("phase") == S.RUNNING
    total = lambda c: F.coalesce(F.sum(F.when(running, F.col(c))), F.lit(0)).cast("long")
    return [total("alloc_cpu_m").alias("used_cpu_m"), total("alloc_mem_mib").alias("used_mem_mib")]


def _phase_aggregates() -> list[Column]:
    is_ = lambda phase: F.col("phase") == phase
    phase = (
        F.when(F.bool_or(is_(S.FAILED)), S.FAILED)
        .when(F.bool_and(is_(S.SUCCEEDED)), S.COMPLETED)
        .otherwise(S.RUNNING)
    )
    return [
        phase.alias("phase"),
        F.min(F.when(is_(S.FAILED), F.col("task_name"))).alias("failed_task"),
        F.count_if(is_(S.RUNNING)).alias("running_tasks"),
    ]


def resource_usage(status: DataFrame) -> DataFrame:
    """Allocated sizes summed over the Running tasks of each workflow; workflows
    that use neither CPU nor memory have no row."""
    used = status.where(F.col("phase") == S.RUNNING).groupBy("wf_id").agg(*_usage_aggregates())
    return used.where((F.col("used_cpu_m") != 0) | (F.col("used_mem_mib") != 0))


def workflow_phase(status: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Phase per workflow from its status rows; a terminal phase stays, also without
    status rows. ``failed_task`` is of Failed workflows alone."""
    phases = status.groupBy("wf_id").agg(*_phase_aggregates())
    if previous is None:
        return phases
    kept = previous.where(F.col("phase").isin(*S.TERMINAL_WORKFLOW_PHASES)).select(
        "wf_id", F.col("phase").alias("kept")
    )
    phase = F.coalesce("kept", "phase")
    return phases.join(kept, "wf_id", "full").select(
        "wf_id",
        phase.alias("phase"),
        F.when(phase == S.FAILED, F.col("failed_task")).alias("failed_task"),
        F.coalesce("running_tasks", F.lit(0)).alias("running_tasks"),
    )


def workflow_state(status: DataFrame) -> DataFrame:
    """Phase and usage of each workflow from one aggregate over its statuses."""
    return status.groupBy("wf_id").agg(*_phase_aggregates(), *_usage_aggregates())


def _age_text(seconds: Column) -> Column:
    hours, minutes = F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600)) / 60)
    rest = F.pmod(seconds, F.lit(60))
    return (
        F.when(seconds >= 3600, F.format_string("%dh%dm%ds", hours, minutes, rest))
        .when(seconds >= 60, F.format_string("%dm%ds", minutes, rest))
        .otherwise(F.format_string("%ds", seconds))
    )


def list_workflows(
    workflows: DataFrame, status: DataFrame, as_of, namespace: str | None = None
) -> DataFrame:
    """Listing rows: namespace, name, phase, task counts and age.

    ``workflows`` has wf_id, namespace, name, phase, n_tasks and created_at.
    """
    if namespace not in (None, "", "all"):
        workflows = workflows.where(F.col("namespace") == namespace)
    running = (
        status.where(F.col("phase") == S.RUNNING)
        .groupBy("wf_id")
        .agg(F.count("*").alias("running_tasks"))
    )
    count = F.coalesce("running_tasks", F.lit(0))
    age = F.round((micros(instant(as_of)) - micros(F.col("created_at"))) / 1e6).cast("long")
    return (
        workflows.join(running, "wf_id", "left")
        .withColumn("age_s", age)
        .select(
            "wf_id",
            "namespace",
            "name",
            "phase",
            F.format_string("%d (%d running)", F.col("n_tasks"), count).alias("tasks"),
            count.cast("long").alias("running_tasks"),
            "age_s",
            _age_text(F.col("age_s")).alias("age"),
        )
    )


def quoted(name: Column) -> Column:
    return F.concat(F.lit('"'), name, F.lit('"'))


def workflow_conditions(phases: DataFrame) -> DataFrame:
    """Condition rows (type, status, reason, message) implied by each phase."""
    failed = quoted(F.col("failed_task"))
    row = lambda type_, status, reason, message: F.struct(
        F.lit(type_).alias("type"),
        F.lit(status).alias("status"),
        F.lit(reason).alias("reason"),
        (message if isinstance(message, Column) else F.lit(message)).alias("message"),
    )
    # Reasons and messages of the three outcomes.
    outcomes = (
        F.when(
            F.col("phase") == S.FAILED,
            F.array(
                row("Available", "False", "TaskFailed",
                    F.concat(F.lit("Task "), failed, F.lit(" failed"))),
                row("Progressing", "False", "TaskFailed",
                    F.concat(F.lit("Workflow stopped because task "), failed, F.lit(" failed"))),
            ),
        )
        .when(
            F.col("phase") == S.COMPLETED,
            F.array(
                row("Available", "True", "AllTasksSucceeded", "All workflow tasks completed successfully"),
                row("Progressing", "False", "Completed", "Workflow execution is complete"),
            ),
        )
        .when(
            F.col("phase") == S.RUNNING,
            F.array(
                row("Progressing", "True", "Reconciling",
                    F.format_string("%d tasks running", F.col("running_tasks"))),
            ),
        )
    )
    return phases.select("wf_id", F.explode(outcomes).alias("c")).select("wf_id", "c.*")


def merge_conditions(existing: DataFrame, update: DataFrame) -> DataFrame:
    """Set-by-type: an updated condition replaces the one of the same type."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(update.withColumn("__new", F.lit(1)))
    body = F.struct("status", "reason", "message")
    return (
        both.groupBy("wf_id", "type")
        .agg(F.max_by(body, F.col("__new")).alias("b"))
        .select("wf_id", "type", "b.*")
    )

