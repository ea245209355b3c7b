"""One planning cycle over the whole fleet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetplan import schemas as S
from fleetplan.operators.history import enrich_with_history, image_history
from fleetplan.operators.predict import DIALECTS, sized, with_prediction
from fleetplan.operators.status import ready_tasks, resource_usage, workflow_state
from fleetplan.plans.admission import admit, free_columns, oversized_workflows
from fleetplan.functions import pod_name
from fleetplan.session import MAX_FOLD_TASKS, stage

TASK = ["wf_id", "task_name"]


def plan_cycle(
    tasks: DataFrame,
    edges: DataFrame,
    status: DataFrame,
    limits: DataFrame,
    executions: DataFrame | None,
    as_of,
    dialect: str = "remote",
    predictor: str | None = None,
    model=None,
    days: int = S.HISTORY_DAYS,
    min_samples: int = 1,
    max_fold: int = MAX_FOLD_TASKS,
    ready: DataFrame | None = None,
    statistics: DataFrame | None = None,
    unpredicted: DataFrame | None = None,
) -> DataFrame:
    """Which ready tasks of the Running workflows start now, and at what size.

    ``predictor`` is ``history`` (averages or model), ``baseline`` (the hint) or
    ``none``; by default ``history`` for the remote dialect and ``baseline`` for
    the local one. Predictions are row-level once the image statistics are
    attached, so they are computed for ready tasks only and need no join back.

    Who keeps the names of the ready tasks, or the image statistics, gives them as ``ready`` (wf_id, task_name) and
    ``statistics``; edges, or executions, are not read then. The workflows in ``unpredicted`` (wf_id), whose prediction
    has failed, are planned without one: on hints and defaults.
    """
    if dialect not in DIALECTS:
        raise ValueError(f"dialect must be one of {DIALECTS}")
    predictor = predictor or ("history" if dialect == "remote" else "baseline")

    state = workflow_state(status).where(F.col("phase") == S.RUNNING)
    # Stored, so that its size is known: in a fleet most workflows have ended, and what belongs
    # to those is left out before anything is shuffled.
    running = stage(state.join(limits, "wf_id", "left").select("wf_id", *free_columns()), "running")
    only = lambda df: df.join(running.select("wf_id"), "wf_id", "left_semi")
    optional = [c for c in ("hint_cpu_limit_m", "hint_mem_limit_mib") if c in tasks.columns]
    needed = tasks.select(
        "wf_id", "idx", "task_name", "image", "hint_cpu_m", "hint_mem_mib", *optional
    )
    if ready is None:
        rows = ready_tasks(only(needed), only(edges), only(status))
    else:
        rows = needed.join(only(ready), TASK, "left_semi")
    rows = rows.join(running, "wf_id")
    if predictor == "history":
        history = image_history(executions, as_of, days) if statistics is None else statistics
        rows = with_prediction(enrich_with_history(rows, history), model, min_samples)
        rows = rows.withColumn("predicted", F.lit(True))
    elif predictor == "baseline" and dialect == "remote":
        # A hint passed through becomes a prediction; only requests are sent.
        hinted = F.coalesce("hint_cpu_m", "hint_mem_mib", *optional).isNotNull()
        rows = rows.withColumns(
            {
                "predicted": hinted,
                "cpu_m": F.col("hint_cpu_m"),
                "mem_mib": F.col("hint_mem_mib"),
                "cpu_limit_m": F.lit(None).cast("bigint"),
                "mem_limit_mib": F.lit(None).cast("bigint"),
            }
        )
    else:
        # Locally a passed-through prediction and the hint itself are the same.
        null = F.lit(None).cast("bigint")
        rows = rows.withColumns(
            {
                "predicted": F.lit(False),
                "cpu_m": null,
                "mem_mib": null,
                "cpu_limit_m": null,
                "mem_limit_mib": null,
            }
        )
    if unpredicted is not None:
        failed = unpredicted.select("wf_id").distinct().withColumn("__failed", F.lit(True))
        rows = rows.join(failed, "wf_id", "left").withColumn("predicted", F.col("predicted") & F.col("__failed").isNull()).drop("__failed")
    return admit(sized(rows, dialect), oversized_workflows(tasks, max_fold), max_fold)


def apply_plan(
    status: DataFrame, plan: DataFrame, workflow_names: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Status after the cycle, and the usage recomputed from it.

    Admitted tasks turn Running with pod name and allocation. A planned task
    without a status row gets one. ``workflow_names`` has wf_id, workflow_name; a
    workflow without a name goes by its id.
    """
    started = (
        plan.groupBy(*TASK)
        .agg(
            # A repeated task name is one pod: the last admitted body stays.
            F.max_by(F.struct("cpu_request_m", "mem_request_mib"), F.col("admit_seq")).alias("p")
        )
        .join(workflow_names, "wf_id", "left")
        .select(
            *TASK,
            "p",
            pod_name(
                F.coalesce("workflow_name", F.col("wf_id").cast("string")), F.col("task_name")
            ).alias("new_pod"),
        )
    )
    known = status if "pod_name" in status.columns else status.withColumn(
        "pod_name", F.lit(None).cast("string")
    )
    starts = F.col("p").isNotNull()
    pick = lambda new, old: F.when(starts, new).otherwise(F.col(old)).alias(old)
    after = known.join(started, TASK, "full").select(
        *TASK,
        pick(F.lit(S.RUNNING), "phase"),
        pick(F.col("new_pod"), "pod_name"),
        pick(F.col("p.cpu_request_m"), "alloc_cpu_m"),
        pick(F.col("p.mem_request_mib"), "alloc_mem_mib"),
    )
    return after, resource_usage(after)
