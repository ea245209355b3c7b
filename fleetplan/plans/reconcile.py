"""The reconcile cycle over a set of workflow documents.

A document without task statuses is initialized. One that has ended is left alone. For all others the
pods' state is taken over, then the workflow fails, completes, or goes on: ready tasks are planned and
started, and usage and conditions are computed anew. The new status is written back into the document.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetplan import schemas as S
from fleetplan.functions import format_mib, format_millicores
from fleetplan.functions.frames import instant, shuffled
from fleetplan.operators.status import pods_to_create, resource_usage, sync_pod_status, workflow_conditions, workflow_phase
from fleetplan.operators.tasks import dependency_edges, flatten_status, flatten_tasks, init_status, pod_spec, workflow_id, workflow_limits
from fleetplan.plans.cycle import apply_plan, plan_cycle
from fleetplan.session import stage
from fleetplan.streaming import events

TASK = ["wf_id", "task_name"]


@dataclass
class Cycle:
    """What a cycle returns: documents with their new status, pods to create, history rows (with wf_id), event records."""

    documents: DataFrame
    pods: DataFrame
    executions: DataFrame
    events: DataFrame


def set_conditions(existing: Column, updates: Column, as_of) -> Column:
    """Conditions with the updates set by type: ``lastTransitionTime`` moves to ``as_of`` where the status
    of a type changes, or the type is new."""
    kind = S.STATUS["conditions"].dataType
    now = F.date_format(instant(as_of), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    old = F.coalesce(existing, F.array().cast(kind))
    fields = ("type", "status", "reason", "message")
    told = F.transform(updates, lambda c: F.struct(*[c[f].alias(f) for f in fields]))
    new = F.coalesce(told, F.array().cast("array<struct<type:string,status:string,reason:string,message:string>>"))

    def placed(c: Column) -> Column:
        same = F.get(F.filter(old, lambda o: (o["type"] == c["type"]) & (o["status"] == c["status"])), 0)
        return F.struct(
            c["type"].alias("type"),
            c["status"].alias("status"),
            c["reason"].alias("reason"),
            c["message"].alias("message"),
            F.coalesce(same["lastTransitionTime"], now).alias("lastTransitionTime"),
        )

    kept = F.filter(old, lambda o: ~F.exists(new, lambda c: c["type"] == o["type"]))
    return F.concat(kept, F.transform(new, placed))


def nest_status(documents: DataFrame, status: DataFrame, phases: DataFrame, conditions: DataFrame, as_of, started: DataFrame | None = None) -> DataFrame:
    """Write flat status rows back into the documents: the inverse of ``flatten_status``.

    ``documents`` have wf_id; ``status`` has the tasks' phases, pods and sizes, ``phases`` the workflows'.
    Entries of tasks in ``started`` (with limits) get new allocations, all others keep theirs. The
    usage is that of the Running tasks; a Completed workflow has none, a Failed one keeps what it had.
    New conditions follow each other by type.
    """
    sizes = ["cpu_request_m", "mem_request_mib", "cpu_limit_m", "mem_limit_mib"]
    rows = status.select(*TASK, "phase", "pod_name")
    if started is not None:
        last = F.max_by(F.struct(*sizes), F.col("admit_seq")).alias("new")
        rows = rows.join(shuffled(started.groupBy(*TASK).agg(last)), TASK, "left")
    else:
        rows = rows.withColumn("new", F.lit(None).cast("struct<" + ",".join(f"{c}:bigint" for c in sizes) + ">"))
    entries = rows.groupBy("wf_id").agg(F.collect_list(F.struct("task_name", "phase", "pod_name", "new")).alias("__entries"))
    usage = resource_usage(status).select("wf_id", "used_cpu_m", "used_mem_mib")
    updates = conditions.groupBy("wf_id").agg(F.sort_array(F.collect_list(F.struct("type", "status", "reason", "message"))).alias("__updates"))
    heads = phases.select("wf_id", F.col("phase").alias("__phase"))
    joined = documents
    for part in (entries, usage, updates, heads):
        joined = joined.join(shuffled(part), "wf_id", "left")

    def amounts(cpu: Column, mem: Column) -> Column:
        given = F.filter(
            F.array(
                F.when(cpu.isNotNull(), F.struct(F.lit("cpu").alias("k"), format_millicores(cpu).alias("v"))),
                F.when(mem.isNotNull(), F.struct(F.lit("memory").alias("k"), format_mib(mem).alias("v"))),
            ),
            lambda x: x.isNotNull(),
        )
        return F.map_from_entries(given)

    def entry(e: Column) -> Column:
        before = F.try_element_at("status.taskStatuses", e["task_name"])
        new = F.struct(
            amounts(e["new"]["cpu_request_m"], e["new"]["mem_request_mib"]).alias("requests"),
            amounts(e["new"]["cpu_limit_m"], e["new"]["mem_limit_mib"]).alias("limits"),
        )
        body = F.struct(
            e["phase"].alias("phase"),
            e["pod_name"].alias("podName"),
            F.when(e["new"].isNotNull(), new).otherwise(before["allocatedResources"]).alias("allocatedResources"),
        )
        return F.struct(e["task_name"], body)

    tasks = F.when(F.col("__entries").isNull(), F.col("status.taskStatuses")).otherwise(F.map_from_entries(F.transform("__entries", entry)))
    phase = F.coalesce("__phase", F.lit(S.RUNNING))
    used = F.when(F.col("used_cpu_m").isNotNull(), amounts(F.col("used_cpu_m"), F.col("used_mem_mib")))
    new = F.struct(
        phase.alias("phase"),
        tasks.alias("taskStatuses"),
        F.when(phase == S.FAILED, F.col("status.currentResourceUsage")).when(phase == S.RUNNING, used).alias("currentResourceUsage"),
        set_conditions(F.col("status.conditions"), F.col("__updates"), as_of).alias("conditions"),
    )
    return joined.withColumn("status", new.cast(S.STATUS)).select(*documents.columns)


def reconcile_cycle(documents: DataFrame, pods: DataFrame, executions: DataFrame | None, as_of, dialect: str = "remote", create: Callable[[DataFrame], DataFrame] | None = None, **options) -> Cycle:
    """One cycle for all ``documents``; ``pods`` has the pods that exist (of any workflow).

    ``create`` makes pods, or tries to: it gets the pods to create and returns those that could not be made
    (namespace, pod_name, error). Their tasks stay as they were, for a later cycle, and are told as events; what the
    plan has charged for them is not dealt again. Without it all pods count as made. ``options`` go to ``plan_cycle``.
    """
    columns = documents.columns
    docs = documents if "wf_id" in columns else documents.withColumn("wf_id", workflow_id(F.col("namespace"), F.col("name")))
    new = F.col("status.taskStatuses").isNull()
    over = F.coalesce(F.col("status.phase").isin(*S.TERMINAL_WORKFLOW_PHASES), F.lit(False))
    fresh = init_status(docs.where(new))
    since = set_conditions(F.array().cast(S.STATUS["conditions"].dataType), F.col("status.conditions"), as_of)
    fresh = fresh.withColumn("status", F.col("status").withField("conditions", since).cast(S.STATUS))
    live = stage(docs.where(~new & ~over), "live-documents")

    tasks = flatten_tasks(live)
    before = flatten_status(live)
    synced, history = sync_pod_status(before, pods, as_of, with_id=True)
    synced = stage(synced, "synced-status")
    plan = stage(
        plan_cycle(tasks, dependency_edges(tasks), synced, workflow_limits(live), executions, as_of, dialect, **options), "plan"
    )
    made = pods_to_create(pod_spec(plan, tasks), pods)
    refused = None
    if create is not None:
        made = stage(made, "pods")
        errors = create(made).groupBy("namespace", "pod_name").agg(F.min("error").alias("error"))
        errors = stage(errors, "refused-pods")  # asked once: making pods has effects
        refused = made.join(shuffled(errors), ["namespace", "pod_name"]).select(*TASK, "error")
        made = made.join(shuffled(errors), ["namespace", "pod_name"], "left_anti")
        plan = plan.join(shuffled(refused), TASK, "left_anti")
    names = live.select("wf_id", F.col("name").alias("workflow_name"))
    after = stage(apply_plan(synced, plan, shuffled(names))[0], "status")
    # a workflow without any task is Running, and so are those that have no entries
    nothing = live.select("wf_id").join(shuffled(after.select("wf_id").distinct()), "wf_id", "left_anti")
    empty = nothing.select("wf_id", F.lit(S.RUNNING).alias("phase"), F.lit(None).cast("string").alias("failed_task"), F.lit(0).cast("bigint").alias("running_tasks"))
    phases = workflow_phase(after).unionByName(empty)
    nested = nest_status(live, after, phases, workflow_conditions(phases), as_of, plan)

    started = plan.select(*TASK).distinct().join(shuffled(after.select(*TASK, "pod_name")), TASK)
    seen = fresh.select("wf_id", F.coalesce(F.size("spec.tasks"), F.lit(0)).cast("bigint").alias("n_tasks"))
    log = events.event_log(events.init_transitions(seen))
    for part in (events.sync_transitions(before, synced), events.workflow_transitions(phases), events.start_transitions(started)):
        log = log.unionByName(events.event_log(part))
    if refused is not None:
        log = log.unionByName(events.event_log(events.reject_transitions(refused)))
    result = fresh.unionByName(docs.where(~new & over)).unionByName(nested)
    return Cycle(result.select(*columns), made, history, log)
