"""One query per operator, over the fleet relations of a table folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetplan import schemas as S
from fleetplan.functions import (
    format_mib,
    format_millicores,
    image_hash,
    parse_dependency_csv,
    parse_mib,
    parse_millicores,
)
from fleetplan.functions.frames import micros, shuffled
from fleetplan.operators import graph, history, model, predict, profile, status, tasks
from fleetplan.plans import admission, cycle, reconcile
from datetime import timedelta
from fleetplan.registry.fleet import AS_OF, Fleet, fleet
from fleetplan.session import shared_dir, stage
from fleetplan.sources import history as history_source
from fleetplan.sources import documents, manifests, synthetic
from fleetplan.streaming import cells, events, phases, planner, reconciler, rolling, wakeups

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(body: Callable[[Fleet], DataFrame]):
    """Register ``body`` under its own name, less a trailing underscore."""
    QUERIES[body.__name__.rstrip("_")] = lambda spark, sf_dir: body(fleet(spark, sf_dir))
    return body


def six(name: str) -> Column:
    """Doubles that come from sums are compared to six places. The nudge makes
    values half-way between two of them round alike everywhere."""
    return F.round(F.col(name) + 1e-9, 6).alias(name)


def new_path(f: Fleet, label: str) -> str:
    return f"{shared_dir(f.spark)}/registry/{label}-{uuid.uuid4().hex}"


# Sources and sinks


@query
def read_manifests(f: Fleet) -> DataFrame:
    path = new_path(f, "documents")
    unnamed = F.when(F.col("o_orderpriority") != "5-LOW", F.col("namespace"))
    manifests.write_workflows_json(f.manifests.withColumn("namespace", unnamed), path)
    read = manifests.read_manifests(f.spark, path, default_ns="default")
    return read.select(
        "namespace",
        "name",
        F.col("spec.optimizationGoal").alias("goal"),
        F.element_at("spec.maxResources", "cpu").alias("max_cpu"),
        F.size("spec.tasks").alias("n_tasks"),
        F.array_join(F.transform("spec.tasks", lambda t: t["image"]), ",").alias("images"),
    )


@query
def upsert_manifests(f: Fleet) -> DataFrame:
    docs = f.manifests
    state = F.struct(
        F.lit("Running").alias("phase"),
        F.lit(None).cast(S.STATUS["taskStatuses"].dataType).alias("taskStatuses"),
        F.lit(None).cast("map<string,string>").alias("currentResourceUsage"),
        F.lit(None).cast(S.STATUS["conditions"].dataType).alias("conditions"),
    )
    goal = lambda text: F.col("spec").withField("optimizationGoal", F.lit(text))
    current = docs.where(F.col("o_orderstatus") != "O").withColumn("status", state)
    new = docs.where(F.col("o_orderstatus") != "F")
    first = new.withColumn("spec", goal("first"))
    again = new.where(F.col("o_orderpriority") == "1-URGENT").select(
        "namespace",
        "name",
        goal("second").alias("spec"),
        (F.col("submitted_at") + F.expr("INTERVAL 1 DAY")).alias("submitted_at"),
    )
    incoming = first.select("namespace", "name", "spec", "submitted_at").unionByName(again)
    return manifests.upsert_manifests(current, incoming).select(
        "namespace",
        "name",
        F.col("spec.optimizationGoal").alias("goal"),
        F.size("spec.tasks").alias("n_tasks"),
        F.col("status.phase").alias("phase"),
    )


@query
def document_versions(f: Fleet) -> DataFrame:
    """Two writers read the first version of each document: the status writer is first, so the spec writer is refused
    where both write one."""
    table = documents.DocumentTable(f.spark, new_path(f, "document-table"))
    docs = f.manifests.withColumn("resource_version", F.lit(None).cast("bigint"))
    table.write(docs, "spec")
    seen = docs.withColumn("resource_version", F.lit(1))
    running = F.from_json(F.lit('{"phase": "Running"}'), S.STATUS)
    table.write(seen.where(F.col("o_orderstatus") != "O").withColumn("status", running), "status")
    late = F.col("spec").withField("optimizationGoal", F.lit("late"))
    refused = table.write(seen.where(F.col("o_orderpriority") == "1-URGENT").withColumn("spec", late), "spec")
    refused = refused.select("namespace", "name", F.lit(True).alias("refused"))
    return table.read().join(shuffled(refused), ["namespace", "name"], "left").select(
        "namespace",
        "name",
        F.col("spec.optimizationGoal").alias("goal"),
        F.col("status.phase").alias("phase"),
        "resource_version",
        F.coalesce("refused", F.lit(False)).alias("refused"),
    )


@query
def delete_cascade(f: Fleet) -> DataFrame:
    urgent = f.manifests.where(F.col("o_orderpriority") == "1-URGENT")
    left, pods = manifests.delete_cascade(f.manifests, f.pods, urgent)
    return left.select(F.lit("workflow").alias("kind"), "namespace", "name").unionByName(
        pods.select(F.lit("pod").alias("kind"), "namespace", F.col("pod_name").alias("name"))
    )


def _execution_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "workflow_name", "task_name", "image", "actual_cpu_m", "actual_mem_mib",
        six("duration_s"), "succeeded", micros(F.col("completed_at")).alias("completed_us"),
    )


@query
def read_history(f: Fleet) -> DataFrame:
    rows = history_source.read_history(f.spark, f.history_path, AS_OF)
    return _execution_columns(rows)


def _recorded(f: Fleet) -> tuple[DataFrame, DataFrame]:
    key = F.col("o_orderkey")
    metric = lambda i: F.struct(
        F.concat(F.lit("t"), i.cast("string")).alias("task_name"),
        F.concat(F.lit("image-"), ((key + i) % 12).cast("string")).alias("image"),
        (100 + i * 10).cast("bigint").alias("actual_cpu_m"),
        (64 + i).cast("bigint").alias("actual_mem_mib"),
        (F.lit(1.5) * i).alias("duration_s"),
        F.when(i % 3 == 1, False).when(i % 3 == 2, True).alias("succeeded"),
        F.when((i == 1) & (key % 13 == 0), F.lit("yesterday"))
        .when(i % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .otherwise("")
        .alias("completed_at"),
    )
    reports = f.table("orders").select(
        F.concat(F.lit("wf-"), key.cast("string")).alias("workflow_name"),
        F.transform(F.sequence(F.lit(0), (key % 4).cast("int")), metric).alias("task_metrics"),
    )
    return history_source.record_executions(reports, AS_OF)


@query
def record_executions(f: Fleet) -> DataFrame:
    return _execution_columns(_recorded(f)[0])


@query
def record_rejects(f: Fleet) -> DataFrame:
    return _recorded(f)[1].select("workflow_name", F.size("task_metrics").alias("n_tasks"), "reason")


@query
def export_workflows_json(f: Fleet) -> DataFrame:
    return manifests.export_workflows_json(f.manifests)


def _samples(f: Fleet) -> DataFrame:
    """One synthetic sample per order."""
    return synthetic.sample_executions(f.table("orders").select(F.col("o_orderkey").alias("sample_id")))


@query
def generate_executions(f: Fleet) -> DataFrame:
    columns = (*model.FEATURES[1:], *model.TARGETS)
    return _samples(f).select("sample_id", "image", *[six(c) for c in columns])


@query
def discard_metrics(f: Fleet) -> DataFrame:
    """The statistics of the history table after the sink has taken all executions once
    more: it keeps nothing, so they are those of the table alone."""
    history_source.discard_metrics(f.executions)
    stored = history.image_history(history_source.read_history(f.spark, f.history_path, AS_OF), AS_OF)
    rows = history.enrich_with_history(f.executions.select("image").distinct(), stored)
    return rows.select("image", six("hist_cpu_m"), six("hist_mem_mib"), six("hist_duration_s"), "n_samples")


# Projections and filters


@query
def flatten_tasks(f: Fleet) -> DataFrame:
    return tasks.flatten_tasks(f.manifests).select(
        "wf_id", "workflow_name", "idx", "task_name", "image",
        F.array_join("dependencies", ",").alias("dependencies"), "hint_cpu_m", "hint_mem_mib",
    )


@query
def parse_quantity(f: Fleet) -> DataFrame:
    text = F.col("quantity")
    return f.quantities.select(
        "id", "quantity", parse_millicores(text).alias("cpu_m"), parse_mib(text).alias("mem_mib")
    )


@query
def format_quantity(f: Fleet) -> DataFrame:
    return f.tasks.select(
        "wf_id",
        "idx",
        F.when(F.col("hint_cpu_m").isNotNull(), format_millicores(F.col("hint_cpu_m"))).alias("cpu"),
        F.when(F.col("hint_mem_mib").isNotNull(), format_mib(F.col("hint_mem_mib"))).alias("mem"),
    )


@query
def image_hash_(f: Fleet) -> DataFrame:
    name = F.concat_ws(":", "p_brand", "p_name")
    return f.table("part").select("p_partkey", image_hash(name).alias("image_hash"))


def _document_plan(f: Fleet) -> tuple[DataFrame, DataFrame]:
    # Stored: the tasks are read three times, and parsing their sizes costs more than all else.
    listed = stage(tasks.flatten_tasks(f.manifests), "listed")
    plan = predict.resolve_resources(listed, predict.predict_baseline(listed), "local")
    sizes = ["cpu_request_m", "mem_request_mib", "cpu_limit_m", "mem_limit_mib"]
    return plan.select("wf_id", "task_name", *sizes), listed


@query
def pod_spec(f: Fleet) -> DataFrame:
    plan, listed = _document_plan(f)
    pods = tasks.pod_spec(plan, listed)
    return pods.select(
        "wf_id", "namespace", "pod_name", "task_name",
        F.element_at("labels", tasks.WORKFLOW_LABEL).alias("workflow_label"),
        F.element_at("labels", tasks.TASK_LABEL).alias("task_label"),
        "restart_policy", "image", F.array_join("command", " ").alias("command"),
        "cpu_request_m", "mem_request_mib", "cpu_limit_m", "mem_limit_mib",
    )


@query
def pod_spec_rejects(f: Fleet) -> DataFrame:
    """Allocations for the line items of an order that its document lacks."""
    wanted = f.tasks.select(F.concat_ws("/", "namespace", "workflow_name").alias("wf_id"), "task_name")
    return tasks.pod_spec_rejects(wanted, tasks.flatten_tasks(f.manifests))


@query
def parse_dependency_csv_(f: Fleet) -> DataFrame:
    text = F.concat(F.translate("p_name", " ", ","), F.lit(" , "), F.col("p_brand"), F.lit(", ,"))
    names = parse_dependency_csv(F.when(F.col("p_size") > 1, text))
    return f.table("part").select(
        "p_partkey", F.size(names).alias("n"), F.array_join(names, "|").alias("names")
    )


@query
def validate_manifests(f: Fleet) -> DataFrame:
    docs = f.manifests.withColumn("status", F.lit(None).cast(S.STATUS))
    good, bad = tasks.validate_manifests(docs)
    reason = F.array_join("reasons", "; ").alias("reasons")
    return good.select("namespace", "name", F.lit("").alias("reasons")).unionByName(
        bad.select("namespace", "name", reason)
    )


@query
def workflow_lookup(f: Fleet) -> DataFrame:
    return tasks.workflow_lookup(f.manifests, "ns-1").select("namespace", "name")


@query
def init_status(f: Fleet) -> DataFrame:
    fresh = tasks.init_status(f.manifests.withColumn("status", F.lit(None).cast(S.STATUS)))
    entries = tasks.flatten_status(fresh).select("wf_id", "task_name", "phase")
    heads = fresh.select(
        F.concat_ws("/", "namespace", "name").alias("wf_id"),
        F.col("status.phase").alias("wf_phase"),
        F.element_at("status.conditions", 1)["message"].alias("message"),
    )
    return heads.join(entries, "wf_id", "left").select("wf_id", "task_name", "phase", "wf_phase", "message")


# Joins


@query
def dependency_edges(f: Fleet) -> DataFrame:
    return tasks.dependency_edges(tasks.flatten_tasks(f.manifests))


@query
def ready_tasks(f: Fleet) -> DataFrame:
    ready = status.ready_tasks(f.tasks, f.edges, f.status)
    return ready.select("wf_id", "idx", "task_name")


@query
def sync_pod_status(f: Fleet) -> DataFrame:
    return status.sync_pod_status(f.status, f.pods, AS_OF)[0]


@query
def sync_pod_executions(f: Fleet) -> DataFrame:
    return _execution_columns(status.sync_pod_status(f.status, f.pods, AS_OF)[1])


@query
def pods_to_create(f: Fleet) -> DataFrame:
    ready = status.ready_tasks(f.tasks, f.edges, f.status)
    sized = predict.resolve_resources(ready, predict.predict_baseline(ready), "local")
    specs = tasks.pod_spec(sized, f.tasks)
    return status.pods_to_create(specs, f.pods).select(
        "namespace", "pod_name", "wf_id", "task_name", "cpu_request_m", "mem_request_mib"
    )


@query
def status_report(f: Fleet) -> DataFrame:
    return status.status_report(f.tasks, f.status)


@query
def enrich_with_history(f: Fleet) -> DataFrame:
    stats = history.image_history(f.executions, AS_OF)
    rows = history.enrich_with_history(f.tasks, stats)
    return rows.select(
        "wf_id", "idx", "image", six("hist_cpu_m"), six("hist_mem_mib"), six("hist_duration_s"), "n_samples"
    )


def _resolved(f: Fleet, dialect: str) -> DataFrame:
    stats = history.image_history(f.executions, AS_OF)
    # Every task whose image has a history is predicted; the others go by hint or default.
    known = history.enrich_with_history(f.tasks, stats).where("n_samples > 0")
    predictions = predict.predict_resources(known)
    rows = predict.resolve_resources(f.tasks, predictions, dialect)
    return rows.select(
        "wf_id", "idx", "task_name", "cpu_request_m", "mem_request_mib", "cpu_limit_m", "mem_limit_mib"
    )


@query
def resolve_resources_local(f: Fleet) -> DataFrame:
    return _resolved(f, "local")


@query
def resolve_resources(f: Fleet) -> DataFrame:
    return _resolved(f, "remote")


# Prediction


@query
def predict_baseline(f: Fleet) -> DataFrame:
    return predict.predict_baseline(f.tasks).select(
        "wf_id", "task_name", "cpu_m", "mem_mib", "duration_s"
    )


@query
def predict_resources(f: Fleet) -> DataFrame:
    stats = history.image_history(f.executions, AS_OF)
    rows = predict.predict_resources(history.enrich_with_history(f.tasks, stats))
    return rows.select(
        "wf_id", "task_name", "cpu_m", "mem_mib", six("duration_s"), six("confidence"), "method"
    )


# Aggregates


@query
def image_history(f: Fleet) -> DataFrame:
    rows = history.image_history(f.executions, AS_OF)
    return rows.select("image", six("hist_cpu_m"), six("hist_mem_mib"), six("hist_duration_s"), "n_samples")


@query
def resource_usage(f: Fleet) -> DataFrame:
    return status.resource_usage(f.status)


@query
def list_workflows(f: Fleet) -> DataFrame:
    counts = f.tasks.groupBy("wf_id").agg(F.count("*").alias("n_tasks"))
    phases_ = status.workflow_phase(f.status).select("wf_id", "phase")
    key = F.col("o_orderkey")
    orders = f.table("orders").select(
        key.alias("wf_id"),
        F.concat(F.lit("ns-"), (F.col("o_custkey") % 5).cast("string")).alias("namespace"),
        F.concat(F.lit("wf-"), key.cast("string")).alias("name"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )
    heads = orders.join(counts, "wf_id", "left").join(phases_, "wf_id", "left").fillna(0, "n_tasks")
    return status.list_workflows(heads, f.status, "2003-01-01 12:34:56.7")


@query
def workflow_phase(f: Fleet) -> DataFrame:
    ended = f.table("orders").where(F.col("o_orderpriority") == "1-URGENT")
    previous = ended.select(F.col("o_orderkey").alias("wf_id"), F.lit("Completed").alias("phase"))
    return status.workflow_phase(f.status, previous).select("wf_id", "phase", "failed_task")


@query
def workflow_conditions(f: Fleet) -> DataFrame:
    return status.workflow_conditions(status.workflow_phase(f.status))


@query
def merge_conditions(f: Fleet) -> DataFrame:
    """Conditions after the pods were synced, set over those from before."""
    before = status.workflow_conditions(status.workflow_phase(f.status))
    synced, _ = status.sync_pod_status(f.status, f.pods, AS_OF)
    after = status.workflow_conditions(status.workflow_phase(synced))
    return status.merge_conditions(before, after)


# Time profiles


@query
def stack_by_start(f: Fleet) -> DataFrame:
    rows = f.tasks.select("wf_id", "idx", "l_linestatus", "hint_mem_mib")
    starts = rows.select(
        "wf_id",
        "idx",
        F.floor(F.col("idx") / 3).alias("start"),
        F.coalesce("hint_mem_mib", F.lit(128)).alias("size"),
    )
    caps = f.limits.select("wf_id", F.col("max_mem_mib").alias("limit"))
    stacked = profile.stack_by_start(starts.join(caps, "wf_id"))
    return stacked.select("wf_id", "idx", "start", "bottom", "size", "crashed")


@query
def stack_crashes(f: Fleet) -> DataFrame:
    rows = f.tasks.select(
        "wf_id",
        "idx",
        F.floor(F.col("idx") / 3).alias("start"),
        F.coalesce("hint_mem_mib", F.lit(128)).alias("size"),
    )
    return profile.stack_crashes(profile.stack_by_start(rows, limit=1500))


def _run_intervals(f: Fleet) -> DataFrame:
    end = micros(F.col("completed_at"))
    return f.executions.select(
        F.col("workflow_name").alias("wf_id"),
        (end - (F.col("duration_s") * 3_600_000_000).cast("bigint") * 24).alias("start"),
        end.alias("end"),
        F.col("actual_mem_mib").alias("size"),
    )


@query
def usage_profile(f: Fleet) -> DataFrame:
    return profile.usage_profile(_run_intervals(f), limit=1500)


@query
def usage_peaks(f: Fleet) -> DataFrame:
    return profile.usage_peaks(profile.usage_profile(_run_intervals(f), limit=1500))


@query
def rolling_image_history(f: Fleet) -> DataFrame:
    rows = history.rolling_image_history(f.executions)
    return rows.select(
        "image", micros(F.col("completed_at")).alias("completed_us"),
        six("hist_cpu_m"), six("hist_mem_mib"), six("hist_duration_s"), "n_samples",
    )


# Admission and planning


@query
def admit_tasks(f: Fleet) -> DataFrame:
    ready = status.ready_tasks(f.tasks, f.edges, f.status)
    sized = predict.resolve_resources(ready, predict.predict_baseline(ready), "local")
    return admission.admit_tasks(sized, status.resource_usage(f.status), f.limits)


def _plan(f: Fleet, dialect: str) -> DataFrame:
    return cycle.plan_cycle(
        f.tasks, f.edges, f.status, f.limits, f.executions, AS_OF, dialect
    )


@query
def plan_cycle(f: Fleet) -> DataFrame:
    return _plan(f, "remote")


@query
def plan_cycle_local(f: Fleet) -> DataFrame:
    return _plan(f, "local")


def _ended(pods: DataFrame, key: Column) -> DataFrame:
    """Created pods, of which a third each has succeeded, failed and goes on."""
    return pods.select(
        "wf_id", "namespace", F.col("labels")[tasks.WORKFLOW_LABEL].alias("workflow_name"), "pod_name", "task_name", "image",
        F.when(key % 3 == 0, "Succeeded").when(key % 3 == 1, "Failed").otherwise("Running").alias("pod_phase"),
        F.lit(None).cast("timestamp").alias("started_at"), F.timestamp_micros(F.lit(896659200000000)).alias("created_at"),
    )


def _document_rows(docs: DataFrame) -> DataFrame:
    entries = F.map_entries("status.taskStatuses")
    return docs.select(
        "namespace", "name", F.col("status.phase").alias("phase"),
        F.array_join(F.array_sort(F.transform(entries, lambda e: F.concat_ws(":", e["key"], e["value"]["phase"], F.coalesce(e["value"]["podName"], F.lit("-"))))), ",").alias("tasks"),
        F.element_at("status.currentResourceUsage", "cpu").alias("cpu"),
        F.array_join(F.transform(F.array_sort("status.conditions"), lambda c: F.concat_ws(":", c["type"], c["status"], c["reason"], c["lastTransitionTime"])), ",").alias("conditions"),
    )


def _three_cycles(f: Fleet):
    """Documents that are initialized, started, and then see the pods of their first tasks end."""

    def build():
        docs = f.manifests.select("namespace", "name", "spec", F.lit(None).cast(S.STATUS).alias("status"))
        pods = f.pods.limit(0).select(
            F.lit(None).cast("string").alias("wf_id"), "namespace", "workflow_name", "pod_name", "task_name", "image", "pod_phase", "started_at", "created_at"
        )
        run = lambda docs, pods, day: reconcile.reconcile_cycle(docs, pods, f.executions, f"1998-06-0{day} 00:00:00")
        first = run(docs, pods, 1)
        second = run(stage(first.documents, "cycle"), pods, 2)
        ended = _ended(second.pods, F.regexp_extract("wf_id", "([0-9]+)$", 1).cast("bigint"))
        docs = stage(second.documents, "cycle")
        third = run(docs, stage(ended, "cycle-pods"), 3)
        return stage(third.documents, "cycle"), third.events

    return f.once("three-cycles", build)


@query
def reconcile_cycle(f: Fleet) -> DataFrame:
    """The documents after three cycles."""
    docs, _ = _three_cycles(f)
    return _document_rows(docs)


@query
def reconcile_events(f: Fleet) -> DataFrame:
    """What the third cycle reports."""
    return _three_cycles(f)[1]


@query
def reconcile_stream(f: Fleet) -> DataFrame:
    """The three cycles as batches of a stream over the document table; the pods that exist are the published ones."""
    table, path, given, offsets = documents.DocumentTable(f.spark, new_path(f, "document-table")), new_path(f, "reconciled"), new_path(f, "changes"), new_path(f, "offsets")
    table.write(f.manifests.withColumn("resource_version", F.lit(None).cast("bigint")), "spec")
    number = F.regexp_extract("wf_id", "([0-9]+)$", 1).cast("bigint")

    def pods(batch: int) -> DataFrame:
        none = f.pods.limit(0).withColumn("wf_id", F.lit(None).cast("string"))
        return none if batch < 2 else _ended(f.spark.read.parquet(f"{path}/pods/batch=1"), number)

    for _ in range(3):
        f.manifests.select("namespace", "name").coalesce(1).write.mode("append").parquet(given)
    changes = f.spark.readStream.schema("namespace string, name string").option("maxFilesPerTrigger", 1).parquet(given)
    reconciler.reconcile_stream(
        changes, table, pods, lambda batch: f.executions, path, offsets, clock=lambda batch: f"1998-06-0{batch + 1} 00:00:00"
    ).awaitTermination()
    return _document_rows(table.read())


@query
def reconcile_refused(f: Fleet) -> DataFrame:
    """A second cycle in which the pods of every fourth workflow cannot be made: its tasks stay Pending."""
    docs = f.manifests.select("namespace", "name", "spec", F.lit(None).cast(S.STATUS).alias("status"))
    none = f.pods.limit(0).withColumn("wf_id", F.lit(None).cast("string"))
    first = reconcile.reconcile_cycle(docs, none, f.executions, "1998-06-01 00:00:00")
    number = F.regexp_extract("wf_id", "([0-9]+)$", 1).cast("bigint")
    create = lambda pods: pods.where(number % 4 == 0).select("namespace", "pod_name", F.lit("quota exceeded").alias("error"))
    second = reconcile.reconcile_cycle(stage(first.documents, "cycle"), none, f.executions, "1998-06-02 00:00:00", create=create)
    entry = F.try_element_at("status.taskStatuses", F.lit("t0"))
    rows = second.documents.select(
        F.concat_ws("/", "namespace", "name").alias("wf_id"), entry["phase"].alias("phase"), entry["podName"].alias("pod_name"),
        F.element_at("status.currentResourceUsage", "cpu").alias("cpu"),
    )
    return rows.join(shuffled(second.events.select("wf_id", "type", "message")), "wf_id", "left")


@query
def apply_plan(f: Fleet) -> DataFrame:
    return cycle.apply_plan(f.status, _plan(f, "remote"), f.names)[0]


@query
def apply_plan_usage(f: Fleet) -> DataFrame:
    return cycle.apply_plan(f.status, _plan(f, "remote"), f.names)[1]


# Graph


def _timed(f: Fleet) -> DataFrame:
    return f.tasks.select(
        "wf_id", "idx", "task_name", (F.col("l_extendedprice") / 1000).alias("duration")
    )


@query
def earliest_start(f: Fleet) -> DataFrame:
    times = graph.earliest_start(_timed(f), f.edges)
    return times.select("wf_id", "idx", "task_name", six("start"), six("end"))


@query
def earliest_start_spec_order(f: Fleet) -> DataFrame:
    times = graph.earliest_start(_timed(f), f.edges, order="spec")
    return times.select("wf_id", "idx", "task_name", six("start"), six("end"))


@query
def dag_lint(f: Fleet) -> DataFrame:
    return graph.dag_lint(f.tasks, f.edges)


# Model


@query
def training_set(f: Fleet) -> DataFrame:
    rows = model.training_set(f.executions)
    return rows.select(
        "workflow_name", "task_name", "image", micros(F.col("completed_at")).alias("completed_us"),
        "image_hash", six("hist_cpu_m"), six("hist_mem_mib"), six("hist_duration_s"),
        "actual_cpu_m", "actual_mem_mib", six("duration_s"),
    )


@query
def split_train_test(f: Fleet) -> DataFrame:
    train, test = model.split_train_test(f.executions)
    columns = ["workflow_name", "task_name", "image", micros(F.col("completed_at")).alias("completed_us")]
    return train.select(*columns, F.lit("train").alias("part")).unionByName(
        test.select(*columns, F.lit("test").alias("part"))
    )


def _trained(f: Fleet):
    """The forest over one synthetic sample per order, and its held-out part."""

    def build():
        train, test = model.split_train_test(stage(_samples(f), "samples"))
        return model.train_forest(train), stage(test, "held-out")

    return f.once("forest", build)


@query
def train_forest(f: Fleet) -> DataFrame:
    forest, test = _trained(f)
    scored = forest.transform(test)
    return scored.select(
        "sample_id", "image", *[F.round(f"p_{t}", 3).alias(f"p_{t}") for t in model.TARGETS]
    )


@query
def evaluate_r2(f: Fleet) -> DataFrame:
    return model.evaluate_r2(*_trained(f))


@query
def score_forest(f: Fleet) -> DataFrame:
    forest, _ = _trained(f)
    stats = history.image_history(f.executions, AS_OF)
    enriched = history.enrich_with_history(f.tasks, stats)
    return predict.predict_resources(enriched, model=forest)


@query
def score_forest_rules(f: Fleet) -> DataFrame:
    """What is fixed of a forest's predictions: who is scored, how sure, and the floors. Sizes of tasks that
    the forest does not score are given as they are."""
    forest, _ = _trained(f)
    enriched = history.enrich_with_history(f.tasks, history.image_history(f.executions, AS_OF))
    rows = predict.predict_resources(enriched, model=forest)
    scored = F.col("method") == "ml"
    floors = (F.col("cpu_m") >= 10) & (F.col("mem_mib") >= 8) & (F.col("duration_s") >= 1)
    other = lambda c: F.when(~scored, F.col(c)).alias(c)
    return rows.select(
        "wf_id", "task_name", "method", six("confidence"), (~scored | floors).alias("above_floors"), other("cpu_m"), other("mem_mib")
    )


@query
def evaluate_r2_floor(f: Fleet) -> DataFrame:
    """The forest explains most of each target on held-out rows."""
    return model.evaluate_r2(*_trained(f)).select("target", (F.col("r2") > 0.5).alias("most_explained"))


@query
def forest_on_history(f: Fleet) -> DataFrame:
    """A forest fitted on the fleet's own runs, each with the statistics its image had at that time, and judged on runs
    held out: it is no worse than the mean of these."""

    def build():
        train, test = model.split_train_test(stage(model.training_set(f.executions), "training-set"))
        return model.train_forest(train, trees=20, depth=6), stage(test, "held-out")

    forest, test = f.once("history-forest", build)
    scores = model.evaluate_r2(forest, test)
    held_out = F.lit(test.count())
    return scores.select("target", held_out.alias("n_held_out"), (F.col("r2") > -0.05).alias("no_worse_than_mean"))


# Ordered reads


@query
def recent_executions(f: Fleet) -> DataFrame:
    return _execution_columns(history.recent_executions(f.executions))


@query
def recent_executions_top(f: Fleet) -> DataFrame:
    return _execution_columns(history.recent_executions(f.executions, n=100))


@query
def executions_of(f: Fleet) -> DataFrame:
    return _execution_columns(history.executions_of(f.executions, "wf-102", "line-6"))


# Streams


def _phase_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "wf_id", "task_name", "phase",
        F.unix_micros("started_at").alias("started_us"), F.unix_micros("ended_at").alias("ended_us"),
        "n_events",
    )


@query
def task_phases(f: Fleet) -> DataFrame:
    return _phase_columns(phases.task_phases(f.pod_events))


@query
def fold_phases(f: Fleet) -> DataFrame:
    """Events on top of the stored statuses of the fleet."""
    folded = phases.fold_phases(f.status.select("wf_id", "task_name", "phase"), f.pod_events)
    return folded.select("wf_id", "task_name", "phase", "before", "n_events")


def _event_stream(f: Fleet) -> DataFrame:
    given = f.table("events").schema
    raw = f.spark.readStream.schema(given).parquet(f"{f.sf_dir}/event[s].parquet")
    return f.as_pod_events(raw)


@query
def task_phase_stream(f: Fleet) -> DataFrame:
    table = new_path(f, "phases")
    running = phases.task_phase_stream(_event_stream(f), table, new_path(f, "offsets"))
    running.awaitTermination()
    current = phases.PhaseTable(f.spark, table).current()
    return current.select("wf_id", "task_name", "phase", F.unix_micros("changed_at").alias("changed_us"))


@query
def task_phase_stream_text_ids(f: Fleet) -> DataFrame:
    """The same over ids as documents have them, ``namespace/name``."""
    named = _event_stream(f)
    number = F.col("wf_id").cast("string")
    named = named.withColumn("wf_id", F.concat(F.lit("ns/wf-"), number))
    table = new_path(f, "phases")
    phases.task_phase_stream(named, table, new_path(f, "offsets")).awaitTermination()
    current = phases.PhaseTable(f.spark, table, "string").current()
    return current.select("wf_id", "task_name", "phase", F.unix_micros("changed_at").alias("changed_us"))


@query
def task_phase_stream_rolling(f: Fleet) -> DataFrame:
    """The events arrive in eight stretches of time, one micro-batch each; tasks leave the state two weeks after their end."""
    given, path, offsets = new_path(f, "pod-events"), new_path(f, "phases"), new_path(f, "offsets")
    table = rolling.RollingPhaseTable(f.spark, path, keep=timedelta(days=14), buckets=3)
    first, last = f.pod_events.agg(F.min("ts"), F.max("ts")).first()
    step = (last - first) / 8 if first else timedelta(0)
    stretch = F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(first))) / F.lit(max(1, step // timedelta(microseconds=1))))
    for n in range(8):
        f.pod_events.where(F.least(stretch, F.lit(7)) == n).write.mode("append").parquet(given)
        stream = f.spark.readStream.schema(f.pod_events.schema).parquet(given)
        phases.task_phase_stream(stream, path, offsets, table=table).awaitTermination()
    return table.states().select("wf_id", "task_name", "phase", F.unix_micros("changed_at").alias("changed_us"))


@query
def metrics_stream(f: Fleet) -> DataFrame:
    path = new_path(f, "history")
    planner.metrics_stream(
        _event_stream(f), new_path(f, "phases"), path, new_path(f, "offsets"),
        status=lambda: f.status, tasks=lambda: f.tasks,
    ).awaitTermination()
    return _execution_columns(f.spark.read.parquet(path))


@query
def event_stream(f: Fleet) -> DataFrame:
    path = new_path(f, "events")
    planner.event_stream(
        _event_stream(f), new_path(f, "phases"), path, new_path(f, "offsets"), names=lambda: f.names
    ).awaitTermination()
    return f.spark.read.parquet(path).select("wf_id", "type", "reason", "message")


def _plan_tables(f: Fleet) -> planner.PlanTables:
    return planner.PlanTables(
        tasks=lambda: f.tasks,
        edges=lambda: f.edges,
        status=lambda: f.status,
        limits=lambda: f.limits,
        executions=lambda: f.executions,
    )


@query
def plan_changed(f: Fleet) -> DataFrame:
    return planner.plan_changed(f.pod_events, _plan_tables(f), AS_OF)


@query
def plan_stream(f: Fleet) -> DataFrame:
    path = new_path(f, "plans")
    planner.plan_stream(
        _event_stream(f), _plan_tables(f), path, new_path(f, "offsets"),
        clock=lambda batch: AS_OF, interval=None,
    ).awaitTermination()
    return f.spark.read.parquet(path).select(*admission.PLAN)


@query
def plan_stream_again(f: Fleet) -> DataFrame:
    """Two micro-batches name the same workflows: each task is started once."""
    given, path = new_path(f, "changes"), new_path(f, "plans")
    changed = f.pod_events.select("wf_id").distinct()
    for _ in range(2):
        changed.coalesce(1).write.mode("append").parquet(given)
    stream = f.spark.readStream.schema(changed.schema).option("maxFilesPerTrigger", 1).parquet(given)
    planner.plan_stream(
        stream, _plan_tables(f), path, new_path(f, "offsets"), clock=lambda batch: AS_OF, interval=None
    ).awaitTermination()
    return f.spark.read.parquet(path).select(*admission.PLAN)


def _by_time(rows: DataFrame, column: str, n: int) -> list[DataFrame]:
    """The rows in ``n`` equal stretches of time; rows without a time come last."""
    first, last = rows.agg(F.min(column), F.max(column)).first()
    step = (last - first) / n if first else timedelta(0)
    stretch = F.floor((F.unix_micros(column) - F.unix_micros(F.lit(first))) / F.lit(max(1, step // timedelta(microseconds=1))))
    return [rows.where(F.coalesce(F.least(stretch, F.lit(n - 1)), F.lit(n - 1)) == i) for i in range(n)]


def _cells(f: Fleet) -> cells.CellTable:
    """Image statistics of the executions, which arrive in six stretches of time; the clock stands still, so that
    only what has left the last window is dropped."""

    def build():
        table = cells.CellTable(f.spark, new_path(f, "cells"), buckets=4)
        for n, part in enumerate(_by_time(stage(f.executions, "executions"), "completed_at", 6)):
            table.write(part, n, AS_OF)
        return table

    return f.once("cells", build)


@query
def image_history_cells(f: Fleet) -> DataFrame:
    """Image statistics from kept cells; of the history only the window's first and last hour are read."""
    kept = _cells(f).history(f.spark.read.parquet(f.history_path), AS_OF)
    return kept.select("image", six("hist_cpu_m"), six("hist_mem_mib"), six("hist_duration_s"), "n_samples")


@query
def ready_stream(f: Fleet) -> DataFrame:
    """The ready tasks after the pod events, which arrive in four stretches of time on top of the stored statuses."""
    table, given, offsets = wakeups.WakeTable(f.spark, new_path(f, "counters"), buckets=3), new_path(f, "pod-events"), new_path(f, "offsets")
    table.load(f.tasks, f.edges, f.status)
    for part in _by_time(f.pod_events, "ts", 4):
        part.write.mode("append").parquet(given)
        stream = f.spark.readStream.schema(f.pod_events.schema).parquet(given)
        wakeups.wake_stream(stream, table, offsets).awaitTermination()
    return table.ready()


@query
def plan_changed_kept(f: Fleet) -> DataFrame:
    """The cycle of the changed workflows on kept counters and kept image statistics: no edges, two hours of history."""
    table = wakeups.WakeTable(f.spark, new_path(f, "counters"), buckets=3)
    table.load(f.tasks, f.edges, f.status)
    kept = replace(
        _plan_tables(f),
        ready=table.ready,
        statistics=lambda as_of: _cells(f).history(f.spark.read.parquet(f.history_path), as_of),
    )
    return planner.plan_changed(f.pod_events, kept, AS_OF)


@query
def event_log(f: Fleet) -> DataFrame:
    """Every kind of event: document seen, task started, refused or ended,
    workflow ended."""
    seen = f.tasks.groupBy("wf_id").agg(F.count("*").alias("n_tasks"))
    synced, _ = status.sync_pod_status(f.status, f.pods, AS_OF)
    started, _ = cycle.apply_plan(f.status, _plan(f, "remote"), f.names)
    was_running = f.status.where(F.col("phase") == "Running").select("wf_id", "task_name")
    new = started.where(F.col("phase") == "Running").join(was_running, ["wf_id", "task_name"], "left_anti")
    # Stored, so that its size is known: of the tasks only those that may be meant are shuffled.
    wanted = stage(f.edges.where(F.col("dep") == "t999").select("wf_id", F.col("dep").alias("task_name")), "wanted")
    refused = tasks.pod_spec_rejects(wanted, f.tasks.join(wanted, ["wf_id", "task_name"], "left_semi"))
    parts = [
        events.init_transitions(seen, f.status),
        events.start_transitions(new),
        events.reject_transitions(refused),
        events.sync_transitions(f.status, synced),
        events.workflow_transitions(status.workflow_phase(synced), status.workflow_phase(f.status)),
    ]
    log = events.event_log(parts[0])
    for part in parts[1:]:
        log = log.unionByName(events.event_log(part))
    return log
