"""The reconcile cycle over a few documents, from first sight to the end."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetplan import schemas as S
from fleetplan.plans.cycle import plan_cycle
from fleetplan.plans.reconcile import reconcile_cycle
from fleetplan.registry.fleet import AS_OF, fleet
from fleetplan.session import stage
from fleetplan.sources.documents import DocumentTable
from fleetplan.streaming import reconciler

PODS = "wf_id string, namespace string, workflow_name string, pod_name string, task_name string, image string, pod_phase string, started_at timestamp, created_at timestamp"


def documents(spark):
    task = lambda name, *deps: (name, "busybox", None, list(deps), None)
    rows = [
        ("ns", "two", ("MinimizeTime", {"cpu": "1", "memory": "1Gi"}, [task("a"), task("b")]), None),
        ("ns", "none", ("MinimizeTime", {}, None), None),
        ("ns", "over", ("MinimizeTime", {}, [task("a")]), ("Completed", {"a": ("Failed", None, None)}, None, [])),
    ]
    schema = T.StructType().add("namespace", "string").add("name", "string").add("spec", S.SPEC).add("status", S.STATUS)
    return spark.createDataFrame(rows, schema)


def state(docs):
    return {r.name: (r.status.phase, {k: v.phase for k, v in r.status.taskStatuses.items()}) for r in docs.collect()}


def test_two_tasks_run_and_complete(spark):
    executions = spark.createDataFrame([], S.EXECUTION)
    none = spark.createDataFrame([], PODS)
    run = lambda docs, pods, day: reconcile_cycle(docs, pods, executions, f"2024-01-0{day} 00:00:00")
    over = ("Completed", {"a": "Failed"})

    first = run(documents(spark), none, 1)
    assert state(first.documents) == {"two": ("Pending", {"a": "Pending", "b": "Pending"}), "none": ("Pending", {}), "over": over}
    assert first.pods.count() == 0 and sorted(r.message for r in first.events.collect()) == ["Workflow initialized with 0 tasks", "Workflow initialized with 2 tasks"]

    second = run(stage(first.documents, "t"), none, 2)
    docs = stage(second.documents, "t")
    assert state(docs) == {"two": ("Running", {"a": "Running", "b": "Running"}), "none": ("Running", {}), "over": over}
    created = second.pods.collect()
    assert sorted(r.pod_name for r in created) == ["two-a", "two-b"]
    two = docs.where("name = 'two'").first().status
    assert two.currentResourceUsage == {"cpu": "200m", "memory": "256Mi"}
    assert two.taskStatuses["a"].allocatedResources.limits == {"cpu": "150m", "memory": "192Mi"}
    assert [(c.reason, c.lastTransitionTime) for c in two.conditions] == [("Reconciling", "2024-01-01T00:00:00Z")]

    ended = spark.createDataFrame([("ns/two", "ns", "two", f"two-{t}", t, "busybox", "Succeeded", None, None) for t in "ab"], PODS)
    ended = ended.withColumn("created_at", F.lit("2024-01-02 23:59:00").cast("timestamp"))
    third = run(docs, ended, 3)
    docs = stage(third.documents, "t")
    assert state(docs)["two"] == ("Completed", {"a": "Succeeded", "b": "Succeeded"})
    two = docs.where("name = 'two'").first().status
    assert two.currentResourceUsage is None
    assert sorted((c.type, c.status, c.lastTransitionTime) for c in two.conditions) == [("Available", "True", "2024-01-03T00:00:00Z"), ("Progressing", "False", "2024-01-03T00:00:00Z")]
    assert sorted((r.task_name, r.duration_s) for r in third.executions.collect()) == [("a", 60.0), ("b", 60.0)]
    assert sorted(r.reason for r in third.events.collect()) == ["TaskSucceeded", "TaskSucceeded", "WorkflowCompleted"]

    fourth = run(docs, ended, 4)
    assert state(fourth.documents) == state(docs)
    assert fourth.events.isEmpty() and fourth.executions.isEmpty() and fourth.pods.isEmpty()


def test_pods_that_cannot_be_made(spark):
    executions, none = spark.createDataFrame([], S.EXECUTION), spark.createDataFrame([], PODS)
    first = stage(reconcile_cycle(documents(spark), none, executions, "2024-01-01 00:00:00").documents, "t")
    told = []

    def create(pods):
        told.append(pods.count())
        failed = pods.where("task_name = 'a'").select("namespace", "pod_name")
        return failed.withColumn("error", F.lit("later")).unionByName(failed.withColumn("error", F.lit("full")))

    second = reconcile_cycle(first, none, executions, "2024-01-02 00:00:00", create=create)
    assert state(second.documents)["two"] == ("Running", {"a": "Pending", "b": "Running"})
    assert told == [2] and [r.pod_name for r in second.pods.collect()] == ["two-b"]
    two = second.documents.where("name = 'two'").first().status
    assert two.currentResourceUsage == {"cpu": "100m", "memory": "128Mi"} and two.taskStatuses["a"].podName is None
    assert sorted(r.message for r in second.events.collect()) == ['Failed to create pod for task "a": full', 'Started task "b" with pod "two-b"']
    third = reconcile_cycle(stage(second.documents, "t"), none, executions, "2024-01-03 00:00:00")
    assert state(third.documents)["two"] == ("Running", {"a": "Running", "b": "Running"})


def test_failed_predictions(spark, sf_dir):
    """Workflows without prediction are planned on hints and defaults, the others as before."""
    f = fleet(spark, sf_dir)
    plan = lambda **o: plan_cycle(f.tasks, f.edges, f.status, f.limits, f.executions, AS_OF, **o)
    failed = f.names.where("wf_id % 3 = 0").select("wf_id")
    got = plan(unpredicted=failed.unionByName(failed))
    expected = plan().where("wf_id % 3 <> 0").unionByName(plan(predictor="none").where("wf_id % 3 = 0"))
    assert got.exceptAll(expected).isEmpty() and expected.exceptAll(got).isEmpty()


def changes(spark, folder, names):
    spark.createDataFrame([("ns", n) for n in names], "namespace string, name string").coalesce(1).write.mode("append").parquet(str(folder / "in"))
    return spark.readStream.schema("namespace string, name string").parquet(str(folder / "in"))


def test_stream_yields_to_other_writers(spark, tmp_path, monkeypatch):
    """A spec is written while a batch is worked out: the batch is refused there, publishes nothing of it, and comes back."""
    table = DocumentTable(spark, str(tmp_path / "docs"))
    table.write(documents(spark).where("name <> 'over'").withColumn("resource_version", F.lit(None).cast("bigint")), "spec")
    executions, none = spark.createDataFrame([], S.EXECUTION), spark.createDataFrame([], PODS)
    path = str(tmp_path / "out")

    def run(names, pods=lambda batch: none):
        stream = changes(spark, tmp_path, names)
        reconciler.reconcile_stream(
            stream, table, pods, lambda batch: executions, path, str(tmp_path / "cp"), lambda batch: f"2024-01-0{batch + 1} 00:00:00", str(tmp_path / "history")
        ).awaitTermination()

    def meddle(batch):
        late = table.read().where("name = 'two'")
        assert table.write(late.withColumn("spec", F.col("spec").withField("optimizationGoal", F.lit("late"))), "spec").isEmpty()
        return none

    phases = lambda: {r.name: None if r.status is None else r.status.phase for r in table.read().collect()}
    published = lambda part, n: spark.read.parquet(f"{path}/{part}/batch={n}")
    run(["two", "none", "absent"], meddle)
    assert phases() == {"two": None, "none": "Pending"}
    assert [r.wf_id for r in published("events", 0).collect()] == ["ns/none"]
    run(["none"])  # and "two" with it
    assert phases() == {"two": "Pending", "none": "Running"}
    assert [r.wf_id for r in published("events", 1).collect()] == ["ns/two"]
    assert table.read().where("name = 'two'").first().spec.optimizationGoal == "late"

    # a batch that fails after its statuses were written publishes what it had worked out
    version, write = table.version(), DocumentTable.write

    def fail(self, rows, part):
        write(self, rows, part)
        raise RuntimeError("lost")

    monkeypatch.setattr(DocumentTable, "write", fail)
    with pytest.raises(Exception):
        run(["two"])
    monkeypatch.setattr(DocumentTable, "write", write)
    assert table.version() == version + 1
    run([])  # batch 2 again, and one without changes
    assert phases() == {"two": "Running", "none": "Running"} and table.version() == version + 1
    assert sorted(r.pod_name for r in published("pods", 2).collect()) == ["two-a", "two-b"]
    assert sorted(r.reason for r in published("events", 2).collect()) == ["TaskStarted", "TaskStarted"]

    ended = spark.createDataFrame([("ns/two", "ns", "two", f"two-{t}", t, "busybox", "Succeeded", None, None) for t in "ab"], PODS)
    run(["two"], lambda batch: ended.withColumn("created_at", F.lit("2024-01-03 00:00:00").cast("timestamp")))
    assert phases() == {"two": "Completed", "none": "Running"}
    assert spark.read.parquet(str(tmp_path / "history")).count() == 2
    before = table.version()
    run(["two"])  # it has ended: nothing is written
    assert table.version() == before and published("events", 5).isEmpty()


def test_statuses_are_never_broadcast(spark):
    """What has a row for each workflow or task does not pass through the driver, however small its files are."""
    none = spark.createDataFrame([], "wf_id string, namespace string, workflow_name string, pod_name string, task_name string, image string, pod_phase string, started_at timestamp, created_at timestamp")
    executions = spark.createDataFrame([], S.EXECUTION)
    first = stage(reconcile_cycle(documents(spark), none, executions, "2024-01-01 00:00:00").documents, "t")
    found = reconcile_cycle(first, none, executions, "2024-01-02 00:00:00")
    plan = found.documents._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 5 and "Broadcast" not in plan
    create = lambda pods: pods.select("namespace", "pod_name", F.lit("quota").alias("error"))
    refused = reconcile_cycle(first, none, executions, "2024-01-02 00:00:00", create=create)
    assert "Broadcast" not in refused.pods._jdf.queryExecution().executedPlan().toString()


def test_stream_reads_the_table_once_for_a_batch(spark, tmp_path, monkeypatch):
    """Nothing is refused, so what was written is not looked up."""
    table = DocumentTable(spark, str(tmp_path / "docs"))
    table.write(documents(spark).where("name <> 'over'").withColumn("resource_version", F.lit(None).cast("bigint")), "spec")
    reads, read = [], DocumentTable.read
    monkeypatch.setattr(DocumentTable, "read", lambda self, *version: reads.append(1) or read(self, *version))
    executions, none = spark.createDataFrame([], S.EXECUTION), spark.createDataFrame([], PODS)
    reconciler.reconcile_stream(
        changes(spark, tmp_path, ["two", "none"]), table, lambda batch: none, lambda batch: executions, str(tmp_path / "out"), str(tmp_path / "cp"), lambda batch: "2024-01-01 00:00:00"
    ).awaitTermination()
    assert len(reads) == 1 and {r.name: r.status.phase for r in read(table).collect()} == {"two": "Pending", "none": "Pending"}
    assert spark.read.parquet(str(tmp_path / "out/requeued/batch=0")).isEmpty()
