import datetime as dt

from pyspark.sql import functions as F

from fleetplan.operators import status as st
from fleetplan.streaming.events import event_log

STATUS = "wf_id long, task_name string, phase string, alloc_cpu_m long, alloc_mem_mib long"
PODS = "wf_id long, namespace string, workflow_name string, pod_name string, task_name string, image string, pod_phase string, started_at timestamp, created_at timestamp"
NOW = dt.datetime(2024, 1, 1, 1)


def pod(task, phase, name=None, image="img", started=None, wf=1):
    return (wf, "ns", "w", name or f"w-{task}", task, image, phase, started, dt.datetime(2024, 1, 1))


def test_sync(spark):
    rows = [(1, t, p, 100, 64) for t, p in
            [("a", "Running"), ("b", "Running"), ("c", "Running"), ("d", "Pending"), ("e", "Succeeded"), ("f", "Running")]]
    pods = [
        pod("a", "Succeeded", started=dt.datetime(2024, 1, 1, 0, 59)), pod("b", "Failed"), pod("c", "Running"),
        pod("d", "Succeeded"), pod("e", "Failed"), pod(None, "Succeeded", "w-x"), pod("ghost", "Succeeded"),
        pod("f", "Succeeded", "w-f-1", image=None), pod("f", "Failed", "w-f-2"),
    ]
    synced, runs = st.sync_pod_status(
        spark.createDataFrame(rows, STATUS), spark.createDataFrame(pods, PODS), NOW
    )
    assert {r.task_name: r.phase for r in synced.collect()} == {
        "a": "Succeeded", "b": "Failed", "c": "Running", "d": "Pending", "e": "Succeeded", "f": "Succeeded"
    }
    got = {r.task_name: (r.image, r.actual_cpu_m, r.actual_mem_mib, r.duration_s, r.completed_at) for r in runs.collect()}
    assert got == {"a": ("img", 100, 64, 60.0, NOW), "f": ("unknown", 100, 64, 3600.0, NOW)}


def phases(spark, workflows, previous=None):
    rows = [(w, f"t{i}", p, 0, 0) for w, ps in workflows.items() for i, p in enumerate(ps)]
    old = previous and spark.createDataFrame(previous, "wf_id long, phase string")
    return st.workflow_phase(spark.createDataFrame(rows, STATUS), old)


def test_phase_precedence_and_conditions(spark):
    got = phases(
        spark,
        {1: ["Succeeded", "Succeeded"], 2: ["Succeeded", "Failed", "Failed"], 3: ["Running", "Running", "Pending"],
         4: ["Running"], 5: ["Failed"]},
        [(4, "Failed"), (5, "Completed"), (3, "Running")],
    )
    assert {r.wf_id: r.phase for r in got.collect()} == {
        1: "Completed", 2: "Failed", 3: "Running", 4: "Failed", 5: "Completed"
    }
    found = {}
    for r in st.workflow_conditions(got.where("wf_id < 4")).collect():
        found.setdefault(r.wf_id, set()).add((r.type, r.status, r.reason, r.message))
    assert found == {
        1: {("Available", "True", "AllTasksSucceeded", "All workflow tasks completed successfully"),
            ("Progressing", "False", "Completed", "Workflow execution is complete")},
        2: {("Available", "False", "TaskFailed", 'Task "t1" failed'),
            ("Progressing", "False", "TaskFailed", 'Workflow stopped because task "t1" failed')},
        3: {("Progressing", "True", "Reconciling", "2 tasks running")},
    }


def test_merge_conditions_sets_by_type(spark):
    schema = "wf_id long, type string, status string, reason string, message string"
    old = spark.createDataFrame([(1, "Progressing", "True", "Initialized", "m"), (1, "Other", "True", "r", "m")], schema)
    new = spark.createDataFrame([(1, "Progressing", "False", "Completed", "n")], schema)
    got = sorted(tuple(r) for r in st.merge_conditions(old, new).collect())
    assert got == [(1, "Other", "True", "r", "m"), (1, "Progressing", "False", "Completed", "n")]


def test_usage_has_no_row_for_nothing(spark):
    rows = [(1, "a", "Running", 100, 64), (1, "b", "Running", 50, None), (1, "c", "Succeeded", 999, 999),
            (2, "a", "Running", 0, 0), (3, "a", "Pending", 5, 5)]
    got = [tuple(r) for r in st.resource_usage(spark.createDataFrame(rows, STATUS)).collect()]
    assert got == [(1, 150, 64)]


def test_listing_age(spark):
    base = dt.datetime(2024, 1, 1)
    ages = {0.4: "0s", 59.5: "1m0s", 3600: "1h0m0s", 90061.2: "25h1m1s"}
    rows = [(i, "ns", f"w{i}", "Running", 3, base - dt.timedelta(seconds=a)) for i, a in enumerate(ages)]
    heads = spark.createDataFrame(rows, "wf_id long, namespace string, name string, phase string, n_tasks long, created_at timestamp")
    status = spark.createDataFrame([(0, "a", "Running", 1, 1)], STATUS)
    got = {r.wf_id: (r.tasks, r.age) for r in st.list_workflows(heads, status, base).collect()}
    assert got == {i: (f"3 ({int(i == 0)} running)", t) for i, t in enumerate(ages.values())}
    assert st.list_workflows(heads, status, base, namespace="other").count() == 0


def test_report_cells(spark):
    tasks = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c")], "wf_id long, idx int, task_name string")
    status = spark.createDataFrame(
        [(1, "a", "Running", "w-a", 10, 20), (1, "b", "Pending", "", None, None)],
        "wf_id long, task_name string, phase string, pod_name string, alloc_cpu_m long, alloc_mem_mib long",
    )
    got = {r.task_name: (r.phase, r.pod, r.cpu, r.mem) for r in st.status_report(tasks, status).collect()}
    assert got == {"a": ("Running", "w-a", "10m", "20Mi"), "b": ("Pending", "-", "-", "-"), "c": ("Unknown", "-", "-", "-")}


def test_event_messages(spark):
    rows = [
        ("Initialized", None, None, None, 3), ("TaskStarted", "t", "w-t", None, None),
        ("PodCreationFailed", "t", None, "boom", None), ("TaskSucceeded", "t", None, None, None),
        ("TaskFailed", "t", None, None, None), ("WorkflowFailed", "t", None, None, None),
        ("WorkflowCompleted", None, None, None, None),
    ]
    df = spark.createDataFrame([(1, *r) for r in rows], "wf_id long, kind string, task_name string, pod_name string, error string, n_tasks long")
    assert [(r.type, r.message) for r in event_log(df).collect()] == [
        ("Normal", "Workflow initialized with 3 tasks"), ("Normal", 'Started task "t" with pod "w-t"'),
        ("Warning", 'Failed to create pod for task "t": boom'), ("Normal", 'Task "t" completed successfully'),
        ("Warning", 'Task "t" failed'), ("Warning", 'Workflow failed because task "t" failed'),
        ("Normal", "All tasks completed successfully"),
    ]


def test_pods_to_create_is_idempotent(spark):
    specs = spark.createDataFrame(
        [("ns", "w-a", 1, "a", 5, 5), ("ns", "w-a", 1, "a", 9, 9), ("ns", "w-b", 1, "b", 5, 5)],
        "namespace string, pod_name string, wf_id long, task_name string, cpu_request_m long, mem_request_mib long",
    )
    pods = spark.createDataFrame([pod("b", "Running")], PODS)
    got = [(r.pod_name, r.cpu_request_m) for r in st.pods_to_create(specs, pods).collect()]
    assert got == [("w-a", 5)]
