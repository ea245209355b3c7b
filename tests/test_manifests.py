import json

from dags import document, task
from pyspark.sql import functions as F

from fleetplan import schemas as S
from fleetplan.operators import tasks
from fleetplan.sources import manifests


def write(tmp_path, lines):
    path = tmp_path / "docs.json"
    path.write_text("\n".join(lines))
    return str(path)


def test_read_fills_defaults_and_keeps_bad_lines(spark, tmp_path):
    number = document("n", 2, "1Gi", [task("a", [], 1, "64Mi")], "prod")  # quantities may be numbers
    blank = document("b", "1", "1Gi", [task("a")], "")
    lines = [json.dumps(number), json.dumps(blank), "{not json"]
    rows = {r.name: r for r in manifests.read_manifests(spark, write(tmp_path, lines), "mine").collect()}
    assert rows["n"].namespace == "prod" and rows["n"].spec.maxResources["cpu"] == "2"
    assert rows["b"].namespace == "mine" and rows["b"].spec.optimizationGoal == "MinimizeTime"
    assert rows[None]._corrupt_record == "{not json" and rows[None].spec is None


def test_round_trip(spark, tmp_path):
    doc = document("n", "2", "1Gi", [task("a", [], "1", "64Mi"), task("b", ["a"])], "ns")
    read = manifests.read_manifests(spark, write(tmp_path, [json.dumps(doc)]))
    fresh = tasks.init_status(read)
    out = str(tmp_path / "out")
    manifests.write_workflows_json(fresh, out)
    back = manifests.read_manifests(spark, out)
    assert back.drop("_corrupt_record").collect() == fresh.drop("_corrupt_record").collect()
    texts = manifests.export_workflows_json(fresh)
    assert manifests.parse_manifests(texts).collect() == back.collect()
    status = {r.task_name: r.phase for r in tasks.flatten_status(back).collect()}
    assert status == {"a": "Pending", "b": "Pending"}


def test_init_keeps_existing_status(spark):
    docs = spark.createDataFrame(
        [("ns", "w", (None, None, [("a", None, None, None, None)] * 2),
          ("Running", {"a": ("Running", "p", None)}, None, None)),
         ("ns", "v", (None, None, [("a", None, None, None, None)] * 2), None),
         ("ns", "empty", (None, None, []), None)],
        S.T.StructType([
            S.T.StructField("namespace", S.T.StringType()), S.T.StructField("name", S.T.StringType()),
            S.T.StructField("spec", S.SPEC), S.T.StructField("status", S.STATUS),
        ]),
    )
    got = {r.name: r.status for r in tasks.init_status(docs).collect()}
    assert got["w"].phase == "Running" and got["w"].taskStatuses["a"].podName == "p"
    assert got["v"].phase == "Pending" and list(got["v"].taskStatuses) == ["a"]
    assert got["v"].conditions[0].message == "Workflow initialized with 2 tasks"
    assert got["empty"].taskStatuses == {}


def test_validation_reasons(spark, tmp_path):
    good = document("good", "1", "1Gi", [task("a", [], "100m", "64Mi")])
    broken = document("broken", "one", "1Gi", [{"image": "x"}, {"name": "y"}, task("z", [], "1K", "64Mi")])
    broken["status"] = {"conditions": [{"type": "Available", "status": "Maybe"}]}
    none = {"metadata": {"name": "none"}, "spec": {"maxResources": {"cpu": "1"}}}
    lines = [json.dumps(d) for d in (good, broken, none)]
    ok, bad = tasks.validate_manifests(manifests.read_manifests(spark, write(tmp_path, lines)))
    assert [r.name for r in ok.collect()] == ["good"]
    assert {r.name: set(r.reasons) for r in bad.collect()} == {
        "broken": {"task name missing", "task image missing", "bad maxResources quantity",
                   "bad request quantity", "bad condition status", "bad condition reason",
                   "condition message missing"},
        "none": {"tasks missing"},
    }


def test_upsert_and_delete(spark, tmp_path):
    doc = lambda name, n: document(name, "1", "1Gi", [task(f"t{i}") for i in range(n)], "ns")
    read = lambda *docs: manifests.read_manifests(spark, write(tmp_path, [json.dumps(d) for d in docs]))
    current = tasks.init_status(read(doc("a", 1), doc("b", 1))).cache()
    current.count()
    at = lambda df, t: df.withColumn("submitted_at", F.lit(t).cast("timestamp"))
    late = at(read(doc("a", 3), doc("c", 1)), "2024-01-02").cache()
    late.count()
    early = at(read(doc("a", 2)), "2024-01-01").cache()
    early.count()
    after = manifests.upsert_manifests(current, late.unionByName(early))
    got = {r.name: (len(r.spec.tasks), r.status and r.status.phase) for r in after.collect()}
    assert got == {"a": (3, "Pending"), "b": (1, "Pending"), "c": (1, None)}
    pods = spark.createDataFrame([("ns", "a", "a-t0"), ("ns", "b", "b-t0"), ("other", "a", "a-t0")],
                                 "namespace string, workflow_name string, pod_name string")
    left, owned = manifests.delete_cascade(after, pods, after.where("name = 'a'"))
    assert sorted(r.name for r in left.collect()) == ["b", "c"]
    assert sorted((r.namespace, r.workflow_name) for r in owned.collect()) == [("ns", "b"), ("other", "a")]


def test_lookup(spark):
    docs = spark.createDataFrame([("x", "a"), ("y", "a"), ("y", "b")], "namespace string, name string")
    count = lambda *a: tasks.workflow_lookup(docs, *a).count()
    assert [count(), count(""), count("all"), count("y"), count("y", "a"), count(None, "a")] == [3, 3, 3, 2, 1, 2]


def test_pod_rows(spark):
    flat = spark.createDataFrame(
        [(1, "ns", "Wf", 0, "A", "img", ["x", "y"]), (1, "ns", "Wf", 1, "B", "img", []), (1, "ns", "Wf", 2, "B", "other", ["z"])],
        "wf_id long, namespace string, workflow_name string, idx int, task_name string, image string, command array<string>",
    )
    plan = spark.createDataFrame([(1, t, 1, 2, 3, 4) for t in ("A", "B", "C")],
        "wf_id long, task_name string, cpu_request_m long, mem_request_mib long, cpu_limit_m long, mem_limit_mib long")
    rows = {r.pod_name: r for r in tasks.pod_spec(plan, flat, manager="me").collect()}
    assert set(rows) == {"wf-a", "wf-b"}
    assert rows["wf-a"].command == ["x", "y"] and rows["wf-b"].command == ["echo", "Running task B"]
    assert rows["wf-b"].image == "img" and rows["wf-a"].restart_policy == "Never"
    assert rows["wf-a"].labels == {"workflow": "Wf", "task-name": "A", "app.kubernetes.io/managed-by": "me"}
    rejects = tasks.pod_spec_rejects(plan, flat).collect()
    assert [(r.task_name, r.error) for r in rejects] == [("C", 'task "C" not found in spec')]
