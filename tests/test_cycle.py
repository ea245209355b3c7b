"""Documents to plans: the golden waves, and the rules of one cycle."""

import json

import pytest
from dags import GOLDEN, document, task
from pyspark.sql import functions as F

from fleetplan import schemas as S
from fleetplan.operators import graph, tasks
from fleetplan.plans.cycle import apply_plan, plan_cycle
from fleetplan.sources.manifests import read_manifests

AS_OF = "2024-02-01 00:00:00"
STATUS = "wf_id string, task_name string, phase string, pod_name string, alloc_cpu_m long, alloc_mem_mib long"


def read(spark, folder, documents):
    path = folder / "docs.json"
    path.write_text("\n".join(json.dumps(d) for d in documents))
    return read_manifests(spark, str(path))


@pytest.fixture(scope="module")
def fleet(spark, tmp_path_factory):
    docs = [document(n, c, m, t) for n, (c, m, t, *_) in GOLDEN.items()]
    read_ = read(spark, tmp_path_factory.mktemp("docs"), docs)
    flat = tasks.flatten_tasks(read_).cache()
    return flat, tasks.dependency_edges(flat).cache(), tasks.workflow_limits(read_).cache(), read_


def test_sizes_and_depth(fleet):
    flat, edges, _, _ = fleet
    n_edges = {r.wf_id: r["count"] for r in edges.groupBy("wf_id").count().collect()}
    times = graph.earliest_start(flat.withColumn("duration", F.lit(1.0)), edges)
    depth = {r.wf_id: r.d for r in times.groupBy("wf_id").agg(F.max("end").alias("d")).collect()}
    for name, (_, _, listed, count, deep, _) in GOLDEN.items():
        assert n_edges[f"default/{name}"] == count
        assert depth[f"default/{name}"] == deep


def test_waves(spark, fleet):
    """Cycle after cycle, every admitted task finishing before the next."""
    flat, edges, limits, docs = fleet
    status = tasks.flatten_status(tasks.init_status(docs))
    names = docs.select(tasks.workflow_id(F.col("namespace"), F.col("name")).alias("wf_id"),
                        F.col("name").alias("workflow_name"))
    waves = {name: [] for name in GOLDEN}
    for _ in range(8):
        plan = plan_cycle(flat, edges, status, limits, None, AS_OF, dialect="local")
        after, _ = apply_plan(status, plan, names)
        rows = after.collect()
        for name in GOLDEN:
            mine = [r for r in rows if r.wf_id == f"default/{name}" and r.phase == "Running"]
            if mine:
                waves[name].append((len(mine), sum(r.alloc_cpu_m for r in mine), sum(r.alloc_mem_mib for r in mine)))
                assert all(r.pod_name == f"{name}-{r.task_name}" for r in mine)
        done = [r.asDict() | {"phase": "Succeeded" if r.phase == "Running" else r.phase} for r in rows]
        status = spark.createDataFrame(done, STATUS)
    assert waves == {name: golden[-1] for name, golden in GOLDEN.items()}


def one_workflow(spark, tmp_path, listed, status, cap=("10", "10Gi"), executions=None, **options):
    docs = read(spark, tmp_path, [document("w", *cap, listed)])
    flat = tasks.flatten_tasks(docs)
    rows = [("default/w", t, p, None, None, None) for t, p in status.items()]
    executions = executions or []
    plan = plan_cycle(
        flat, tasks.dependency_edges(flat), spark.createDataFrame(rows, STATUS),
        tasks.workflow_limits(docs), spark.createDataFrame(executions, S.EXECUTION), AS_OF, **options,
    )
    return {r.task_name: (r.cpu_request_m, r.mem_request_mib, r.cpu_limit_m, r.mem_limit_mib)
            for r in plan.collect()}


def test_two_independent_tasks(spark, tmp_path):
    got = one_workflow(spark, tmp_path, [task("a"), task("b")], {"a": "Pending", "b": "Pending"}, dialect="local")
    assert got == {"a": (100, 128, 200, 256), "b": (100, 128, 200, 256)}


def test_only_running_workflows_are_planned(spark, tmp_path):
    listed = [task("a"), task("b"), task("c", ["a"])]
    assert one_workflow(spark, tmp_path, listed, {"a": "Succeeded", "b": "Failed"}) == {}
    assert one_workflow(spark, tmp_path, listed, {"a": "Succeeded"}) == {}
    assert one_workflow(spark, tmp_path, listed, {}) == {}
    assert set(one_workflow(spark, tmp_path, listed, {"a": "Succeeded", "b": "Pending"})) == {"b", "c"}


def test_missing_status_row_is_pending_but_not_succeeded(spark, tmp_path):
    listed = [task("a"), task("b", ["a"]), task("c", ["ghost"]), task("d")]
    got = one_workflow(spark, tmp_path, listed, {"d": "Running"})
    assert set(got) == {"a"}


def test_sizes_by_dialect(spark, tmp_path):
    listed = [task("hint", [], "300m", "64Mi"), task("half", [], "300m", None), task("none", image="seen")]
    pending = {n: "Pending" for n in ("hint", "half", "none")}
    import datetime

    seen = [("w0", "t", "seen", 250, 99, 10.0, True, datetime.datetime(2024, 1, 31))]
    remote = one_workflow(spark, tmp_path, listed, pending, executions=seen, dialect="remote")
    assert remote == {
        "hint": (300, 64, 450, 96), "half": (300, 128, 450, 192), "none": (300, 118, 450, 177)
    }
    local = one_workflow(spark, tmp_path, listed, pending, executions=seen, dialect="local")
    assert local == {
        "hint": (300, 64, None, None), "half": (300, None, None, None), "none": (100, 128, 200, 256)
    }
    plain = one_workflow(spark, tmp_path, listed, pending, dialect="remote", predictor="none")
    assert plain == {"hint": (300, 64, 600, 128), "half": (300, 0, 600, 0), "none": (100, 128, 200, 256)}
    passed = one_workflow(spark, tmp_path, listed, pending, dialect="remote", predictor="baseline")
    assert passed == {"hint": (300, 64, 450, 96), "half": (300, 0, 450, 0), "none": (100, 128, 200, 256)}


def test_repeated_task_name_is_charged_twice_and_makes_one_pod(spark, tmp_path):
    docs = read(spark, tmp_path, [document("w", "1", "10Gi", [task("a"), task("a"), task("b")])])
    flat = tasks.flatten_tasks(docs)
    status = tasks.flatten_status(tasks.init_status(docs))
    plan = plan_cycle(flat, tasks.dependency_edges(flat), status, tasks.workflow_limits(docs), None, AS_OF, "local")
    assert sorted(r.idx for r in plan.collect()) == [0, 1, 2]
    assert tasks.pod_spec(plan, flat).select("pod_name").distinct().count() == 2
