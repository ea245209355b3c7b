"""Streams give what one batch over the same events gives."""

import datetime as dt
import random

import pytest
from brute import fold as brute_fold
from pyspark.sql import functions as F

from fleetplan import schemas as S
from fleetplan.sources.history import read_history
from fleetplan.streaming import phases, planner

BASE = dt.datetime(2024, 1, 1)
KINDS = ["Pending", "Running", "Running", "Succeeded", "Failed"]


def events(n=600, seed=0, tasks=40):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        # One task has a third of all events.
        key = (0, "hot") if rng.random() < 0.33 else (rng.randint(1, 5), f"t{rng.randint(0, tasks // 5)}")
        out.append((i, BASE + dt.timedelta(seconds=rng.randint(0, 20_000)), *key, rng.choice(KINDS)))
    return out


def by_key(rows):
    keyed = {}
    for i, ts, wf, task, kind in rows:
        keyed.setdefault((wf, task), []).append((ts, i, kind))
    return keyed


@pytest.mark.parametrize("cell_us", [3_600_000_000, 60_000_000, 10**15])
def test_batch_fold(spark, cell_us):
    rows = events()
    df = spark.createDataFrame(rows, S.POD_EVENT).repartition(5)
    got = {(r.wf_id, r.task_name): r for r in phases.fold_phases(None, df, cell_us).collect()}
    expected = by_key(rows)
    assert set(got) == set(expected)
    for key, listed in expected.items():
        assert got[key].phase == brute_fold(listed) and got[key].n_events == len(listed)


def test_fold_starts_from_stored_phase(spark):
    rows = events(seed=3)
    stored = {key: phase for key, phase in zip(by_key(rows), ["Pending", "Running", "Succeeded", "Failed"] * 20)}
    stored[(9, "quiet")] = "Running"
    status = spark.createDataFrame([(*k, p) for k, p in stored.items()], "wf_id long, task_name string, phase string")
    folded = phases.fold_phases(status, spark.createDataFrame(rows, S.POD_EVENT)).collect()
    got = {(r.wf_id, r.task_name): r.phase for r in folded}
    expected = by_key(rows)
    assert got == {k: brute_fold(expected.get(k, []), stored.get(k, "Pending")) for k in {*expected, *stored}}


def feed(spark, folder, parts):
    for i, part in enumerate(parts):
        df = spark.createDataFrame(part, S.POD_EVENT).coalesce(1)
        df.write.mode("append").parquet(str(folder / "in"))
    return (
        spark.readStream.schema(S.POD_EVENT).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    )


def split(rows, n):
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    size = -(-len(rows) // n)
    return [ordered[i : i + size] for i in range(0, len(rows), size)]


@pytest.mark.parametrize("n_files", [1, 3])
def test_phase_stream_equals_batch(spark, tmp_path, n_files):
    rows = events(300, seed=1)
    stream = feed(spark, tmp_path, split(rows, n_files))
    table = str(tmp_path / "table")
    phases.task_phase_stream(stream, table, str(tmp_path / "cp")).awaitTermination()
    store = phases.PhaseTable(spark, table)
    expected = {k: brute_fold(v) for k, v in by_key(rows).items()}
    assert {(r.wf_id, r.task_name): r.phase for r in store.current().collect()} == expected
    compacted = store.compact(n_files - 1, str(tmp_path / "small"))
    assert compacted.log().count() == len(expected)
    assert {(r.wf_id, r.task_name): r.phase for r in compacted.current().collect()} == expected


def test_text_ids_over_many_batches_read_few_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(phases.PhaseTable, "SNAPSHOT_EVERY", 4)
    rows = events(150, seed=5)
    table = phases.PhaseTable(spark, str(tmp_path / "table"), "string")
    for batch, part in enumerate(split(rows, 13)):
        df = spark.createDataFrame(part, S.POD_EVENT).withColumn("wf_id", F.concat(F.lit("ns/w"), "wf_id"))
        seen = df.select("wf_id", "task_name").distinct()
        assert len(table.folders(batch)) <= 4
        folded = phases.fold_phases(table.current(batch, seen), df)
        table.write(phases.phase_changes(folded), batch)
    expected = {(f"ns/w{w}", t): brute_fold(v) for (w, t), v in by_key(rows).items()}
    assert {(r.wf_id, r.task_name): r.phase for r in table.current().collect()} == expected


def test_rerun_of_a_batch_changes_nothing(spark, tmp_path):
    """A batch that was written but not acknowledged runs again after a restart."""
    rows = events(200, seed=2)
    first, second = split(rows, 2)
    table = phases.PhaseTable(spark, str(tmp_path / "table"))
    for batch, part in [(0, first), (1, second), (1, second)]:
        df = spark.createDataFrame(part, S.POD_EVENT)
        seen = df.select("wf_id", "task_name").distinct()
        table.write(phases.phase_changes(phases.fold_phases(table.current(batch, seen), df)), batch)
    expected = {k: brute_fold(v) for k, v in by_key(rows).items()}
    got = {(r.wf_id, r.task_name): r.phase for r in table.current().collect()}
    assert got == expected


def test_history_and_events_of_a_stream(spark, tmp_path):
    script = [
        [(0, BASE, 1, "a", "Running"), (1, BASE, 1, "b", "Succeeded")],
        [(2, BASE + dt.timedelta(seconds=30), 1, "a", "Succeeded"), (3, BASE + dt.timedelta(seconds=31), 1, "b", "Running")],
        [(4, BASE + dt.timedelta(seconds=40), 1, "a", "Succeeded"), (5, BASE + dt.timedelta(seconds=41), 1, "b", "Failed")],
    ]
    stream = feed(spark, tmp_path, script)
    status = spark.createDataFrame([(1, "a", "Pending", 70, 80)], "wf_id long, task_name string, phase string, alloc_cpu_m long, alloc_mem_mib long")
    tasks = spark.createDataFrame([(1, 0, "a", "w", "img"), (1, 1, "b", "w", "img"), (1, 2, "a", "w", "later")], "wf_id long, idx int, task_name string, workflow_name string, image string")
    history = str(tmp_path / "history")
    planner.metrics_stream(stream, str(tmp_path / "t1"), history, str(tmp_path / "c1"), lambda: status, lambda: tasks).awaitTermination()
    got = read_history(spark, history, BASE + dt.timedelta(days=1)).collect()
    assert [(r.task_name, r.actual_cpu_m, r.actual_mem_mib, r.duration_s) for r in got] == [("a", 70, 80, 30.0)]
    log = str(tmp_path / "log")
    names = lambda: spark.createDataFrame([(1, "w")], "wf_id long, workflow_name string")
    planner.event_stream(stream, str(tmp_path / "t2"), log, str(tmp_path / "c2"), names).awaitTermination()
    rows = spark.read.parquet(log).orderBy("batch", "message").collect()
    assert [(r.batch, r.type, r.reason, r.message) for r in rows] == [
        (0, "Normal", "TaskStarted", 'Started task "a" with pod "w-a"'),
        (1, "Normal", "TaskStarted", 'Started task "b" with pod "w-b"'),
        (1, "Normal", "TaskSucceeded", 'Task "a" completed successfully'),
        (2, "Warning", "TaskFailed", 'Task "b" failed'),
    ]


def test_plan_stream_plans_changed_workflows_only(spark, tmp_path):
    nodes = [(w, i, f"t{i}", "img", None, None) for w in (1, 2, 3) for i in range(2)]
    frames = dict(
        tasks=spark.createDataFrame(nodes, "wf_id long, idx int, task_name string, image string, hint_cpu_m long, hint_mem_mib long"),
        edges=spark.createDataFrame([], "wf_id long, task_name string, dep string"),
        status=spark.createDataFrame([(w, "t0", "Pending", None, None) for w in (1, 2, 3)],
            "wf_id long, task_name string, phase string, alloc_cpu_m long, alloc_mem_mib long"),
        limits=spark.createDataFrame([(1, 100, 0)], "wf_id long, max_cpu_m long, max_mem_mib long"),
        executions=spark.createDataFrame([], S.EXECUTION),
    )
    tables = planner.PlanTables(**{k: (lambda df=df: df) for k, df in frames.items()})
    stream = feed(spark, tmp_path, [[(0, BASE, 1, "t0", "Pending")], [(1, BASE, 3, "t0", "Pending")]])
    out = str(tmp_path / "plans")
    planner.plan_stream(
        stream, tables, out, str(tmp_path / "cp"), clock=lambda batch: BASE, interval=None
    ).awaitTermination()
    got = sorted((r.batch, r.wf_id, r.task_name) for r in spark.read.parquet(out).collect())
    assert got == [(0, 1, "t0"), (1, 3, "t0"), (1, 3, "t1")]


def test_plan_stream_starts_each_task_once(spark, tmp_path):
    """Two micro-batches name the same workflow; its status has not changed in between."""
    nodes = [(1, i, f"t{i}", "img", 100, 100) for i in range(3)]
    frames = dict(
        tasks=spark.createDataFrame(nodes, "wf_id long, idx int, task_name string, image string, hint_cpu_m long, hint_mem_mib long"),
        edges=spark.createDataFrame([], "wf_id long, task_name string, dep string"),
        status=spark.createDataFrame([(1, "t0", "Pending", None, None)], "wf_id long, task_name string, phase string, alloc_cpu_m long, alloc_mem_mib long"),
        limits=spark.createDataFrame([(1, 200, 0)], "wf_id long, max_cpu_m long, max_mem_mib long"),
        executions=spark.createDataFrame([], S.EXECUTION),
    )
    tables = planner.PlanTables(**{k: (lambda df=df: df) for k, df in frames.items()})
    stream = feed(spark, tmp_path, [[(i, BASE, 1, "t0", "Pending")] for i in range(3)])
    out = str(tmp_path / "plans")
    planner.plan_stream(stream, tables, out, str(tmp_path / "cp"), clock=lambda batch: BASE, interval=None).awaitTermination()
    got = sorted((r.batch, r.task_name) for r in spark.read.parquet(out).collect())
    assert got == [(0, "t0"), (0, "t1")]
