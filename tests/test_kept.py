"""Kept state of planning, cells and counters: equal to what is worked out anew, after every batch."""

import datetime as dt
import os
import random

import pytest
from brute import fold as brute_fold
from pyspark.sql import functions as F

from fleetplan import schemas as S
from fleetplan.operators.history import image_history
from fleetplan.operators.status import ready_tasks
from fleetplan.sources.history import append_history
from fleetplan.streaming.cells import CellTable
from fleetplan.streaming.wakeups import WakeTable, counters

BASE = dt.datetime(2024, 3, 1)
EXECUTION = "workflow_name string, task_name string, image string, actual_cpu_m long, actual_mem_mib long, duration_s double, succeeded boolean, completed_at timestamp"


def rounded(df):
    six = lambda x: None if x is None else round(x, 6)
    return sorted((r.image or "", six(r.hist_cpu_m), six(r.hist_mem_mib), six(r.hist_duration_s), r.n_samples) for r in df.collect())


def runs(rng, day, n=40):
    """Runs of one day: a hot image, null measures, failures, full hours, and runs told late."""
    rows = []
    for i in range(n):
        image = rng.choice(["hot", "hot", "hot", f"i{rng.randint(0, 5)}", None])
        at = BASE + dt.timedelta(days=day - rng.choice([0, 0, 0, 2]), hours=rng.randint(0, 23), minutes=rng.choice([0, 0, 31]))
        gone = lambda x: None if rng.random() < 0.1 else x
        rows.append(("w", f"t{i}", image, gone(rng.randint(1, 900)), gone(rng.randint(1, 900)), gone(rng.random() * 100), rng.random() < 0.8, at))
    return rows + [("w", "none", "hot", 1, 1, 1.0, True, None)]


def test_cells_equal_history_at_every_batch(spark, tmp_path):
    rng = random.Random(1)
    path, store = str(tmp_path / "cells"), str(tmp_path / "history")
    table, every, sizes = CellTable(spark, path, keep_days=3, buckets=3), [], []
    for batch in range(9):
        part = runs(rng, batch)
        every += part
        df = spark.createDataFrame(part, EXECUTION).coalesce(2)
        clock = BASE + dt.timedelta(days=batch, hours=rng.choice([0, 7, 23]), minutes=rng.choice([0, 30]))
        for _ in range(2 if batch in (4, 5) else 1):  # written, but not acknowledged
            append_history(df.where("completed_at is not null"), store, f"b-{batch}")
            table.write(df, batch, clock)
        history = spark.createDataFrame(every, EXECUTION)
        kept = table.history(spark.read.parquet(store), clock)
        assert rounded(kept) == rounded(image_history(history, clock, 3))
        assert rounded(table.history(history, clock, days=1)) == rounded(image_history(history, clock, 1))
        if batch >= 7:
            sizes.append((len(os.listdir(path)), len(os.listdir(path + "-base")), table.log().count()))
    # images x hours of the window and of the batches until an image is rolled
    assert all(a <= 10 and b <= 10 and rows <= 7 * 24 * (3 + 3 + 2) for a, b, rows in sizes)
    with pytest.raises(ValueError):
        table.history(history, clock, days=4)


def test_cells_of_nothing(spark, tmp_path):
    table = CellTable(spark, str(tmp_path / "cells"))
    empty = spark.createDataFrame([], EXECUTION)
    assert table.history(empty, BASE).count() == 0
    table.write(empty, 0, BASE)
    assert table.history(empty, BASE).count() == 0


NODES = "wf_id long, task_name string"
EDGES = "wf_id long, task_name string, dep string"
STATUS = "wf_id long, task_name string, phase string"


def workflows(rng, ids, n=8):
    """Tasks, edges (some repeated, null or of unknown names) and statuses of workflows."""
    tasks = [(w, f"t{i}") for w in ids for i in range(n)] + [(w, "t1") for w in ids] + [(w, None) for w in ids]
    edges = [(w, f"t{i}", f"t{rng.randrange(i)}") for w in ids for i in range(1, n) for _ in range(rng.randint(0, 3))]
    edges += [(w, "t7", "outside") for w in ids if w % 4 == 0] + [(w, "t6", None) for w in ids if w % 5 == 0]
    status = [(w, f"t{i}", rng.choice(["Pending", "Pending", "Running", "Succeeded", "Failed", None])) for w in ids for i in range(0, n, 3)]
    status += [(ids[0], "t0", "Succeeded")]
    return tasks, edges, status


def frames(spark, data):
    return [spark.createDataFrame(rows, kind).coalesce(2) for rows, kind in zip(data, (NODES, EDGES, STATUS))]


def stored(status):
    """One phase for each name: the furthest."""
    rank = {None: 0, "Pending": 0, "Running": 1, "Failed": 2, "Succeeded": 3}
    found = {}
    for w, t, p in status:
        if rank[p] >= rank[found.get((w, t))]:
            found[w, t] = p or "Pending"
    return found


def ready_now(tasks, edges, phases):
    blocked = {(w, t) for w, t, d in edges if phases.get((w, d)) != "Succeeded"}
    return {k for k in tasks if k[1] is not None and phases.get(k, "Pending") == "Pending" and k not in blocked}


def test_counters_follow_every_batch(spark, tmp_path):
    rng = random.Random(5)
    first, later = workflows(rng, [1, 2, 3, 4, 5]), workflows(rng, [8, 10])
    table = WakeTable(spark, str(tmp_path / "counters"), buckets=3)
    table.load(*frames(spark, first))
    tasks, edges, status = (list(x) for x in first)
    phases, number, old, ready, rows = stored(status), 0, [], ready_now(tasks, edges, stored(status)), []
    assert {tuple(r) for r in table.ready().collect()} == ready
    for batch in range(12):
        fresh = None
        if batch == 6:
            fresh = counters(*frames(spark, later))
            tasks, edges, status = tasks + later[0], edges + later[1], status + later[2]
            phases |= stored(later[2])
        names = sorted({k for k in tasks if k[1]} | {(4, "outside"), (8, "outside"), (77, "unknown")})
        events = []
        for key in rng.sample(names, 9) + sorted(ready)[:2] * 2:
            for kind in rng.choice([["Running"], ["Running", "Succeeded"], ["Running", "Succeeded", "Failed"], ["Failed"], ["Running", "Succeeded", "Succeeded"]]):
                number += 1
                events.append((number, BASE + dt.timedelta(minutes=batch, seconds=number % 60), *key, kind))
        told = events + rng.sample(old, min(len(old), 6))  # and some are told again
        old += events
        df = spark.createDataFrame(told, S.POD_EVENT).coalesce(2)
        for _ in range(2 if batch in (6, 9) else 1):
            table.take(df, batch, fresh)
        seen = {}
        for i, ts, w, t, kind in told:
            seen.setdefault((w, t), []).append((ts, i, kind))
        known = {k for k in names if k[1] != "unknown" and k[0] in {w for w, _ in tasks}}  # nothing waits for others
        phases |= {k: brute_fold(v, phases.get(k, "Pending")) for k, v in seen.items() if k in known}
        before, ready = ready, ready_now(tasks, edges, phases)
        assert {tuple(r) for r in table.ready().collect()} == ready
        if fresh is None:
            assert {tuple(r) for r in table.woken(batch).collect()} == ready - before
        rows.append(table.current().where("phase not in ('Succeeded', 'Failed')").count())
    # the same from the operator that works on whole workflows
    now = spark.createDataFrame([(*k, p) for k, p in phases.items()], STATUS)
    whole = ready_tasks(*frames(spark, (tasks, edges, []))[:2], now).where("task_name is not null").distinct()
    assert {tuple(r) for r in whole.collect()} == ready
    assert rows[-1] == len([k for k in {k for k in tasks if k[1]} | {(w, d) for w, _, d in edges if d} if phases.get(k, "Pending") in ("Pending", "Running")])
    assert len(os.listdir(str(tmp_path / "counters"))) <= 10


def test_counters_of_nothing(spark, tmp_path):
    table = WakeTable(spark, str(tmp_path / "counters"), buckets=2)
    table.load(*frames(spark, ([], [], [])))
    table.take(spark.createDataFrame([(1, BASE, 1, "a", "Running")], S.POD_EVENT), 0)
    assert table.ready().count() == 0 and table.woken(0).count() == 0


def test_text_ids_and_a_wide_task(spark, tmp_path):
    """One task on which very many depend."""
    n = 3000
    tasks = spark.range(n).select(F.lit("ns/w").alias("wf_id"), F.concat(F.lit("t"), "id").alias("task_name"))
    edges = tasks.where("task_name <> 't0'").withColumn("dep", F.lit("t0"))
    table = WakeTable(spark, str(tmp_path / "counters"), "string", buckets=2)
    table.load(tasks, edges, spark.createDataFrame([], STATUS.replace("long", "string")))
    assert [r.task_name for r in table.ready().collect()] == ["t0"]
    kinds = [(i, BASE, "ns/w", "t0", k) for i, k in enumerate(["Running", "Succeeded"])]
    table.take(spark.createDataFrame(kinds, "event_id long, ts timestamp, wf_id string, task_name string, pod_phase string"), 0)
    assert table.woken(0).count() == n - 1 == table.ready().count()
