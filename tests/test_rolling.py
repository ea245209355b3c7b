"""State of a long stream: bounded, equal to one batch, and indifferent to batches that are run again."""

import datetime as dt
import os
import random

from brute import fold as brute_fold

from fleetplan import schemas as S
from fleetplan.streaming import phases
from fleetplan.streaming.rolling import RollingPhaseTable

BASE = dt.datetime(2024, 1, 1)
KEEP = dt.timedelta(minutes=4)


def minute(n, rng):
    """Events of one minute: five tasks start, those of the minute before end, and an old end is told again."""
    at = lambda: BASE + dt.timedelta(minutes=n, seconds=rng.randint(0, 59))
    rows = [(n * 100 + i, at(), n, f"t{i}", "Running") for i in range(5)]
    rows += [(n * 100 + 10 + i, at(), n - 1, f"t{i}", rng.choice(["Succeeded", "Failed"])) for i in range(5) if n]
    return rows


def take(spark, path, rows, batch):
    table = RollingPhaseTable(spark, path, keep=KEEP, buckets=4)
    df = spark.createDataFrame(rows, S.POD_EVENT).coalesce(2)
    known = table.current(batch, df.select("wf_id", "task_name").distinct())
    table.write(phases.phase_changes(phases.fold_phases(known, table.on_time(df, known, batch))), batch)
    return table


def size(folder):
    return len([x for _, _, files in os.walk(folder) for x in files if x.endswith(".parquet")])


def test_state_is_bounded_and_equals_one_batch(spark, tmp_path):
    rng = random.Random(7)
    path = str(tmp_path / "phases")
    every, live, folders = [], [], []
    for n in range(24):
        rows = minute(n, rng)
        every += rows
        table = take(spark, path, rows, n)
        if n in (11, 12, 20):  # written, but not acknowledged
            table = take(spark, path, rows, n)
        if n >= 14:
            live.append(table.current().count())
            folders.append((len(os.listdir(path)), len(os.listdir(path + "-base")), len(table.folders())))
    # tasks of the time kept, of the minutes until their bucket is rolled, and of the running minute
    assert max(live) <= 5 * (4 + 4 + 3) < len({r[2:4] for r in every}) / 2
    assert all(a <= 13 and b <= 13 and c <= 8 for a, b, c in folders)
    expected = {}
    for i, ts, wf, task, kind in every:
        expected.setdefault((wf, task), []).append((ts, i, kind))
    got = {(r.wf_id, r.task_name): r.phase for r in table.states().collect()}
    assert got == {k: brute_fold(v) for k, v in expected.items()}


def test_late_events_are_put_aside(spark, tmp_path):
    rng = random.Random(3)
    path = str(tmp_path / "phases")
    for n in range(12):
        table = take(spark, path, minute(n, rng), n)
    before = {(r.wf_id, r.task_name): r.phase for r in table.states().collect()}
    old = [(9000 + i, BASE + dt.timedelta(minutes=1), wf, "t0", "Running") for i, wf in enumerate([0, 777])]
    table = take(spark, path, [*old, *old], 12)
    assert {(r.wf_id, r.task_name): r.phase for r in table.states().collect()} == before
    late = spark.read.parquet(f"{path}-late/batch=12")
    assert sorted(r.wf_id for r in late.collect()) == [0, 0, 777, 777]
    again = [(9100, BASE + dt.timedelta(minutes=12), 0, "t0", "Running")]
    table = take(spark, path, again, 13)
    assert [r.phase for r in table.current().where("wf_id = 0").collect()] == ["Running"]
    assert {(r.wf_id, r.task_name): r.phase for r in table.states().collect()} == before


def test_no_events(spark, tmp_path):
    table = take(spark, str(tmp_path / "phases"), [], 0)
    assert table.states().count() == 0 and table.horizon(1) is None
