import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from fleetplan import schemas as S
from fleetplan.operators.history import (
    enrich_with_history,
    executions_of,
    image_history,
    recent_executions,
    rolling_image_history,
)
from fleetplan.sources import history as source

AS_OF = dt.datetime(2024, 3, 1)


def execution(image, at, cpu=100, mem=10, duration=1.0, ok=True, wf="w", task="t"):
    return (wf, task, image, cpu, mem, duration, ok, at)


def test_window_edges(spark):
    rows = [
        execution("a", AS_OF - dt.timedelta(days=30), 1000),  # exactly 30 days old: out
        execution("a", AS_OF - dt.timedelta(days=30) + dt.timedelta(microseconds=1), 10),
        execution("a", AS_OF, 30),
        execution("a", AS_OF + dt.timedelta(microseconds=1), 1000),  # later: out
        execution("a", AS_OF, 1000, ok=False),
        execution("b", AS_OF, 5, ok=False),
    ]
    got = image_history(spark.createDataFrame(rows, S.EXECUTION), AS_OF).collect()
    assert [(r.image, r.hist_cpu_m, r.n_samples) for r in got] == [("a", 20.0, 2)]


def test_enrich_gives_zeros(spark):
    tasks = spark.createDataFrame([("x",)], "image string")
    none = image_history(spark.createDataFrame([], S.EXECUTION), AS_OF)
    assert tuple(enrich_with_history(tasks, none).first()) == ("x", 0.0, 0.0, 0.0, 0)


@pytest.mark.parametrize("days, bucket_us", [(30, 3_600_000_000), (2, 3_600_000_000), (1, 86_400_000_000)])
def test_rolling_against_brute_force(spark, days, bucket_us):
    rng = random.Random(days)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for _ in range(400):
        # Many instants on the edges of the window and of the buckets.
        step = rng.choice([dt.timedelta(hours=rng.randint(0, 100)), dt.timedelta(days=rng.randint(0, 70)),
                           dt.timedelta(microseconds=rng.randint(0, 10**13))])
        rows.append(execution(rng.choice("ab"), base + step, rng.randint(1, 999), rng.randint(1, 99),
                              rng.random() * 100, rng.random() < 0.8))
    df = spark.createDataFrame(rows, S.EXECUTION).repartition(6)
    got = {(r.image, r.completed_at): r for r in rolling_image_history(df, days, bucket_us).collect()}
    assert set(got) == {(r[2], r[7]) for r in rows}
    for (image, at), r in got.items():
        past = [e for e in rows if e[2] == image and e[6] and at - dt.timedelta(days=days) < e[7] < at]
        assert r.n_samples == len(past)
        for i, value in [(3, r.hist_cpu_m), (4, r.hist_mem_mib), (5, r.hist_duration_s)]:
            assert value == pytest.approx(sum(e[i] for e in past) / len(past) if past else 0.0)


def test_record_then_read(spark, tmp_path):
    metric = lambda task, at, ok: (task, "img", 10, 20, 1.5, ok, at)
    reports = spark.createDataFrame(
        [
            ("w1", [metric("a", "2024-02-20T10:00:00Z", True), metric("b", "", None), metric("c", None, False)]),
            ("w2", [metric("a", "2024-01-01T00:00:00Z", True)]),
            ("w3", []),
        ],
        S.REPORT,
    )
    rows, rejects = source.record_executions(reports, AS_OF)
    assert rejects.isEmpty()
    got = {(r.workflow_name, r.task_name): (r.succeeded, r.completed_at) for r in rows.collect()}
    assert got == {
        ("w1", "a"): (True, dt.datetime(2024, 2, 20, 10)),
        ("w1", "b"): (True, AS_OF),
        ("w1", "c"): (False, AS_OF),
        ("w2", "a"): (True, dt.datetime(2024, 1, 1)),
    }
    path = str(tmp_path / "history")
    source.append_history(rows, path)
    source.append_history(rows, path)  # append only, nothing is merged
    kept = source.read_history(spark, path, AS_OF)
    assert sorted((r.workflow_name, r.task_name) for r in kept.collect()) == [("w1", "a")] * 2 + [("w1", "b")] * 2
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "completed_date" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    for _ in range(2):  # a named batch is stored once
        source.append_history(rows.where("task_name = 'b'"), path, batch="retry-7")
    assert source.read_history(spark, path, AS_OF).where("task_name = 'b'").count() == 3
    assert source.read_history(spark, path, AS_OF, image="other").count() == 0
    assert source.read_history(spark, path, "2030-01-01").count() == 0
    with pytest.raises(FileNotFoundError):
        source.read_history(spark, path + "-elsewhere", AS_OF)


def test_a_clock_with_an_offset_is_the_same_instant(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = spark.createDataFrame([("w", "a", "i", 1, 1, 1.0, True, dt.datetime(2024, 5, 31, 19, 0))], S.EXECUTION)
    source.append_history(rows, path)
    for clock in ("2024-06-01T00:30:00+05:00", "2024-05-31 19:30:00", dt.datetime.fromisoformat("2024-05-31T14:30:00-05:00")):
        assert source.read_history(spark, path, clock, days=1).count() == 1


def test_a_report_with_a_malformed_time_is_refused(spark):
    metric = lambda task, at: (task, "i", 1, 1, 1.0, None, at)
    reports = spark.createDataFrame([("good", [metric("a", ""), metric("b", "2024-01-01T00:00:00Z")]), ("bad", [metric("a", None), metric("b", "soon")])], S.REPORT)
    rows, rejects = source.record_executions(reports, AS_OF)
    assert sorted((r.workflow_name, r.task_name) for r in rows.collect()) == [("good", "a"), ("good", "b")]
    assert [(r.workflow_name, r.reason) for r in rejects.collect()] == [("bad", 'malformed completed_at "soon"')]


def test_discard(spark):
    source.discard_metrics(spark.range(3))


def test_time_slices_cover_the_window():
    parts = source.time_slices(AS_OF, 30, 4)
    assert len(parts) == 4 and "2024-01-31 00:00:00" in parts[0] and "2024-03-01 00:00:00" in parts[-1]


def test_recent_is_newest_first(spark):
    rows = [execution("a", AS_OF - dt.timedelta(days=d), wf=f"w{d}") for d in (3, 1, 2)]
    df = spark.createDataFrame(rows, S.EXECUTION)
    assert [r.workflow_name for r in recent_executions(df).collect()] == ["w1", "w2", "w3"]
    top = recent_executions(df, 2)
    assert [r.workflow_name for r in top.collect()] == ["w1", "w2"]
    assert "TakeOrdered" in top._jdf.queryExecution().executedPlan().toString()


def rows_read(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


def test_lookups_skip_the_files_of_other_keys(spark, tmp_path):
    """Each batch has every range of names, so that only the filters in the files tell where a key is."""
    path = str(tmp_path / "history")
    at = dt.datetime(2024, 1, 1)
    for part in range(6):
        rows = [(f"wf-{i:05d}", "t0", f"img-{i:05d}", 1, 1, 1.0, True, at) for i in range(part, 6000, 6)]
        source.append_history(spark.createDataFrame(rows, S.EXECUTION).coalesce(1), path, f"b{part}")
    files = [os.path.join(d, x) for d, _, names in os.walk(path) for x in names if x.endswith(".parquet")]
    assert all(os.path.getsize(x) < 200_000 for x in files)
    spark.conf.set("parquet.filter.dictionary.enabled", "false")
    try:
        stored = spark.read.parquet(path)
        read = rows_read(executions_of(stored, "wf-03333", "t0"))
        image = rows_read(stored.where(F.col("image") == "img-00017"))
        spark.conf.set("parquet.filter.bloom.enabled", "false")
        without = rows_read(executions_of(spark.read.parquet(path), "wf-03333", "t0"))
    finally:
        spark.conf.unset("parquet.filter.bloom.enabled")
        spark.conf.unset("parquet.filter.dictionary.enabled")
    # one of 24 files; by the ranges of names alone it would be six
    assert read <= 300 and image <= 300 and without >= 1200
    assert executions_of(stored, "wf-03333", "t0").count() == 1
