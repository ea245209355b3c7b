import pytest
from pyspark.sql import functions as F

from fleetplan.operators.predict import predict_baseline, predict_resources, resolve_resources

ROW = "wf_id long, task_name string, image string, hint_cpu_m long, hint_mem_mib long, hist_cpu_m double, hist_mem_mib double, hist_duration_s double, n_samples long"


@pytest.mark.parametrize(
    "hint, hist, expected",
    [
        ((None, None), (333.3, 100.0, 10.0, 2), (399, 120, 11.0, 0.38, "history")),
        ((900, 900), (100.0, 100.0, 10.0, 30), (120, 120, 11.0, 0.7, "history")),
        ((300, 64), (0.0, 0.0, 0.0, 0), (300, 64, 30.0, 0.3, "hint")),
        ((300, None), (0.0, 0.0, 0.0, 0), (300, 128, 30.0, 0.3, "hint")),
        ((0, 64), (0.0, 0.0, 0.0, 0), (100, 64, 30.0, 0.3, "hint")),
        ((0, 0), (0.0, 0.0, 0.0, 0), (100, 128, 30.0, 0.1, "default")),
        ((None, None), (0.0, 0.0, 0.0, 0), (100, 128, 30.0, 0.1, "default")),
    ],
)
def test_chain(spark, hint, hist, expected):
    df = spark.createDataFrame([(1, "t", "i", *hint, *hist)], ROW)
    r = predict_resources(df).first()
    assert (r.cpu_m, r.mem_mib, r.method) == (expected[0], expected[1], expected[4])
    assert r.duration_s == pytest.approx(expected[2]) and r.confidence == pytest.approx(expected[3])


def test_min_samples(spark):
    df = spark.createDataFrame([(1, "t", "i", 300, 64, 100.0, 100.0, 10.0, 9)], ROW)
    assert predict_resources(df, min_samples=10).first().method == "hint"
    assert predict_resources(df).first().method == "history"


def test_baseline_omits_tasks_without_hint(spark):
    schema = "wf_id long, task_name string, hint_cpu_m long, hint_mem_mib long, hint_cpu_limit_m long, hint_mem_limit_mib long"
    rows = [(1, "a", 10, None, None, None), (1, "b", None, None, None, 64), (1, "c", None, None, None, None)]
    got = {r.task_name: r for r in predict_baseline(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"].duration_s == 0.0 and got["b"].mem_limit_mib == 64


def test_a_repeated_name_has_one_prediction(spark):
    schema = "wf_id long, idx int, task_name string, hint_cpu_m long, hint_mem_mib long"
    tasks = spark.createDataFrame([(1, 0, "a", 10, 1), (1, 1, "a", 20, 2), (1, 2, "b", 30, 3)], schema)
    rows = resolve_resources(tasks, predict_baseline(tasks), "local").collect()
    assert sorted((r.idx, r.cpu_request_m) for r in rows) == [(0, 20), (1, 20), (2, 30)]


def test_resolution_priority(spark):
    tasks = spark.createDataFrame(
        [(1, 0, "p", 7, 7), (1, 1, "h", 11, 13), (1, 2, "d", None, None)],
        "wf_id long, idx int, task_name string, hint_cpu_m long, hint_mem_mib long",
    )
    predictions = spark.createDataFrame(
        [(1, "p", 101, 33, 5, 6)],
        "wf_id long, task_name string, cpu_m long, mem_mib long, cpu_limit_m long, mem_limit_mib long",
    )
    sizes = ["cpu_request_m", "mem_request_mib", "cpu_limit_m", "mem_limit_mib"]
    get = lambda d: {
        r.task_name: tuple(r[c] for c in sizes) for r in resolve_resources(tasks, predictions, d).collect()
    }
    assert get("remote") == {"p": (101, 33, 151, 49), "h": (11, 13, 22, 26), "d": (100, 128, 200, 256)}
    assert get("local") == {"p": (101, 33, 5, 6), "h": (11, 13, None, None), "d": (100, 128, 200, 256)}
    with pytest.raises(ValueError):
        get("other")
