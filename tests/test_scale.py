"""What a task does, and how often rows are read, as inputs grow."""

import pytest

from fleetplan import session
from fleetplan.operators import graph, model
from fleetplan.registry.fleet import fleet
from fleetplan.registry.queries import QUERIES
from fleetplan.streaming import wakeups

INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def initial(spark):
    yield
    spark.conf.unset(INITIAL)


def test_shuffles_begin_with_as_many_partitions_as_the_input_asks_for(spark, tmp_path, initial, monkeypatch):
    paths = [str(tmp_path / name) for name in ("a", "b")]
    for path in paths:
        spark.range(5000).coalesce(1).write.parquet(path)
    session.fit_shuffles(spark, [*paths, str(tmp_path / "absent")])
    assert session.shuffle_partitions(spark) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(session, "PARTITION_BYTES", 1000)
    session.fit_shuffles(spark, paths[:1])
    one = session.shuffle_partitions(spark)
    session.fit_shuffles(spark, paths)
    both = session.shuffle_partitions(spark)
    assert 4 < one < both
    session.fit_shuffles(spark, paths[:1])
    assert session.shuffle_partitions(spark) == both


def test_fleet_fits_shuffles_to_its_tables(spark, sf_dir, initial, monkeypatch):
    monkeypatch.setattr(session, "PARTITION_BYTES", 10_000)
    fleet(spark, sf_dir)
    assert session.shuffle_partitions(spark) > 4


def test_pod_specs_parse_the_sizes_of_a_task_once(spark, sf_dir):
    assert "regexp_extract" not in plan_of(QUERIES["pod_spec"](spark, sf_dir))


def test_lint_looks_for_known_tasks_before_edges_are_made_distinct(spark):
    tasks = spark.createDataFrame([(1, 0, "a", 1.0), (1, 1, "b", 1.0)], "wf_id long, idx int, task_name string, duration double")
    edges = spark.createDataFrame([(1, "b", "gone"), (1, "b", "gone"), (1, "b", "a"), (1, None, None)], "wf_id long, task_name string, dep string")
    found = graph.dag_lint(tasks, edges)
    lines = plan_of(found).splitlines()
    distinct = next(i for i, line in enumerate(lines) if "Aggregate" in line)
    assert any("LeftAnti" in line for line in lines[distinct + 1 : distinct + 4])
    rows = sorted((r.task_name or "", r.issue, r.detail) for r in found.where("issue = 'dangling'").collect())
    assert rows == [("", "dangling", None), ("b", "dangling", "gone")]


def test_events_shuffle_only_the_tasks_that_may_be_refused(spark, sf_dir):
    assert plan_of(QUERIES["event_log"](spark, sf_dir)).count("LeftSemi") > plan_of(QUERIES["apply_plan"](spark, sf_dir)).count("LeftSemi")


def test_counters_shuffle_edges_once_for_both_uses(spark):
    tasks = spark.createDataFrame([(1, n) for n in "abcd"], "wf_id long, task_name string")
    edges = [(1, "b", "a"), (1, "b", "a"), (1, "c", "a"), (1, "c", None), (1, "c", None), (1, "d", "x"), (1, None, "a")]
    edges = spark.createDataFrame(edges, "wf_id long, task_name string, dep string")
    status = spark.createDataFrame([(1, "d", "Running")], "wf_id long, task_name string, phase string")
    found = wakeups.counters(tasks, edges, status)
    got = {r.task_name: (r.phase, r.unmet, sorted(r.dependents or [])) for r in found.collect()}
    assert got == {
        "a": ("Pending", 0, ["b", "c"]), "b": ("Pending", 1, []), "c": ("Pending", 2, []), "d": ("Running", 1, []), "x": ("Pending", None, ["d"]),
    }
    # the distinct arcs had an exchange of their own, by all three columns
    assert "Aggregate [wf_id, task_name, dep]" not in "".join(c for c in plan_of(found) if c not in "#L0123456789")


def test_all_targets_are_judged_in_one_pass(spark):
    rows = [(f"img{i % 3}", i / 10, float(i), 1.0, 2.0, float(i), 2.0 * i, 5.0) for i in range(40)]
    df = spark.createDataFrame(rows, "image string, image_hash double, hist_cpu_m double, hist_mem_mib double, hist_duration_s double, actual_cpu_m double, actual_mem_mib double, duration_s double")
    forest = model.train_forest(df, trees=3, depth=4)
    scored = forest.transform(df)
    spark.sparkContext.setJobGroup("r2", "r2")
    got = {r.target: r.r2 for r in model.evaluate_r2(forest, df).collect()}
    spark.sparkContext.setJobGroup("", "")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("r2")) <= 3
    actual = [(r.actual_cpu_m, r.p_actual_cpu_m) for r in scored.collect()]
    mean = sum(a for a, _ in actual) / len(actual)
    assert got["actual_cpu_m"] == pytest.approx(1 - sum((a - p) ** 2 for a, p in actual) / sum((a - mean) ** 2 for a, _ in actual))
    with pytest.raises(ValueError):
        model.evaluate_r2(forest, df.limit(0))
