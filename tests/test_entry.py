"""The driver contract, the session helpers, and both routes on the fleet."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from fleetplan.operators import graph, profile
from fleetplan.plans.cycle import plan_cycle
from fleetplan.registry.fleet import AS_OF, fleet
from fleetplan.registry.queries import _run_intervals, _timed
from fleetplan.session import clear_staged, large_groups, shared_dir, spread, stage


def test_contract(spark):
    df = contract.entry(spark)
    assert df.columns[0] == "wf_id" and df.count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert all(callable(q) for q in contract.queries().values())


def same(left, right):
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def test_routes_for_large_workflows_agree(spark, sf_dir):
    """Every workflow of more than a few tasks sent down the distributed route."""
    f = fleet(spark, sf_dir)
    plan = lambda **o: plan_cycle(f.tasks, f.edges, f.status, f.limits, f.executions, AS_OF, **o)
    assert same(plan(), plan(max_fold=3))
    assert same(graph.earliest_start(_timed(f), f.edges), graph.earliest_start(_timed(f), f.edges, max_fold=4))
    assert same(graph.stuck_tasks(f.tasks, f.edges), graph.stuck_tasks(f.tasks, f.edges, max_fold=4))
    runs = _run_intervals(f)
    assert same(profile.usage_profile(runs, 1500), profile.usage_profile(runs, 1500, max_group=3))


def fake_session(master, setting=None):
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: setting or default)

        class sparkContext:
            applicationId = "app-fake"

    Session.sparkContext.master = master
    return Session


def test_shared_dir(spark):
    with pytest.raises(RuntimeError):
        shared_dir(fake_session("spark://host:7077"))
    assert shared_dir(fake_session("spark://host:7077", "hdfs://shared/cp/")) == "hdfs://shared/cp"
    local = shared_dir(fake_session("local[2]"))
    assert os.path.isdir(local) and shared_dir(fake_session("local[2]")) == local


def test_stage_and_spread(spark):
    df = spark.range(100).withColumn("k", F.when(F.col("id") < 60, 0).otherwise(F.col("id")))
    staged = stage(df, "unit")
    assert same(staged, df)
    assert spread(staged.coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert [tuple(r) for r in large_groups(staged, "k", 50).collect()] == [(0, 60)]
    assert large_groups(staged, "k", 60) is None
    folder = f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}"
    assert os.path.isdir(folder)


def test_clear_staged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("fleetplan.session.shared_dir", lambda spark: str(tmp_path))
    stage(spark.range(3), "gone")
    assert os.listdir(tmp_path / "staged")
    clear_staged(spark)
    assert not os.listdir(tmp_path / "staged")
