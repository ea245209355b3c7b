import random

import pytest

from fleetplan.operators.profile import stack_by_start, stack_crashes, usage_peaks, usage_profile

INTERVALS = "wf_id long, start long, end long, size long"


def brute(rows, wf):
    mine = [r for r in rows if r[0] == wf and r[2] > r[1]]
    times = sorted({t for r in mine for t in r[1:3]})
    use = lambda t: sum(r[3] for r in mine if r[1] <= t < r[2])
    return [(t, n, use(t)) for t, n in zip(times, times[1:] + [None])]


@pytest.mark.parametrize("max_group", [1_000_000, 10])
def test_profile(spark, max_group):
    rng = random.Random(7)
    rows = [(1, 0, 10, 5), (1, 10, 20, 7), (1, 5, 12, 1), (1, 3, 3, 100)]
    for w, n in [(2, 60), (3, 4), (4, 45)]:
        for _ in range(n):
            start = rng.choice([rng.randint(0, 1000), rng.randint(0, 20)])
            rows.append((w, start, start + rng.randint(0, 300), rng.randint(1, 50)))
    df = spark.createDataFrame(rows, INTERVALS).repartition(5)
    profile = usage_profile(df, limit=200, max_group=max_group)
    got = {}
    for r in profile.collect():
        got.setdefault(r.wf_id, []).append((r.at, r.until, r.in_use))
        assert r.over_limit == (r.in_use > 200)
    for w in (1, 2, 3, 4):
        assert sorted(got[w]) == brute(rows, w)
    for r in usage_peaks(profile).collect():
        steps = brute(rows, r.wf_id)
        assert r.peak == max(s[2] for s in steps)
        assert r.time_over_limit == sum(u - t for t, u, x in steps if x > 200)


def test_limit_per_workflow(spark):
    df = spark.createDataFrame([(1, 0, 4, 5, 4), (2, 0, 4, 5, None)], INTERVALS + ", limit long")
    got = {r.wf_id: r.time_over_limit for r in usage_peaks(usage_profile(df)).collect()}
    assert got == {1: 4, 2: 0}


@pytest.mark.parametrize("max_fold", [4096, 3])
def test_stack(spark, max_fold):
    rows = [(1, i, i // 4, 65) for i in range(10)] + [(2, 0, 0, 10)]
    df = spark.createDataFrame(rows, "wf_id long, idx int, start long, size long").repartition(4)
    stacked = stack_by_start(df, limit=150, max_fold=max_fold)
    got = {(r.wf_id, r.idx): (r.bottom, r.crashed) for r in stacked.collect()}
    for w, i, _, _ in rows:
        below = 65 * (i % 4)
        assert got[w, i] == ((below, below + 65 > 150) if w == 1 else (0, False))
    assert {r.wf_id: r.is_crasher for r in stack_crashes(stacked).collect()} == {1: True, 2: False}


@pytest.mark.parametrize("seed", range(2))
def test_doubles_are_the_same_in_pieces_of_any_size(spark, seed):
    """All instants of the large workflow lie in one hour of a long time."""
    rng = random.Random(seed)
    rows = [(1, 0, 10**9, 0.1)] + [(1, (s := rng.randint(5000, 8600)), s + rng.randint(1, 400), rng.choice([0.1, 0.2, 0.3, 0.7])) for _ in range(400)]
    rows += [(2, 0, 5, float("nan")), (2, 1, 4, 0.4), (3, 1, 2, None)]
    df = spark.createDataFrame(rows, "wf_id long, start long, end long, size double").repartition(3)
    seen = [sorted(map(tuple, usage_profile(df, limit=0.4, max_group=n).collect()), key=repr) for n in (10**6, 100, 7)]
    assert seen[0] == seen[1] == seen[2]
    assert (2, 1, 4, 0.4, False) in seen[0]
    hundredths = lambda x: round(x * 10)
    for w, at, until, use, _ in seen[0]:
        if w == 1:
            assert hundredths(use) == sum(hundredths(r[3]) for r in rows if r[0] == 1 and r[1] <= at < r[2])


def test_pieces_hold_so_many_instants(spark, monkeypatch):
    from fleetplan.operators import profile

    kept = []
    real = profile.stage
    monkeypatch.setattr(profile, "stage", lambda df, label: kept.append((label, real(df, label))) or kept[-1][1])
    rows = [(1, 0, 10**12, 1)] + [(1, 10**6 + i, 10**6 + i + 50, 1) for i in range(500)]
    profile.usage_profile(spark.createDataFrame(rows, INTERVALS), max_group=50).count()
    pieces = dict(kept)["pieces"].groupBy("__cell").count().collect()
    assert len(pieces) == 12 and max(r["count"] for r in pieces) <= 50


def test_stacks_of_doubles_and_repeats_are_the_same_on_both_routes(spark):
    rng = random.Random(4)
    rows = [(1, rng.randint(0, 30), rng.randint(0, 2), rng.choice([0.1, 0.2, 0.3])) for _ in range(90)]
    df = spark.createDataFrame(rows, "wf_id long, idx int, start long, size double").repartition(4)
    seen = [sorted(map(tuple, stack_by_start(df, limit=2.6, max_fold=n).collect())) for n in (4096, 7)]
    assert seen[0] == seen[1]


def test_rows_of_a_task_do_not_grow_with_the_input(spark, monkeypatch):
    from fleetplan.operators import profile

    monkeypatch.setattr(profile, "TASK_INTERVALS", 50, raising=False)
    rows = [(w, s, s + 5, 1) for w in range(200) for s in range(10)]
    steps = profile.usage_profile(spark.createDataFrame(rows, INTERVALS))
    assert steps.rdd.getNumPartitions() == 41
    assert steps.groupBy().max("in_use").first()[0] == 5
