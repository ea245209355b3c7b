import random

import pytest
from brute import longest
from brute import stuck as brute_stuck

from fleetplan.operators import maxplus
from fleetplan.operators.graph import dag_lint, earliest_start, stuck_tasks

NODES = "wf_id long, idx int, task_name string, duration double"
EDGES = "wf_id long, task_name string, dep string"


def frames(spark, workflows):
    """workflows: wf_id -> list of (name, duration, deps) in spec order."""
    nodes = [(w, i, n, d) for w, ts in workflows.items() for i, (n, d, _) in enumerate(ts)]
    edges = [(w, n, dep) for w, ts in workflows.items() for n, _, deps in ts for dep in deps]
    return spark.createDataFrame(nodes, NODES).repartition(4), spark.createDataFrame(edges, EDGES).repartition(4)


CASES = {
    1: [("a", 2.0, []), ("b", 3.0, ["a"]), ("c", 1.0, ["a"]), ("d", 1.0, ["b", "c"])],
    2: [("a", 1.0, ["b"]), ("b", 1.0, ["a"]), ("c", 1.0, ["b"]), ("d", 5.0, [])],
    3: [("a", 1.0, ["nowhere"]), ("b", 1.0, ["a"]), ("c", 1.0, [])],
    4: [("late", 1.0, ["early"]), ("early", 4.0, [])],
    5: [("self", 1.0, ["self"])],
}


@pytest.mark.parametrize("max_fold", [4096, 2])
def test_times_and_stuck(spark, max_fold):
    nodes, edges = frames(spark, CASES)
    got = {(r.wf_id, r.task_name): r.start for r in earliest_start(nodes, edges, max_fold=max_fold).collect()}
    stuck = {(r.wf_id, r.task_name) for r in stuck_tasks(nodes, edges, max_fold=max_fold).collect()}
    for w, ts in CASES.items():
        deps = {n: d for n, _, d in ts}
        assert {n: got[w, n] for n, _, _ in ts} == longest({n: d for n, d, _ in ts}, deps)
        assert {n for v, n in stuck if v == w} == brute_stuck([n for n, _, _ in ts], deps)


@pytest.mark.parametrize("max_fold", [4096, 2])
def test_spec_order_ignores_later_dependencies(spark, max_fold):
    nodes, edges = frames(spark, CASES)
    rows = earliest_start(nodes, edges, order="spec", max_fold=max_fold).collect()
    got = {(r.wf_id, r.task_name): (r.start, r.end) for r in rows}
    assert len(rows) == sum(map(len, CASES.values()))
    assert got[1, "d"] == (5.0, 6.0)
    assert got[2, "a"] == (0.0, 1.0) and got[2, "b"] == (1.0, 2.0) and got[2, "c"] == (2.0, 3.0)
    assert got[4, "late"] == (0.0, 1.0) and got[5, "self"] == (0.0, 1.0)


@pytest.mark.parametrize("order", ["spec", "any"])
def test_gaps_and_unknown_durations_agree_on_both_routes(spark, order):
    nodes = [(1, 10, "a", 2.0), (1, 20, "b", 1.0), (1, 35, "c", None), (1, 40, "d", 1.5), (2, 0, "x", None), (2, 1, "y", 4.0)]
    edges = [(1, "b", "a"), (1, "c", "b"), (1, "d", "c"), (2, "y", "x")]
    frames = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)
    for max_fold in (4096, 5, 1):
        got = {(r.wf_id, r.task_name): (r.start, r.end) for r in earliest_start(*frames, order=order, max_fold=max_fold).collect()}
        assert got == {
            (1, "a"): (0.0, 2.0), (1, "b"): (2.0, 3.0), (1, "c"): (3.0, 3.0), (1, "d"): (3.0, 4.5), (2, "x"): (0.0, 0.0), (2, "y"): (0.0, 4.0),
        }


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    workflows = {}
    for w in range(15):
        n = rng.randint(1, 14)
        names = [f"t{i}" for i in range(n)]
        forward = rng.random() < 0.6
        workflows[w] = [
            (names[i], float(rng.randint(1, 9)),
             rng.sample(names[:i] if forward else names, min(i, rng.randint(0, 2))))
            for i in range(n)
        ]
    nodes, edges = frames(spark, workflows)
    for max_fold in (4096, 6):
        got = {(r.wf_id, r.task_name): (r.start, r.end) for r in earliest_start(nodes, edges, max_fold=max_fold).collect()}
        for w, ts in workflows.items():
            expected = longest({n: d for n, d, _ in ts}, {n: d for n, _, d in ts})
            for n, d, deps in ts:
                assert got[w, n][0] == expected[n]
                if expected[n] is not None:
                    assert got[w, n][1] == expected[n] + d


def test_lint(spark):
    workflows = {1: [("a", 1.0, []), ("a", 1.0, []), ("b", 1.0, ["gone"]), ("c", 1.0, ["b"])]}
    nodes, edges = frames(spark, workflows)
    got = sorted((r.issue, r.task_name, r.detail) for r in dag_lint(nodes, edges).collect())
    assert got == [
        ("blocked", "b", None), ("blocked", "c", None), ("dangling", "b", "gone"), ("duplicate", "a", "2")
    ]


def plain(rows, edges, spec=False):
    """Start and reason of each task of one workflow; rows: (idx, name, duration), also with repeated positions and names."""
    rows = sorted(rows, key=lambda r: (r[0], r[1], r[2] or 0))
    named = {}
    for i, (_, name, _) in enumerate(rows):
        named.setdefault(name, []).append(i)
    deps = [[j for n, d in edges if n == name for j in named.get(d, [])] for _, name, _ in rows]
    if spec:
        deps = [[j for j in ds if j < i] for i, ds in enumerate(deps)]
    above = [set(ds) for ds in deps]
    for _ in rows:
        above = [a.union(*(above[j] for j in a)) for a in above]
    cyclic = {i for i, a in enumerate(above) if i in a}
    lost = {i for i, (_, name, _) in enumerate(rows) if any(n == name and d not in named for n, d in edges)}
    reason = ["cycle" if i in cyclic else "blocked" if above[i] & (cyclic | lost) or i in lost else None for i in range(len(rows))]
    start = [None] * len(rows)
    for _ in rows:
        for i, ds in enumerate(deps):
            if i not in cyclic and not above[i] & cyclic and all(start[j] is not None for j in ds):
                start[i] = max([start[j] + (rows[j][2] or 0) for j in ds], default=0.0)
    return [(idx, name, d, start[i], reason[i]) for i, (idx, name, d) in enumerate(rows)]


def random_workflow(rng, n):
    gaps, repeats = rng.random() < 0.5, rng.random() < 0.5
    at = sorted(rng.randint(0, n // 2) if repeats else i * 3 if gaps else i for i in range(n))
    names = [f"t{rng.randint(0, n - 2)}" if rng.random() < 0.1 else f"t{i}" for i in range(n)]
    rows = [(at[i], names[i], rng.choice([None, 0.0, rng.randint(1, 40) / 10])) for i in range(n)]
    order = list(range(n))
    if rng.random() < 0.6:
        rng.shuffle(order)
    edges = []
    for k in range(1, n):
        for j in rng.sample(range(max(0, k - 4), k), min(k, rng.randint(0, 2))):
            edges.append((names[order[k]], names[order[j]]))
    if rng.random() < 0.5:
        edges += [(rng.choice(names), rng.choice(names)) for _ in range(rng.randint(1, 3))]
    if rng.random() < 0.3:
        edges.append((rng.choice(names), "nowhere"))
    return rows, edges


@pytest.mark.parametrize("max_fold, close", [(4096, 64), (5, 64), (5, 6)])
def test_gaps_repeats_cycles_and_doubles_on_all_routes(spark, monkeypatch, max_fold, close):
    from fleetplan.operators import graph

    monkeypatch.setattr(maxplus.solve, "__defaults__", (True, close))
    monkeypatch.setattr(graph, "MASK_NODES", close)
    rng = random.Random(11)
    workflows = {w: random_workflow(rng, rng.choice([2, 3, 6, 12, 20])) for w in range(40 if close == 64 else 6)}
    nodes = spark.createDataFrame([(w, *r) for w, (rows, _) in workflows.items() for r in rows], NODES).repartition(4)
    edges = spark.createDataFrame([(w, *e) for w, (_, es) in workflows.items() for e in es], EDGES).repartition(4)
    near = lambda x: None if x is None else round(x, 6)
    for order in ("any", "spec"):
        got = sorted(((r.wf_id, r.idx, r.task_name, near(r.start), near(r.end)) for r in earliest_start(nodes, edges, order, max_fold).collect()), key=repr)
        expected = sorted(
            ((w, idx, name, near(s), near(None if s is None else s + (d or 0))) for w, (rows, es) in workflows.items() for idx, name, d, s, _ in plain(rows, es, order == "spec")),
            key=repr,
        )
        assert got == expected
    got = sorted(map(tuple, stuck_tasks(nodes, edges, max_fold).collect()))
    assert got == sorted((w, idx, name, reason) for w, (rows, es) in workflows.items() for idx, name, _, _, reason in plain(rows, es) if reason)


def test_small_workflows_are_shuffled_once(spark, monkeypatch):
    """Tasks and dependencies meet by workflow: neither is joined, nor shuffled by name."""
    from fleetplan.operators import graph

    plans, stage = [], graph.stage

    def seen(df, label):
        if label == "forward":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df, label)

    monkeypatch.setattr(graph, "stage", seen)
    nodes, edges = frames(spark, CASES)
    earliest_start(nodes, edges)
    stuck_tasks(nodes, edges)
    assert [(p.count("Exchange hashpartitioning"), p.count("Join")) for p in plans] == [(1, 0), (1, 0)]


@pytest.mark.parametrize("few", [64, 2])
def test_nulls_and_repeated_names_agree_in_row_and_by_join(spark, monkeypatch, few):
    from fleetplan.operators import graph

    monkeypatch.setattr(graph, "FEW_TASKS", few)
    nodes = [(1, 0, "a", 2.0), (1, 1, "a", 5.0), (1, 2, None, 1.0), (1, 3, "b", 1.0), (1, 4, "c", 1.0), (2, None, "x", 3.0), (2, 1, "y", 4.0), (2, 2, "z", 1.0)]
    nodes += [(3, i, f"t{i}", 1.0) for i in range(70)] + [(None, 0, "m", 1.0), (None, 1, "n", 1.0), (None, 2, "o", 1.0)]
    edges = [(1, "b", "a"), (1, "b", "a"), (1, None, "a"), (1, "c", None), (1, "c", "b"), (2, "y", "x"), (2, "z", "y"), (2, "gone", "x"), (4, "p", "q")]
    edges += [(3, f"t{i}", f"t{i - 1}") for i in range(1, 70)] + [(None, "n", "m")]
    nodes, edges = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)
    got = {(r.wf_id, r.task_name, r.idx): r.start for r in earliest_start(nodes, edges).collect()}
    assert got == {
        (1, "a", 0): 0, (1, "a", 1): 0, (1, None, 2): 0, (1, "b", 3): 5, (1, "c", 4): 6, (2, "x", None): 0, (2, "y", 1): 0, (2, "z", 2): 4,
        **{(3, f"t{i}", i): i for i in range(70)}, (None, "m", 0): 0, (None, "n", 1): 0, (None, "o", 2): 0,
    }
    assert sorted(map(tuple, stuck_tasks(nodes, edges).collect())) == [(1, 4, "c", "blocked"), (2, 1, "y", "blocked"), (2, 2, "z", "blocked")]


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """20,000 tasks in one chain whose tasks stand in the document in any order."""
    rounds = []
    chosen = maxplus._chosen
    monkeypatch.setattr(maxplus, "_chosen", lambda *a: rounds.append(1) or chosen(*a))
    n = 20_000
    order = list(range(n))
    random.Random(5).shuffle(order)
    nodes = spark.createDataFrame([(1, order[i], f"t{i}", 0.1) for i in range(n)], NODES).repartition(4)
    edges = spark.createDataFrame([(1, f"t{i}", f"t{i - 1}") for i in range(1, n)], EDGES).repartition(4)
    got = {r.task_name: r.start for r in earliest_start(nodes, edges).collect()}
    assert got == {f"t{i}": i / 10 for i in range(n)}
    # each of them goes forward once and back once
    assert 2 * len(rounds) <= 40


def test_cycles_in_a_large_graph(spark):
    """Loops in a row, with chains before, between and behind them."""
    n, edges = 520, []
    edges += [(1, f"t{i}", f"t{i - 1}") for i in range(1, n)]
    back = [(40, 20), (41, 41), (300, 200), (250, 210), (501, 500)]
    edges += [(1, f"t{lo}", f"t{hi}") for hi, lo in back]
    nodes = spark.createDataFrame([(1, i, f"t{i}", 1.0) for i in range(n)], NODES)
    got = {r.idx: r.reason for r in stuck_tasks(nodes, spark.createDataFrame(edges, EDGES)).collect()}
    on = {i for hi, lo in back for i in range(lo, hi + 1)}
    assert got == {i: "cycle" if i in on else "blocked" for i in range(20, n)}
