"""Longest paths and lint checks on the dependency graph.

A workflow of ordinary size whose dependencies precede their dependents in the document needs one pass over its
tasks in spec order, done inside one row. Where it has few tasks and dependencies, both meet in that row by one shuffle;
otherwise the names of dependencies are looked up by a join first. All others (larger ones, and those that list a dependency after its
dependent or repeat a position) are solved together by elimination, in rounds that grow with the logarithm of a chain's
length (``maxplus``). Times are added as decimals of nine places, so both routes give the same numbers.

A task is a row: rows that repeat a position follow each other by name and duration, and a dependency means each task of
its name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetplan.functions.exact import VALUE, value_of
from fleetplan.functions.numbering import positions
from fleetplan.operators.maxplus import ENDLESS, gathered, is_endless, on_cycles, solve
from fleetplan.session import MAX_FOLD_TASKS, stage

ORDERS = ("any", "spec")


#: Tasks of the inner lists of a fold: a step copies one of them, not all that came before.
BLOCK = 64
#: Tasks of a workflow, and dependencies for each of them, up to which names are compared inside a row.
FEW_TASKS = 64
LINKS = 4
#: Tasks whose ancestors are the bits of one number.
MASK_NODES = 64


def _nodes(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Each task with the positions of its dependencies. Dependencies are grouped
    by task name, the key the tasks are joined on: one exchange serves both."""
    at = tasks.select("wf_id", F.col("task_name").alias("dep"), F.col("idx").alias("src"))
    deps = (
        edges.join(at, ["wf_id", "dep"], "left")
        .groupBy("wf_id", "task_name")
        .agg(
            F.collect_set("src").alias("deps"),
            F.bool_or(F.col("src").isNull()).alias("dangling"),
            F.max("src").alias("last_dep"),
        )
    )
    return tasks.select("wf_id", "idx", "task_name", "duration").join(
        deps, ["wf_id", "task_name"], "left"
    )


def _known_durations(tasks: DataFrame) -> DataFrame:
    """An unknown duration counts as 0."""
    return tasks.withColumn("duration", value_of(F.col("duration")))


def _queues_by_join(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Each workflow as one row (wf_id, in_order: no dependency comes later, repeats: a position occurs twice, queue): its
    tasks in spec order with the ``places`` of their dependencies and ``dangling``. Names of dependencies are looked up by a join."""
    body = F.struct("idx", "task_name", "duration", "deps", "dangling", "last_dep")
    groups = _nodes(tasks, edges).groupBy("wf_id").agg(F.sort_array(F.collect_list(body)).alias("queue"))

    # Positions are usually dense from 0, so that the place in the array is the
    # position; in a document with gaps the places are looked up.
    dense = (F.element_at("queue", -1)["idx"] == F.size("queue") - 1) & (F.element_at("queue", 1)["idx"] == 0)
    places = lambda deps: F.transform(
        deps, lambda p: (F.array_position(F.col("queue.idx"), p) - 1).cast("int")
    )
    task = lambda t, deps: F.struct(
        t["idx"].alias("idx"),
        t["task_name"].alias("task_name"),
        t["duration"].alias("duration"),
        deps.alias("places"),
        F.coalesce(t["dangling"], F.lit(False)).alias("dangling"),
    )
    no_deps = F.array().cast("array<int>")
    # The condition stands outside of the lambda functions: inside, it would be evaluated for each task.
    placed = F.when(dense & ~_repeats(), F.transform("queue", lambda t: task(t, F.coalesce(t["deps"], no_deps)))).otherwise(
        F.transform("queue", lambda t: task(t, places(F.coalesce(t["deps"], no_deps))))
    )
    late = F.exists("queue", lambda t: F.coalesce(t["last_dep"] >= t["idx"], F.lit(False)))
    return groups.select("wf_id", (~late).alias("in_order"), _repeats().alias("repeats"), placed.alias("queue"))


def _queues_in_row(tasks: DataFrame, edges: DataFrame, dangling: bool) -> DataFrame:
    """The same for workflows of few tasks and dependencies: both are brought together by workflow, once, and names are
    compared inside the row. Without ``dangling`` that is not looked for, and false."""
    no_link = F.lit(None).cast("struct<task_name:string,dep:string>")
    # a dependency without workflow or task belongs to none
    links = edges.where("wf_id IS NOT NULL AND task_name IS NOT NULL").select("wf_id", F.struct("task_name", "dep").alias("link"))
    own = tasks.select("wf_id", F.struct("idx", "task_name", "duration").alias("task"))
    both = own.withColumn("link", no_link).unionByName(links.withColumn("task", F.lit(None).cast(own.schema["task"].dataType)))
    groups = both.groupBy("wf_id").agg(F.sort_array(F.collect_list("task")).alias("queue"), F.collect_list("link").alias("links"))
    groups = groups.where(F.size("queue") > 0)

    at = F.transform("queue", lambda t, p: F.struct(t["task_name"].alias("name"), t["idx"].alias("idx"), p.alias("p")))

    def task(t: Column, at: Column) -> Column:
        deps = F.transform(F.filter("links", lambda l: l["task_name"] == t["task_name"]), lambda l: l["dep"])
        same = lambda s, d: F.coalesce(s["name"] == d, F.lit(False))
        unknown = lambda d: ~F.exists(at, lambda s: same(s, d)) | F.exists(at, lambda s: s["idx"].isNull() & same(s, d))
        return _let(
            deps,
            lambda deps: F.struct(
                t["idx"].alias("idx"),
                t["task_name"].alias("task_name"),
                t["duration"].alias("duration"),
                F.transform(F.filter(at, lambda s: s["idx"].isNotNull() & F.array_contains(deps, s["name"])), lambda s: s["p"]).alias("places"),
                (F.exists(deps, unknown) if dangling else F.lit(False)).alias("dangling"),
            ),
        )

    placed = _let(at, lambda at: F.transform("queue", lambda t: task(t, at)))
    groups = groups.select("wf_id", _repeats().alias("repeats"), placed.alias("queue"))
    late = F.exists(
        F.transform("queue", lambda t, p: t["idx"].isNotNull() & F.coalesce(F.array_max(t["places"]) >= p, F.lit(False))), lambda l: l
    )
    return groups.select("wf_id", (~late).alias("in_order"), "repeats", "queue")


def _repeats() -> Column:
    return F.size(F.array_distinct(F.col("queue.idx"))) < F.size("queue")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once; inside of a lambda function it would be for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _folded(queues: DataFrame, type_: str, step: Callable[[Column, Callable[[Column], Column]], Column], blocks: bool) -> DataFrame:
    """Fold each workflow of ``queues`` in spec order: one row for each task with its ``value``, which ``step`` gives from
    the task and a lookup of the value at an earlier place (null at its own and later ones)."""
    none = F.array().cast(f"array<{type_}>")
    if blocks:
        # A step of ``aggregate`` copies its state. So tasks are folded block by block, the state of which is the block alone;
        # what came before is copied once for each block.
        def at(blocks: Column, open_: Column) -> Callable[[Column], Column]:
            full = F.size(blocks) * BLOCK
            return lambda p: F.when(p < full, F.get(F.get(blocks, F.floor(p / BLOCK).cast("int")), p % BLOCK)).otherwise(F.get(open_, p - full))

        last = F.floor((F.size("queue") - 1) / BLOCK).cast("int")
        cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("queue", i * BLOCK + 1, F.lit(BLOCK)))
        block = lambda blocks, tasks: F.concat(
            blocks, F.array(F.aggregate(tasks, none, lambda open_, task: F.concat(open_, F.array(step(task, at(blocks, open_))))))
        )
        done = F.aggregate(cut, F.array().cast(f"array<array<{type_}>>"), block, F.flatten)
    else:
        done = F.aggregate("queue", none, lambda open_, task: F.concat(open_, F.array(step(task, lambda p: F.get(open_, p)))))
    # All of a workflow is worked out before the explode: beside it, an expression is evaluated for each task. No array is
    # empty; an inner explode would work everything out once more to see that.
    whole = queues.select("wf_id", "in_order", "repeats", F.arrays_zip("queue", done.alias("done")).alias("all"))
    return whole.select("wf_id", "in_order", "repeats", F.explode_outer("all").alias("t")).select(
        "wf_id",
        F.col("t.queue.idx").alias("idx"),
        F.col("t.queue.task_name").alias("task_name"),
        F.col("t.queue.duration").alias("duration"),
        F.col("t.done").alias("value"),
        "in_order",
        "repeats",
    )


def _end(task: Column, at: Callable[[Column], Column]) -> Column:
    start = F.coalesce(F.array_max(F.transform(task["places"], at)), F.lit(0).cast(VALUE))
    return (start + task["duration"]).cast(VALUE)


def _is_stuck(task: Column, at: Callable[[Column], Column]) -> Column:
    """A dependency is dangling, or is itself of such a task."""
    return task["dangling"] | F.exists(task["places"], lambda p: F.coalesce(at(p), F.lit(False)))


def _routes(
    tasks: DataFrame, edges: DataFrame, max_fold: int, order: str, type_: str, step: Callable, columns: list[Column]
) -> tuple[DataFrame, DataFrame | None]:
    """The forward pass, with ``columns``, of the workflows it holds for, and the ids of all others (None if there are none)."""
    few, dangling = FEW_TASKS, step is _is_stuck
    tasks, edges = tasks.select("wf_id", "idx", "task_name", "duration"), edges.select("wf_id", "task_name", "dep")
    row = lambda df, n, m: df.select("wf_id", F.lit(n).alias("n"), F.lit(m).alias("m"))
    sizes = row(tasks, 1, 0).unionByName(row(edges, 0, 1)).groupBy("wf_id").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    many = stage(sizes.where((F.col("n") > min(few, max_fold)) | (F.col("m") > few * LINKS)), "large-groups")
    large = None
    if many.isEmpty():
        passed = _folded(_queues_in_row(tasks, edges, dangling), type_, step, blocks=False)
    else:
        # rows without workflow are one group, and always folded
        large = many.where((F.col("n") > max_fold) & F.col("wf_id").isNotNull())
        wide = many.where((F.col("n") <= max_fold) | F.col("wf_id").isNull()).select(F.col("wf_id").alias("of"))
        all_ = many.select(F.col("wf_id").alias("of"))
        part = lambda df, ids, how: df.join(ids, F.col("wf_id").eqNullSafe(F.col("of")), how)
        small = _queues_in_row(part(tasks, all_, "left_anti"), part(edges, all_, "left_anti"), dangling)
        joined = _queues_by_join(part(tasks, wide, "left_semi"), part(edges, wide, "left_semi"))
        passed = _folded(small, type_, step, blocks=False).unionByName(_folded(joined, type_, step, blocks=True))
    passed = stage(passed.select("wf_id", "idx", "task_name", *columns, "in_order", "repeats"), "forward")
    holds = ~F.col("repeats") if order == "spec" else F.col("in_order") & ~F.col("repeats")
    rest = passed.where(~holds).select("wf_id").distinct()
    rest = stage(rest if large is None else rest.unionByName(large.select("wf_id")), "to-solve")
    return passed.where(holds), None if rest.isEmpty() else rest


def _graphs(tasks: DataFrame, edges: DataFrame, rest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The workflows of ``rest``: tasks with their place in the workflow as ``node``, and arcs (wf_id, src, dst, w);
    ``src`` is null for a dangling dependency. ``rest`` is a stored table: where it is small, it is broadcast by its
    known size, and tasks and edges are cut down before they are shuffled."""
    some = tasks.select("wf_id", "idx", "task_name", "duration").join(rest, "wf_id", "left_semi")
    some = stage(positions(some, "wf_id", ["idx", "task_name", "duration"], "node").withColumn("node", F.col("node").cast("bigint")), "placed")
    dep = some.select("wf_id", F.col("task_name").alias("dep"), F.col("node").alias("src"), F.col("duration").alias("w"))
    at = some.select("wf_id", "task_name", F.col("node").alias("dst"))
    named = edges.select("wf_id", "task_name", "dep").join(rest, "wf_id", "left_semi")
    arcs = named.join(dep, ["wf_id", "dep"], "left").join(at, ["wf_id", "task_name"]).select("wf_id", "src", "dst", "w")
    return some, stage(arcs, "placed-arcs")


def earliest_start(
    tasks: DataFrame, edges: DataFrame, order: str = "any", max_fold: int = MAX_FOLD_TASKS
) -> DataFrame:
    """Start = latest end over the dependencies (0 if none), end = start + duration.

    ``tasks`` has wf_id, idx, task_name, duration; positions may have gaps and repeats, and an
    unknown duration counts as 0, as does one that is no number. A dependency that is not in
    the workflow counts as 0. With ``order="spec"`` so does one listed at or
    after its dependent (one forward pass over the document); with ``"any"`` the
    order of the document does not matter, and tasks on or behind a cycle get
    null times. Durations count to nine places.
    """
    if order not in ORDERS:
        raise ValueError(f"order must be one of {ORDERS}")
    timed = lambda df, start, end: df.select("wf_id", "idx", "task_name", start.cast("double").alias("start"), end.cast("double").alias("end"))
    tasks = _known_durations(tasks)
    # stored as the doubles they are given as
    start = (F.col("value") - F.col("duration")).cast(VALUE).cast("double")
    columns = [start.alias("start"), F.col("value").cast("double").alias("end")]
    passed, rest = _routes(tasks, edges, max_fold, order, VALUE, _end, columns)
    good = timed(passed, F.col("start"), F.col("end"))
    if rest is None:
        return good
    some, arcs = _graphs(tasks, edges, rest)
    arcs = arcs.where(F.col("src") < F.col("dst")) if order == "spec" else arcs.where(F.col("src").isNotNull())
    values = solve(some.select("wf_id", "node", F.lit(0).cast(VALUE).alias("base")), arcs)
    start = F.when(~is_endless(F.col("value")), F.col("value"))
    return good.unionByName(timed(some.join(values, ["wf_id", "node"]), start, start + F.col("duration")))


def stuck_tasks(tasks: DataFrame, edges: DataFrame, max_fold: int = MAX_FOLD_TASKS) -> DataFrame:
    """Tasks (wf_id, idx, task_name, reason) that can never become ready: ``cycle`` for those on a cycle, ``blocked`` for those
    with a dangling dependency and all that are behind a cycle or a dangling dependency."""
    nodes = tasks.select("wf_id", "idx", "task_name", F.lit(0).cast(VALUE).alias("duration"))
    passed, rest = _routes(nodes, edges, max_fold, "any", "boolean", _is_stuck, [F.col("value").alias("stuck")])
    reasons = lambda df, reason: df.select("wf_id", "idx", "task_name", reason.alias("reason"))
    stuck = reasons(passed.where("stuck"), F.lit("blocked"))
    if rest is None:
        return stuck
    some, arcs = _graphs(nodes, edges, rest)
    dangling = arcs.where("src IS NULL").select("wf_id", F.col("dst").alias("node"), F.lit(True).alias("dangling")).distinct()
    marked = some.join(dangling, ["wf_id", "node"], "left").withColumn("dangling", F.coalesce("dangling", F.lit(False)))
    marked = stage(marked, "marked-tasks")
    arcs = arcs.where("src IS NOT NULL")
    sizes = stage(marked.groupBy("wf_id").agg(F.count("*").alias("n")), "sizes")
    few = sizes.where(F.col("n") <= MASK_NODES).select("wf_id")
    many = sizes.where(F.col("n") > MASK_NODES).select("wf_id")
    found = _reasons_in_row(marked.join(few, "wf_id", "left_semi"), arcs.join(few, "wf_id", "left_semi"))
    if not many.isEmpty():
        nodes, arcs = marked.join(many, "wf_id", "left_semi"), arcs.join(many, "wf_id", "left_semi")
        found = found.unionByName(_reasons_by_solving(nodes, arcs))
    return stuck.unionByName(reasons(some.join(found, ["wf_id", "node"]), F.col("reason")))


def _reasons_by_solving(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """(wf_id, node, reason) of stuck tasks, in graphs of any size."""
    base = F.when(F.col("dangling"), F.lit(ENDLESS)).otherwise(F.lit(0)).cast(VALUE)
    values = solve(nodes.withColumn("base", base), arcs)
    stuck = stage(values.where(is_endless(F.col("value"))).select("wf_id", "node"), "stuck")
    inside = arcs
    for end in ("src", "dst"):
        inside = inside.join(stuck.withColumnRenamed("node", end), ["wf_id", end], "left_semi")
    cycles = on_cycles(stuck, inside).withColumn("reason", F.lit("cycle"))
    return stuck.join(cycles, ["wf_id", "node"], "left").select("wf_id", "node", F.coalesce("reason", F.lit("blocked")).alias("reason"))


def _reasons_in_row(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """The same for graphs of at most 64 nodes: the ancestors of a node are the bits of one number, and six times the
    ancestors of all ancestors are added."""
    rows = gathered(nodes, arcs, ["dangling"])
    bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("bigint"), p)
    has = lambda mask, p: mask.bitwiseAND(bit(p)) != 0
    either = lambda masks: F.aggregate(masks, F.lit(0).cast("bigint"), lambda a, m: a.bitwiseOR(m))
    parents = F.transform("queue", lambda t: either(F.transform(t["ins"], lambda a: bit(a["p"]))))
    grown = lambda all_: F.transform(all_, lambda own: own.bitwiseOR(either(F.transform(all_, lambda m, p: F.when(has(own, p), m).otherwise(F.lit(0).cast("bigint"))))))
    above = F.aggregate(F.sequence(F.lit(1), F.lit(6)), parents, lambda masks, _: F.when(F.exists(masks, lambda m: m != 0), grown(masks)).otherwise(masks))
    rows = rows.withColumn("above", above)
    cycles = F.transform("above", lambda m, p: F.when(has(m, p), bit(p)).otherwise(F.lit(0).cast("bigint")))
    missing = F.transform("queue", lambda t, p: F.when(t["dangling"], bit(p)).otherwise(F.lit(0).cast("bigint")))
    rows = rows.withColumn("on_cycle", either(cycles)).withColumn("without", either(missing))
    each = rows.select("wf_id", "on_cycle", "without", F.posexplode_outer(F.arrays_zip("queue", "above")).alias("p", "t"))
    blocked = F.col("t.above").bitwiseOR(bit(F.col("p"))).bitwiseAND(F.col("on_cycle").bitwiseOR(F.col("without"))) != 0
    reason = F.when(has(F.col("on_cycle"), F.col("p")), "cycle").when(blocked, "blocked")
    return each.select("wf_id", F.col("t.queue.node").alias("node"), reason.alias("reason")).where("reason IS NOT NULL")


def dag_lint(tasks: DataFrame, edges: DataFrame, max_fold: int = MAX_FOLD_TASKS) -> DataFrame:
    """Findings (wf_id, task_name, issue, detail): ``dangling`` dependency,
    ``duplicate`` task name, task on a ``cycle``, task ``blocked`` by one of these before it."""
    known = tasks.select("wf_id", F.col("task_name").alias("dep"))
    finding = lambda df, issue, detail: df.select(
        "wf_id", "task_name", issue.alias("issue"), detail.alias("detail")
    )
    # made distinct after the join: few dangle, and all edges would be shuffled once more
    dangling = edges.select("wf_id", "task_name", "dep").join(known, ["wf_id", "dep"], "left_anti").distinct()
    repeated = tasks.groupBy("wf_id", "task_name").count().where(F.col("count") > 1)
    stuck = stuck_tasks(tasks, edges, max_fold)
    return (
        finding(dangling, F.lit("dangling"), F.col("dep"))
        .unionByName(finding(repeated, F.lit("duplicate"), F.col("count").cast("string")))
        .unionByName(finding(stuck, F.col("reason"), F.lit(None).cast("string")))
    )
