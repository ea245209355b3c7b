"""Concurrent use over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from fleetplan.functions.exact import exact
from fleetplan.functions.frames import prefix_sums
from fleetplan.functions.numbering import positions
from fleetplan.session import MAX_FOLD_TASKS, large_groups, stage

# Intervals of one workflow that one task runs up.
MAX_GROUP_INTERVALS = 1_000_000
#: Intervals that the workflows of one task have together, about; larger inputs take more tasks.
TASK_INTERVALS = 200_000


def stack_by_start(
    starts: DataFrame, limit: float | None = None, max_fold: int = MAX_FOLD_TASKS
) -> DataFrame:
    """Stack the tasks that start together, in spec order.

    ``starts`` has wf_id, idx, start, size and, unless ``limit`` is given, a
    ``limit`` per row. ``bottom`` is the size of the earlier tasks at the same
    start, ``crashed`` marks a top above the limit. Tasks that repeat a position
    follow each other by size. Doubles are added as decimals of nine places, so
    both routes give the same numbers.
    """
    cap = F.lit(limit) if limit is not None else F.col("limit")
    starts, back = exact(starts, "size")
    order = ["idx", "size"]
    large = large_groups(starts, "wf_id", max_fold)
    if large is None:
        earlier = Window.partitionBy("wf_id", "start").orderBy(*order)
        earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
        below = F.coalesce(F.sum("size").over(earlier), F.lit(0))
        stacked = starts.withColumn("bottom", below)
    else:
        rows = positions(starts, "wf_id", order, "__place", max_fold)
        rows = rows.withColumn("__cell", F.floor(F.col("__place") / F.lit(max_fold)))
        stacked = prefix_sums(rows, ["wf_id", "start"], "__cell", ["__place"], {"bottom": "size"})
        stacked = stacked.drop("__cell", "__place")
    top = F.col("bottom") + F.col("size")
    crashed = F.coalesce((top.cast(back) if back else top) > cap, F.lit(False))
    if back:
        return stacked.select(*[F.col(c).cast(back).alias(c) if c in ("bottom", "size") else F.col(c) for c in stacked.columns], crashed.alias("crashed"))
    return stacked.withColumn("crashed", crashed)


def stack_crashes(stacked: DataFrame) -> DataFrame:
    """Per workflow: does any stack pass the limit?"""
    return stacked.groupBy("wf_id").agg(F.bool_or("crashed").alias("is_crasher"))


def usage_profile(
    intervals: DataFrame, limit: float | None = None, max_group: int = MAX_GROUP_INTERVALS
) -> DataFrame:
    """Size in use per workflow as a step function of time.

    ``intervals`` has wf_id, start, end, size; an interval holds its size over
    [start, end). One output row per step: wf_id, at, until, in_use and
    over_limit (against ``limit`` or a ``limit`` column). Instead of joining
    intervals to instants, the changes at each instant are summed first and then
    run up. A workflow of up to ``max_group`` intervals is run up in one task,
    a larger one in pieces of so many instants each, wherever in time they lie. Doubles are
    added as decimals of nine places, so the pieces do not change a sum.
    """
    intervals, back = exact(intervals.where(F.col("end") > F.col("start")), "size")
    large = large_groups(intervals, "wf_id", max_group)
    if large is None:
        steps = _steps(intervals)
    else:
        ordinary = intervals.join(large, "wf_id", "left_anti")
        steps = _steps(ordinary).unionByName(_wide_steps(intervals, large, max_group))
    has_column = "limit" in intervals.columns
    cap = F.lit(limit) if limit is not None else (F.col("limit") if has_column else F.lit(None))
    if back:
        steps = steps.withColumn("in_use", F.col("in_use").cast(back))
    over = F.coalesce(F.col("in_use") > cap, F.lit(False))
    return steps.select("wf_id", "at", "until", "in_use", over.alias("over_limit"))


def _carried(intervals: DataFrame) -> list[str]:
    return ["limit"] if "limit" in intervals.columns else []


def _changes(intervals: DataFrame) -> DataFrame:
    ends = F.array(
        F.struct(F.col("start").alias("at"), F.col("size").alias("delta")),
        F.struct(F.col("end").alias("at"), (-F.col("size")).alias("delta")),
    )
    return intervals.withColumn("c", F.explode(ends)).select("wf_id", "c.*", *_carried(intervals))


def _by_instant(changes: DataFrame) -> DataFrame:
    carried = [F.max(c).alias(c) for c in _carried(changes)]
    return changes.groupBy("wf_id", "at").agg(_sum("delta", changes).alias("delta"), *carried)


def _sum(name: str, df: DataFrame) -> Column:
    """A sum in the type of its column where that is a decimal."""
    kind = df.schema[name].dataType
    return F.sum(name).cast(kind) if isinstance(kind, DecimalType) else F.sum(name)


def _steps(intervals: DataFrame) -> DataFrame:
    """Steps of workflows that fit one task each. The rows are brought together
    by workflow before anything else: the grouping by instant and both windows
    then need no exchange of their own. The number of tasks follows the number of
    rows, since what a task holds would grow with them otherwise."""
    tasks = max(intervals.count() // TASK_INTERVALS + 1, intervals.sparkSession.sparkContext.defaultParallelism)
    deltas = _by_instant(_changes(intervals.repartition(tasks, "wf_id")))
    order = Window.partitionBy("wf_id").orderBy("at")
    return deltas.select(
        "wf_id",
        "at",
        F.lead("at").over(order).alias("until"),
        F.sum("delta").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast(deltas.schema["delta"].dataType).alias("in_use"),
        *_carried(deltas),
    )


def _wide_steps(intervals: DataFrame, large: DataFrame, max_group: int) -> DataFrame:
    """Steps of workflows that are run up in pieces of ``max_group`` instants."""
    # Summed per instant before the shuffle, so that a hot instant is no burden.
    deltas = stage(_by_instant(_changes(intervals.join(large, "wf_id", "left_semi"))), "deltas")
    columns = ["wf_id", "at", "delta", *_carried(deltas)]
    placed = positions(deltas, "wf_id", ["at"], "__place", max_group)
    deltas = stage(placed.select(*columns, F.floor(F.col("__place") / F.lit(max_group)).alias("__cell")), "pieces")
    run = prefix_sums(deltas, ["wf_id"], "__cell", ["at"], {"__before": "delta"})
    # The end of a step is the next instant: inside the piece, else the first
    # instant of the next piece that has one.
    firsts = deltas.groupBy("wf_id", "__cell").agg(F.min("at").alias("__first"))
    after = Window.partitionBy("wf_id").orderBy("__cell")
    nexts = firsts.select("wf_id", "__cell", F.lead("__first").over(after).alias("__next"))
    inside = Window.partitionBy("wf_id", "__cell").orderBy("at")
    return run.join(nexts, ["wf_id", "__cell"]).select(
        "wf_id",
        "at",
        F.coalesce(F.lead("at").over(inside), F.col("__next")).alias("until"),
        (F.col("__before") + F.col("delta")).cast(deltas.schema["delta"].dataType).alias("in_use"),
        *_carried(deltas),
    )


def usage_peaks(profile: DataFrame) -> DataFrame:
    """Peak use per workflow and the time spent above the limit."""
    over = F.when(F.col("over_limit"), F.col("until") - F.col("at"))
    return profile.groupBy("wf_id").agg(
        F.max("in_use").alias("peak"),
        F.coalesce(F.sum(over), F.lit(0)).alias("time_over_limit"),
    )
