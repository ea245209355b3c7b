"""Positions of rows inside a key, for keys of any size and also null ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetplan.session import stage


def ranked(rows: DataFrame, key: str, order: Sequence[str], name: str = "pos", count: str = "n") -> DataFrame:
    """Add ``name``, the place (bigint, from 0) of each row of a ``key`` by ``order`` (nulls first), and ``count``,
    the rows of the key. ``key`` holds no null.

    Rows are dealt into ranges of (key, order), numbered inside their range, and shifted by the counts of the
    ranges before. Rows that are equal in all of them are told apart by a stored number, so that a range never
    has to hold all copies of one row; which of them comes first is open.
    """
    salted = stage(rows.withColumn("__salt", F.monotonically_increasing_id()), "rows-to-rank")
    # Stored, so that the range a row fell into is a fact also for a task that is run again.
    ranged = stage(salted.repartitionByRange(key, *order, "__salt").withColumn("__range", F.spark_partition_id()), "ranges")
    whole = Window.partitionBy(key)
    before = whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy(key, "__range")
        .agg(F.count("*").alias("__rows"))
        .select(key, "__range", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"), F.sum("__rows").over(whole).alias(count))
    )
    inside = Window.partitionBy(key, "__range").orderBy(*order, "__salt")
    numbered = ranged.withColumn(name, F.row_number().over(inside).cast("bigint") - 1).join(starts, [key, "__range"])
    return numbered.withColumn(name, F.col(name) + F.col("__start")).drop("__salt", "__range", "__start")
