"""Dense positions inside a key, also when one key holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetplan.session import MAX_FOLD_TASKS, large_groups, stage


def positions(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    name: str = "idx",
    max_group: int = MAX_FOLD_TASKS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Add ``name`` = 0-based position of each row inside ``key`` by ``order``.

    Keys up to ``max_group`` rows are numbered by one window. Larger keys are
    range-partitioned over many tasks by the full order, numbered inside each
    range, and shifted by the row counts of the earlier ranges. ``sizes`` may
    hand in a cheaper frame to count the keys on (a superset of the rows).
    """
    large = large_groups(df if sizes is None else sizes, key, max_group)
    window = Window.partitionBy(key).orderBy(*order)
    if large is None:
        return df.withColumn(name, F.row_number().over(window) - 1)

    small = df.join(large, key, "left_anti").withColumn(name, F.row_number().over(window) - 1)
    ranged = (
        df.join(large, key, "left_semi")
        .repartitionByRange(key, *order)
        .withColumn("__part", F.spark_partition_id())
    )
    # Written out before use, so that the range a row fell into is a stored fact.
    ranged = stage(ranged, "ranged-keys")
    earlier = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy(key, "__part")
        .count()
        .select(key, "__part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("__start"))
    )
    inside = Window.partitionBy(key, "__part").orderBy(*order)
    big = (
        ranged.join(starts, [key, "__part"])
        .withColumn(name, (F.row_number().over(inside) - 1 + F.col("__start")).cast("int"))
        .drop("__part", "__start")
    )
    return small.unionByName(big)
