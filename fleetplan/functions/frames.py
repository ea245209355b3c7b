"""DataFrame helpers used by several operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType


def optional(df: DataFrame, name: str, type_: str) -> Column:
    """The column if ``df`` has it, else a typed null."""
    return F.col(name) if name in df.columns else F.lit(None).cast(type_)


def micros(column: Column) -> Column:
    return F.unix_micros(column.cast("timestamp"))


def instant(value) -> Column:
    """A clock argument (ISO text, datetime or Column) as a timestamp column.

    A datetime without a zone is read in the session zone, like text.
    """
    if isinstance(value, Column):
        return value
    text = value.isoformat(sep=" ") if isinstance(value, datetime) else value
    return F.lit(text).cast("timestamp")


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that is not to be broadcast. Rows of documents and of their tasks take many times the
    room of the files they are stored in, by whose size Spark would send all of them through the driver."""
    return df.hint("merge")


def prefix_sums(
    df: DataFrame,
    keys: Sequence[str],
    bucket: str,
    order: Sequence[str],
    sums: Mapping[str, str],
) -> DataFrame:
    """Exclusive running sums per key, in two levels so that no key is one task.

    ``bucket`` must be monotone in ``order``. Rows are windowed per
    (key, bucket); totals of the earlier buckets, one row per bucket, are added
    as offsets. ``sums`` maps output name -> summed column. Sums of decimals keep
    the type of the column, so that no place is lost.
    """
    decimals = {o: df.schema[c].dataType for o, c in sums.items() if isinstance(df.schema[c].dataType, DecimalType)}
    typed = lambda value, o: value.cast(decimals[o]) if o in decimals else value
    cell = [*keys, bucket]
    totals = df.groupBy(*cell).agg(*[F.sum(c).alias(f"__t_{o}") for o, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *cell, *[F.sum(f"__t_{o}").over(before).alias(f"__o_{o}") for o in sums]
    )
    # Workflows that fit one bucket need no offset: only later buckets travel.
    offsets = offsets.where(F.coalesce(*[F.col(f"__o_{o}") for o in sums]).isNotNull())
    inside = Window.partitionBy(*cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    return df.join(offsets, cell, "left").select(
        *[F.col(c) for c in df.columns],
        *[
            typed(
                typed(F.coalesce(F.sum(c).over(inside), zero), o) + typed(F.coalesce(F.col(f"__o_{o}"), zero), o), o
            ).alias(o)
            for o, c in sums.items()
        ],
    )
