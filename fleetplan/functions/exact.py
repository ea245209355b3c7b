"""Sums that do not depend on the order of their terms: doubles are taken as decimals of nine places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

VALUE = "decimal(28,9)"
#: Numbers of this size and above are outside of the range.
BEYOND = 10**17


def value_of(number: Column) -> Column:
    """A number as a decimal of nine places; what is no number, or beyond the range, is 0."""
    value = number.try_cast(VALUE)
    return F.coalesce(F.when(F.abs(value) < BEYOND, value), F.lit(0).cast(VALUE))


def exact(df: DataFrame, name: str) -> tuple[DataFrame, str | None]:
    """``df`` with a column of doubles made exact, and the type to give sums in the end; other columns stay as they
    are, since sums of integers and decimals are exact."""
    if isinstance(df.schema[name].dataType, (DoubleType, FloatType)):
        return df.withColumn(name, value_of(F.col(name))), "double"
    return df, None
