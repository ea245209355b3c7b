"""Text functions on names and images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def image_hash(image: Column) -> Column:
    """First 32 bits of SHA-256 scaled to [0, 1)."""
    head = F.substring(F.sha2(image, 256), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(float(16**8))


def parse_dependency_csv(text: Column) -> Column:
    """``"a, b"`` -> ``["a", "b"]``; blanks dropped, null or empty -> ``[]``."""
    names = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda name: F.trim(name))
    return F.filter(names, lambda name: name != "")


def pod_name(workflow_name: Column, task_name: Column) -> Column:
    return F.lower(F.concat_ws("-", workflow_name, task_name))
