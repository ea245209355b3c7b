"""The execution history table: read, append, discard."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetplan import schemas as S
from fleetplan.functions.frames import instant
from fleetplan.operators.history import recent
from fleetplan.session import path_exists, shuffle_partitions

#: Columns that readers look up by value.
INDEXED = ("image", "workflow_name", "task_name")

# The history table as stored: execution columns plus the partition columns.
_STORED = T.StructType(
    [
        *S.EXECUTION.fields,
        T.StructField("completed_date", T.DateType()),
        T.StructField("batch", T.StringType()),
    ]
)


def read_history(
    spark: SparkSession,
    path: str,
    as_of: str | datetime,
    days: int = S.HISTORY_DAYS,
    image: str | None = None,
) -> DataFrame:
    """Recent successful executions of the table at ``path``.

    The table is partitioned by ``completed_date``. Only the folders of the
    window are listed, so the cost of opening the table does not grow with its
    age; the other predicates reach the Parquet scan.
    """
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no history table at {path}")
    clock = _clock(spark, as_of)
    dates = [(clock - timedelta(days=d)).date().isoformat() for d in range(days + 1)]
    table = spark.read.schema(_STORED).option("basePath", path)
    try:
        stored = table.parquet(f"{path}/completed_date={{{','.join(dates)}}}")
    except AnalysisException as error:  # no day of the window has a folder
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], _STORED)
    rows = recent(stored, clock, days).drop("batch")
    return rows if image is None else rows.where(F.col("image") == image)


def _clock(spark: SparkSession, as_of: str | datetime) -> datetime:
    """The clock as local time of the session zone, in which days and times are stored."""
    clock = as_of if isinstance(as_of, datetime) else datetime.fromisoformat(as_of)
    if clock.tzinfo is None:
        return clock
    zone = ZoneInfo(spark.conf.get("spark.sql.session.timeZone"))
    return clock.astimezone(zone).replace(tzinfo=None)


def read_history_jdbc(
    spark: SparkSession,
    url: str,
    as_of,
    days: int = S.HISTORY_DAYS,
    table: str = "task_executions",
    slices: int = 16,
    properties: dict | None = None,
) -> DataFrame:
    """The same from a database, one time slice of the window per task.

    ``as_of`` must be ISO text or a datetime, since it becomes part of the
    predicates evaluated by the database.
    """
    clock = _clock(spark, as_of)
    predicates = time_slices(clock, days, slices)
    rows = spark.read.jdbc(url, table, predicates=predicates, properties=properties or {})
    return recent(rows, clock, days)


def time_slices(clock, days: int, slices: int) -> list[str]:
    """Predicates that cut (clock - days, clock] into equal pieces."""
    step = timedelta(days=days) / slices
    edges = [clock - timedelta(days=days) + step * i for i in range(slices)] + [clock]
    return [
        f"succeeded AND completed_at > '{a:%Y-%m-%d %H:%M:%S.%f}' AND completed_at <= '{b:%Y-%m-%d %H:%M:%S.%f}'"
        for a, b in zip(edges, edges[1:])
    ]


def record_executions(reports: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """Reports (workflow + list of task metrics) as history rows, and the refused reports.

    An empty ``completed_at`` becomes ``as_of``, an absent ``succeeded`` True. A report with a
    malformed time is refused as a whole and told in ``reason``.
    """
    stamp_of = lambda m: F.nullif(m["completed_at"].cast("string"), F.lit(""))
    malformed = F.filter("task_metrics", lambda m: stamp_of(m).isNotNull() & F.try_to_timestamp(stamp_of(m)).isNull())
    marked = reports.withColumn("__bad", F.coalesce(F.get(malformed, 0)["completed_at"].cast("string"), F.lit("")))
    refused = marked.where(F.col("__bad") != "")
    rejects = refused.withColumn("reason", F.concat(F.lit('malformed completed_at "'), "__bad", F.lit('"'))).drop("__bad")
    return _execution_rows(marked.where(F.col("__bad") == ""), as_of), rejects


def _execution_rows(reports: DataFrame, as_of) -> DataFrame:
    m = "m."
    stamp = F.col(m + "completed_at").cast("string")
    return reports.select("workflow_name", F.explode("task_metrics").alias("m")).select(
        "workflow_name",
        F.col(m + "task_name").alias("task_name"),
        F.col(m + "image").alias("image"),
        F.col(m + "actual_cpu_m").cast("bigint").alias("actual_cpu_m"),
        F.col(m + "actual_mem_mib").cast("bigint").alias("actual_mem_mib"),
        F.col(m + "duration_s").cast("double").alias("duration_s"),
        F.coalesce(F.col(m + "succeeded"), F.lit(True)).alias("succeeded"),
        F.coalesce(F.try_to_timestamp(F.nullif(stamp, F.lit(""))), instant(as_of)).alias("completed_at"),
    )


def append_history(executions: DataFrame, path: str, batch: str | None = None) -> None:
    """Append to the history table, partitioned by day and batch.

    Without ``batch`` the rows are added under a new name. With one, rows written
    earlier under the same name and day are replaced, so that a writer that is
    run again after a failure stores its rows once.

    Rows are range-partitioned by time and name into as many equal parts as a shuffle begins
    with: a day goes to few files, a hot day to as many tasks as its share
    of the rows, and each file covers a short stretch of time.

    Files carry Bloom filters of the columns that readers look up (``INDEXED``): a reader of one
    image, or of one task of a workflow, skips the row groups that do not hold it.
    """
    rows = executions.withColumns(
        {"completed_date": F.to_date("completed_at"), "batch": F.lit(batch or uuid.uuid4().hex)}
    )
    parts = shuffle_partitions(executions.sparkSession)
    writer = rows.repartitionByRange(parts, "completed_at", "workflow_name", "task_name").write
    if batch is None:
        writer = writer.mode("append")
    else:
        writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    # as large as the different values of a row group ask
    writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
    for column in INDEXED:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.partitionBy("completed_date", "batch").parquet(path)


def discard_metrics(df: DataFrame) -> None:
    """The sink used when no history is kept."""
    df.write.format("noop").mode("overwrite").save()
