"""Workflow documents: read, export, upsert, delete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetplan import schemas as S

_CORRUPT = T.StructField("_corrupt_record", T.StringType())
_WIRE = T.StructType([*S.MANIFEST.fields, _CORRUPT])


def _typed(raw: DataFrame, default_ns: str) -> DataFrame:
    goal = F.coalesce("spec.optimizationGoal", F.lit(S.DEFAULT_GOAL))
    namespace = F.col("metadata.namespace")
    return raw.select(
        F.when(namespace != "", namespace).otherwise(F.lit(default_ns)).alias("namespace"),
        F.col("metadata.name").alias("name"),
        F.when(F.col("spec").isNotNull(), F.col("spec").withField("optimizationGoal", goal)).alias("spec"),
        "status",
        "_corrupt_record",
    )


def read_manifests(spark: SparkSession, path: str, default_ns: str = "default") -> DataFrame:
    """JSON documents, one per line, as typed rows. Lines that are not JSON keep
    their text in ``_corrupt_record``."""
    raw = spark.read.schema(_WIRE).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return _typed(raw, default_ns)


def parse_manifests(texts: DataFrame, column: str = "doc", default_ns: str = "default") -> DataFrame:
    """The same for documents held in a text column."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = texts.select(F.from_json(column, _WIRE, options).alias("d")).select("d.*")
    return _typed(parsed, default_ns)


def export_workflows_json(workflows: DataFrame) -> DataFrame:
    """Documents as JSON text: namespace, name, doc."""
    status = F.col("status") if "status" in workflows.columns else F.lit(None).cast(S.STATUS)
    body = F.struct(
        F.struct("namespace", "name").alias("metadata"), F.col("spec"), status.alias("status")
    )
    return workflows.select("namespace", "name", F.to_json(body).alias("doc"))


def write_workflows_json(workflows: DataFrame, path: str) -> None:
    """Write documents as text files, one document per line."""
    export_workflows_json(workflows).select(F.col("doc").alias("value")).write.text(path)


def upsert_manifests(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Create absent workflows, replace the spec of present ones, keep status.

    ``incoming`` has ``submitted_at``: of several submissions of one workflow
    the latest is kept, by a grouped maximum that combines before the shuffle.
    """
    key = ["namespace", "name"]
    latest = incoming.groupBy(*key).agg(
        F.max_by("spec", F.struct("submitted_at", F.to_json("spec"))).alias("new_spec")
    )
    kept = current.select(*key, "spec", "status")
    return kept.join(latest, key, "full").select(
        *key, F.coalesce("new_spec", "spec").alias("spec"), "status"
    )


def delete_cascade(
    workflows: DataFrame, pods: DataFrame, tombstones: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Remove the named workflows and every pod they own."""
    gone = tombstones.select("namespace", "name")
    owners = gone.withColumnRenamed("name", "workflow_name")
    return (
        workflows.join(gone, ["namespace", "name"], "left_anti"),
        pods.join(owners, ["namespace", "workflow_name"], "left_anti"),
    )
