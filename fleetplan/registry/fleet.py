"""The fleet relations (tasks, edges, status, ...) derived from the given tables.

One workflow = one order, one task = one line item. Only the task table needs a
shuffle; it is written once per application to the shared folder and read from
there, like a task table at rest. The others are row-local projections.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetplan.functions.numbering import positions
from fleetplan.session import fit_shuffles, shared_dir, spread, stage
from fleetplan.sources.history import append_history

AS_OF = "1998-06-01 00:00:00"

_FLEETS: dict[tuple[str, str], "Fleet"] = {}


def fleet(spark: SparkSession, sf_dir: str) -> "Fleet":
    # The tables hold zone-less timestamps; they are read as UTC.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    key = (spark.sparkContext.applicationId, sf_dir)
    fit_shuffles(spark, [f"{sf_dir}/{name}.parquet" for name in ("lineitem", "orders", "events")])
    if key not in _FLEETS:
        _FLEETS[key] = Fleet(spark, sf_dir)
    return _FLEETS[key]


class Fleet:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._built: dict[str, object] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def tasks(self) -> DataFrame:
        lines = self.table("lineitem")
        order = [
            "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
            "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        ]
        parts = self.table("part").select(
            F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size"
        )
        orders = self.table("orders").select(
            F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus"
        )
        # Orders are the smaller side: hashed, so that lines are sorted once, for their numbers, and not for the join too.
        joined = lines.join(parts, "l_partkey").join(orders.hint("shuffle_hash"), "l_orderkey")
        numbered = positions(joined, "l_orderkey", order, sizes=lines)
        hinted = F.col("l_linenumber") % 3 != 0
        rows = numbered.select(
            F.col("l_orderkey").alias("wf_id"),
            F.concat(F.lit("ns-"), (F.col("o_custkey") % 5).cast("string")).alias("namespace"),
            F.concat(F.lit("wf-"), F.col("l_orderkey").cast("string")).alias("workflow_name"),
            "idx",
            F.concat(F.lit("t"), F.col("idx").cast("string")).alias("task_name"),
            F.col("p_brand").alias("image"),
            F.when(hinted, (F.col("l_quantity") * 20).cast("bigint")).alias("hint_cpu_m"),
            F.when(hinted, (F.col("p_size") * 16).cast("bigint")).alias("hint_mem_mib"),
            "o_orderstatus",
            "l_linestatus",
            "l_extendedprice",
            "l_shipdate",
        )
        return stage(rows, "tasks")

    @cached_property
    def edges(self) -> DataFrame:
        idx, wf = F.col("idx"), F.col("wf_id")
        name = lambda i: F.concat(F.lit("t"), i.cast("int").cast("string"))
        deps = F.array(
            F.when(idx > 0, name(F.floor((idx - 1) / 2))),
            F.when((idx >= 3) & (idx % 3 == 0), name(idx - 1)),
            F.when((wf % 97 == 0) & (idx == 1), F.lit("t999")),
            F.when((wf % 101 == 0) & (idx == 0), F.lit("t1")),
        )
        # nulls go after the explode: a lambda function is not compiled
        return self.tasks.select("wf_id", "task_name", F.explode(deps).alias("dep")).where("dep IS NOT NULL")

    @cached_property
    def status(self) -> DataFrame:
        idx, wf = F.col("idx"), F.col("wf_id")
        phase = (
            F.when(
                F.col("o_orderstatus") == "F",
                F.when((idx == 2) & (wf % 7 == 0), "Failed").otherwise("Succeeded"),
            )
            .when(F.col("o_orderstatus") == "O", "Pending")
            .when(idx == 0, "Succeeded")
            .when(idx <= 2, F.when(F.col("l_linestatus") == "F", "Succeeded").otherwise("Running"))
            .otherwise("Pending")
        )
        sized = F.col("phase") != "Pending"
        return (
            self.tasks.where((wf + idx) % 41 != 0)
            .withColumn("phase", phase)
            .select(
                "wf_id",
                "task_name",
                "phase",
                F.when(sized, F.coalesce("hint_cpu_m", F.lit(100))).alias("alloc_cpu_m"),
                F.when(sized, F.coalesce("hint_mem_mib", F.lit(128))).alias("alloc_mem_mib"),
            )
        )

    @cached_property
    def names(self) -> DataFrame:
        """One row per workflow: its first task carries all workflow columns."""
        return self.tasks.where(F.col("idx") == 0).select("wf_id", "namespace", "workflow_name")

    @cached_property
    def limits(self) -> DataFrame:
        wf = F.col("wf_id")
        return self.tasks.where(F.col("idx") == 0).select(
            "wf_id",
            F.when(wf % 10 != 0, 500 + (wf % 4) * 500).cast("bigint").alias("max_cpu_m"),
            F.when(wf % 9 != 0, 512 + (wf % 3) * 512).cast("bigint").alias("max_mem_mib"),
            F.when(wf % 2 == 0, "MinimizeTime").otherwise("MinimizeCost").alias("goal"),
        )

    @cached_property
    def executions(self) -> DataFrame:
        parts = self.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
        parts = parts.where(~F.col("p_brand").isin("Brand#5", "Brand#15", "Brand#25"))
        return (
            self.table("lineitem")
            .join(parts, "l_partkey")
            .select(
                F.concat(F.lit("wf-"), F.col("l_orderkey").cast("string")).alias("workflow_name"),
                F.concat(F.lit("line-"), F.col("l_linenumber").cast("string")).alias("task_name"),
                F.col("p_brand").alias("image"),
                (F.col("l_quantity") * 20).cast("bigint").alias("actual_cpu_m"),
                (F.round(F.col("l_discount") * 10000).cast("bigint") + 64).alias("actual_mem_mib"),
                (F.col("l_extendedprice") / 1000).alias("duration_s"),
                (F.col("l_returnflag") != "R").alias("succeeded"),
                F.col("l_shipdate").cast("timestamp").alias("completed_at"),
            )
        )

    @cached_property
    def pod_events(self) -> DataFrame:
        return self.as_pod_events(self.table("events"))

    @staticmethod
    def as_pod_events(events: DataFrame) -> DataFrame:
        kind = F.col("event_type")
        return events.select(
            "event_id",
            F.col("ts").cast("timestamp").alias("ts"),
            F.col("user_id").alias("wf_id"),
            F.concat(
                F.lit("t"),
                (F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 5).cast("string"),
            ).alias("task_name"),
            F.when(kind == "signup", "Pending")
            .when(kind.isin("view", "click"), "Running")
            .when(kind == "purchase", "Succeeded")
            .when(kind == "error", "Failed")
            .alias("pod_phase"),
        )

    @cached_property
    def history_path(self) -> str:
        """The executions as a stored history table, partitioned by day."""
        path = f"{shared_dir(self.spark)}/history/{uuid.uuid4().hex}"
        append_history(self.executions, path)
        return path

    def once(self, name: str, build):
        """A result shared by several queries, built on first use."""
        if name not in self._built:
            self._built[name] = build()
        return self._built[name]

    @cached_property
    def quantities(self) -> DataFrame:
        size = F.col("p_size")
        text = size.cast("string")
        kind = F.col("p_partkey") % 7
        return self.table("part").select(
            F.col("p_partkey").alias("id"),
            F.when(kind == 0, F.concat(text, F.lit("m")))
            .when(kind == 1, text)
            .when(kind == 2, F.concat(text, F.lit(".5")))
            .when(kind == 3, F.concat((size * 64).cast("string"), F.lit("Mi")))
            .when(kind == 4, F.concat(text, F.lit("Gi")))
            .when(kind == 5, F.concat(text, F.lit("M")))
            .otherwise("bad")
            .alias("quantity"),
        )

    @cached_property
    def pods(self) -> DataFrame:
        """Pods of the tasks whose status is not Pending; the phase follows the
        price, and a pod in six carries no task label."""
        price = F.col("l_extendedprice")
        at = F.col("l_shipdate").cast("timestamp")
        return self.tasks.where(F.col("o_orderstatus") != "O").select(
            "wf_id",
            "namespace",
            "workflow_name",
            F.concat_ws("-", "workflow_name", "task_name").alias("pod_name"),
            F.when(F.col("idx") % 6 != 5, F.col("task_name")).alias("task_name"),
            F.when(F.col("l_linestatus") == "F", F.col("image")).alias("image"),
            F.when(price < 25000, "Succeeded")
            .when(price < 35000, "Failed")
            .when(price < 50000, "Running")
            .otherwise("Pending")
            .alias("pod_phase"),
            F.when(price < 20000, at + F.expr("INTERVAL 1 HOUR")).alias("started_at"),
            at.alias("created_at"),
        )

    @cached_property
    def manifests(self) -> DataFrame:
        """Nested documents, one per order, built inside the row and stored."""
        key = F.col("o_orderkey")
        sizes = ("500m", "1", "1.5", "250m", "bad")
        task = lambda i: F.struct(
            F.concat(F.lit("t"), i.cast("string")).alias("name"),
            F.when((key + i) % 50 != 0, F.concat(F.lit("image-"), ((key + i) % 12).cast("string"))).alias("image"),
            F.when(i % 2 == 0, F.array(F.lit("run"), i.cast("string"))).alias("command"),
            F.when(i > 0, F.array(F.concat(F.lit("t"), (i - 1).cast("string")))).alias("dependencies"),
            F.struct(
                F.when(
                    i % 3 != 0,
                    F.create_map(
                        F.lit("cpu"), F.element_at(F.array(*map(F.lit, sizes)), ((key + i) % 5 + 1).cast("int")),
                        F.lit("memory"), F.concat((64 * (i + 1)).cast("string"), F.lit("Mi")),
                    ),
                ).alias("requests"),
                F.lit(None).cast("map<string,string>").alias("limits"),
            ).alias("baseResources"),
        )
        count = (key % 7).cast("int")
        listed = F.transform(F.sequence(F.lit(0), count), task)
        docs = spread(self.table("orders")).select(
            F.concat(F.lit("ns-"), (F.col("o_custkey") % 5).cast("string")).alias("namespace"),
            F.concat(F.lit("wf-"), key.cast("string")).alias("name"),
            F.struct(
                F.when(key % 3 != 0, F.lit("MinimizeCost")).alias("optimizationGoal"),
                F.create_map(
                    F.lit("cpu"), (1 + key % 4).cast("string"), F.lit("memory"), F.lit("2Gi")
                ).alias("maxResources"),
                F.when(key % 40 != 39, listed).alias("tasks"),
            ).alias("spec"),
            F.col("o_orderdate").cast("timestamp").alias("submitted_at"),
            "o_orderstatus",
            "o_orderpriority",
        )
        return stage(docs, "documents")
