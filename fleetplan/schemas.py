"""Row types and fixed values shared by all operators."""

from pyspark.sql import types as T

# Task and workflow phases.
PENDING = "Pending"
RUNNING = "Running"
SUCCEEDED = "Succeeded"
FAILED = "Failed"
COMPLETED = "Completed"
TASK_PHASES = (PENDING, RUNNING, SUCCEEDED, FAILED)
WORKFLOW_PHASES = (PENDING, RUNNING, COMPLETED, FAILED)
TERMINAL_WORKFLOW_PHASES = (COMPLETED, FAILED)

# Cold-start sizes and multipliers.
DEFAULT_CPU_M = 100
DEFAULT_MEM_MIB = 128
DEFAULT_DURATION_S = 30.0
DEFAULT_CONFIDENCE = 0.1
HINT_CONFIDENCE = 0.3
PREDICTION_LIMIT_FACTOR = 1.5
HINT_LIMIT_FACTOR = 2.0
HISTORY_DAYS = 30
DEFAULT_GOAL = "MinimizeTime"

_RESOURCES = T.MapType(T.StringType(), T.StringType())

REQUIREMENTS = T.StructType(
    [
        T.StructField("requests", _RESOURCES),
        T.StructField("limits", _RESOURCES),
    ]
)

TASK = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("image", T.StringType()),
        T.StructField("command", T.ArrayType(T.StringType())),
        T.StructField("dependencies", T.ArrayType(T.StringType())),
        T.StructField("baseResources", REQUIREMENTS),
    ]
)

SPEC = T.StructType(
    [
        T.StructField("optimizationGoal", T.StringType()),
        T.StructField("maxResources", _RESOURCES),
        T.StructField("tasks", T.ArrayType(TASK)),
    ]
)

TASK_STATUS = T.StructType(
    [
        T.StructField("phase", T.StringType()),
        T.StructField("podName", T.StringType()),
        T.StructField("allocatedResources", REQUIREMENTS),
    ]
)

CONDITION = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("lastTransitionTime", T.StringType()),
    ]
)

STATUS = T.StructType(
    [
        T.StructField("phase", T.StringType()),
        T.StructField("taskStatuses", T.MapType(T.StringType(), TASK_STATUS)),
        T.StructField("currentResourceUsage", _RESOURCES),
        T.StructField("conditions", T.ArrayType(CONDITION)),
    ]
)

# A manifest as served over JSON keeps name and namespace under ``metadata``.
MANIFEST = T.StructType(
    [
        T.StructField(
            "metadata",
            T.StructType(
                [
                    T.StructField("namespace", T.StringType()),
                    T.StructField("name", T.StringType()),
                ]
            ),
        ),
        T.StructField("spec", SPEC),
        T.StructField("status", STATUS),
    ]
)

EXECUTION = T.StructType(
    [
        T.StructField("workflow_name", T.StringType()),
        T.StructField("task_name", T.StringType()),
        T.StructField("image", T.StringType()),
        T.StructField("actual_cpu_m", T.LongType()),
        T.StructField("actual_mem_mib", T.LongType()),
        T.StructField("duration_s", T.DoubleType()),
        T.StructField("succeeded", T.BooleanType()),
        T.StructField("completed_at", T.TimestampType()),
    ]
)

REPORT = T.StructType(
    [
        T.StructField("workflow_name", T.StringType()),
        T.StructField(
            "task_metrics",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("task_name", T.StringType()),
                        T.StructField("image", T.StringType()),
                        T.StructField("actual_cpu_m", T.LongType()),
                        T.StructField("actual_mem_mib", T.LongType()),
                        T.StructField("duration_s", T.DoubleType()),
                        T.StructField("succeeded", T.BooleanType()),
                        T.StructField("completed_at", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)

POD_EVENT = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("wf_id", T.LongType()),
        T.StructField("task_name", T.StringType()),
        T.StructField("pod_phase", T.StringType()),
    ]
)
