"""Prediction chain and resource resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetplan import schemas as S
from fleetplan.functions.frames import optional

TASK = ["wf_id", "task_name"]
DIALECTS = ("local", "remote")
_SIZES = ("cpu_m", "mem_mib", "cpu_limit_m", "mem_limit_mib")


def _hints(df: DataFrame) -> dict[str, Column]:
    return {
        "cpu": F.col("hint_cpu_m"),
        "mem": F.col("hint_mem_mib"),
        "cpu_limit": optional(df, "hint_cpu_limit_m", "bigint"),
        "mem_limit": optional(df, "hint_mem_limit_mib", "bigint"),
    }


def _has_hint(df: DataFrame) -> Column:
    """Requests or limits are given."""
    return F.coalesce(*_hints(df).values()).isNotNull()


def _positive_request(df: DataFrame) -> Column:
    """A request above zero: the only hint that survives the remote call."""
    return F.coalesce(F.greatest("hint_cpu_m", "hint_mem_mib"), F.lit(0)) > 0


def _positive_or(value: Column, default: int) -> Column:
    return F.when(value > 0, value).otherwise(F.lit(default)).cast("bigint")


def _times(value: Column, factor: float) -> Column:
    """Truncated product, computed in double."""
    return (value * F.lit(factor)).cast("bigint")


def _position(tasks: DataFrame) -> list[str]:
    """The place in the document, which tells predictions of a repeated name apart."""
    return [c for c in ("idx",) if c in tasks.columns]


def predict_baseline(tasks: DataFrame) -> DataFrame:
    """The user's hint as prediction, duration unknown (0); no hint, no row."""
    hints = _hints(tasks)
    return tasks.where(_has_hint(tasks)).select(
        *TASK,
        *_position(tasks),
        hints["cpu"].alias("cpu_m"),
        hints["mem"].alias("mem_mib"),
        F.lit(0.0).alias("duration_s"),
        hints["cpu_limit"].alias("cpu_limit_m"),
        hints["mem_limit"].alias("mem_limit_mib"),
    )


def with_prediction(enriched: DataFrame, model=None, min_samples: int = 1) -> DataFrame:
    """Add the prediction columns to rows that carry image statistics.

    First match wins: model, history average, hint, default. With ``model`` the
    rows with history are scored by the forest.
    """
    n = F.col("n_samples")
    has_history = n >= min_samples
    hinted = _positive_request(enriched)
    if model is not None:
        from fleetplan.operators.model import score_forest

        enriched = score_forest(model, enriched)
        ml = {c: F.col(f"ml_{c}") for c in ("cpu_m", "mem_mib", "duration_s", "confidence")}
        first = lambda column: F.when(has_history, ml[column])
        method = F.when(has_history, "ml")
    else:
        # Headroom on history averages.
        averages = {
            "cpu_m": _times(F.col("hist_cpu_m"), 1.2),
            "mem_mib": _times(F.col("hist_mem_mib"), 1.2),
            "duration_s": F.col("hist_duration_s") * F.lit(1.1),
            "confidence": F.least(F.lit(0.7), F.lit(0.3) + n * F.lit(0.04)),
        }
        first = lambda column: F.when(has_history, averages[column])
        method = F.when(has_history, "history")
    predicted = {
        "cpu_m": first("cpu_m")
        .when(hinted, _positive_or(F.col("hint_cpu_m"), S.DEFAULT_CPU_M))
        .otherwise(F.lit(S.DEFAULT_CPU_M).cast("bigint")),
        "mem_mib": first("mem_mib")
        .when(hinted, _positive_or(F.col("hint_mem_mib"), S.DEFAULT_MEM_MIB))
        .otherwise(F.lit(S.DEFAULT_MEM_MIB).cast("bigint")),
        "duration_s": first("duration_s").otherwise(F.lit(S.DEFAULT_DURATION_S)),
        "confidence": first("confidence")
        .when(hinted, S.HINT_CONFIDENCE)
        .otherwise(F.lit(S.DEFAULT_CONFIDENCE)),
        "method": method.when(hinted, "hint").otherwise("default"),
    }
    added = enriched.select("*", *[c.alias(name) for name, c in predicted.items()])
    added = added.drop(*[c for c in added.columns if c.startswith("ml_")])
    return added.withColumns(
        {
            "cpu_limit_m": _times(F.col("cpu_m"), S.PREDICTION_LIMIT_FACTOR),
            "mem_limit_mib": _times(F.col("mem_mib"), S.PREDICTION_LIMIT_FACTOR),
        }
    )


def predict_resources(enriched: DataFrame, model=None, min_samples: int = 1) -> DataFrame:
    """Predictions (cpu, memory, duration, confidence, method) per task."""
    return with_prediction(enriched, model, min_samples).select(
        *TASK, *_position(enriched), "cpu_m", "mem_mib", "duration_s", "confidence", "method",
        "cpu_limit_m", "mem_limit_mib",
    )


def sized(rows: DataFrame, dialect: str) -> DataFrame:
    """Request and limit columns of rows that carry hint and prediction columns.

    ``local`` takes a prediction or hint as it is; ``remote`` recomputes limits
    from requests. A row without a prediction has nulls in all of its columns
    and a null ``predicted``.
    """
    if dialect not in DIALECTS:
        raise ValueError(f"dialect must be one of {DIALECTS}")
    hints = _hints(rows)
    predicted = F.coalesce("predicted", F.lit(False))
    cpu, mem = F.lit(S.DEFAULT_CPU_M), F.lit(S.DEFAULT_MEM_MIB)
    double = S.HINT_LIMIT_FACTOR
    if dialect == "local":
        hinted = _has_hint(rows)
        from_prediction = [F.col(c) for c in _SIZES]
        from_hint = [hints["cpu"], hints["mem"], hints["cpu_limit"], hints["mem_limit"]]
    else:
        hinted = _positive_request(rows)
        p_cpu, p_mem = F.coalesce("cpu_m", F.lit(0)), F.coalesce("mem_mib", F.lit(0))
        h_cpu, h_mem = F.coalesce(hints["cpu"], F.lit(0)), F.coalesce(hints["mem"], F.lit(0))
        share = S.PREDICTION_LIMIT_FACTOR
        from_prediction = [p_cpu, p_mem, _times(p_cpu, share), _times(p_mem, share)]
        from_hint = [h_cpu, h_mem, _times(h_cpu, double), _times(h_mem, double)]
    default = [cpu, mem, _times(cpu, double), _times(mem, double)]
    names = ["cpu_request_m", "mem_request_mib", "cpu_limit_m", "mem_limit_mib"]
    sizes = [
        F.when(predicted, p).when(hinted, h).otherwise(d).cast("bigint").alias(name)
        for p, h, d, name in zip(from_prediction, from_hint, default, names)
    ]
    kept = [c for c in rows.columns if c not in (*_SIZES, "predicted")]
    return rows.select(*kept, *sizes)


def resolve_resources(tasks: DataFrame, predictions: DataFrame, dialect: str) -> DataFrame:
    """Sizes per task: prediction, else hint, else default; one row for each row of ``tasks``.

    A repeated task name has one prediction, the last in the document (without positions, the
    largest).
    """
    sizes = F.struct(*_SIZES)
    order = F.struct(*_position(predictions), sizes)
    last = predictions.groupBy(*TASK).agg(F.max_by(sizes, order).alias("p"))
    found = last.select(*TASK, "p.*", F.lit(True).alias("predicted"))
    return sized(tasks.join(found, TASK, "left"), dialect)
