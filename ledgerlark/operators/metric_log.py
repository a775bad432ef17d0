"""Training-metric logs: dynamic columns, curves, fallbacks and gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.text import finite


def to_long(log: DataFrame, *keys: str) -> DataFrame:
    """(keys, metric, value) of every numeric column of a wide log."""
    numeric = [f.name for f in log.schema.fields if f.name not in keys and f.dataType.typeName() in ("double", "float", "long", "integer")]
    return log.unpivot(list(keys), [F.col(f"`{c}`").cast("double").alias(c) for c in numeric], "metric", "value").where("value is not null") if numeric else log.select(*keys).limit(0)


def curve(long: DataFrame, metric: Column, *, model: str = "model_key", step: str = "step") -> DataFrame:
    """Mean of a metric by model and step."""
    return long.where(metric).groupBy(model, step).agg(F.avg("value").alias("value"), F.count("*").alias("n"))


def fallback(long: DataFrame, candidates: Sequence[str], *, model: str = "model_key") -> DataFrame:
    """Of each model the first candidate that has a finite point; null if none has."""
    named = F.array(*[F.lit(c) for c in candidates])
    at = F.when(finite(F.col("value")), F.nullif(F.array_position(named, F.col("metric")), F.lit(0)))
    first = long.groupBy(model).agg(F.min(at).alias("_at"))
    # element_at of a literal array takes a null position for the first one.
    return first.select(model, F.when(F.col("_at").isNotNull(), F.element_at(named, F.col("_at").cast("int"))).alias("metric"))


def with_suffix(columns: Sequence[str], suffix: str) -> list[str]:
    """Names of the dynamic columns that end so."""
    return sorted(c for c in columns if c.endswith(suffix))


def gate(long: DataFrame, metric: Column, *, by: str) -> DataFrame:
    """Rows, least value and whether the log passes: only finite values, and one of the metric in [0, 1)."""
    value = F.col("value")
    return long.groupBy(by).agg(
        F.count_if(metric).alias("n"),
        F.min(F.when(metric, value)).alias("least"),
        F.coalesce(F.bool_and(finite(value)) & F.bool_or(metric & (value >= 0) & (value < 1)), F.lit(False)).alias("passes"),
    )


def bad_steps(log: DataFrame, step: str = "step") -> DataFrame:
    """Rows without a step, or with one that isn't whole."""
    return log.where(F.col(step).isNull() | (F.col(step) != F.floor(step)))
