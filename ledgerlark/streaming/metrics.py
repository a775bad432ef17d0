"""Metrics of completions while they arrive: micro-batches, exactly once per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlark.functions.text import stripped
from ledgerlark.operators import scoring as S

GROUP = ("event_type",)


def follow(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, *, fmt: str = "parquet", files_a_batch: int = 64) -> StreamingQuery:
    """Read all new files of a folder, append per-batch partial sums to the sink, and stop.

    Each batch writes a folder named by its number, which a retried batch overwrites, so a restart
    counts nothing twice. ``totals`` adds the batches up."""

    def write(batch: DataFrame, batch_id: int) -> None:
        parts = batch.groupBy(*GROUP).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("greatest"))
        parts.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).format(fmt).load(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, sink: str) -> DataFrame:
    """The metrics of all batches so far."""
    parts = spark.read.parquet(sink)
    return parts.groupBy(*GROUP).agg(F.sum("n").alias("n"), F.round(F.sum("total"), 6).alias("total"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))


def completion_metrics(completions: DataFrame, weights: S.Weights = S.Weights(), **scoring) -> DataFrame:
    """One row of the diagnostics of a batch of completions: component means, failure fractions,
    duplicates and variance of the total within examples; of no rows, zeros."""
    scored = S.score(completions, weights, **scoring).persist()
    parts = (
        S.component_means(scored),
        S.failure_fractions(scored, F.col("score.status")),
        S.duplicate_fraction(scored, "example_id", stripped(F.col("completion"))).drop("n"),
        S.group_variance(scored, "example_id", F.col("score.total")),
    )
    try:
        values: dict = {}
        for part in parts:
            values |= part.first().asDict()
    finally:
        scored.unpersist()
    columns = [F.lit(v).cast("bigint" if k.startswith("n") else "double").alias(k) for k, v in values.items()]
    return completions.sparkSession.range(1).select(*columns)


def follow_completions(
    spark: SparkSession, source: str, schema, sink: str, checkpoint: str, *, completions: Callable[[DataFrame], DataFrame] = lambda batch: batch,
    weights: S.Weights = S.Weights(), fmt: str = "parquet", files_a_batch: int = 64, **scoring,
) -> StreamingQuery:
    """Read all new files of a folder and write ``completion_metrics`` of each micro-batch, then stop.

    ``completions`` makes the columns that scoring reads from those of the files. As in ``follow``, a
    retried batch overwrites its folder; read back, the sink has the number of the batch as ``batch``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        completion_metrics(completions(batch), weights, **scoring).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).format(fmt).load(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Counts and sums by event-time window, with late rows let in for ``late``."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), *GROUP).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
