"""Diagnostics of groups of completions that arrive over many micro-batches.

The completions of one example need not come together, so what is known of an example is kept as
state: how often each text has come, and the moments of its reward. Both are one streaming aggregation,
keyed by example and text and by example alone: rows are combined where they are scored, so that an
example with a third of all rows sends each task's sums only, and its texts are the work of many tasks.

Only groups or texts that time closes need a processor of their own. There a group is dealt to ``SALTS``
keys by the text; a text always meets its repeats, and moments of parts add up exactly. It asks the state
store several times for every text, so it costs some hundred times what the aggregation does.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ledgerlark.operators.scoring import CONSTANT
from ledgerlark.streaming import runs

SALTS = 16
#: One part of a group, as of a batch: ``since`` tells parts of one key apart that idle time has closed. With
#: ``text_hash`` it is one text's repeats, and nothing else.
PART = "example_id string, text_hash binary, salt int, since bigint, n bigint, duplicates bigint, mean double, m2 double, closed boolean"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Part(StatefulProcessor):
    """Texts and moments of the part of a group under one key."""

    def __init__(self, idle_ms: int | None = None, ttl_ms: int | None = None) -> None:
        self.idle_ms, self.ttl_ms = idle_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.texts = handle.getMapState("texts", "text_hash string", "n bigint", self.ttl_ms)
        self.sums = handle.getValueState("sums", "since bigint, n bigint, duplicates bigint, mean double, m2 double", self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.idle_ms else 0
        since, n, duplicates, mean, m2 = self.sums.get() or (now, 0, 0, 0.0, 0.0)
        texts: Counter[str] = Counter()
        for row in rows:
            n += 1
            texts[row["text_hash"]] += 1
            off = row["reward"] - mean
            mean += off / n
            m2 += off * (row["reward"] - mean)
        for text, count in texts.items():
            before = self.texts.getValue((text,))
            duplicates += count - (before is None)
            self.texts.updateValue((text,), ((before[0] if before else 0) + count,))
        self.sums.update((since, n, duplicates, mean, m2))
        if self.idle_ms:
            for at in [t for batch in self.handle.listTimers() for t in batch]:
                self.handle.deleteTimer(at)
            self.handle.registerTimer(now + self.idle_ms)
        yield Row(example_id=key[0], text_hash=None, salt=key[1], since=since, n=n, duplicates=duplicates, mean=mean, m2=m2, closed=False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        kept = self.sums.get()
        self.texts.clear()
        self.sums.clear()
        if kept is not None:
            since, n, duplicates, mean, m2 = kept
            yield Row(example_id=key[0], text_hash=None, salt=key[1], since=since, n=n, duplicates=duplicates, mean=mean, m2=m2, closed=True)

    def close(self) -> None:
        pass


def parts(completions: DataFrame, example: Column, text: Column, reward: Column, *, salts: int = SALTS, idle_ms: int | None = None, ttl_ms: int | None = None) -> DataFrame:
    """The stream of changed parts of groups, as in PART: after every batch those that it touched, of texts
    those that have come again.

    A null example is a group of its own, a null text counts as the empty one, a null or NaN reward as 0.
    With ``idle_ms`` a part that nothing comes to for so long is closed and forgotten; with ``ttl_ms`` texts
    are, so that later repeats of them are no duplicates; only these are dealt to ``salts`` keys."""
    value = F.coalesce(F.nanvl(reward.cast("double"), F.lit(0.0)), F.lit(0.0))
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    rows = completions.select(example.cast("string").alias("example_id"), digest.alias("text_hash"), value.alias("reward"))
    if not (idle_ms or ttl_ms):
        return _untimed(rows)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("text_hash"), F.lit(salts)).cast("int"))
    return rows.groupBy("example_id", "salt").transformWithState(Part(idle_ms, ttl_ms), PART, "Update", "ProcessingTime" if idle_ms else "None")


def _untimed(rows: DataFrame) -> DataFrame:
    """Parts that last: one aggregation holds the moments of every example, under no text, and counts its texts."""
    text = F.explode(F.array(F.lit(None).cast("binary"), F.unhex("text_hash"))).alias("text_hash")
    sums = rows.select("example_id", text, "reward").groupBy("example_id", "text_hash").agg(F.count("*").alias("n"), F.avg("reward").alias("mean"), F.var_pop("reward").alias("variance"))
    group = F.col("text_hash").isNull()
    held = lambda c, kind: F.when(group, c).otherwise(F.lit(0)).cast(kind)
    return sums.where(group | (F.col("n") > 1)).select(
        "example_id", "text_hash", F.lit(0).alias("salt"), F.lit(0).cast("bigint").alias("since"), held(F.col("n"), "bigint").alias("n"), F.when(group, 0).otherwise(F.col("n") - 1).cast("bigint").alias("duplicates"),
        held(F.col("mean"), "double").alias("mean"), held(F.col("variance") * F.col("n"), "double").alias("m2"), F.lit(False).alias("closed"),
    )


@contextmanager
def map_state(spark: SparkSession) -> Iterator[None]:
    """A state store that has maps, timers and times to live, and keeps its rows on disk, for streams begun within."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def follow(spark: SparkSession, completions: DataFrame, folder: str, config: Mapping[str, Any], example: Column, text: Column, reward: Column, *, resume: bool = False, stop: runs.Stop | None = None, each: Callable[[dict[str, Any]], None] | None = None, **options: Any) -> str:
    """Keep the groups of a stream of completions in a run (``runs.run``)."""
    with map_state(spark):
        return runs.run(spark, parts(completions, example, text, reward, **options), lambda rows: rows, folder, config, resume=resume, stop=stop, each=each, output="update")


def groups(spark: SparkSession, folder: str) -> DataFrame:
    """(example_id, n, duplicates, mean, variance) of all completions so far: the newest state of every part,
    added up by example."""
    newest = runs.batches(spark, folder).groupBy("example_id", "text_hash", "salt", "since")
    state = F.max_by(F.struct("n", "duplicates", "mean", "m2"), F.struct("batch", F.col("closed").cast("int"))).alias("s")
    each = newest.agg(state).select("example_id", "text_hash", "s.*")
    moments = F.when(F.col("text_hash").isNull(), F.struct("n", "mean", "m2"))
    # An example has one part with moments, or at most as many as there are salts and those that idle time has closed.
    whole = each.groupBy("example_id").agg(F.sum("n").alias("n"), F.sum("duplicates").alias("duplicates"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.collect_list(moments).alias("p"))
    moved = F.transform("p", lambda x: x["m2"] + x["n"] * (x["mean"] - F.col("mean")) * (x["mean"] - F.col("mean")))
    return whole.select("example_id", "n", "duplicates", "mean", (F.aggregate(moved, F.lit(0.0), lambda a, x: a + x) / F.col("n")).alias("variance"))


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Share of repeated completions, mean variance within examples, share of constant examples; one row."""
    found = groups(spark, folder)
    return found.agg(
        F.coalesce(F.sum("duplicates") / F.sum("n"), F.lit(0.0)).alias("duplicate_fraction"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.avg("variance"), F.lit(0.0)).alias("mean_variance"),
        F.coalesce(F.avg((F.col("variance") <= CONSTANT).cast("int")), F.lit(0.0)).alias("zero_variance_fraction"),
        F.count("*").alias("n_groups"),
    )
