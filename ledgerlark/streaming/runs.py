"""Runs of a stream that stop at the end of a batch and go on under the configuration they began with.

A run is a folder: the frozen configuration, the state of the stream, the batches of its sink, and a
marker once everything has been read. The folder is on any file system that Spark reads.
"""

from __future__ import annotations

import signal
import threading
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from typing import Any

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ledgerlark.functions.hashing import canonical_json
from ledgerlark.sinks import files

FROZEN, COMPLETE = "frozen_config.json", "training_complete.json"
#: Said by a batch that must not begin, and looked for in the error of the query that it ends.
HELD_BACK = "held back: the run stops between batches"


class ResumeError(RuntimeError):
    """A run that can't be begun, or gone on with, as asked."""


class Stop:
    """A wish to stop, made by a signal, by a batch number or by hand, and granted between batches."""

    def __init__(self, after_batch: int | None = None) -> None:
        self.asked = threading.Event()
        self.after_batch = after_batch

    def ask(self, *_: Any) -> None:
        self.asked.set()

    def batch_over(self, batch_id: int) -> None:
        if self.after_batch is not None and batch_id >= self.after_batch:
            self.ask()

    @contextmanager
    def on(self, *signals: int) -> Iterator[Stop]:
        """Ask on these signals (SIGTERM and SIGUSR1 by default); the handlers before come back at the end."""
        before = {s: signal.signal(s, self.ask) for s in signals or (signal.SIGTERM, signal.SIGUSR1)}
        try:
            yield self
        finally:
            for s, handler in before.items():
                signal.signal(s, handler)


class BatchLog(StreamingQueryListener):
    """Keeps the progress of one query's batches, calls ``each`` with it, and stops the query between batches
    once that is asked for."""

    def __init__(self, spark: SparkSession, stop: Stop, each: Callable[[dict[str, Any]], None] | None = None) -> None:
        self.spark, self.stop, self.each = spark, stop, each
        self.query: StreamingQuery | None = None
        self.batches: list[dict[str, Any]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress, query = event.progress, self.query
        if query is None or str(progress.id) != str(query.id):
            return
        self.batches.append({"batch": progress.batchId, "rows": progress.numInputRows, "at": progress.timestamp})
        if self.each is not None:
            self.each(self.batches[-1])
        if self.stop.asked.is_set():
            # The listener's own thread must go on, as the query reports its end to it.
            threading.Thread(target=query.stop, daemon=True).start()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def differences(frozen: Mapping[str, Any], now: Mapping[str, Any], at: str = "") -> list[str]:
    """Paths of settings that one configuration has otherwise than the other, or not at all."""
    out = []
    for k in sorted({*frozen, *now}):
        a, b = frozen.get(k, ...), now.get(k, ...)
        if isinstance(a, Mapping) and isinstance(b, Mapping):
            out += differences(a, b, f"{at}{k}.")
        elif a is ... or b is ... or canonical_json(a) != canonical_json(b):
            out.append(f"{at}{k}")
    return out


def claim(spark: SparkSession, folder: str, config: Mapping[str, Any], *, resume: bool, bookkeeping: Sequence[str] = ("_config_path",)) -> None:
    """Begin a run in a new folder, or go on with one whose frozen configuration is the same but for settings
    that only keep books. A folder in use, one that is complete, one that isn't there, and any other
    configuration are errors."""
    kept = {k: v for k, v in config.items() if k not in bookkeeping}
    path = f"{folder}/{FROZEN}"
    if not resume:
        try:
            files.create(spark, path, files.sealed(kept))
        except FileExistsError:
            raise ResumeError(f"{folder} is in use; it can be resumed, not begun again") from None
        return
    if not files.exists(spark, path):
        raise ResumeError(f"{folder} holds no run to resume")
    if files.exists(spark, f"{folder}/{COMPLETE}"):
        raise ResumeError(f"the run in {folder} is complete")
    frozen = files.opened(files.read_text(spark, path))
    if frozen is None:
        raise ResumeError(f"the configuration in {path} is damaged")
    if canonical_json(frozen) != canonical_json(kept):
        raise ResumeError(f"settings differ from the frozen ones: {', '.join(differences(frozen, kept))}")


def run(spark: SparkSession, stream: DataFrame, batch: Callable[[DataFrame], DataFrame], folder: str, config: Mapping[str, Any], *, resume: bool = False, stop: Stop | None = None, each: Callable[[dict[str, Any]], None] | None = None, output: str = "append") -> str:
    """Write what ``batch`` makes of every micro-batch to ``folder``/sink, and return ``complete`` or
    ``stopped``.

    A batch writes the folder of its number, and writes it anew if it is tried again, so nothing counts
    twice, whether a run stops between batches, is killed within one, or loses an executor. A run that was
    stopped is resumed by the same call with ``resume`` and an equal configuration.
    """
    claim(spark, folder, config, resume=resume)
    stop = stop or Stop()
    log = BatchLog(spark, stop, each)

    def write(rows: DataFrame, batch_id: int) -> None:
        if stop.asked.is_set():
            raise RuntimeError(HELD_BACK)
        batch(rows).write.mode("overwrite").parquet(f"{folder}/sink/batch={batch_id}")
        stop.batch_over(batch_id)

    spark.streams.addListener(log)
    try:
        log.query = stream.writeStream.foreachBatch(write).outputMode(output).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        log.query.awaitTermination()
    except StreamingQueryException as e:
        if not (stop.asked.is_set() and HELD_BACK in str(e)):
            raise
        return "stopped"
    finally:
        spark.streams.removeListener(log)
    if stop.asked.is_set():
        return "stopped"
    files.create(spark, f"{folder}/{COMPLETE}", files.sealed({"state": "complete"}))
    return "complete"


def batches(spark: SparkSession, folder: str) -> DataFrame:
    """What the batches of a run have written so far, with the number of each as ``batch``."""
    return spark.read.parquet(f"{folder}/sink").withColumn("batch", F.col("batch").cast("bigint"))
