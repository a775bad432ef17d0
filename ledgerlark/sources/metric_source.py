"""Metric logs in JSON lines as a data source, for tables and for streams.

Every line is an object with a whole ``step``; blank lines are skipped. A row is one key of a line, so
that logs with other keys have the same schema. Files are cut into ranges of bytes, and lines are read
and checked by the tasks that have their ranges. A line without its end is still being written: a
stream waits for it. Offsets of a stream are the bytes of each file that have been read.

Files are opened through Arrow's file systems: local and mounted paths, ``file:``, and the stores and
clusters that Arrow knows by their schemes.
"""

from __future__ import annotations

import io
import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from ledgerlark.sources.readers import SourceError, arrow_file

#: ``position`` is the byte at which a line begins; ``value`` has numbers, ``text`` any other value as JSON.
SCHEMA = "path string, position bigint, step bigint, metric string, value double, text string"
_ARROW = pa.schema([("path", pa.string()), ("position", pa.int64()), ("step", pa.int64()), ("metric", pa.string()), ("value", pa.float64()), ("text", pa.string())])
SPLIT_BYTES = 64 << 20
BATCH_ROWS = 10_000
#: Bytes that are read together when the end of the last whole line is looked for.
BACK = 1 << 16


@dataclass
class Range(InputPartition):
    """The lines of a file that begin from ``first`` on and before ``past``; ``whole`` if only lines with
    their ends count."""

    path: str
    first: int
    past: int
    whole: bool


def listed(path: str) -> dict[str, int]:
    """Bytes of the log's files by path: of the file itself, or of all below a folder but hidden ones."""
    system, where = arrow_file(path)
    info = system.get_file_info(where)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(where, recursive=True, allow_not_found=True))
    top = len(where.rstrip("/").split("/"))
    shown = lambda f: info.type == fs.FileType.File or not any(p[:1] in "._" for p in f.path.split("/")[top:])
    return {f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and shown(f)}


def end_of_lines(file: Any, size: int, known: int) -> int:
    """Where the last whole line ends, looked for from the end back to a place that is known to be one."""
    past = size
    while past > known:
        first = max(known, past - BACK)
        at = file.read_at(past - first, first).rfind(b"\n")
        if at >= 0:
            return first + at + 1
        past = first
    return known


def lines(file: Any, part: Range) -> Iterator[tuple[int, bytes, bool]]:
    """(position, line, whether it has its end) of the lines that begin in a range."""
    at = part.first
    if at:
        # A line that begins before the range belongs to another task.
        file.seek(at - 1)
        at += len(file.readline()) - 1
    else:
        file.seek(0)
    while at < part.past:
        line = file.readline()
        if not line:
            return
        yield at, line, line.endswith(b"\n")
        at += len(line)


def checked(line: bytes, where: str) -> dict[str, Any]:
    """The object of a line with a whole step; anything else is an error that names its place."""
    try:
        value = json.loads(line)
    except ValueError:
        raise SourceError(f"{where} is not JSON") from None
    if not isinstance(value, dict) or type(value.get("step")) is not int:
        raise SourceError(f"{where} has no whole step")
    return value


#: What a filter says of a value.
_TESTS: dict[type, Callable[[Any, Any], bool]] = {
    EqualTo: lambda x, v: x == v,
    GreaterThan: lambda x, v: x > v,
    GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v,
    LessThanOrEqual: lambda x, v: x <= v,
    In: lambda x, v: x in v,
}


def _taken(f: Filter) -> bool:
    return getattr(f, "attribute", None) in (("step",), ("metric",)) and (type(f) in _TESTS or type(f) is IsNotNull) and getattr(f, "value", 0) is not None


class _Log:
    def __init__(self, options: Any) -> None:
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT_BYTES))
        self.finite = str(options.get("finite", "false")).lower() == "true"
        self.filters: list[tuple[str, type, Any]] = []

    def ranges(self, path: str, first: int, past: int, whole: bool) -> list[Range]:
        return [Range(path, a, min(a + self.split, past), whole) for a in range(first, past, self.split)]

    def kept(self, column: str, x: Any) -> bool:
        return all(_TESTS[kind](x, v) for name, kind, v in self.filters if name == column)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, _ = arrow_file(self.path)
        rows: list[tuple] = []
        with system.open_input_file(partition.path) as raw:
            for at, line, ended in lines(io.BufferedReader(raw, 1 << 20), partition):
                if not line.strip():
                    continue
                if not ended:
                    if partition.whole:
                        return
                    try:
                        json.loads(line)
                    except ValueError:
                        break  # still being written
                value = checked(line, f"{partition.path}, byte {at},")
                if not self.kept("step", value["step"]):
                    continue
                for k, v in value.items():
                    if k == "step" or not self.kept("metric", k):
                        continue
                    number = isinstance(v, (int, float)) and not isinstance(v, bool)
                    if self.finite and number and not math.isfinite(v):
                        raise SourceError(f"{partition.path}, byte {at}, has {k} = {v}")
                    rows.append((partition.path, at, value["step"], k, float(v) if number else None, None if number else json.dumps(v, sort_keys=True, ensure_ascii=False)))
                if len(rows) >= BATCH_ROWS:
                    yield self.batch(rows)
                    rows = []
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: Sequence[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class TableReader(_Log, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of step and metric with constants are taken; steps and metrics are never null."""
        for f in filters:
            if not _taken(f):
                yield f
            elif type(f) is not IsNotNull:
                self.filters.append((f.attribute[0], type(f), f.value))

    def partitions(self) -> list[Range]:
        files = listed(self.path)
        if not sum(files.values()):
            raise SourceError(f"no metrics in {self.path}")
        return [r for path, size in files.items() for r in self.ranges(path, 0, size, False)]


class StreamReader(_Log, DataSourceStreamReader):
    def __init__(self, options: Any) -> None:
        super().__init__(options)
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, _ = arrow_file(self.path)
        for path, size in listed(self.path).items():
            known = self.known.get(path, 0)
            if size > known:
                with system.open_input_file(path) as raw:
                    self.known[path] = end_of_lines(raw, size, known)
        return {path: past for path, past in self.known.items() if past}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        if lost := sorted(path for path, past in start.items() if end.get(path, 0) < past):
            raise SourceError(f"lines that were read are no longer there: {', '.join(lost)}")
        return [r for path, past in sorted(end.items()) for r in self.ranges(path, start.get(path, 0), past, True)]

    def commit(self, end: dict) -> None:
        self.known = {**self.known, **{path: max(past, self.known.get(path, 0)) for path, past in end.items()}}


class MetricLog(DataSource):
    """Format ``metric_log``. Options: ``path``; ``splitBytes`` (64 MB); ``finite`` (true makes numbers that
    aren't finite an error)."""

    @classmethod
    def name(cls) -> str:
        return "metric_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> TableReader:
        return TableReader(self.options)

    def streamReader(self, schema: Any) -> StreamReader:
        return StreamReader(self.options)


def _format(spark: SparkSession, reader: Any, path: str, options: dict[str, Any]) -> DataFrame:
    spark.dataSource.register(MetricLog)
    # Without this, a source that takes filters is refused when it is planned.
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return reader.format("metric_log").options(**options).load(path)


def metric_rows(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """(path, position, step, metric, value, text) of a log as it is now; a log without a byte is an error,
    and so is a line that is no object with a whole step."""
    return _format(spark, spark.read, path, options)


def metric_stream(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """The same rows as a stream, each line once its end has been written. A log that does not exist yet is
    empty; one that has been cut is an error."""
    return _format(spark, spark.readStream, path, options)
