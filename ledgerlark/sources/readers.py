"""Readers: sample logs, results, metric logs, datasets, file listings and hash manifests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.functions.hashing import prefix_id, sha256
from ledgerlark.functions.text import in_domain

SAMPLE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("doc_hash", T.StringType()),
        T.StructField("doc", T.StructType([T.StructField("task_type", T.StringType()), T.StructField("supercategory", T.StringType())])),
        T.StructField("metrics", T.ArrayType(T.StringType())),
        T.StructField("avg_accuracy", T.DoubleType()),
    ]
)
#: Parts of a path whose files belong to no tree.
IGNORED = (".git", "__pycache__", ".pytest_cache", ".cache")


#: Files of so many bytes don't become one value.
LARGE = 1 << 28


class SourceError(ValueError):
    """A source that can't be read as what it should be."""


def samples(spark: SparkSession, root: str, schema: T.StructType = SAMPLE) -> DataFrame:
    """Rows of every ``samples*.jsonl`` under a folder, with their path; a line that isn't JSON is kept
    in ``corrupt``."""
    full = T.StructType([*schema.fields, T.StructField("corrupt", T.StringType())])
    reader = spark.read.schema(full).option("recursiveFileLookup", True).option("pathGlobFilter", "samples*.jsonl")
    return reader.option("columnNameOfCorruptRecord", "corrupt").json(root).withColumn("path", F.col("_metadata.file_path"))


def first_valid_results(spark: SparkSession, root: str, task: str, metrics: Sequence[str] = ("pass_at_1", "pass_at_3", "avg_accuracy")) -> DataFrame:
    """The metrics of the first results file, in the order of paths, that has them all in [0, 1]."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "results*.json").text(root, wholetext=True)
    # Keys of metrics hold a comma, so they are looked up in a map, not by path.
    body = F.from_json("value", "results map<string, map<string, string>>")["results"][task]
    values = files.select(F.col("_metadata.file_path").alias("path"), *[F.try_element_at(body, F.lit(f"{m},all")).try_cast("double").alias(m) for m in metrics])
    valid = values.where(F.forall(F.array(*metrics), lambda x: in_domain(x)))
    return valid.agg(*[F.min_by(c, "path").alias(c) for c in ("path", *metrics)]).where("path is not null")


def metric_log(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines metric log with the union of all keys as columns; blank lines are skipped. Lines
    that aren't objects, missing steps and an empty log are errors."""
    raw = spark.read.text(path).where("trim(value) <> ''")
    bad = raw.where(~F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False)) | F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json("value"), "$.step", "variant")) != "BIGINT", F.lit(True)))
    if raw.isEmpty():
        raise SourceError(f"no metrics in {path}")
    if not bad.isEmpty():
        raise SourceError(f"lines without a whole step in {path}")
    return spark.read.json(path)


def dataset(spark: SparkSession, path: str, task_family: str | None = None) -> DataFrame:
    """A frozen dataset; of one written by family only the partition asked for is read."""
    df = spark.read.parquet(path)
    return df.where(F.col("task_family") == task_family) if task_family else df


def pool(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text pool with their identity; blank ones are an error, repeated ones stay."""
    rows = spark.read.text(path).select(F.trim("value").alias("smiles"))
    if not rows.where("smiles = ''").isEmpty():
        raise SourceError(f"blank lines in {path}")
    return rows.select(prefix_id(F.col("smiles")).alias("molecule_id"), "smiles")


#: Bytes that are hashed together.
CHUNK = 1 << 20


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the SHA-256 of each file, read chunk by chunk through Arrow's file systems."""
    for batch in batches:
        digests = []
        for url in batch.column("url").to_pylist():
            system, where = arrow_file(url)
            digest = hashlib.sha256()
            with system.open_input_stream(where) as stream:
                while chunk := stream.read(CHUNK):
                    digest.update(chunk)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("size_bytes"), pa.array(digests, pa.string())], names=["path", "size_bytes", "sha256"])


def arrow_file(url: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a path, and the path there."""
    if url.startswith("file:"):
        url = "/" + url.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), url) if "://" not in url else fs.FileSystem.from_uri(url)


def file_listing(spark: SparkSession, root: str, ignored: Sequence[str] = IGNORED) -> DataFrame:
    """(path below the folder, size_bytes, sha256) of every file whose path has no ignored part.

    Contents are hashed by tasks: files of less than LARGE bytes as one value each, larger ones chunk by
    chunk, and so those that the file sources leave out: empty files and names with a leading dot or
    underscore, as markers have them. Only names and sizes pass through the driver.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(root.rstrip("/"))
    # An address may be written in several ways; the path in it is the same in all.
    base = top.toUri().getPath()
    path = F.regexp_replace(F.col("path"), f"^.*?{_quoted(base)}/", "")
    listed = files.where((F.col("length") > 0) & (F.col("length") < LARGE)).select(path.alias("path"), F.col("length").alias("size_bytes"), sha256(F.col("content")).alias("sha256"))
    found, rest = top.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(top, True), []
    while found.hasNext():
        status = found.next()
        url = status.getPath().toString()
        name = url.split(f"{base}/", 1)[1]
        if not 0 < status.getLen() < LARGE or any(p[0] in "._" for p in name.split("/")):
            rest.append((name, status.getLen(), url))
    listed = listed.where(~F.exists(F.split("path", "/"), lambda p: p.startswith("_") | p.startswith(".")))
    if rest:
        others = spark.createDataFrame(rest, "path string, size_bytes bigint, url string").repartition(min(len(rest), spark.sparkContext.defaultParallelism))
        listed = listed.unionByName(others.mapInArrow(_hashed, "path string, size_bytes bigint, sha256 string"))
    return listed.where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(i) for i in ignored]))) if ignored else listed


def _quoted(text: str) -> str:
    import re

    return re.escape(text)


def hash_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of ``<hash>  <path>`` lines; a malformed line or a repeated path is an error."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    rows = lines.select(F.regexp_extract("value", r"^([0-9a-f]{64}) [ *](.+)$", 1).alias("sha256"), F.regexp_extract("value", r"^([0-9a-f]{64}) [ *](.+)$", 2).alias("path"))
    bad = rows.where((F.col("sha256") == "") | F.col("path").startswith("/") | F.array_contains(F.split("path", "/"), ".."))
    if not bad.isEmpty() or not rows.groupBy("path").count().where("count > 1").isEmpty():
        raise SourceError(f"{path} is no hash manifest")
    return rows.select("path", "sha256")


def completed_runs(spark: SparkSession, root: str, marker: str = "_COMPLETE") -> DataFrame:
    """(model_key, run) of every ``<model>/<run>/<marker>`` below a folder. The file sources skip names
    with a leading underscore, so the markers (one a run) are listed through Hadoop's file system."""
    jvm = spark._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/*/*/{marker}")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    parts = [f.getPath().toString().split("/") for f in found]
    return spark.createDataFrame([(p[-3], p[-2]) for p in parts], "model_key string, run string")


def single_runs(runs: DataFrame, models: Sequence[str]) -> dict[str, str]:
    """The one completed run of each model of a registry; none, or several, are an error."""
    found: dict[str, list[str]] = {m: [] for m in models}
    for model, run in runs.where(F.col("model_key").isin(*models)).collect():
        found[model].append(run)
    if bad := {m: r for m, r in found.items() if len(r) != 1}:
        raise SourceError(f"runs by model: {bad}")
    return {m: r[0] for m, r in found.items()}


def key_values(text: Column, pair: str = "\n", separator: str = "=") -> Column:
    """Map of the ``key=value`` lines of a record."""
    return F.str_to_map(text, F.lit(pair), F.lit(separator))


def comma_rows(text: Column, columns: Sequence[str]) -> Column:
    """Lines of comma-separated output of a command as an array of structs: blank lines are skipped, values
    stripped, and what is over the last column stays in it."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.trim(line) != "")
    return F.transform(lines, lambda line: F.struct(*[F.trim(F.get(F.split(line, ",", len(columns)), F.lit(i))).alias(c) for i, c in enumerate(columns)]))
