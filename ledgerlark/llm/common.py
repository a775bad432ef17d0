"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_UPPER = bytes(range(0x41, 0x5B))
_LOWER = bytes(range(0x61, 0x7B))
#: A-Z to a-z, every other byte as it is.
LOWER = bytes.maketrans(_UPPER, _LOWER)
#: As LOWER, and each byte outside ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` (after lower-casing) to a
#: blank, so that ``split()`` yields the words. Bytes over 0x7F belong to words.
WORDS = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)


def words_of(raw: bytes | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 text; null has none."""
    return raw.translate(WORDS).split() if raw else []


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of an Arrow string column, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_of(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of the documents table, dealt to all cores where its files make fewer tasks: what is done
    to a text costs far more than to move it once."""
    df = table(spark, sf_dir, "documents").select(*columns)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Bytes of one Arrow batch of texts. What a worker makes of a batch is several times as large, and the
#: bound that Spark has by itself, 64 MB, is held by the executor and its worker at once.
BATCH_BYTES = 4 << 20


def bound_batches(df: DataFrame) -> None:
    """Bound Arrow batches of the session by BATCH_BYTES, unless it has a bound of its own. Rows that are
    larger go one by one; how many rows a batch may hold stays as it is."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) in ("67108864b", "64MB"):
        conf.set(key, str(BATCH_BYTES))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _tables(spark: SparkSession) -> str:
    """The folder of this application's tables under ``spark.checkpoint.dir``, which driver and executors
    share. A session of one machine that names none has them in its temporary folder; any other must."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"{tempfile.gettempdir()}/ledgerlark"
    return f"{base.rstrip('/')}/llm-{spark.sparkContext.applicationId}"


def shared_dir(spark: SparkSession) -> str:
    """A new folder for one table of this application."""
    return f"{_tables(spark)}/{uuid.uuid4().hex}"


def remove_tables(spark: SparkSession) -> None:
    """Delete all tables that operators have written in this application. Results that are not yet
    written read them, so this is for when they are."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at replicated files, which
    outlive a lost executor, and what follows sees one evaluation of nondeterministic columns."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
