"""Writers: tables that refuse to overwrite, CSV and JSON documents, inventories and atomic publication."""

from __future__ import annotations

import csv
import json
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions.hashing import text_sha256
from ledgerlark.operators.integrity import tree_hash
from ledgerlark.sources.readers import file_listing


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir``. A session of one machine
    that names none has it in its temporary folder; any other must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_dataset(df: DataFrame, path: str, *partition_by: str) -> None:
    """A Parquet dataset; an existing one is an error. Reads of one family prune the others if it is
    partitioned by family."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_json(df: DataFrame, path: str) -> None:
    """Append rows to a JSON-lines log."""
    df.write.mode("append").json(path)


def write_json(path: str | Path, value: Any) -> None:
    """A document with sorted keys; an existing file is an error."""
    with open(path, "x", encoding="utf-8") as f:
        f.write(json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False, allow_nan=False) + "\n")


def write_yaml(path: str | Path, value: Any) -> None:
    """A configuration, with sorted keys; an existing file is an error. Without a YAML library it is
    written as JSON, which is YAML too."""
    try:
        import yaml
    except ImportError:
        write_json(path, value)
        return
    with open(path, "x", encoding="utf-8") as f:
        yaml.safe_dump(value, f, sort_keys=True, allow_unicode=True)


def utc_now() -> str:
    """The time in UTC, as ISO 8601 with its offset."""
    return datetime.now(UTC).isoformat()


def stamp() -> str:
    """The time in UTC, compact, for names."""
    return datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ")


def write_csv(df: DataFrame, path: str | Path, columns: Sequence[str], order: Sequence[str]) -> int:
    """A report table as one CSV file with CRLF line ends; a column of ``columns`` that the table lacks
    is empty, one that it has besides is an error, and so is an existing file. Rows come to the driver
    one partition at a time; for reports, not for corpora."""
    if extra := sorted(set(df.columns) - set(columns)):
        raise ValueError(f"columns without a place: {extra}")
    present = [c for c in columns if c in df.columns]
    n = 0
    with open(path, "x", newline="", encoding="utf-8") as f:
        out = csv.DictWriter(f, fieldnames=list(columns), restval="")
        out.writeheader()
        for row in df.select(*present).orderBy(*order).toLocalIterator():
            out.writerow(row.asDict())
            n += 1
    return n


def write_inventory(listing: DataFrame, path: str) -> None:
    """``<hash>  <path>`` lines in the order of paths."""
    listing.orderBy("path").select(F.concat_ws("  ", "sha256", "path").alias("value")).coalesce(1).write.mode("errorifexists").text(path)


def mark_ready(folder: str | Path, manifest: str | Path, name: str = "_READY") -> str:
    """A marker with the digest of the manifest; it can be written once."""
    digest = text_sha256(Path(manifest).read_bytes())
    with open(Path(folder) / name, "x", encoding="utf-8") as f:
        f.write(digest + "\n")
    return digest


def is_ready(folder: str | Path, manifest: str | Path, name: str = "_READY") -> bool:
    marker = Path(folder) / name
    return marker.is_file() and Path(manifest).is_file() and marker.read_text().strip() == text_sha256(Path(manifest).read_bytes())


@contextmanager
def published(target: str | Path) -> Iterator[Path]:
    """A hidden folder beside the target that becomes the target if all goes well, else is removed. On a
    cluster the target is on a file system that driver and executors mount alike."""
    target = Path(target)
    if target.exists():
        raise FileExistsError(target)
    staging = target.parent / f".{target.name}.{uuid.uuid4().hex}"
    staging.mkdir(parents=True)
    try:
        yield staging
        os.replace(staging, target)
    except BaseException:
        shutil.rmtree(staging, ignore_errors=True)
        raise


def output_manifest(spark, folder: str) -> dict[str, Any]:
    """Digests of every file of a folder, with that of the whole tree."""
    listing = file_listing(spark, folder)
    whole = tree_hash(listing, size="size_bytes").first().asDict()
    return whole | {"files": [r.asDict() for r in listing.orderBy("path").toLocalIterator()]}


def write_pointer(path: str | Path, folder: str | Path, root: str | Path) -> None:
    """A one-line file that names a folder below ``root``."""
    with open(path, "x", encoding="utf-8") as f:
        f.write(Path(folder).resolve().relative_to(Path(root).resolve()).as_posix() + "\n")
