"""Small documents on whatever file system Spark reads: read, listed, and created only if absent."""

from __future__ import annotations

import json
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ledgerlark.functions.hashing import canonical_json, text_sha256


def _at(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    where = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def sizes(spark: SparkSession, folder: str) -> dict[str, int]:
    """Bytes of the files right in a folder by name; none if there is no such folder."""
    fs, where = _at(spark, folder)
    if not fs.exists(where):
        return {}
    return {s.getPath().getName(): s.getLen() for s in fs.listStatus(where) if s.isFile()}


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = _at(spark, path)
    stream = fs.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def create(spark: SparkSession, path: str, text: str) -> None:
    """A new file; FileExistsError if there is one, also if another writer has been faster.

    The file system decides who is first; where it has no exclusive creation, the content is read back, and
    whoever finds another's has lost."""
    fs, where = _at(spark, path)
    try:
        out = fs.create(where, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName() or "already exists" in str(e.java_exception.getMessage()):
            raise FileExistsError(str(path)) from None
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if read_text(spark, path) != text:
        raise FileExistsError(str(path))


def sealed(body: dict[str, Any]) -> str:
    """A document as canonical JSON with its own digest, by which a torn or changed one is known."""
    return canonical_json(body | {"sha256": text_sha256(canonical_json(body))}) + "\n"


def opened(text: str) -> dict[str, Any] | None:
    """The document of ``sealed``, without its digest; None if it doesn't hold."""
    try:
        value = json.loads(text)
    except ValueError:
        return None
    if not isinstance(value, dict) or not isinstance(value.get("sha256"), str):
        return None
    body = {k: v for k, v in value.items() if k != "sha256"}
    return body if text_sha256(canonical_json(body)) == value["sha256"] else None
