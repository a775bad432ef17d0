"""Tables published by a log of numbered commits.

Data go to folders that nobody else knows; a commit names them, and is a file that is created only if
its number is free. So a version is there as a whole or not at all, on any file system that Spark
writes to, without renames: of writers that race, one has the number, and the others look again at
what has become the newest. A reader takes the newest commit that holds: its own digest is right, and
the files it names are there.

A commit is small whatever it publishes: of every folder it has the number, bytes and digest of the
files, while the listing itself is a table beside the data.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.operators.integrity import hash_mismatch, listing_diff, tree_hash
from ledgerlark.sinks import files
from ledgerlark.sources.readers import file_listing

LOG = "_commits"


class CommitConflict(FileExistsError):
    """Another version came first."""


@dataclass(frozen=True)
class Commit:
    """A version: the folders of each table in the order they were added, and what is said of it all."""

    number: int
    tables: Mapping[str, Sequence[Mapping[str, Any]]]
    meta: Mapping[str, Any]
    sha256: str


def _name(number: int) -> str:
    return f"{number:010d}.json"


def numbers(spark: SparkSession, root: str) -> list[int]:
    """Numbers of all commits, damaged ones with them, newest first."""
    found = files.sizes(spark, f"{root}/{LOG}")
    return sorted((int(n[:-5]) for n in found if n.endswith(".json") and n[:-5].isdigit()), reverse=True)


def load(spark: SparkSession, root: str, number: int) -> Commit | None:
    """The commit of a number; None if it is damaged."""
    body = files.opened(files.read_text(spark, f"{root}/{LOG}/{_name(number)}"))
    if body is None or body.get("number") != number:
        return None
    return Commit(number, body["tables"], body["meta"], files.text_sha256(files.canonical_json(body)))


def _listing(spark: SparkSession, folder: str) -> DataFrame:
    return file_listing(spark, folder, ()).where(~F.exists(F.split("path", "/"), lambda p: p.startswith("_") | p.startswith(".")))


def broken(spark: SparkSession, root: str, commit: Commit, *, deep: bool = False) -> list[str]:
    """Folders of a commit whose files are not those it names: by number and bytes, with ``deep`` by their
    contents too."""
    out = []
    for entries in commit.tables.values():
        for e in entries:
            if deep:
                now = _whole(_listing(spark, f"{root}/{e['folder']}"))
                same = all(now[k] == e[k] for k in now)
            elif not files.exists(spark, f"{root}/{e['folder']}"):
                same = False
            else:
                found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root}/{e['folder']}").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
                same = tuple(found) == (e["n_files"], e["size_bytes"])
            if not same:
                out.append(e["folder"])
    return out


def newest(spark: SparkSession, root: str, *, deep: bool = False, listed: bool = True, among: Sequence[int] | None = None) -> Commit | None:
    """The commit of the highest number that holds, of all or of some numbers; None if there is none. Without
    ``listed`` only its own digest is looked at, not its files."""
    for number in numbers(spark, root) if among is None else among:
        commit = load(spark, root, number)
        if commit is not None and not (listed and broken(spark, root, commit, deep=deep)):
            return commit
    return None


def _whole(listing: DataFrame) -> dict[str, Any]:
    return tree_hash(listing, size="size_bytes").first().asDict()


def write(spark: SparkSession, root: str, tables: Mapping[str, DataFrame]) -> dict[str, dict[str, Any]]:
    """Write tables to new folders and digest their files where they are; what a commit says of each."""
    out = {}
    for name, df in tables.items():
        folder = f"data/{name}-{uuid.uuid4().hex}"
        df.write.mode("errorifexists").parquet(f"{root}/{folder}/rows")
        listing = _listing(spark, f"{root}/{folder}/rows")
        listing.write.parquet(f"{root}/{folder}/files")
        out[name] = {"folder": f"{folder}/rows", "files": f"{folder}/files", "schema": df.schema.json()} | _whole(spark.read.parquet(f"{root}/{folder}/files"))
    return out


def publish(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], meta: Mapping[str, Any] | None = None, *, append: bool = False, expected: int | None = None) -> Commit:
    """Publish a version. With ``append`` its tables go on from those of the newest commit, whichever that
    is by then; without, they take the place of all. ``expected`` is the number of the commit that must be
    the newest (0: there is none); if another one is, nothing is published."""
    root = str(root).rstrip("/")
    made = write(spark, root, tables)
    while True:
        # The base is the newest of the very numbers after which the own one comes: if there is another by now,
        # that number is taken, and all is looked at again.
        known = numbers(spark, root)
        base = newest(spark, root, among=known)
        if expected is not None and expected != (base.number if base else 0):
            raise CommitConflict(f"the newest version of {root} is {base.number if base else 0}, not {expected}")
        before = base.tables if append and base else {}
        number = max(known, default=0) + 1
        body = {
            "number": number, "base": base.number if base else 0, "meta": dict(meta or {}),
            "tables": {name: [*before.get(name, []), *([made[name]] if name in made else [])] for name in sorted({*before, *made})},
        }
        try:
            files.create(spark, f"{root}/{LOG}/{_name(number)}", files.sealed(body))
        except FileExistsError:
            continue
        return load(spark, root, number)


def read(spark: SparkSession, root: str, table: str, commit: Commit | None = None) -> DataFrame:
    """A table of a version, the newest that holds unless one is given."""
    root = str(root).rstrip("/")
    commit = commit or newest(spark, root)
    if commit is None or table not in commit.tables:
        raise FileNotFoundError(f"{root} has no version with {table}")
    return spark.read.parquet(*[f"{root}/{e['folder']}" for e in commit.tables[table]])


def changed_files(spark: SparkSession, root: str, commit: Commit, table: str) -> DataFrame:
    """(path, state) of the files of a table that are missing, extra or changed since it was published."""
    root = str(root).rstrip("/")
    out = spark.createDataFrame([], "path string, state string")
    for e in commit.tables[table]:
        want, have = spark.read.parquet(f"{root}/{e['files']}"), _listing(spark, f"{root}/{e['folder']}")
        named = F.concat(F.lit(e["folder"] + "/"), "path").alias("path")
        out = out.unionByName(listing_diff(want, have, "path").select(named, "state")).unionByName(hash_mismatch(want, have, "path").select(named, F.lit("changed").alias("state")))
    return out
