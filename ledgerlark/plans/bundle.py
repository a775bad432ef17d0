"""Frozen datasets on disk: build, validate, bundle, resolve, seal.

An artifact is a folder with the records as Parquet and one commit (``sinks.commits``), which holds the
manifest and its digest and is created only if there is none. A half-built artifact is never seen, on
any file system that Spark writes to, and of two writers one has it. Record digests are computed where
the records are (``integrity.chunked_hash``).
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions.hashing import canonical_json, record_json, text_sha256
from ledgerlark.operators import integrity, validation
from ledgerlark.sinks import commits, writers
from ledgerlark.sources import readers
from ledgerlark.sources.config import within

SCHEMA_VERSION = 1
DATASET = "dataset"
PROVENANCE = ("source_dataset_revision", "generator_revision", "preprocessing_config_hash")


class BundleError(ValueError):
    """An artifact, a bundle or a seal that doesn't hold."""


def record_text(df: DataFrame) -> Column:
    """A record as JSON with sorted keys at every depth."""
    return record_json(df)


def records_digest(df: DataFrame) -> tuple[str, int]:
    row = integrity.chunked_hash(df, record_text(df), F.col("example_id")).first()
    return row["records_sha256"], row["n"]


def _read(path: Path) -> dict[str, Any]:
    value = json.loads(path.read_text(encoding="utf-8"))
    if not isinstance(value, dict):
        raise BundleError(f"{path} holds no object")
    return value


def _committed(spark: SparkSession, folder: str | Path) -> commits.Commit:
    """The one commit of an artifact or a bundle, if its digest is right."""
    found = commits.newest(spark, str(folder), listed=False)
    if found is None:
        raise BundleError(f"{folder} is not complete")
    return found


def _join(root: str | Path, name: str) -> str | Path:
    return root / name if isinstance(root, Path) else f"{root.rstrip('/')}/{name}"


def _below(root: str | Path, relative: str) -> str | Path:
    """A folder below another one; a path that leaves it is an error."""
    if isinstance(root, Path):
        return within(root, relative)
    if relative.startswith("/") or ".." in relative.split("/"):
        raise BundleError(f"{relative} leaves {root}")
    return _join(root, relative)


def _relative(root: str | Path, folder: str | Path) -> str:
    if isinstance(root, Path):
        return Path(folder).resolve().relative_to(root.resolve()).as_posix()
    if not str(folder).startswith(f"{root.rstrip('/')}/"):
        raise BundleError(f"{folder} is not below {root}")
    return str(folder)[len(root.rstrip("/")) + 1 :]


def freeze(records: DataFrame, root: str | Path, family: str, *, system_text: str | None = None, denylist: Sequence[str] = (), drops: Mapping[str, int] | None = None, more: Mapping[str, Any] | None = None) -> str | Path:
    """Validate records of one family and publish them as ``<family>-<digest prefix>`` below ``root``; an
    existing artifact is an error.

    All rows must agree on their provenance, which goes into the manifest."""
    validation.validate_records(records, family, system_text, denylist)
    origins = records.select(*PROVENANCE).distinct().limit(2).collect()
    if len(origins) != 1:
        raise BundleError("records of more than one origin")
    digest, n = records_digest(records)
    types = {r[0]: r[1] for r in records.groupBy("task_type").count().collect()}
    artifact = f"{family}-{digest[:12]}"
    manifest = dict(more or {}) | origins[0].asDict() | {
        "schema_version": SCHEMA_VERSION, "task_family": family, "num_examples": n, "records_sha256": digest,
        "task_type_counts": types, "drop_counts": dict(drops or {}), "dataset_artifact_id": artifact,
    }
    target = _join(root, artifact)
    commits.publish(records.sparkSession, str(target), {DATASET: records}, manifest, expected=0)
    return target


def validate_artifact(spark: SparkSession, folder: str | Path, *, expected_task: str | None = None, system_text: str | None = None, denylist: Sequence[str] = ()) -> dict[str, Any]:
    """The manifest of an artifact whose commit, rows, provenance, count and digest all agree."""
    commit = _committed(spark, folder)
    manifest = dict(commit.meta)
    family = manifest.get("task_family")
    if expected_task is not None and family != expected_task:
        raise BundleError(f"{folder} holds {family}, not {expected_task}")
    rows = commits.read(spark, str(folder), DATASET, commit)
    n = validation.validate_records(rows, family, system_text, denylist)
    foreign = ~F.lit(True)
    for c in PROVENANCE:
        foreign = foreign | ~F.col(c).eqNullSafe(F.lit(manifest.get(c)))
    digest, _ = records_digest(rows)
    wrong = [
        name
        for name, ok in {
            "schema_version": manifest.get("schema_version") == SCHEMA_VERSION,
            "provenance": rows.where(foreign).isEmpty(),
            "num_examples": manifest.get("num_examples") == n,
            "records_sha256": manifest.get("records_sha256") == digest,
            "dataset_artifact_id": manifest.get("dataset_artifact_id") == str(folder).rstrip("/").rsplit("/", 1)[-1],
        }.items()
        if not ok
    ]
    if wrong:
        raise BundleError(f"{folder} differs from its manifest in {', '.join(wrong)}")
    return manifest


def bundle(spark: SparkSession, artifacts: Mapping[str, str | Path], root: str | Path, config: Mapping[str, Any]) -> str | Path:
    """A bundle that points at one artifact of each family below ``root``; an existing one is an error."""
    entries = {}
    for family, folder in sorted(artifacts.items()):
        commit = _committed(spark, folder)
        if commit.meta["task_family"] != family:
            raise BundleError(f"{folder} holds {commit.meta['task_family']}, not {family}")
        entries[family] = {"path": _relative(root, folder), "commit_sha256": commit.sha256, **{k: commit.meta[k] for k in ("dataset_artifact_id", "records_sha256", "num_examples")}}
    body = {"schema_version": SCHEMA_VERSION, "config_sha256": text_sha256(canonical_json(config)), "artifacts": entries}
    name = f"bundle-{text_sha256(canonical_json(body))[:12]}"
    commits.publish(spark, str(_join(root, name)), {}, body | {"bundle_id": name}, expected=0)
    return _join(root, name)


def resolve(spark: SparkSession, folder: str | Path, task: str, **options) -> tuple[str | Path, dict[str, Any]]:
    """Folder and manifest of a bundle's artifact of one family, all five of their ties checked."""
    entry = _committed(spark, folder).meta.get("artifacts", {}).get(task)
    if not isinstance(entry, dict):
        raise BundleError(f"{folder} has no artifact of {task}")
    root = folder.parent if isinstance(folder, Path) else folder.rstrip("/").rsplit("/", 1)[0]
    artifact = _below(root, entry["path"])
    if _committed(spark, artifact).sha256 != entry["commit_sha256"]:
        raise BundleError(f"the manifest of {artifact} has changed")
    manifest = validate_artifact(spark, artifact, expected_task=task, **options)
    if wrong := [k for k in ("dataset_artifact_id", "records_sha256", "num_examples") if manifest[k] != entry[k]]:
        raise BundleError(f"{artifact} differs from its bundle in {wrong}")
    return artifact, manifest


def seal(spark: SparkSession, folder: str | Path, name: str = "SEAL.json") -> dict[str, Any]:
    """Digest of every file of a folder, and of the whole, in a document that is written once."""
    body = writers.output_manifest(spark, str(folder))
    writers.write_json(Path(folder) / name, body)
    return body


def verify_seal(spark: SparkSession, folder: str | Path, name: str = "SEAL.json") -> None:
    """Raise if a sealed folder has a missing, an extra or a changed file."""
    body = _read(Path(folder) / name)
    schema = "path string, sha256 string"
    expected = spark.createDataFrame([(f["path"], f["sha256"]) for f in body["files"]], schema)
    actual = readers.file_listing(spark, str(folder)).where(F.col("path") != name)
    diff = [tuple(r) for r in integrity.listing_diff(expected, actual, "path").orderBy("path").limit(5).collect()]
    changed = [r["path"] for r in integrity.hash_mismatch(expected, actual, "path").orderBy("path").limit(5).collect()]
    whole = integrity.tree_hash(actual, size="size_bytes").first().asDict()
    if diff or changed or any(body[k] != v for k, v in whole.items()):
        raise BundleError(f"the seal of {folder} is broken: {diff}, changed {changed}")
