"""The evaluation report: tables of overall, family, supercategory and paired results, published at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions.text import FAMILIES, task_family
from ledgerlark.operators import evaluation as E
from ledgerlark.sinks import writers

TABLES = {
    "overall.csv": ("model_key", "model_label", "pass_at_1", "pass_at_3", "avg_accuracy"),
    "family.csv": ("model_key", "task_family", "avg_accuracy"),
    "supercategory.csv": ("model_key", "supercategory", "avg_accuracy"),
    "paired.csv": ("model_key", "model_label", "scope", "n_documents", "avg_accuracy_delta", "ci95_lower", "ci95_upper", "bootstrap_replicates", "bootstrap_seed"),
}


def observations_of(samples: DataFrame, model_key: str) -> DataFrame:
    """Observations of one model from its sample rows."""
    return samples.select(
        F.lit(model_key).alias("model_key"), "doc_hash", task_family(F.col("doc.task_type")).alias("family"), F.col("doc.supercategory").alias("supercategory"), F.col("avg_accuracy").alias("accuracy")
    )


def require_paired(obs: DataFrame, baseline: str) -> None:
    """Raise unless observations are in their domains, a document is once per model, every model has the
    documents of the baseline, and all agree on families and supercategories. One pass each, and no
    document comes to the driver but a few that show what is wrong."""
    bad = E.bad_observations(obs).limit(3).collect()
    if bad:
        raise E.EvaluationError(f"bad observations: {[(r['model_key'], r['doc_hash'], r['reasons']) for r in bad]}")
    if twice := obs.groupBy("model_key", "doc_hash").count().where("count > 1").limit(3).collect():
        raise E.EvaluationError(f"repeated documents: {[tuple(r) for r in twice]}")
    base = obs.where(F.col("model_key") == baseline).select("doc_hash")
    # Every candidate has each document of the baseline, and no other.
    counts = obs.where(F.col("model_key") != baseline).join(base.withColumn("_b", F.lit(1)), "doc_hash", "left").groupBy("model_key").agg(F.count("*").alias("n"), F.count("_b").alias("shared")).collect()
    n = base.count()
    if wrong := [r["model_key"] for r in counts if r["n"] != n or r["shared"] != n]:
        raise E.EvaluationError(f"documents differ from the baseline's: {sorted(wrong)}")
    if odd := E.inconsistent_pairs(E.paired(obs, baseline)).limit(3).collect():
        raise E.EvaluationError(f"models disagree on documents: {[(r['model_key'], r['doc_hash']) for r in odd]}")


def paired_table(obs: DataFrame, baseline: str, labels: Mapping[str, str], replicates: int) -> DataFrame:
    """Paired deltas with their intervals, in the columns of the report."""
    names = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    rows = E.bootstrap_exact(obs, baseline, replicates)
    return rows.select(
        "model_key", F.try_element_at(names, F.col("model_key")).alias("model_label"), "scope", F.col("n").alias("n_documents"), F.col("mean_delta").alias("avg_accuracy_delta"),
        F.col("ci_low").alias("ci95_lower"), F.col("ci_high").alias("ci95_upper"), F.lit(replicates).alias("bootstrap_replicates"), F.col("seed").alias("bootstrap_seed"),
    )


def publish(spark: SparkSession, obs: DataFrame, overall: Sequence[Mapping[str, Any]], target: str | Path, *, baseline: str, labels: Mapping[str, str], replicates: int = E.REPLICATES, training: DataFrame | None = None) -> dict[str, Any]:
    """Write all tables and a manifest of their digests to ``target``, which appears complete or not at all.
    ``training``: metric logs of all models with model_key and step, if there are any."""
    obs = obs.cache()
    try:
        require_paired(obs, baseline)
        E.require_models(obs, list(labels))
        lacking = obs.groupBy("model_key").agg(F.collect_set("family").alias("have")).where(F.size(F.array_except(F.array(*[F.lit(f) for f in FAMILIES]), "have")) > 0)
        if missing := [r[0] for r in lacking.collect()]:
            raise E.EvaluationError(f"families are missing for {sorted(missing)}")
        head = spark.createDataFrame([(r["model_key"], labels[r["model_key"]], *(float(r[m]) for m in ("pass_at_1", "pass_at_3", "avg_accuracy"))) for r in overall], "model_key string, model_label string, pass_at_1 double, pass_at_3 double, avg_accuracy double")
        with writers.published(target) as staging:
            writers.write_csv(head, staging / "overall.csv", TABLES["overall.csv"], ["model_key"])
            family = E.means_by(obs, "model_key", "family").select("model_key", F.col("family").alias("task_family"), "avg_accuracy")
            writers.write_csv(family, staging / "family.csv", TABLES["family.csv"], ["model_key", "task_family"])
            writers.write_csv(E.means_by(obs, "model_key", "supercategory").drop("n"), staging / "supercategory.csv", TABLES["supercategory.csv"], ["model_key", "supercategory"])
            writers.write_csv(paired_table(obs, baseline, labels, replicates), staging / "paired.csv", TABLES["paired.csv"], ["model_key", "scope"])
            if training is not None:
                # The columns are those that any log has; a row without one has an empty cell.
                writers.write_csv(training, staging / "training_metrics.csv", sorted(training.columns), ["model_key", "step"])
            manifest = writers.output_manifest(spark, str(staging))
            writers.write_json(staging / "manifest.json", manifest)
            writers.mark_ready(staging, staging / "manifest.json", "_COMPLETE")
    finally:
        obs.unpersist()
    return manifest
