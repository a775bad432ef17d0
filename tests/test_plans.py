import csv
import json
from functools import reduce

import pytest
from pyspark.sql import functions as F
from records import RECORD, SYSTEM, record

from ledgerlark.functions import text as X
from ledgerlark.operators import evaluation as E
from ledgerlark.operators import validation as V
from ledgerlark.plans import bundle as B
from ledgerlark.plans import protocol as P
from ledgerlark.plans import report as R
from ledgerlark.plans import views as W
from ledgerlark.sinks import commits
from ledgerlark.sinks import writers as K
from ledgerlark.sources import config, readers
from ledgerlark.sources.metric_source import metric_rows

NAMES = [f.split()[0] for f in RECORD.split(", ")]


def records(spark, family, n=4):
    return spark.createDataFrame([[record(family, example_id=f"{family}-{i}")[c] for c in NAMES] for i in range(n)], RECORD)


def test_bundle_round_trip(spark, tmp_path):
    made = {f: B.freeze(records(spark, f), tmp_path, f, system_text=SYSTEM, drops={"x": 1}) for f in V.TASK_TYPES}
    again = B.records_digest(records(spark, "count").repartition(3))
    assert commits.newest(spark, str(made["count"])).meta["records_sha256"] == again[0] and again[1] == 4
    with pytest.raises(FileExistsError):
        B.freeze(records(spark, "count"), tmp_path, "count")
    whole = B.bundle(spark, made, tmp_path, {"seed": 1})
    folder, manifest = B.resolve(spark, whole, "index", system_text=SYSTEM)
    assert folder == made["index"].resolve() and manifest["num_examples"] == 4 and manifest["drop_counts"] == {"x": 1}
    with pytest.raises(B.BundleError):
        B.resolve(spark, whole, "other")
    with pytest.raises(B.BundleError, match="not count"):
        B.validate_artifact(spark, made["index"], expected_task="count")
    K.write_pointer(tmp_path / "LATEST", whole, tmp_path)
    assert config.pointer(tmp_path / "LATEST", tmp_path) == whole.resolve()


def test_changed_artifacts_are_refused(spark, tmp_path):
    made = B.freeze(records(spark, "count"), tmp_path, "count", system_text=SYSTEM)
    whole = B.bundle(spark, {"count": made}, tmp_path, {})
    K.write_dataset(records(spark, "count", 5), str(tmp_path / "other"))
    held = made / commits.newest(spark, str(made)).tables["dataset"][0]["folder"]
    held.rename(tmp_path / "old")
    (tmp_path / "other").rename(held)
    assert commits.newest(spark, str(made)) is None
    with pytest.raises(B.BundleError, match="num_examples, records_sha256"):
        B.validate_artifact(spark, made)
    (log,) = (made / commits.LOG).glob("*.json")
    log.write_text(log.read_text().replace('"num_examples":4', '"num_examples":5'))
    (log.parent / f".{log.name}.crc").unlink()
    for check in (lambda: B.validate_artifact(spark, made), lambda: B.resolve(spark, whole, "count")):
        with pytest.raises(B.BundleError):
            check()
    mixed = records(spark, "count").withColumn("generator_revision", F.col("example_id"))
    with pytest.raises(B.BundleError, match="origin"):
        B.freeze(mixed, tmp_path / "m", "count")
    with pytest.raises(V.ContractError):
        B.freeze(records(spark, "count").withColumn("multitask_load", F.lit(0)), tmp_path / "n", "count")
    assert not (tmp_path / "n").exists()


def test_bundles_by_address(spark, tmp_path):
    """The same by addresses of a file system, as text."""
    root = f"file://{tmp_path}/store"
    made = {f: B.freeze(records(spark, f), root, f, system_text=SYSTEM) for f in ("count", "index")}
    whole = B.bundle(spark, made, root, {})
    folder, manifest = B.resolve(spark, whole, "index", system_text=SYSTEM)
    assert folder == made["index"] and folder.startswith("file:///") and manifest["num_examples"] == 4
    with pytest.raises(FileExistsError):
        B.freeze(records(spark, "count"), root, "count")
    with pytest.raises(B.BundleError, match="not complete"):
        B.resolve(spark, f"{root}/none", "index")
    with pytest.raises(B.BundleError, match="not below"):
        B.bundle(spark, made, f"file://{tmp_path}/other", {})


def test_seal(spark, tmp_path):
    (tmp_path / "a").write_text("a")
    (tmp_path / "b").write_text("b")
    B.seal(spark, tmp_path)
    B.verify_seal(spark, tmp_path)
    (tmp_path / "b").write_text("c")
    with pytest.raises(B.BundleError, match="'b'"):
        B.verify_seal(spark, tmp_path)
    (tmp_path / "b").write_text("b")
    (tmp_path / "_new").write_text("")
    with pytest.raises(B.BundleError, match="extra"):
        B.verify_seal(spark, tmp_path)


def observations(spark, drop=None, family=None):
    rows = [(m, f"d{i}", ("count", "index", "constraint")[i % 3], "s", ((i * k) % 5) / 4) for k, m in enumerate(("base", "a"), 1) for i in range(9)]
    rows = [r for r in rows if r[:2] != drop]
    rows = [(*r[:2], family, *r[3:]) if family and r[:2] == ("a", "d0") else r for r in rows]
    return spark.createDataFrame(rows, "model_key string, doc_hash string, family string, supercategory string, accuracy double")


def test_report(spark, tmp_path):
    overall = [{"model_key": m, "pass_at_1": 0.5, "pass_at_3": 0.6, "avg_accuracy": 0.55} for m in ("base", "a")]
    labels = {"base": "Base", "a": "A"}
    R.publish(spark, observations(spark), overall, tmp_path / "report", baseline="base", labels=labels, replicates=50)
    rows = {n: list(csv.DictReader((tmp_path / "report" / n).open(newline=""))) for n in R.TABLES}
    assert [len(rows[n]) for n in R.TABLES] == [2, 6, 2, 4] and rows["overall.csv"][0]["model_label"] == "A"
    assert list(rows["paired.csv"][0]) == ["model_key", "model_label", "scope", "n_documents", "avg_accuracy_delta", "ci95_lower", "ci95_upper", "bootstrap_replicates", "bootstrap_seed"]
    assert {(r["model_label"], r["bootstrap_replicates"]) for r in rows["paired.csv"]} == {("A", "50")} and {r["n_documents"] for r in rows["paired.csv"]} == {"9", "3"}
    log = spark.createDataFrame([("a", 1, 0.5), ("base", 2, None)], "model_key string, step bigint, loss double")
    R.publish(spark, observations(spark), overall, tmp_path / "more", baseline="base", labels=labels, replicates=20, training=log)
    assert (tmp_path / "more" / "training_metrics.csv").read_text().split("\n")[:2] == ["loss,model_key,step", "0.5,a,1"]
    with pytest.raises(E.EvaluationError, match="missing"):
        R.publish(spark, observations(spark), overall, tmp_path / "bad", baseline="base", labels=labels | {"b": "B"}, replicates=20)
    assert K.is_ready(tmp_path / "report", tmp_path / "report" / "manifest.json", "_COMPLETE")
    for bad in (observations(spark, drop=("a", "d1")), observations(spark).union(observations(spark).limit(1)), observations(spark, family="index")):
        with pytest.raises(E.EvaluationError):
            R.publish(spark, bad, overall, tmp_path / "bad", baseline="base", labels=labels, replicates=50)
    assert not (tmp_path / "bad").exists()


def test_from_sample_logs_to_the_report(spark, tmp_path):
    """Sample logs of two models and a metric log of each, to the published tables."""
    kinds = ("single_count", "single_index_identification", "constraint_generation")
    for k, model in enumerate(("base", "a")):
        run = tmp_path / "runs" / model / "r1"
        run.mkdir(parents=True)
        lines = [{"doc_id": i, "doc_hash": f"d{i}", "doc": {"task_type": kinds[i % 3], "supercategory": "s"}, "metrics": ["avg_accuracy"], "avg_accuracy": (i * (k + 1) % 5) / 4} for i in range(9)]
        (run / "samples_t.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines))
        (run / "results_1.json").write_text(json.dumps({"results": {"t": {"pass_at_1,all": 0.5, "pass_at_3,all": 0.6, "avg_accuracy,all": 0.55}}}))
        (run / "metrics.jsonl").write_text(json.dumps({"step": 1, "loss": k / 2}) + "\n")
        (run / "_COMPLETE").write_text("")
    found = readers.single_runs(readers.completed_runs(spark, str(tmp_path / "runs")), ["base", "a"])
    paths = {m: f"{tmp_path}/runs/{m}/{r}" for m, r in found.items()}
    obs = reduce(lambda x, y: x.unionByName(y), [R.observations_of(readers.samples(spark, p), m) for m, p in paths.items()])
    overall = [{"model_key": m} | readers.first_valid_results(spark, p, "t").first().asDict() for m, p in paths.items()]
    log = reduce(lambda x, y: x.unionByName(y), [metric_rows(spark, f"{p}/metrics.jsonl").select(F.lit(m).alias("model_key"), "step", "metric", "value") for m, p in paths.items()])
    R.publish(spark, obs, overall, tmp_path / "report", baseline="base", labels={"base": "Base", "a": "A"}, replicates=30, training=log.groupBy("model_key", "step").pivot("metric", ["loss"]).agg(F.first("value")))
    rows = {n: list(csv.DictReader((tmp_path / "report" / n).open(newline=""))) for n in [*R.TABLES, "training_metrics.csv"]}
    assert [len(rows[n]) for n in R.TABLES] == [2, 6, 2, 4] and {(r["model_key"], r["avg_accuracy"]) for r in rows["overall.csv"]} == {("base", "0.55"), ("a", "0.55")}
    whole = next(r for r in rows["paired.csv"] if r["n_documents"] == "9")
    assert float(whole["avg_accuracy_delta"]) == pytest.approx(sum((i * 2 % 5) / 4 - (i % 5) / 4 for i in range(9)) / 9)
    assert [(r["model_key"], r["loss"]) for r in rows["training_metrics.csv"]] == [("a", "0.5"), ("base", "0.0")]


def test_paths_and_names(spark, tmp_path):
    with pytest.raises(config.ConfigError):
        config.within(tmp_path, "../x")
    (tmp_path / "p").write_text("a\nb\n")
    with pytest.raises(config.ConfigError):
        config.pointer(tmp_path / "p", tmp_path)
    assert config.package_versions(["pyspark", "no-such-package"])["no-such-package"] is None
    df = spark.range(1).select(X.safe_name(F.lit("a b/c")), X.key_values(F.create_map(F.lit("b"), F.lit(2), F.lit("a"), F.lit(1))), X.is_sha256(F.lit("f" * 64)))
    assert tuple(df.first()) == ("a-b-c", "a=1,b=2", True)


def manifest(**changes):
    clean = dict.fromkeys(P.CLEAN, False)
    return json.dumps({"official_task": "t", "seeds": [1, 2], "package_versions": {"b": "1", "a": "2"}, "limit": None} | clean | changes)


def test_protocols(spark):
    same = [("a", manifest()), ("b", manifest(package_versions={"a": "2", "b": "1"}, own="x"))]
    runs = lambda rows: spark.createDataFrame(rows, "model_key string, manifest string")
    P.require_one_protocol(runs(same), expected={"official_task": '"t"', "seeds": "[1,2]"})
    for rows in ([*same, ("c", manifest(seeds=[2, 1]))], [("a", manifest(benchmark_used_for_training=True))], [("a", manifest(benchmark_used_for_training=None))]):
        with pytest.raises(E.EvaluationError):
            P.require_one_protocol(runs(rows))
    with pytest.raises(E.EvaluationError):
        P.require_one_protocol(runs(same), expected={"official_task": '"u"'})


def test_protocols_with_the_digest_of_a_package(spark):
    fields = P.fields_with("own")
    assert len(fields) == 23 and fields[-1] == "environment_lock"
    rows = [("a", manifest(installed_own_tree_sha256="1")), ("b", manifest(installed_own_tree_sha256="2"))]
    df = spark.createDataFrame(rows, "model_key string, manifest string")
    P.require_one_protocol(df)
    with pytest.raises(E.EvaluationError):
        P.require_one_protocol(df, fields=fields)


def test_model_bindings(spark):
    registry = {"experiment_id": "e", "checkpoint_path": "/c", "task_family": "count"}
    binding = {"kind": "trained", "task_family": "count", "dataset_artifact_id": "d", "dataset_records_sha256": "h", "frozen_config": {"path": "/f", "sha256": "1"}}
    run = {"experiment_id": "e", "checkpoint_path": "/c", "checkpoint_identity": {"tree_sha256": "ab"}, "training_binding": binding}
    completion = {"smoke_run": False, "experiment_id": "e", "task_family": "count", "dataset_artifact_id": "d", "dataset_records_sha256": "h", "final_model_identity": {"tree_sha256": "ab"}}
    base = run | {"training_binding": {"kind": "baseline", "base_model_revision": "r"}}
    assets = {"model_path": "/c", "model_identity": {"tree_sha256": "ab"}, "resolved_model_revision": "r"}
    plain = {k: v for k, v in registry.items() if k != "task_family"}
    cases = [
        ("a", "ab", registry, run, completion, None, []),
        ("b", "cd", registry, run, completion, None, ["checkpoint_identity", "final_model"]),
        ("c", "ab", registry | {"task_family": "index"}, run, completion, None, ["task_family"]),
        ("d", "ab", registry, run, completion | {"smoke_run": True}, None, ["completion"]),
        ("e", "ab", registry, run | {"training_binding": binding | {"dataset_artifact_id": None}}, completion, None, ["dataset"]),
        ("base", "ab", plain, base, None, assets, []),
        ("base", "ab", registry, base, None, assets | {"resolved_model_revision": "s"}, ["completion", "kind"]),
    ]
    rows = [(m, t, *(None if x is None else json.dumps(x) for x in rest[:-1])) for m, t, *rest in cases]
    df = spark.createDataFrame(rows, "model_key string, tree_sha256 string, registry string, manifest string, completion string, assets string")
    assert [r["failed"] for r in P.failed_bindings(df, "base").collect()] == [c[-1] for c in cases]
    files = P.bound_files(df.limit(1), ["frozen_config"]).collect()
    assert [tuple(r) for r in files] == [("a", "frozen_config", "/f", "1")]


def test_oracle_table(spark):
    values = {"constraint met": F.lit("C2"), "constraint missed": F.lit("C1"), "value refused": F.lit("C5")}
    cases = P.oracle_cases(spark.createDataFrame([(4,), (None,)], "n bigint"), F.col("n"), values, F.lit('[{"type":"k","operator":"=","value":0}]'))
    assert [r["case"] for r in cases.collect()] == [c[0] for c in P.CASES]
    assert P.oracle_failures(cases, evaluator=W.parity, validator=W.acceptable).isEmpty()
    wrong = P.oracle_failures(cases, evaluator=W.generous, validator=W.acceptable).collect()
    assert {r["case"] for r in wrong} == {"count missed", "indices shifted", "constraint missed"}
    # Without its validator a refused value is judged like any other.
    assert {r["case"] for r in P.oracle_failures(cases, evaluator=W.generous).collect()} == {"count missed", "indices shifted", "constraint missed", "value refused"}


def test_pinned_evaluator(spark):
    good = {"official_evaluator_commit": "c", "official_task": "t", "official_task_yaml_sha256": "y", "official_evaluator_identity": {"commit": "c", "clean": True, "source_tree_sha256": "s"}}
    bad = [{k: "other"} for k in good] + [{"official_evaluator_identity": good["official_evaluator_identity"] | x} for x in ({"commit": "d"}, {"clean": False}, {"clean": "true"}, {"source_tree_sha256": ""}, {"source_tree_sha256": None})]
    rows = [json.dumps(good)] + [json.dumps(good | b) for b in bad] + ["{}", "no json", None]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(rows)], "i int, m string")
    assert [r["i"] for r in df.where(P.pinned(F.col("m"), "c", "t", "y")).collect()] == [0]


def test_reward_table_reads_its_cases_once(spark, sf_dir):
    from ledgerlark import catalogue

    plan = catalogue.QUERIES["reward_table"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython ") == 2 and plan.count("Scan parquet") == 1
