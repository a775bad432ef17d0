import json

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import integrity as I
from ledgerlark.operators.scoring import Weights
from ledgerlark.sinks import writers as K
from ledgerlark.sources import config, readers as R
from ledgerlark.streaming import metrics as stream


def test_samples_and_results(spark, tmp_path):
    a = tmp_path / "run" / "b"
    a.mkdir(parents=True)
    row = {"doc_id": 0, "doc_hash": "h", "doc": {"task_type": "single_count", "supercategory": "x"}, "metrics": ["avg_accuracy"], "avg_accuracy": 0.5, "more": 1}
    (a / "samples_x.jsonl").write_text(json.dumps(row) + "\nnot json\n")
    (a / "other.jsonl").write_text(json.dumps(row) + "\n")
    rows = R.samples(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [r["corrupt"] for r in rows] == ["not json", None] and rows[1]["doc"]["supercategory"] == "x"
    metrics = {f"{m},all": v for m, v in (("pass_at_1", 0.1), ("pass_at_3", 0.2), ("avg_accuracy", 0.3))}
    (a / "results_1.json").write_text(json.dumps({"results": {"t": metrics | {"pass_at_1,all": 7}}}))
    (a / "results_2.json").write_text(json.dumps({"results": {"t": metrics}}))
    (a / "results_3.json").write_text(json.dumps({"results": {"t": metrics | {"pass_at_1,all": 0.9}}}))
    got = R.first_valid_results(spark, str(tmp_path), "t").first()
    assert got["path"].endswith("results_2.json") and got["pass_at_1"] == 0.1


def test_metric_log(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text('{"step": 1, "loss": 0.5}\n\n{"step": 2, "a/b": 1.0}\n')
    assert R.metric_log(spark, str(p)).columns == ["a/b", "loss", "step"]
    for bad in ("", '{"loss": 1}\n', '{"step": 1.5}\n', "[1]\n"):
        p.write_text(bad)
        with pytest.raises(R.SourceError):
            R.metric_log(spark, str(p))


def test_listing_manifest_and_inventory(spark, tmp_path):
    tree = tmp_path / "tree"
    (tree / "sub").mkdir(parents=True)
    (tree / ".git").mkdir()
    (tree / "a.txt").write_text("a")
    (tree / "sub" / "b.txt").write_text("b")
    (tree / ".git" / "x").write_text("x")
    listing = R.file_listing(spark, str(tree))
    assert [r["path"] for r in listing.orderBy("path").collect()] == ["a.txt", "sub/b.txt"]
    K.write_inventory(listing, str(tmp_path / "inventory"))
    expected = R.hash_manifest(spark, str(tmp_path / "inventory"))
    assert I.listing_diff(expected, listing, "path").isEmpty() and I.hash_mismatch(expected, listing, "path").isEmpty()
    (tree / "a.txt").write_text("changed")
    (tree / "c.txt").write_text("c")
    assert [tuple(r) for r in I.listing_diff(expected, R.file_listing(spark, str(tree)), "path").collect()] == [("c.txt", "extra")]
    assert [r["path"] for r in I.hash_mismatch(expected, R.file_listing(spark, str(tree)), "path").collect()] == ["a.txt"]
    assert K.output_manifest(spark, str(tree))["n_files"] == 3
    bad = tmp_path / "bad"
    bad.write_text("0" * 64 + "  ../x\n")
    with pytest.raises(R.SourceError):
        R.hash_manifest(spark, str(bad))


def test_runs(spark, tmp_path):
    for model, run in (("m1", "r1"), ("m2", "r1"), ("m2", "r2")):
        (tmp_path / model / run).mkdir(parents=True)
        (tmp_path / model / run / "_COMPLETE").write_text("ok")
    runs = R.completed_runs(spark, str(tmp_path))
    assert R.single_runs(runs, ["m1"]) == {"m1": "r1"}
    for models in (["m1", "m2"], ["m3"]):
        with pytest.raises(R.SourceError):
            R.single_runs(runs, models)


def test_pool_and_dataset(spark, tmp_path):
    (tmp_path / "pool.txt").write_text("CC\nCO\nCC\n")
    assert R.pool(spark, str(tmp_path / "pool.txt")).count() == 3
    (tmp_path / "blank.txt").write_text("CC\n \n")
    with pytest.raises(R.SourceError):
        R.pool(spark, str(tmp_path / "blank.txt"))
    df = spark.createDataFrame([("count", 1), ("index", 2)], "task_family string, x int")
    K.write_dataset(df, str(tmp_path / "ds"), "task_family")
    one = R.dataset(spark, str(tmp_path / "ds"), "index")
    assert one.count() == 1 and "PartitionFilters: [isnotnull(task_family" in one._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="(?i)already exists"):
        K.write_dataset(df, str(tmp_path / "ds"))


def test_config():
    assert config.expanded({"a": ["${X}/y", "$X", 1]}, {"X": "v"}) == {"a": ["v/y", "$X", 1]}
    with pytest.raises(config.ConfigError, match="A, B"):
        config.expanded("${B} ${A} ${C}", {"C": "1"})
    with pytest.raises(config.ConfigError):
        config.require({"a": 1}, ["a", "b"])
    assert config.forbidden_keys({"x": [{"limit": 5}, {"limit": None}], "samples": ""}, ("limit", "samples")) == ["x.0.limit"]


def test_untagged_yaml(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "t.yaml").write_text("f: !function a.b\nm: !x {k: [1, 2]}\ns: !y [a, !z b]\n")
    assert config.untagged(tmp_path / "t.yaml") == {"f": "a.b", "m": {"k": [1, 2]}, "s": ["a", "b"]}
    (tmp_path / "t.yaml").write_text("- 1\n")
    with pytest.raises(config.ConfigError):
        config.untagged(tmp_path / "t.yaml")


def test_windows_of_event_time(spark):
    df = spark.createDataFrame([("2024-01-01 01:00:00", "a", 1.0), ("2024-01-01 23:00:00", "a", 2.0), ("2024-01-02 00:00:00", "a", 4.0), ("2024-01-02 00:00:00", "b", 8.0)], "ts string, event_type string, value double")
    rows = stream.windowed(df).orderBy("window", "event_type").collect()
    assert [(r["window"]["start"].day, r["event_type"], r["n"], r["total"]) for r in rows] == [(1, "a", 2, 3.0), (2, "a", 1, 4.0), (2, "b", 1, 8.0)]


def test_config_files(tmp_path):
    (tmp_path / "c.json").write_text('{"a": "${X}"}')
    assert config.load(tmp_path / "c.json", env={"X": "1"}) == {"a": "1"}
    (tmp_path / "l.json").write_text("[1]")
    with pytest.raises(config.ConfigError):
        config.load(tmp_path / "l.json")


def test_documents_are_written_once(spark, tmp_path):
    K.write_json(tmp_path / "m.json", {"b": 1, "a": "é"})
    assert (tmp_path / "m.json").read_text() == '{\n  "a": "é",\n  "b": 1\n}\n'
    with pytest.raises(FileExistsError):
        K.write_json(tmp_path / "m.json", {})
    K.mark_ready(tmp_path, tmp_path / "m.json")
    assert K.is_ready(tmp_path, tmp_path / "m.json")
    (tmp_path / "m.json").write_text("{}")
    assert not K.is_ready(tmp_path, tmp_path / "m.json")
    df = spark.createDataFrame([("b", 1), ("a", 2)], "k string, v int")
    assert K.write_csv(df, tmp_path / "t.csv", ["k", "v", "none"], ["k"]) == 2
    assert (tmp_path / "t.csv").read_bytes() == b"k,v,none\r\na,2,\r\nb,1,\r\n"
    with pytest.raises(ValueError):
        K.write_csv(df, tmp_path / "u.csv", ["k"], ["k"])


def test_publication_is_atomic(tmp_path):
    with pytest.raises(RuntimeError):
        with K.published(tmp_path / "out") as p:
            (p / "x").write_text("x")
            raise RuntimeError
    assert list(tmp_path.iterdir()) == []
    with K.published(tmp_path / "out") as p:
        (p / "x").write_text("x")
    assert [x.name for x in tmp_path.iterdir()] == ["out"]
    with pytest.raises(FileExistsError):
        with K.published(tmp_path / "out"):
            pass


def test_stream_counts_nothing_twice(spark, tmp_path, sf_dir):
    src = str(tmp_path / "src")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.limit(100).repartition(3).write.parquet(src)
    args = (spark, src, events.schema, str(tmp_path / "sink"), str(tmp_path / "state"))
    stream.follow(*args, files_a_batch=1).awaitTermination()
    stream.follow(*args).awaitTermination()
    assert stream.totals(spark, str(tmp_path / "sink")).agg(F.sum("n")).first()[0] == 100
    events.limit(10).coalesce(1).write.mode("append").parquet(src)
    stream.follow(*args).awaitTermination()
    assert stream.totals(spark, str(tmp_path / "sink")).agg(F.sum("n")).first()[0] == 110


def test_stream_of_completions_has_metrics_of_each_batch(spark, tmp_path):
    good, wrong = '<answer>{"k":1}</answer>', '<answer>{"k":2}</answer>'
    batches = [[("a", good), ("a", f" {good} "), ("a", wrong), ("b", "")], [("a", good), ("b", good)]]
    schema = "example_id string, completion string, task_family string, task_type string, target_json string, constraints_json string"
    args = (spark, str(tmp_path / "src"), schema, str(tmp_path / "sink"), str(tmp_path / "state"))
    for rows in batches:
        df = spark.createDataFrame([(e, t, "count", "single_count", '{"k":1}', "[]") for e, t in rows], schema)
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
        stream.follow_completions(*args, weights=Weights(validity=0.0)).awaitTermination()
    first, second = [r.asDict() for r in spark.read.parquet(str(tmp_path / "sink")).orderBy("batch").collect()]
    totals = [1.05, 1.05, 0.05]
    assert first == pytest.approx({
        "batch": 0, "n": 4, "n_groups": 2, "mean_correctness": 0.5, "mean_format_reward": 0.75, "mean_validity": 0.0, "mean_total": sum(totals) / 4,
        "failure_fraction": 0.25, "invalid_value_fraction": 0.0, "verifier_error_fraction": 0.0,
        "duplicate_fraction": 0.25, "mean_variance": 2 / 9 / 2, "zero_variance_fraction": 0.5,
    })
    assert (second["batch"], second["n"], second["mean_correctness"], second["duplicate_fraction"], second["zero_variance_fraction"]) == (1, 2, 1.0, 0.0, 1.0)


def test_json_log_appends(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "step int")
    K.append_json(df, str(tmp_path / "log"))
    K.append_json(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_comma_rows(spark):
    df = spark.createDataFrame([("gpu a, 1, x, y, z\n\n b ,2\n",), (None,)], "t string")
    rows = df.select(R.comma_rows(F.col("t"), ("name", "n", "p", "q"))).collect()
    assert [tuple(r) for r in rows[0][0]] == [("gpu a", "1", "x", "y, z"), ("b", "2", None, None)] and rows[1][0] is None


def test_yaml_and_stamps(tmp_path):
    import re

    K.write_yaml(tmp_path / "c.yaml", {"b": [1], "a": None})
    with pytest.raises(FileExistsError):
        K.write_yaml(tmp_path / "c.yaml", {})
    assert (tmp_path / "c.yaml").read_text().index('a') < (tmp_path / "c.yaml").read_text().index('b')
    assert re.fullmatch(r"\d{8}T\d{6}Z", K.stamp()) and K.utc_now().endswith("+00:00")


def test_large_files_are_streamed(spark, tmp_path, monkeypatch):
    (tmp_path / "small").write_bytes(b"x" * 10)
    (tmp_path / "large").write_bytes(b"y" * 5000)
    want = {tuple(r) for r in R.file_listing(spark, str(tmp_path)).collect()}
    monkeypatch.setattr(R, "LARGE", 1000)
    assert {tuple(r) for r in R.file_listing(spark, str(tmp_path)).collect()} == want and len(want) == 2
