import hashlib
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from records import RECORD, SYSTEM, record

from ledgerlark.functions import hashing as H
from ledgerlark.functions import text as X
from ledgerlark.operators import builder as B
from ledgerlark.operators import evaluation as E
from ledgerlark.operators import integrity as I
from ledgerlark.operators import metric_log as M
from ledgerlark.operators import validation as V


def broken(spark, family, **changes):
    row = record(family, **changes)
    df = spark.createDataFrame([[row[n] for n in (f.split()[0] for f in RECORD.split(", "))]], RECORD)
    return sorted(r["rule"] for r in V.violations(df, V.record_rules(family, SYSTEM, ("validation", "test_pool"))).collect())


@pytest.mark.parametrize("family", V.TASK_TYPES)
def test_valid_records(spark, family):
    assert broken(spark, family) == []


MUTATIONS = [
    ("count", {"prompt": [("system", SYSTEM)]}, "prompt"),
    ("count", {"prompt": [("system", "other"), ("user", "x")]}, "prompt"),
    ("count", {"prompt": [("user", "x"), ("system", SYSTEM)]}, "prompt"),
    ("count", {"prompt": [("system", SYSTEM), ("user", None)]}, "prompt"),
    ("count", {"source_dataset_revision": "my-Validation-set"}, "source"),
    ("count", {"task_family": "index"}, "family"),
    ("count", {"task_type": "constraint_generation"}, "task_type"),
    ("count", {"molecule_id": "0" * 24}, "identity"),
    ("count", {"target_json": '{"ring_count":-1}'}, "targets"),
    ("count", {"target_json": '{"ring_count":true}'}, "targets"),
    ("count", {"target_json": '{"ring_count":1.5}'}, "targets"),
    ("count", {"target_json": '{"other":1}'}, "key_names"),
    ("count", {"multitask_load": 2}, "load"),
    ("count", {"molecular_complexity": float("nan")}, "complexity"),
    ("count", {"prompt": [("system", SYSTEM), ("user", 'is it {"ring_count":2}?')]}, "target_leak"),
    ("count", {"target_json": "not json"}, "json"),
    ("count", {"example_id": ""}, "example_id"),
    ("index", {"target_json": '{"ring_count":[0,0]}'}, "targets"),
    ("index", {"target_json": '{"ring_count":[1,0]}'}, "targets"),
    ("index", {"target_json": '{"ring_count":[0,-1]}'}, "targets"),
    ("index", {"target_json": '{"ring_count":[0,true]}'}, "targets"),
    ("index", {"target_json": '{"ring_count":[0,1.5]}'}, "targets"),
    ("constraint", {"prompt": [("system", SYSTEM), ("user", "such as CCO")]}, "witness_leak"),
    ("constraint", {"reference_smiles": ""}, "witness"),
    ("constraint", {"constraints_json": '[{"operator":"<","type":"ring","value":1}]'}, "constraints"),
    ("constraint", {"constraints_json": '[{"operator":"=","type":"ring","value":true}]'}, "constraints"),
    ("constraint", {"constraints_json": '[{"operator":"=","type":"ring","value":1,"more":2}]'}, "constraints"),
    ("constraint", {"target_json": '{"a":1}'}, "fields"),
]


@pytest.mark.parametrize("family,changes,rule", MUTATIONS)
def test_each_mutation_breaks_its_rule(spark, family, changes, rule):
    assert rule in broken(spark, family, **changes)


def test_validate_records_counts_or_raises(spark):
    names = [f.split()[0] for f in RECORD.split(", ")]
    rows = [[record(example_id=f"e{i}")[n] for n in names] for i in range(3)]
    df = spark.createDataFrame(rows, RECORD)
    assert V.validate_records(df, "count", SYSTEM) == 3
    for bad in (df.union(df), df.limit(0), df.drop("prompt"), df.withColumn("multitask_load", F.lit(9))):
        with pytest.raises(V.ContractError):
            V.validate_records(bad, "count", SYSTEM)


def test_family_of_type(spark):
    df = spark.createDataFrame([("generation_count",), ("Multi_INDEX_count",), ("single_count",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(X.task_family(F.col("t"))).collect()] == ["constraint", "index", "count", "unknown", "unknown"]


def test_observation_errors_and_families(spark):
    rows = [("m", "d1", "count", "s", 0.5), ("m", "d2", "count", "", 0.5), ("m", "d3", "odd", "s", 0.5), ("m", "d4", "index", "s", float("nan")), ("m", "d5", "index", "s", 1.5)]
    obs = spark.createDataFrame(rows, "model_key string, doc_hash string, family string, supercategory string, accuracy double")
    assert {r["doc_hash"]: r["reasons"] for r in E.bad_observations(obs).collect()} == {"d2": ["supercategory"], "d3": ["family"], "d4": ["accuracy"], "d5": ["accuracy"]}
    with pytest.raises(E.EvaluationError):
        E.require_families(E.means_by(obs, "family"))


def test_paired_bootstrap_has_a_row_per_model_and_scope(spark):
    rows = [(m, f"d{i}", ("count", "index", "constraint")[i % 3], "s", ((i * k) % 5) / 4) for k, m in enumerate(("base", "a", "b", "c"), 1) for i in range(12)]
    obs = spark.createDataFrame(rows, "model_key string, doc_hash string, family string, supercategory string, accuracy double")
    out = E.bootstrap_exact(obs, "base", 200).collect()
    assert len(out) == 12 and all(r["ci_low"] <= r["mean_delta"] <= r["ci_high"] for r in out)
    deltas = {(r["model_key"], r["scope"]): r["mean_delta"] for r in E.paired_delta(obs, "base").collect()}
    assert all(deltas[r["model_key"], r["scope"]] == pytest.approx(r["mean_delta"]) for r in out)


def test_property_samples(spark):
    pool, names = spark.range(40).selectExpr("cast(id as string) as k"), ("a", "b", "c", "d")
    rows = B.epoch_specs(pool, 400, key="k", seed="s", loads=(1, 4), properties=names).collect()
    assert len(rows) == 400 and all(len(set(r["properties"])) == len(r["properties"]) == r["load"] for r in rows)
    # Each name is drawn as often as any other, first as well as at all.
    for at in (lambda r: r["properties"][:1], lambda r: r["properties"]):
        seen = [sum(n in at(r) for r in rows) for n in names]
        assert min(seen) > 0.7 * sum(seen) / 4
    plain = B.epoch_specs(pool, 400, key="k", seed="s", loads=(1, 4)).collect()
    assert sorted(map(tuple, plain)) == sorted(tuple(r)[:5] for r in rows)
    for loads in ((0, 2), (1, 5), (3, 2)):
        with pytest.raises(ValueError):
            B.epoch_specs(pool, 4, key="k", seed="s", loads=loads, properties=names)
    assert "properties" in B.epoch_specs(pool.limit(0), 4, key="k", seed="s", loads=(1, 1), properties=names).columns


def test_newest_that_is_valid(spark, tmp_path):
    rows = [("a", 1, True), ("a", 5, False), ("a", 3, True), ("b", 2, True), ("c", 9, False), ("c", 8, False), (None, 4, False), (None, 3, True), ("d", None, True), ("e", 7, True), ("e", 7, True)]
    df = spark.createDataFrame(rows, "run string, number int, ok boolean")
    asked = []

    def verify(at):
        asked.append(sorted((r["run"] or "", r["number"]) for r in at.collect()))
        return at.where("ok")

    got = I.newest_valid(df, "run", "number", verify, str(tmp_path / "a"))
    assert sorted((r["run"] or "", r["number"]) for r in got.collect()) == [("", 3), ("a", 3), ("b", 2), ("e", 7), ("e", 7)]
    # The newest of all, then the next where it failed, and no more.
    assert asked == [[("", 4), ("a", 5), ("b", 2), ("c", 9), ("e", 7), ("e", 7)], [("", 3), ("a", 3), ("c", 8)]]
    assert I.newest_valid(df.limit(0), "run", "number", verify, str(tmp_path / "b")).count() == 0


def test_exact_bootstrap_as_a_plain_loop(spark):
    """Seeds, order, chunks and quantiles of the published procedure, written out for one scope after another."""
    families = ("count", "index", "constraint")
    rows = [(m, f"d{i:03d}", families[i % 3], "s", ((i * i * k + i) % 11) / 10) for k, m in ((1, "base"), (3, "a"), (7, "b")) for i in range(50)]
    obs = spark.createDataFrame(rows, "model_key string, doc_hash string, family string, supercategory string, accuracy double").repartition(5)
    got = {(r["model_key"], r["scope"]): r for r in E.bootstrap_exact(obs, "base", 450).collect()}
    accuracy = {(m, d): a for m, d, _, _, a in rows}
    family = {d: f for _, d, f, _, _ in rows}
    want = {}
    for model in ("a", "b"):
        for scope in ("overall", *families):
            docs = sorted(d for d in family if scope == "overall" or family[d] == scope)
            deltas = np.array([accuracy[model, d] - accuracy["base", d] for d in docs])
            seed = int.from_bytes(hashlib.sha256(f"{E.SEED_PREFIX}:{model}:{scope}".encode()).digest()[:8], "big")
            rng, means = np.random.default_rng(seed), []
            for size in (200, 200, 50):
                for replicate in rng.integers(0, len(docs), size=(size, len(docs))):
                    means.append(np.mean([deltas[i] for i in replicate]))
            want[model, scope] = (deltas.mean(), *np.quantile(means, [0.025, 0.975]), len(docs), str(seed))
    assert set(got) == set(want)
    for at, (mean, low, high, n, seed) in want.items():
        r = got[at]
        assert (r["mean_delta"], r["ci_low"], r["ci_high"]) == pytest.approx((mean, low, high), abs=1e-12) and (r["n"], r["seed"]) == (n, seed)


def test_portable_bootstrap_as_brute_force(spark):
    n = 9
    value = {(m, i): ((i * k) % 5) / 4 for k, m in enumerate(("base", "a"), 1) for i in range(n)}
    rows = [(m, f"d{i}", ("count", "index")[i % 2], "s", v) for (m, i), v in value.items()]
    obs = spark.createDataFrame(rows, "model_key string, doc_hash string, family string, supercategory string, accuracy double")
    intervals = E.bootstrap_portable(obs, "base")
    bars = {r["scope"]: r for r in E.error_bars(E.paired_delta(obs, "base"), intervals).collect()}
    got = {r["scope"]: r for r in intervals.collect()}
    assert set(got) == {"overall", "count", "index"}
    for scope, r in got.items():
        d = [value["a", i] - value["base", i] for i in range(n) if scope in ("overall", ("count", "index")[i % 2])]
        docs = [f"d{i}" for i in range(n) if scope in ("overall", ("count", "index")[i % 2])]
        means = []
        for k in range(2_000):
            draws = [int(H.text_sha256(f"a:{scope}:{doc}:{k // 16}")[k % 16 * 4 :][:4], 16) for doc in docs]
            weights = [sum(u >= c for c in E.poisson_cuts()) for u in draws]
            if sum(weights):
                means.append(np.average(d, weights=weights))
        low, high = np.quantile(means, [0.025, 0.975])
        assert (r["ci_low"], r["ci_high"], r["replicates"]) == (pytest.approx(low), pytest.approx(high), 2_000)
        assert (bars[scope]["below"], bars[scope]["above"]) == (pytest.approx(np.mean(d) - low), pytest.approx(high - np.mean(d)))


def test_poisson_weights():
    cuts = E.poisson_cuts()
    shares = np.diff([0, *cuts, 1 << 16]) / (1 << 16)
    assert np.allclose(shares[:4], [np.exp(-1), np.exp(-1), np.exp(-1) / 2, np.exp(-1) / 6], atol=2e-5)
    assert (shares * np.arange(len(shares))).sum() == pytest.approx(1, abs=1e-3)


def test_models_must_be_those_of_the_registry(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "model_key string")
    E.require_models(df, ["b", "a"])
    for models in (["a"], ["a", "b", "c"]):
        with pytest.raises(E.EvaluationError):
            E.require_models(df, models)


def test_identifiers(spark):
    df = spark.createDataFrame([("a" * 64,), ("a" * 40,), ("checkpoint-12",), ("run.1-x",), ("a" * 64 + "\n",), (None,)], "t string")
    rows = df.select(*[X.is_named(F.col("t"), p) for p in (X.SHA256, X.COMMIT, X.CHECKPOINT, X.RUN)]).collect()
    assert [tuple(r) for r in rows] == [(True, False, False, True), (False, True, False, True), (False, False, True, True), (False, False, False, True), (False,) * 4, (False,) * 4]


def test_epoch_order_in_many_ranges(spark, monkeypatch):
    pool = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    want = {r["attempt"]: r["k"] for r in B.epoch_specs(pool, 2500, key="k", seed="s", loads=(1, 3)).collect()}
    monkeypatch.setattr(B, "PLACED", 30)
    assert {r["attempt"]: r["k"] for r in B.epoch_specs(pool, 2500, key="k", seed="s", loads=(1, 3)).collect()} == want
    assert sorted(want) == list(range(2500)) and len({want[i] for i in range(1000)}) == 1000


def test_hashes(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2)], "t string, k int")
    plain = H.text_sha256("a\nb\n")
    assert I.ordered_hash(df, F.col("t"), "t").first()[0] == plain == I.streamed_hash(df, F.col("t"), "t")[0]
    assert I.ordered_hash(df.limit(0), F.col("t"), "t").first()[0] == H.text_sha256("")
    assert I.chunked_hash(df, F.col("t"), F.col("k")).first() == I.chunked_hash(df.repartition(3), F.col("t"), F.col("k")).first()
    row = df.select(H.prefix_id(F.col("t")), H.composite_id(F.col("t"), F.col("k")), H.seed_of(F.col("t"))).first()
    assert row[0] == H.text_sha256("b")[:24] and row[1] == H.text_sha256("b\x001") and int(row[2]) == int(H.text_sha256("b")[:16], 16)
    assert H.canonical_json({"b": 1, "a": [1.0, "é"]}) == '{"a":[1.0,"é"],"b":1}'
    with pytest.raises(ValueError):
        H.canonical_json(float("nan"))


def test_id_gaps(spark):
    df = spark.createDataFrame([(0,), (2,), (2,), (7,)], "id bigint")
    assert {r["id"]: r["state"] for r in I.id_gaps(df, "id", 4).collect()} == {1: "missing", 3: "missing", 2: "repeated", 7: "beyond"}


def test_latest_is_by_number(spark):
    df = spark.createDataFrame([("g", "checkpoint-9"), ("g", "checkpoint-10"), ("g", "other")], "g string, name string")
    assert I.latest_by_number(df, "g", "name").first()["name"] == "checkpoint-10"


def test_generation_and_first_records(spark):
    pool = [{"molecule_id": str(i), "smiles": "C" * (i + 1)} for i in range(4)]
    specs = B.exact_specs(spark, pool, "count", ["a", "b", "c"], (1, 2), B.family_seed(5, 1), 10)
    assert specs.collect() == B.exact_specs(spark, pool, "count", ["a", "b", "c"], (1, 2), 1014, 10).collect()

    def make():
        def one(spec):
            if len(spec["smiles"]) == 1:
                return None, "short"
            if len(spec["smiles"]) == 2:
                raise ValueError("x" * 300)
            return {"id": spec["molecule_id"]}, None

        return one

    made = B.generate(specs, make, T.StructType([T.StructField("id", T.StringType())]))
    kept, drops = B.build_family(made, 3)
    assert kept.count() == 3 and kept.orderBy("attempt").first()["attempt"] == made.where("record is not null").orderBy("attempt").first()["attempt"]
    reasons = {r["reason"]: r["n"] for r in drops.collect()}
    assert set(reasons) == {"short", "ValueError:" + "x" * 160} and sum(reasons.values()) + made.where("record is not null").count() == 10
    with pytest.raises(B.ShortfallError):
        B.build_family(made, 11)
    assert B.attempts_for(20_000, 1.35) == 27_000


def test_shortfalls(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("a", 3, True), ("b", 1, False)], "g string, k int, ok boolean")
    kept = B.first_n_valid(df, F.col("ok"), 2, group="g", order="k")
    assert [(r["g"], r["k"]) for r in kept.orderBy("k").collect()] == [("a", 1), ("a", 3)]
    assert [tuple(r) for r in B.shortfalls(kept, df, 2, group="g").collect()] == [("b", 0)]


def test_metric_log(spark):
    log = spark.createDataFrame([(1, 0.5, 1.0, None), (2, 0.4, 0.5, 3.0)], "step bigint, loss double, `x/zero_fraction` double, `y` double")
    long = M.to_long(log, "step").withColumn("model_key", F.lit("m"))
    assert long.count() == 5 and M.with_suffix(log.columns, "zero_fraction") == ["x/zero_fraction"]
    zero = F.col("metric").endswith("zero_fraction")
    assert M.gate(long, zero, by="model_key").first().asDict() == {"model_key": "m", "n": 2, "least": 0.5, "passes": True}
    ones = long.withColumn("value", F.when(zero, 1.0).otherwise(F.col("value")))
    assert not M.gate(ones, zero, by="model_key").first()["passes"]
    nan = long.withColumn("value", F.when(F.col("metric") == "loss", float("nan")).otherwise(F.col("value")))
    assert not M.gate(nan, zero, by="model_key").first()["passes"]
    assert M.fallback(long, ("absent", "y", "loss")).first()["metric"] == "y"
    assert M.fallback(long, ("absent",)).first()["metric"] is None
    assert M.bad_steps(spark.createDataFrame([(1.0,), (1.5,), (None,)], "step double")).count() == 2


def test_records_without_bookkeeping(spark):
    df = spark.createDataFrame([(1, "a", None, "x"), (2, "a", None, "y"), (3, "b", None, "x")], "pos int, t string, u string, note string")
    h = [r["record_sha256"] for r in I.hashed_without(df, "pos", "note").orderBy("pos").collect()]
    assert h[0] == h[1] != h[2] and h[0] == H.text_sha256('{"t":"a","u":null}')


def test_evaluated_documents(spark):
    want = spark.createDataFrame([(i, f"q{i}") for i in range(6)], "id int, q string")
    seen = spark.createDataFrame([(0, "q0"), (1, "other"), (2, "q2"), (2, "q2"), (9, "q9"), (3, None)], "id int, q string")
    got = {r["id"]: r["state"] for r in I.evaluated_documents(seen, want, "id", F.col("q")).collect()}
    assert got == {1: "changed", 2: "repeated", 3: "changed", 4: "missing", 5: "missing", 9: "extra"}


def test_required_records_and_trees(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha256 string")
    row = I.chunked_hash(df, F.col("sha256"), F.col("path")).first()
    I.require_records(df, F.col("sha256"), F.col("path"), 2, row["records_sha256"])
    with pytest.raises(ValueError):
        I.require_records(df.limit(1), F.col("sha256"), F.col("path"), 2, row["records_sha256"])
    other = spark.createDataFrame([("b", "3"), ("c", "4")], "path string, sha256 string")
    assert {tuple(r) for r in I.tree_difference(df, other).collect()} == {("a", "missing"), ("c", "extra"), ("b", "changed")}
    assert I.tree_difference(df, df).isEmpty()
    assert [tuple(r) for r in I.unexpected(df, other, "path", "sha256").collect()] == [("b", "2", "3")]


def test_base_records(spark):
    specs = spark.createDataFrame([("count", "m", 7, ["p", "q"])], "task_family string, molecule_id string, question_seed bigint, properties array<string>")
    row = B.base_record(specs, "sys", F.lit("how many?"), F.lit("{}")).first()
    assert row["example_id"] == H.text_sha256("count\0m\x007") and row["multitask_load"] == 2
    assert [tuple(m) for m in row["prompt"]] == [("system", "sys"), ("user", "how many?")]
    assert tuple(B.longest_prompt(specs, F.size("properties")).first()) == (2, 1) and B.longest_prompt(specs.limit(0), F.size("properties")).first()[0] == 0


def test_batch_arithmetic():
    assert B.batch_arithmetic(4, 2, 3, 8) == {"generation_batch_size": 24, "unique_prompts_per_generation_batch": 3}
    for bad in ((4, 2, 3, 7), (4, 2, 3, 1)):
        with pytest.raises(ValueError):
            B.batch_arithmetic(*bad)


def test_generators_draw_by_row(spark):
    specs = spark.createDataFrame([(i, i % 3) for i in range(12)], "attempt bigint, question_seed bigint")

    def generator():
        import random

        return lambda spec: ({"x": random.random()}, None)

    schema = T.StructType([T.StructField("x", T.DoubleType())])
    rows = [B.generate(specs.repartition(n), generator, schema).orderBy("attempt").collect() for n in (1, 5)]
    assert rows[0] == rows[1] and len({r["record"]["x"] for r in rows[0]}) == 3


def test_exact_bootstrap_holds_one_replicate(spark):
    """Draws of many replicates at once, as the sequence is defined, with rows of several batches and a null scope."""
    import numpy as np

    from ledgerlark.operators import evaluation as E

    obs = spark.range(3000).selectExpr("lpad(id * 7919 % 3000, 5, '0') AS doc_hash", "IF(id % 3 = 0, NULL, 'f') AS family", "'s' AS supercategory", "explode(array(struct('b' AS model_key, 0.0D AS accuracy), struct('m' AS model_key, id % 11 / 10.0D AS accuracy))) AS m")
    obs = obs.select("doc_hash", "family", "supercategory", "m.model_key", "m.accuracy")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 700)
    try:
        df = E.bootstrap_exact(obs, "b", 250)
        got = {r["scope"]: r for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().executedPlan().toString()
    rows = sorted((r["doc_hash"], r["family"], r["accuracy"]) for r in obs.where("model_key = 'm'").fillna("", ["family"]).collect())
    for scope in ("overall", "f", None):
        deltas = np.array([x for _, f, x in rows if scope == "overall" or f == (scope or "")])
        rng = np.random.default_rng(E.bootstrap_seed("m", scope))
        means = np.concatenate([deltas[rng.integers(0, len(deltas), size=(n, len(deltas)))].mean(axis=1) for n in (200, 50)])
        low, high = np.quantile(means, [0.025, 0.975])
        assert (got[scope]["ci_low"], got[scope]["ci_high"], got[scope]["n"], got[scope]["mean_delta"]) == (low, high, len(deltas), deltas.mean())
