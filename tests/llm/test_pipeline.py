import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import pii
from ledgerlark.llm.common import materialise


@pytest.fixture(scope="module")
def stages(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = [docs]
    for _, stage in corpus_pipeline.STAGES:
        found.append(materialise(stage(spark, found[-1], sf_dir)))
    return found


def ids(df):
    return [r[0] for r in df.select("doc_id").orderBy("doc_id").collect()]


def test_stages_keep_columns_and_only_remove(stages):
    for before, after in zip(stages, stages[1:-1], strict=False):
        assert after.columns == before.columns and after.dtypes == before.dtypes
        assert set(ids(after)) <= set(ids(before))
    assert ids(stages[4]) == ids(stages[3]) == ids(stages[5])


def test_toxic_documents_go_and_others_stay(stages):
    labels = stages[0].sparkSession.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = stages[1].select("doc_id").withColumn("kept", F.lit(1))
    rows = labels.join(kept, "doc_id", "left").groupBy("toxic").agg(F.avg(F.coalesce("kept", F.lit(0))).alias("share"))
    share = {r["toxic"]: r["share"] for r in rows.collect()}
    assert share[0] > 0.98 and share[1] < 0.6


def test_one_document_of_each_group_stays(stages):
    from test_llm_operators import brute_groups

    rows = [(r["doc_id"], r["text"]) for r in stages[1].orderBy("doc_id").collect()]
    assert ids(stages[2]) == sorted(d for d, _, c in brute_groups(rows) if c == d)


def test_contaminated_documents_go(stages):
    from test_llm_operators import brute_windows

    items = [tuple(r) for r in stages[0].sparkSession.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select("item_id", "text").collect()]
    texts = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    gone = set(texts) - set(ids(stages[3]))
    assert gone and all(brute_windows(texts[d], items)[1] for d in gone)
    assert not any(brute_windows(texts[d], items)[1] for d in sorted(texts)[::9] if d not in gone)


def test_personal_data_are_replaced(stages):
    before = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    changed = 0
    for r in stages[4].collect():
        spans = pii.find(before[r["doc_id"]], pii.default_models())[1]
        assert r["text"] == pii.redacted(before[r["doc_id"]], spans) and (not spans or r["n_chars"] == len(r["text"]))
        changed += bool(spans)
    assert changed > 5


def test_tokens_round_trip(stages):
    import hashlib

    texts = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    for r in stages[5].collect():
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() and len(r["ids"]) == r["n_tokens"]


def test_run_equals_the_stages(spark, stages):
    rows = {(r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, "/root/testdata/sf0.01").collect()}
    assert rows == {(r["doc_id"], r["ids_sha256"]) for r in stages[5].collect()}


ODD = [(1, None), (2, ""), (3, " \t "), (4, "p q r s t u"), (5, "P q r s t u"), (5, "P q r s t u"), (6, "mail a.b@c.example.org now"), (7, "lorem ipsum dolor " * 40_000), (None, "x y z"), (None, None), (8, "aa bb cc dd ee ff"), (8, "gg hh ii jj kk ll")]
CLASHES = ("windows", "toxicity", "personal", "tokens", "node", "_gone", "_id", "_row", "_name", "_key", "name", "least", "n", "y", "Toxicity_")


def odd_documents(spark):
    df = spark.createDataFrame(ODD, "doc_id bigint, text string").withColumn("n_chars", F.length("text").cast("bigint"))
    return df.withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce("text", F.lit("-"))) for c in CLASHES})


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows_and_clashing_columns(spark, name, stage):
    docs = odd_documents(spark)
    out = materialise(stage(spark, docs, "/root/testdata/sf0.001"))
    none = materialise(stage(spark, docs.limit(0), "/root/testdata/sf0.001"))
    assert none.count() == 0 and none.columns == out.columns
    rows = out.collect()
    if name == "bpe":
        assert len(rows) == len(ODD) and all((r["n_tokens"] == 0) == (r["doc_id"] in (2,) or len(r["ids"]) == 0) for r in rows)
        return
    assert out.dtypes == docs.dtypes
    # Other columns are those of the row, and nothing but near duplicates goes.
    plain = lambda r: (r["doc_id"], *(r[c] for c in CLASHES))
    before = sorted(map(repr, map(plain, docs.collect())))
    after = sorted(map(repr, map(plain, rows)))
    if name == "ngram_jaccard_join":
        assert len(after) == len(before) - 2 and not set(after) - set(before) and {r["doc_id"] for r in rows} == {1, 2, 3, 4, 6, 7, 8, None}
    else:
        assert after == before
    texts = {r["doc_id"]: r["text"] for r in rows}
    assert texts[1] is None and texts[2] == "" and texts[7] == dict(ODD)[7]
    if name == "pii":
        assert texts[6] == "mail <EMAIL> now" and {r["doc_id"]: r["n_chars"] for r in rows}[6] == 16
