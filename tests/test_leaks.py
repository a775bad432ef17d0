"""Texts that contain reference values, against a plain comparison of all with all."""

import random

import pytest

from ledgerlark.operators import leaks as L


def made_up(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["a", "bb", "é", "日本", "x1", "the", "Token", "z"])
    texts = [(i, r.choice([" ", ", ", "\n"]).join(word() for _ in range(r.randint(0, 30)))) for i in range(80)] + [(3, "more of three"), (900, None), (901, ""), (None, "the a bb")]
    cut = lambda t: t[(a := r.randint(0, len(t))) : r.randint(a, len(t))]
    values = [(f"v{i}", cut(r.choice(texts[:80])[1])) for i in range(60)] + [("n", None), ("e", ""), (None, "a"), ("one", "the"), ("none", "a never b"), ("edge", " a "), ("dot", ","), ("v1", "a bb the"), ("q", "it's")]
    return texts, values


def plain(texts, values):
    return sorted({(k, v) for k, t in texts for v, w in values if k is not None and v is not None and t and w and w in t})


def found(spark, texts, values):
    a, b = spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(values, "item string, answer string")
    df = L.leak_join(a, b, key="doc_id", text="text", value_key="item", value="answer")
    assert df.columns == ["doc_id", "item"]
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_as_a_plain_comparison(spark, seed):
    texts, values = made_up(seed)
    assert found(spark, texts, values) == plain(texts, values)


def test_ways_of_joining_agree(spark, monkeypatch):
    texts, values = made_up(3)
    for hot, block in ((1, 3), (1 << 40, 1)):
        monkeypatch.setattr(L, "HOT", hot)
        monkeypatch.setattr(L, "BLOCK", block)
        assert found(spark, texts, values) == plain(texts, values)


def test_empty_tables_and_long_texts(spark):
    assert found(spark, [], [("v", "a b c")]) == [] and found(spark, [(1, "a b c")], []) == []
    text = "filler words " * 100_000 + "the needle is here"
    assert found(spark, [(1, text), (2, "the needle")], [("v", "e needle i"), ("w", "needle")]) == [(1, "v"), (1, "w"), (2, "w")]


@pytest.mark.parametrize("small", [L.SMALL, 0])
def test_values_of_one_id_are_looked_up_apart(spark, monkeypatch, small):
    monkeypatch.setattr(L, "SMALL", small)
    texts = [(1, "a rare b"), (2, "a common b"), (3, "x common b")]
    assert found(spark, texts, [("v", "a rare b"), ("v", "a common b"), ("w", "a never b"), ("w", "x common b")]) == [(1, "v"), (2, "v"), (3, "w")]
    texts, values = made_up(4)
    assert found(spark, texts, values) == plain(texts, values)


def test_neither_texts_nor_their_tokens_are_moved(spark):
    texts, values = made_up(5)
    a, b = spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(values, "item string, answer string")
    plan = L.leak_join(a, b, key="doc_id", text="text", value_key="item", value="answer")._jdf.queryExecution().optimizedPlan().toString()
    # What has been found is told apart once, and no pairs of documents and tokens are.
    assert plan.count("strategy=broadcast") == 1 and "Aggregate [k" in plan
    assert not any("Aggregate [k" in line and "token" in line for line in plan.split("\n"))
