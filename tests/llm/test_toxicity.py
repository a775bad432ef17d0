"""The label model decides from votes alone, and its classifier holds on texts it has not seen."""

import zlib

import numpy as np
import pytest
from oracle import connection

from ledgerlark.llm import toxicity
from ledgerlark.llm.common import table
from ledgerlark.llm.linear import fold, labelled_sample

BIG = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def learned(spark):
    """What ``train`` hands to ``fit`` for the larger table."""
    documents, labels = table(spark, BIG, "documents"), table(spark, BIG, "labels")
    kept = {}
    fit = toxicity.fit
    try:
        toxicity.fit = lambda *args: kept.setdefault("args", args) and fit(*args)
        kept["model"] = toxicity.train(documents, labels)
    finally:
        toxicity.fit = fit
    return kept


def votes(args):
    chosen, places, lists, hits, y, part = args
    seen = np.flatnonzero(part != 4)
    return toxicity.votes_of([lists[i] for i in seen], [hits[i] for i in seen], toxicity.voters_of(chosen, places), len(places)), y[seen]


def test_permuted_labels_change_nothing_once_the_lists_are_drawn(learned):
    chosen, places, lists, hits, y, part = learned["args"]
    seen = np.flatnonzero(part != 4)
    other = y.copy()
    other[seen] = np.random.default_rng(5).permutation(other[seen])
    assert (other != y).sum() > 100
    assert toxicity.fit(chosen, places, lists, hits, other, part) == learned["model"]


def test_posterior_is_the_voters_work(learned):
    v, y = votes(learned["args"])
    q, rates, _ = toxicity.label_model(v, y.mean())
    agreement = ((q >= 0.5) == (y == 1)).mean()
    assert 0.97 < agreement < 1  # it is not the label, though it comes close
    strongest = int(np.argmax(rates[1] - rates[0]))
    without = v.copy()
    without[:, strongest] = 0
    changed, _, _ = toxicity.label_model(without, y.mean())
    assert np.abs(changed - q).max() > 0.1


def test_every_telling_word_of_the_sample_is_kept(spark, learned):
    chosen = learned["args"][0]
    assert len({f for f, _, _ in chosen}) == len(chosen) and not hasattr(toxicity, "MOST_FEATURES")
    documents, labels = table(spark, BIG, "documents"), table(spark, BIG, "labels")
    sample = labelled_sample(documents, labels, "toxic", fold("doc_id", 5) != 0, toxicity.MOST_LABELLED)
    a, b = {}, {}
    for r in sample.collect():
        for f in toxicity.features_of(set(toxicity.words_of(r["text"].encode()))):
            of = a if r["y"] else b
            of[f] = of.get(f, 0) + 1
    assert all((a.get(f, 0), b.get(f, 0)) == (n, m) for f, n, m in chosen)


def test_held_out_texts(spark):
    got = {r["doc_id"]: r for r in toxicity.op5_toxicity(spark, BIG).collect()}
    gold = connection(BIG).execute("SELECT doc_id, toxic FROM labels").fetchall()
    rows = [(got[i]["score"], got[i]["predicted"], y) for i, y in gold if zlib.crc32(str(i).encode()) % 5 == 0]
    score, predicted, y = map(np.array, zip(*rows, strict=True))
    hits = ((predicted == 1) & (y == 1)).sum()
    assert len(y) > 800 and hits / predicted.sum() > 0.97 and hits / y.sum() > 0.8
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(y))
    ranks[order] = np.arange(1, len(y) + 1)
    n1 = y.sum()
    assert (ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1)) > 0.95
    print("precision", hits / predicted.sum(), "recall", hits / y.sum())
