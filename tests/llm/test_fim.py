"""Fill-in-the-middle: cuts by runs against cuts of Python strings."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlark.llm import fim

TEXTS = ["", "a", "plain ascii", "ßäöü", "日本語テキスト", "a😀b😀😀c", "mixed äß 日本 😀 end", "holds <M> itself", "nearly <P and S> <", "<<<<", "é" * 5000 + "x" * 5000, "\x00\x7f\u0080߿ࠀ￿\U00010000\U0010ffff"]


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_every_offset_is_that_of_the_encoded_prefix(text):
    runs = fim.class_runs(text.encode("utf-8", "ignore"))
    text = text.encode("utf-8", "ignore").decode()
    assert runs.n == len(text)
    assert [runs.offset(k) for k in range(len(text) + 1)] == [len(text[:k].encode()) for k in range(len(text) + 1)]


def test_runs_are_maximal_whatever_the_slab(monkeypatch):
    text = "".join(random.Random(2).choice(["a", "bb", "é", "日本", "😀"]) for _ in range(400))
    whole = fim.class_runs(text.encode())
    assert all(a != b for a, b in zip(whole.width, whole.width[1:], strict=False))
    for slab in (1, 2, 3, 7, 64):
        monkeypatch.setattr(fim, "SLAB", slab)
        assert all((a == b).all() for a, b in zip(whole, fim.class_runs(text.encode()), strict=True))


def expected(doc_id, text):
    text = text or ""
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_outputs_and_what_is_restored(spark):
    rows = [(i, t, i % 7) for i, t in enumerate(TEXTS * 12)] + [(3, None, 0), (None, "no id", 1), (None, None, 2), (5, TEXTS[5], 3), (5, TEXTS[5], 3)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, _drawn int")
    made = fim.transform(documents)
    assert made.columns == ["doc_id", "text", "_drawn", "fim"]
    found = made.select("*", fim.restored(made["fim.form"], made["fim.output"]).alias("back")).collect()
    assert len(found) == len(rows) and sorted(r["_drawn"] for r in found) == sorted(r[2] for r in rows)
    forms = set()
    for r in found:
        f = r["fim"]
        assert (f["n"], f["form"], f["prefix_chars"], f["middle_chars"], f["output"]) == expected(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")
        forms.add(f["form"])
    assert forms == {"plain", "psm", "spm"}


def test_other_marks_and_shares(spark):
    documents = spark.createDataFrame([(i, f"text <P> {i}") for i in range(40)], "k string, body string").withColumnRenamed("k", "fim")
    marks = ("[pre]", "[suf]", "[mid]")
    made = fim.transform(documents, key="fim", text="body", to="cut", marks=marks, cut_percent=100, suffix_first_percent=100)
    rows = made.select("cut.*", "body", fim.restored(made["cut.form"], made["cut.output"], marks).alias("back")).collect()
    assert {r["form"] for r in rows} == {"spm"} and all(r["back"] == r["body"] and r["output"].startswith("[suf]") for r in rows)


@pytest.mark.parametrize("to", ["fim", "text"])
def test_empty_table_and_replaced_column(spark, to):
    documents = spark.createDataFrame([], "doc_id bigint, text string, fim string")
    assert fim.transform(documents, to=to).count() == 0


def test_a_very_long_text(spark):
    text = "long text 日本 😀 " * 200_000
    made = fim.transform(spark.createDataFrame([(8, text)], "doc_id bigint, text string")).first()["fim"]
    assert (made["n"], made["form"], made["prefix_chars"], made["middle_chars"], made["output"]) == expected(8, text)
