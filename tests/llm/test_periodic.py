"""Periodic runs: the harmonic grid against a scan of every period."""

import hashlib
import random
import re
import zlib

import numpy as np
from oracle import connection

from ledgerlark.llm import periodic


def plain_runs(words):
    out = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(6, 4 * q):
                out.setdefault((start, i + q - start), q)
            i += 1
    return [(s, n, q) for (s, n), q in sorted(out.items(), key=lambda x: (x[0][0], x[1]))]


def plain_collapsed(words):
    dropped = {i for s, n, q in plain_runs(words) for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def made_up(r, most=60):
    n, k = r.randint(0, most), r.choice([1, 2, 2, 3, 8])
    words = [r.choice("abcdefgh"[:k]) for _ in range(n)]
    if n and r.random() < 0.5:
        a = r.randrange(n)
        p = r.randint(1, max(1, (n - a) // 3))
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def checked(texts):
    for words, got in zip(texts, periodic.found_in([" ".join(w).encode() if w else None for w in texts]).to_pylist(), strict=True):
        assert [(x["start"], x["length"], x["period"]) for x in got["runs"]] == plain_runs(words)
        assert (got["collapsed"], got["n_words"]) == (plain_collapsed(words), len(words))


def test_batches_as_a_plain_scan():
    r = random.Random(1)
    for _ in range(150):
        checked([made_up(r) for _ in range(r.randint(0, 6))])


def test_pairs_in_small_blocks(monkeypatch):
    monkeypatch.setattr(periodic, "PAIRS", 7)
    r = random.Random(2)
    for _ in range(20):
        checked([made_up(r, 90) for _ in range(3)])


def test_hashes_that_lie_are_found_out(monkeypatch):
    """Under a hash that tells nothing apart, every verification fails, and the next attempt is taken."""
    attempts, true = [], periodic.Prefixes.equal

    class Lying(periodic.Prefixes):
        def __init__(self, ids, attempt):
            super().__init__(ids, attempt)
            attempts.append(attempt)
            self.equal = (lambda a, q, length: np.ones(len(a), bool)) if attempt < 2 else (lambda a, q, length: true(self, a, q, length))

    monkeypatch.setattr(periodic, "Prefixes", Lying)
    checked([list("xyabababababzz"), list("abcabcabcabcabcx")])
    assert attempts == [0, 1, 2]


def test_products_modulo_the_prime():
    p = (1 << 61) - 1
    r = random.Random(3)
    a, b = ([r.choice([0, 1, p - 1, r.randrange(p)]) for _ in range(500)] for _ in range(2))
    got = periodic.mulmod(np.array(a, np.uint64), np.array(b, np.uint64))
    assert got.tolist() == [x * y % p for x, y in zip(a, b, strict=True)]


def looped(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_query_as_a_plain_version(spark, sf_dir):
    got = {r["doc_id"]: r for r in periodic.op13_periodic(spark, sf_dir).collect()}
    rows = connection(sf_dir).execute("SELECT doc_id, text FROM documents").fetchall()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        words, r = looped(doc_id, text), got[doc_id]
        if len(words) > 2500:
            continue  # the plain scan is quadratic; the SQL covers these
        runs = plain_runs(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"]) == (best or (None,) * 3)
        assert r["exponent_milli"] == (best and 1000 * best[1] // best[2])
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(plain_collapsed(words).encode()).hexdigest()


def test_odd_rows_and_clashing_columns(spark):
    loop = "go  go\tgo\ngo go go stop"
    rows = [(1, None, 0), (2, "", 1), (3, " \n\t ", 2), (None, loop, 3), (4, loop, 4), (4, loop, 4), (5, "  a b", 5), (6, "w " * 300_000, 6)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, start int")
    out = periodic.find_runs(documents).orderBy("start").collect()
    assert [r["start"] for r in out] == [0, 1, 2, 3, 4, 4, 5, 6]
    assert [r["periodic"]["n_words"] for r in out] == [0, 0, 0, 7, 7, 7, 3, 300_000]
    assert [r["periodic"]["collapsed"] for r in out] == ["", "", "", *["go stop"] * 3, "  a b", "w"]
    assert [tuple(x) for x in out[7]["periodic"]["runs"]] == [(0, 300_000, 1)]
    assert periodic.find_runs(documents.limit(0)).count() == 0


def test_texts_are_looped_as_stated(spark):
    text = " one two  three\nfour five six seven eight nine ten eleven twelve "
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0] + [1]
    df = spark.createDataFrame([(i, text) for i in ids], "doc_id bigint, text string")
    got = df.select("doc_id", periodic.looped(df["text"], df["doc_id"]).alias("text")).collect()
    assert len(got) > 30 and all(r["text"].split() == looped(r["doc_id"], text) for r in got)
