"""Every registered query against its SQL, or against a plain version of the same contract."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from oracle import connection, spark_rows, sql_rows

from ledgerlark.llm import license_scan, quality, registry, sharding, toxicity


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(registry._SQL))
def test_query_matches_sql(spark, sf_dir, con, name):
    assert spark_rows(registry.QUERIES[name](spark, sf_dir)) == sql_rows(con, registry.oracle_sql()[name])


def test_every_operator_is_registered():
    """Where their libraries are installed none is left out of the entry."""
    import __spark_entry__

    found = __spark_entry__.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in found if re.match("op[0-9]+_", n)) == list(range(1, 14)) and "pipeline" in found


def test_tables_are_removed(spark, tmp_path, monkeypatch):
    from ledgerlark.llm import common

    monkeypatch.setattr(common, "_tables", lambda spark: str(tmp_path / "own"))
    assert common.materialise(spark.range(3)).count() == 3 and len(list((tmp_path / "own").iterdir())) == 1
    common.remove_tables(spark)
    assert not (tmp_path / "own").exists()


def documents(con):
    return con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_nearest_as_brute_force(spark, con, sf_dir):
    rows = connection("/root/testdata/sf0.01").execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    found, hits = {}, []
    for r in registry.QUERIES["op3_nearest"](spark, "/root/testdata/sf0.01").collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(found) == sorted(i for i in ids if i % 20 == 0)
    for q, near in found.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        best = np.lexsort((ids, -s))[:20]
        near.sort()
        hits.append(len(set(ids[best].tolist()) & {n[1] for n in near}) / 20)
        assert [n[0] for n in near] == list(range(1, 21)) and near == sorted(near, key=lambda n: (-n[2], n[1]))
        assert all(abs(s[ids == v][0] - score) < 1e-12 for _, v, score in near)
    assert np.mean(hits) >= 0.9


def drawn(children, key):
    """Position of the child (name, weight, position) with the largest weighted draw, the first of equal ones."""
    draws = [(np.log((int(hashlib.md5(f"{name}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / w, -i) for name, w, i in children if w > 0]
    return -max(draws)[1]


def descended(tree, key):
    region = tree[drawn([(r.name, r.weight, i) for i, r in enumerate(tree)], key)]
    rack = region.racks[drawn([(f"{region.name}/{k.name}", k.weight, i) for i, k in enumerate(region.racks)], key)]
    return drawn([(f"{region.name}/{rack.name}/{s}", w, s) for s, w in rack.shards], key)


def test_shards_as_a_plain_version(spark, sf_dir, con):
    tree = sharding.even_tree(sharding.SHARDS)
    grown = sharding.grow(tree)
    got = {r["doc_id"]: r for r in registry.QUERIES["op2_sharding"](spark, sf_dir).collect()}
    slots = {}
    for doc_id, text in documents(con):
        r, raw = got[doc_id], (text or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert (r["shard"], r["grown_shard"]) == (descended(tree, str(doc_id)), descended(grown, str(doc_id)))
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == len(got)


FAMILIES = [("agpl-3", "agpl-3", 0.2), ("lgpl-", "lgpl", 0.5), ("gpl-2", "gpl-2", 0.3), ("gpl-3", "gpl-3", 0.3), ("apache-2", "apache-2", 0.95), ("mpl-2", "mpl-2", 0.7),
            ("cc0", "cc0", 1.0), ("cc-by-nc", "cc-by-nc", 0.2), ("cc-by-nd", "cc-by-nd", 0.2), ("cc-by-sa", "cc-by-sa", 0.6), ("cc-by", "cc-by", 0.9), ("isc", "isc", 1.0), ("mit", "mit", 1.0)]


def plain_expression(text):
    """(labels, freedom) of the longest expression at the start of a text: every start is tried, by descent."""
    tokens = re.match(r"(?:[ \t]*(?:[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*))*", text)[0]
    tokens = re.findall(r"[()]|[^()\s]+", tokens)[:60]

    def known(t):
        low = t.lower().rstrip(".:-").rstrip("+")
        if "bsd" in low:
            return "bsd", 1.0
        return next(((label, free) for start, label, free in FAMILIES if low.startswith(start)), (low, 0.4))

    def parse(ts):
        def unit():
            if ts and ts[0] == "(":
                ts.pop(0)
                found = level(0)
                assert ts and ts.pop(0) == ")"
                return found
            assert ts and ts[0] != ")" and ts[0].upper() not in ("AND", "OR", "WITH")
            label, free = known(ts.pop(0))
            return {label}, free

        def level(k):
            if k == 3:
                return unit()
            left = level(k + 1)
            while ts and ts[0] in (("OR", "or"), ("AND", "and"), ("WITH", "with"))[k]:
                ts.pop(0)
                assert ts and (ts[0] == "(" or known(ts[0])[1] != 0.4 or re.search("-[0-9]|-exception|-only|-or-later", ts[0]))
                right = level(k + 1)
                left = (left[0], (left[1] + 1) / 2) if k == 2 else (left[0] | right[0], (max, min)[k](left[1], right[1]))
            return left

        found = level(0)
        assert not ts
        return found

    for n in range(len(tokens), 0, -1):
        try:
            return parse(tokens[:n])
        except AssertionError:
            continue
    return None


def test_plain_expressions_agree():
    for text in ("MIT", "GPL-3.0-only OR MIT AND CC-BY-NC-4.0", "(GPL-3.0-only OR MIT) AND CC-BY-NC-4.0 etc", "GPL-2.0-or-later WITH Classpath-exception-2.0 and Apache-2.0", "MIT or later", "MIT AND (GPL-2.0-only OR", "AND", "(MIT"):
        tokens = license_scan.postfix(text)
        assert (tokens and license_scan.evaluate(tokens)) == plain_expression(text), text


def test_licence_labels_and_scores_as_a_plain_version(spark, sf_dir, con):
    """Labels beyond the base ones, and the score: notices by a plain search of words, tags by their expressions."""
    got = {r["doc_id"]: r for r in registry.QUERIES["op4_license_scan"](spark, sf_dir).collect()}
    for doc_id, text in documents(con):
        w, labels, free = words(text), set(), []
        for phrase, label in (license_scan.BASE_PHRASES | license_scan.NOTICE_PHRASES).items():
            p = phrase.split()
            if any(w[i : i + len(p)] == p for i in range(len(w) - len(p) + 1)):
                labels.add(label)
                free.append(license_scan.FREEDOM[label])
        for m in re.finditer(r"(?ai:SPDX-License-Identifier)\s*:", text or ""):
            if found := plain_expression((text or "")[m.end() : m.end() + 2000]):
                labels |= found[0]
                free.append(found[1])
        r = got[doc_id]
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert r["labels"] == ",".join(sorted(labels)) and r["score"] == min(free, default=0.0)


def test_licence_places(spark, sf_dir, con):
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    got = {r["doc_id"]: r for r in registry.QUERIES["op4_license_scan"](spark, sf_dir).collect()}
    for doc_id, text in documents(con):
        w = words(text)
        places = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        r = got[doc_id]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


@pytest.mark.parametrize("name,folds,held,label,cut", [("op5_toxicity", 5, 0, "toxic", 0.5), ("op6_quality", 4, 2, "quality", 0.7)])
def test_scores(spark, con, name, folds, held, label, cut):
    sf_dir = "/root/testdata/sf0.1"
    y = dict(connection(sf_dir).execute(f"SELECT doc_id, {label} FROM labels").fetchall())
    rows = registry.QUERIES[name](spark, sf_dir).collect()
    assert len(rows) == 10_000
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == held)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= cut)
    judged = [(r["predicted"], y[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in y]
    assert np.mean([p == t for p, t in judged]) > 0.96
    positive = 1 if name == "op5_toxicity" else 0
    called = [t for p, t in judged if p == positive]
    assert np.mean([t == positive for t in called]) > 0.95
    # Of what the minority label holds, most is found, on rows that nothing was learned from.
    assert np.mean([p == positive for p, t in judged if t == positive]) > 0.85


@pytest.mark.parametrize("name", ["op5_toxicity", "op6_quality"])
def test_scores_as_the_fitted_model_gives_them(spark, sf_dir, con, name):
    """Scores of the query beside those of a plain formula over the weights of the same model."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r["score"] for r in registry.QUERIES[name](spark, sf_dir).collect()}
    texts = con.execute("SELECT doc_id, text, n_chars FROM documents").fetchall()
    if name == "op5_toxicity":
        m = toxicity.train(docs, labels)
        for doc_id, text, _ in texts:
            found = {w.encode() for w in words(text)}
            found |= {b"^" + w[:k] for w in found for k in toxicity.STEMS if len(w) > k}
            x = m.scale * (m.bias + sum(v for f, v in m.weights.items() if f in found)) + m.offset
            assert abs(rows[doc_id] - 1 / (1 + np.exp(-np.clip(x, -40, 40)))) < 1e-9
        return
    m = quality.train(docs, labels, meta="n_chars")
    for doc_id, text, n in texts:
        index, values = quality.inputs(None if text is None else text.encode(), n)
        x, v = m.standard(values).astype(float), m.v[index].astype(float)
        # All pairs one by one, without the identity that the machine scores with.
        pairs = ((v @ v.T) * np.outer(x, x))[np.triu_indices(len(x), 1)].sum()
        raw = m.w0 + m.w[index].astype(float) @ x + pairs
        assert abs(m.raw(index, values) - raw) < 1e-3 * (1 + abs(raw)) and abs(rows[doc_id] - m.score(index, values)) < 1e-6


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def base_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], ("email", "ip", "card", "phone").index(s[0])))


def test_personal_data(spark, sf_dir, con):
    got = {r["doc_id"]: r for r in registry.QUERIES["op7_pii"](spark, sf_dir).collect()}
    for doc_id, text in documents(con):
        base, r = base_spans(text or ""), got[doc_id]
        listed = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r["base_sha256"] == sha(",".join(listed)) and set(listed) <= set(r["spans"].split(",")) | {""}
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone")]


def test_bpe_equals_the_library(spark, sf_dir, con):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    got = {r["doc_id"]: r for r in registry.QUERIES["op9_bpe"](spark, sf_dir).collect()}
    for doc_id, text in documents(con):
        ids = t.encode(text or "", add_special_tokens=False).ids
        r = got[doc_id]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(",".join(map(str, ids))))
        assert r["decoded_sha256"] == sha(t.decode(ids, skip_special_tokens=False))
