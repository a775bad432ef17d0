"""Contracts of nested documents, every rule broken by a document of its own."""

import json

import pytest

from ledgerlark.plans import contracts as C
from ledgerlark.sources.config import forbidden_keys

RULES = [
    {"rule": "name", "path": "task.name", "equals": "t"},
    {"rule": "generation", "path": "task.generation", "equals": {"until": [], "max": 5, "sample": True}},
    {"rule": "family", "path": "family", "one_of": ["count", "index"]},
    {"rule": "selector", "path": "dataset.selector", "same_as": "family"},
    {"rule": "no limit", "path": "task.limit", "present": False},
    {"rule": "seeds", "path": "seeds", "present": True},
    {"rule": "local", "path": "model.local", "truthy": True},
    {"rule": "no remote code", "path": "model.remote", "truthy": False},
    {"rule": "metrics", "path": "task.metrics", "names": {"by": "m", "all": ["p1", "p3"]}},
    {"rule": "held out", "path": "flags", "none_set": "used_for"},
]
GOOD = {
    "task": {"name": "t", "generation": {"sample": True, "max": 5, "until": []}, "metrics": [{"m": "p3"}, "x", {"m": "p1", "k": 2}, {"m": None}]},
    "family": "index", "dataset": {"selector": "index"}, "seeds": None, "model": {"local": True}, "flags": {"used_for_training": False, "used_for_tuning": None, "other": True},
}


def changed(path, value=...):
    out = json.loads(json.dumps(GOOD))
    *way, last = path.split(".")
    at = out
    for k in way:
        at = at[k]
    if value is ...:
        del at[last]
    else:
        at[last] = value
    return out


CASES = [
    (GOOD, []), (changed("task.name", "T"), ["name"]), (changed("task.name"), ["name"]), (changed("task.generation.max", 6), ["generation"]), (changed("task.generation.more", 1), ["generation"]),
    (changed("family", "other"), ["family", "selector"]), (changed("dataset.selector", "count"), ["selector"]), (changed("dataset"), ["selector"]), (changed("task.limit", None), ["no limit"]),
    (changed("task.limit", 3), ["no limit"]), (changed("seeds"), ["seeds"]), (changed("model.local", 0), ["local"]), (changed("model.local"), ["local"]), (changed("model.remote", True), ["no remote code"]),
    (changed("model.remote", ""), []), (changed("task.metrics", [{"m": "p1"}]), ["metrics"]), (changed("task.metrics", "p1 p3"), ["metrics"]), (changed("task.metrics"), ["metrics"]),
    (changed("flags.used_for_tuning", True), ["held out"]), (changed("flags.used_for_more", 1), ["held out"]), (changed("flags"), []),
]


def test_every_rule(spark):
    texts = [json.dumps(d) for d, _ in CASES] + ["[]", "no json", "1", None, "{}"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "i int, doc string, broken string")
    got = [r["broken"] for r in C.broken_rules(df, "doc", RULES).orderBy("i").collect()]
    every = sorted({r["rule"] for r in RULES} - {"no limit", "no remote code", "held out"})
    assert got == [sorted(b) for _, b in CASES] + [["object"]] * 4 + [every]
    assert C.broken_rules(df.limit(0), "doc", RULES).count() == 0


@pytest.mark.parametrize("rule", [{"rule": "a", "path": "b"}, {"rule": "a", "path": "b", "like": 1}, {"rule": "a", "path": "b", "equals": 1, "present": True}, {"rule": "object", "path": "b", "equals": 1}])
def test_rules_that_are_none(spark, rule):
    df = spark.createDataFrame([("{}",)], "doc string")
    with pytest.raises(C.ContractError):
        C.broken_rules(df, "doc", [rule])
    with pytest.raises(C.ContractError):
        C.broken_rules(df, "doc", [RULES[0], RULES[0]])


def test_forbidden_settings_at_any_depth(spark):
    docs = [{"x": [{"limit": 5}, {"limit": None}, [[{"deep": {"samples": [0]}}]]], "samples": "", "limit": False}, {"limit": {"limit": 1}}, {}, [{"samples": 2}], {"a": {"b": {"c": {"d": {"e": {"limit": "x"}}}}}}]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(90, None), (91, "no json")], "i int, doc string")
    got = sorted((r["i"], r["path"]) for r in C.forbidden_settings(df, "i", "doc", ("limit", "samples")).collect())
    want = sorted((i, p) for i, d in enumerate(docs) for p in [*forbidden_keys(d, ("limit", "samples"))])
    assert got == sorted({*want, (1, "limit.limit")}) and (0, "x.2.0.0.deep.samples") in got
    assert C.forbidden_settings(df.limit(0), "i", "doc", ("limit",)).count() == 0


def test_a_document_is_parsed_once(spark, sf_dir):
    from ledgerlark import catalogue

    df = spark.createDataFrame([(1, json.dumps(GOOD))], "i int, doc string")
    for found in (C.broken_rules(df, "doc", RULES), catalogue.QUERIES["document_contract"](spark, sf_dir)):
        assert found._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
