"""Contracts of nested documents, as data: rules are compiled to one projection over any number of rows.

A document is JSON text in a column: a task definition, an experiment's configuration, a manifest. A
rule names a path and what is to hold there; all rules of a contract look at one parsed value, and the
names of those that are broken come back with the row. Values are compared as canonical text, in which
keys are sorted and a missing key is not JSON null.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.hashing import canonical_json
from ledgerlark.operators.integrity import failed_checks

#: The rule that a text breaks which is no JSON object; none of the others is looked at then.
OBJECT = "object"


class ContractError(ValueError):
    """A contract that can't be compiled."""


def _at(document: Column, path: str) -> Column:
    return F.try_variant_get(document, f"$.{path}", "variant")


def _text(value: Column) -> Column:
    """Canonical text of a value, ``null`` for JSON null; null where there is none."""
    return F.when(value.isNotNull(), F.when(F.is_variant_null(value), F.lit("null")).otherwise(F.to_json(value)))


def _empty(text: Column) -> Column:
    """Whether a canonical text is of a value that says no: nothing, null, false, zero or an empty one."""
    return text.isNull() | text.isin("null", "false", "0", "0.0", '""', "[]", "{}")


def _entries(value: Column) -> Column:
    """Canonical texts of an object's values by key; null for anything else."""
    return F.from_json(F.to_json(value), "map<string,variant>")


_RULES: dict[str, Callable[[Column, str, Any], Column]] = {
    "equals": lambda d, path, want: _text(_at(d, path)) == F.lit(canonical_json(want)),
    "one_of": lambda d, path, want: _text(_at(d, path)).isin(*[canonical_json(w) for w in want]),
    "same_as": lambda d, path, want: _text(_at(d, path)).eqNullSafe(_text(_at(d, want))) & _at(d, path).isNotNull(),
    "present": lambda d, path, want: _at(d, path).isNotNull() if want else _at(d, path).isNull(),
    "truthy": lambda d, path, want: ~_empty(_text(_at(d, path))) if want else _empty(_text(_at(d, path))),
    # Objects of an array, by the value that each has under a key.
    "names": lambda d, path, want: F.size(F.array_except(F.array(*[F.lit(canonical_json(n)) for n in want["all"]]), _named(_at(d, path), want["by"]))) == 0,
    # No key of an object that begins so says yes.
    "none_set": lambda d, path, want: _at(d, path).isNull() | (F.size(F.map_filter(_entries(_at(d, path)), lambda k, v: k.startswith(want) & ~_empty(_text(v)))) == 0),
}


def _named(value: Column, key: str) -> Column:
    each = F.from_json(F.to_json(value), "array<variant>")
    return F.filter(F.transform(F.coalesce(each, F.array().cast("array<variant>")), lambda x: _text(F.try_variant_get(x, f"$.{key}", "variant"))), lambda t: t.isNotNull())


def compiled(document: Column, rules: Sequence[Mapping[str, Any]]) -> dict[str, Column]:
    """The check of each rule by its name. A rule is ``{"rule": name, "path": dotted path, kind: what is
    wanted}`` with one kind of: equals, one_of, same_as (a path), present, truthy (true or false), names
    (``{"by": key, "all": [...]}``), none_set (a prefix of keys). Names are told apart."""
    out: dict[str, Column] = {}
    for rule in rules:
        kinds = set(rule) - {"rule", "path"}
        if len(kinds) != 1 or not kinds <= set(_RULES) or rule["rule"] in {*out, OBJECT}:
            raise ContractError(f"no rule can be made of {dict(rule)}")
        (kind,) = kinds
        out[rule["rule"]] = _RULES[kind](document, rule["path"], rule[kind])
    return out


def broken_rules(df: DataFrame, document: str, rules: Sequence[Mapping[str, Any]], to: str = "broken") -> DataFrame:
    """Add the sorted names of the rules that a row's document breaks. A null text, one that is no JSON, and
    one that is no object break ``object`` alone. An empty table stays empty; a column ``to`` is replaced."""
    # A column, so that a text is parsed once and not by every look of every rule.
    parsed = "_parsed"
    while parsed in df.columns:
        parsed += "_"
    held = df.withColumn(parsed, F.try_parse_json(F.col(document)))
    is_object = F.try_variant_get(F.col(parsed), "$", "map<string,variant>").isNotNull()
    found = failed_checks(held, compiled(F.col(parsed), rules), to)
    return found.withColumn(to, F.when(is_object, F.col(to)).otherwise(F.array(F.lit(OBJECT)))).drop(parsed)


def forbidden_settings(df: DataFrame, key: str, document: str, forbidden: Sequence[str]) -> DataFrame:
    """(key, path) of every forbidden key with a value that says something, at any depth. Positions in arrays
    are part of paths. One step of the search goes one level deeper, for all documents together, until none
    has more; texts that are no JSON have no keys."""
    spark = df.sparkSession
    level = df.select(F.col(key).alias("k"), F.lit("").alias("path"), F.try_parse_json(F.col(document)).alias("value")).where("value is not null")
    found = None
    while True:
        inner = level.lateralJoin(spark.tvf.variant_explode(F.col("value").outer()).select(F.col("pos"), F.col("key").alias("name"), F.col("value").alias("v")))
        step = F.coalesce(F.col("name"), F.col("pos").cast("string"))
        inner = inner.select("k", F.when(F.col("path") == "", step).otherwise(F.concat_ws(".", "path", step)).alias("path"), "name", F.col("v").alias("value"))
        hits = inner.where(F.col("name").isin(*forbidden) & ~_empty(_text(F.col("value")))).select(F.col("k").alias(key), "path")
        found = hits if found is None else found.unionByName(hits)
        kind = F.schema_of_variant("value")
        level = inner.where(kind.startswith("OBJECT<") | kind.startswith("ARRAY<")).select("k", "path", "value")
        if level.isEmpty():
            return found
