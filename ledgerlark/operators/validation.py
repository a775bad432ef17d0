"""Row contracts: all rules in one pass, and the violations they give."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.hashing import prefix_id
from ledgerlark.functions.text import finite, prompt_contract, prompt_text, strictly_sorted

#: Types of each family.
TASK_TYPES = {
    "count": ("single_count", "multi_count"),
    "index": ("single_index_identification", "multi_index_identification"),
    "constraint": ("constraint_generation",),
}
REQUIRED = (
    "example_id", "molecule_id", "task_family", "task_type", "prompt", "target_json", "constraints_json",
    "reference_smiles", "metadata_json", "molecular_complexity", "multitask_load", "question_seed",
    "source_dataset_revision", "generator_revision", "preprocessing_config_hash",
)


class ContractError(ValueError):
    """A dataset that breaks its contract."""


@dataclass(frozen=True)
class Rule:
    """``holds`` is true for rows that keep the rule; null counts as broken."""

    name: str
    holds: Column


def violations(df: DataFrame, rules: Sequence[Rule], *keys: str) -> DataFrame:
    """(keys, rule) of every broken rule. The rows are read once, whatever the number of rules."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(r.holds, F.lit(False)), r.name) for r in rules]), lambda r: r.isNotNull())
    return df.select(*keys, F.explode(broken).alias("rule"))


def violation_counts(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    return violations(df, rules).groupBy("rule").agg(F.count("*").alias("n"))


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that several rows have, with how many."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_columns(df: DataFrame, required: Sequence[str] = REQUIRED) -> None:
    if missing := sorted(set(required) - set(df.columns)):
        raise ContractError(f"missing columns: {missing}")


def denied(text: Column, tokens: Sequence[str]) -> Column:
    """Whether the lower-cased text holds any of the tokens."""
    return F.exists(F.array(*[F.lit(t.lower()) for t in tokens]), lambda t: F.lower(text).contains(t))


def not_leaked(secret: Column, prompt: Column, sentinel: str) -> Column:
    """The serialised secret isn't in the prompt; the sentinel of an absent one may be."""
    return (secret == sentinel) | ~prompt.contains(secret)


def same_keys(keys: Column, named: Column) -> Column:
    """Whether two arrays name the same keys, none of them twice."""
    return (F.array_sort(keys) == F.array_sort(named)) & (F.size(named) == F.size(F.array_distinct(named)))


def positive_constraint(values: Column) -> Column:
    return F.exists(values, lambda v: v > 0)


def record_rules(family: str, system_text: str | None = None, denylist: Sequence[str] = ()) -> list[Rule]:
    """The contract of frozen training records of one family, over their columns.

    JSON columns are read as VARIANT, which tells whole numbers from fractions and booleans and
    refuses repeated keys."""
    prompt = prompt_text(F.col("prompt"))
    target, constraints, meta = (F.try_parse_json(F.col(f"{c}_json")) for c in ("target", "constraints", "metadata"))
    keys = F.json_object_keys(F.col("target_json"))
    n_target = F.coalesce(F.size(keys), F.lit(0))
    n_constraints = F.coalesce(F.json_array_length(F.col("constraints_json")), F.lit(0))
    names = F.try_variant_get(meta, "$.key_names", "array<string>")
    rules = [
        Rule("example_id", F.length("example_id") > 0),
        Rule("family", F.col("task_family") == family),
        Rule("task_type", F.col("task_type").isin(*TASK_TYPES[family])),
        Rule("prompt", prompt_contract(F.col("prompt"), F.lit(system_text) if system_text is not None else None)),
        Rule("json", target.isNotNull() & constraints.isNotNull() & meta.isNotNull()),
        Rule("metadata_type", F.try_variant_get(meta, "$.task_type", "string") == F.col("task_type")),
        Rule("target_leak", not_leaked(F.col("target_json"), prompt, "{}")),
        Rule("constraint_leak", not_leaked(F.col("constraints_json"), prompt, "[]")),
        Rule("load", (F.col("multitask_load") >= 1) & (F.col("multitask_load") == (n_constraints if family == "constraint" else n_target))),
        Rule("complexity", finite(F.col("molecular_complexity"))),
    ]
    if denylist:
        source = F.concat_ws(" ", "source_dataset_revision", "generator_revision")
        rules.append(Rule("source", ~denied(source, denylist)))
    if family == "constraint":
        witness = F.col("reference_smiles")
        items = F.try_variant_get(constraints, "$", "array<variant>")
        good = F.forall(
            items,
            lambda c: F.coalesce(
                (F.try_variant_get(c, "$.operator", "string") == "=")
                & F.schema_of_variant(F.try_variant_get(c, "$.type", "variant")).isin("STRING")
                & ~F.schema_of_variant(F.try_variant_get(c, "$.value", "variant")).isin("BOOLEAN", "STRING", "VOID")
                & finite(F.try_variant_get(c, "$.value", "double"))
                & (F.size(F.json_object_keys(F.to_json(c))) == 3),
                F.lit(False),
            ),
        )
        rules += [
            Rule("fields", (n_target == 0) & (n_constraints > 0)),
            Rule("witness", F.length(witness) > 0),
            Rule("witness_leak", ~prompt.contains(witness)),
            Rule("constraints", good),
            Rule("metadata_constraints", F.to_json(F.try_variant_get(meta, "$.constraints", "variant")) == F.to_json(constraints)),
        ]
        return rules
    kind = "map<string,variant>"
    values = F.map_values(F.try_variant_get(target, "$", kind))
    if family == "count":
        good = F.forall(values, lambda v: (F.schema_of_variant(v) == "BIGINT") & (F.try_variant_get(v, "$", "bigint") >= 0))
    else:
        good = F.forall(
            values,
            lambda v: (F.schema_of_variant(v) == "ARRAY<BIGINT>") & strictly_sorted(F.try_variant_get(v, "$", "array<bigint>"))
            | (F.to_json(v) == "[]"),
        )
    rules += [
        Rule("fields", (n_target > 0) & (n_constraints == 0)),
        Rule("key_names", same_keys(keys, names) & (F.size(F.try_variant_get(meta, "$.properties", "array<variant>")) == F.size(names))),
        Rule("identity", prefix_id(F.try_variant_get(meta, "$.smiles", "string")) == F.col("molecule_id")),
        Rule("targets", good),
    ]
    return rules


def validate_records(df: DataFrame, family: str, system_text: str | None = None, denylist: Sequence[str] = ()) -> int:
    """Number of records, if they keep the whole contract; else ContractError with a few violations."""
    require_columns(df)
    broken = violations(df, record_rules(family, system_text, denylist), "example_id").limit(5).collect()
    if broken:
        raise ContractError(f"broken rules: {[(r[0], r[1]) for r in broken]}")
    if twice := repeated_keys(df, "example_id").limit(5).collect():
        raise ContractError(f"repeated example_id: {[r[0] for r in twice]}")
    if not (n := df.count()):
        raise ContractError("no rows")
    return n
