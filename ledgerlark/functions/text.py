"""Text expressions shared by classification, parsing and contracts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN, CLOSE = "<answer>", "</answer>"
FAMILIES = ("count", "index", "constraint")


def task_family(task_type: Column) -> Column:
    """Family that a task type's name tells; the first that fits, so ``generation_count`` is constraint."""
    low = F.lower(task_type)
    return (
        F.when(low.contains("constraint") | low.contains("generation"), "constraint")
        .when(low.contains("index"), "index")
        .when(low.contains("count"), "count")
        .otherwise("unknown")
    )


def stripped(text: Column) -> Column:
    """Without leading and trailing white space of any kind, as Python knows it (``trim`` takes blanks only)."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def payload(text: Column) -> Column:
    """Without surrounding white space, then back-ticks, then white space."""
    return stripped(F.regexp_replace(stripped(text), r"^`+|`+$", ""))


def answer_blocks(text: Column) -> Column:
    """Contents of all complete answer blocks, in order."""
    return F.regexp_extract_all(text, F.lit(r"(?s)<answer>(.*?)</answer>"), F.lit(1))


def unbalanced(text: Column) -> Column:
    """Whether a tag stands in the text though no block is complete."""
    return (text.contains(OPEN) | text.contains(CLOSE)) & (F.size(answer_blocks(text)) == 0)


def prompt_text(prompt: Column) -> Column:
    """Contents of an array of messages, line by line."""
    return F.array_join(F.transform(prompt, lambda m: m["content"]), "\n")


def prompt_contract(prompt: Column, system_text: Column | None = None) -> Column:
    """Whether a prompt is one system and one user message, both with content (and the system
    message the given one)."""
    ok = (F.size(prompt) == 2) & (prompt[0]["role"] == "system") & (prompt[1]["role"] == "user")
    ok = ok & prompt[0]["content"].isNotNull() & prompt[1]["content"].isNotNull()
    if system_text is not None:
        ok = ok & (prompt[0]["content"] == system_text)
    return F.coalesce(ok, F.lit(False))


def in_domain(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Finite and between the bounds; null is not."""
    return F.coalesce(~F.isnan(value) & (value >= low) & (value <= high), F.lit(False))


def finite(value: Column) -> Column:
    return F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))


def strictly_sorted(values: Column) -> Column:
    """Whether an array of whole numbers is sorted, without repeats, nulls or negatives."""
    ok = (values == F.array_sort(F.array_distinct(values))) & F.forall(values, lambda x: x.isNotNull() & (x >= 0))
    return F.coalesce(ok, F.lit(False))


def whole_if_integral(value: Column) -> Column:
    """Decimal text of a number, without a fraction where it has none."""
    return F.when((value == F.floor(value)) & (F.abs(value) < 1e15), value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def safe_name(text: Column) -> Column:
    """A name with every character that files and URLs might not take replaced."""
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "-")


def key_values(entries: Column) -> Column:
    """``key=value`` of a map's entries without null values, sorted by key, with commas between them."""
    kept = F.array_sort(F.map_entries(F.map_filter(entries, lambda k, v: v.isNotNull())))
    return F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


def is_sha256(text: Column) -> Column:
    return is_named(text, SHA256)


def given(json: Column, key: str, default: str, null: str = "None") -> Column:
    """Text of a top-level value of a JSON object: ``default`` where the key is missing, ``null`` where the
    value is JSON null."""
    value = F.try_variant_get(F.try_parse_json(json), f"$.{key}", "variant")
    return F.when(value.isNull(), default).when(F.is_variant_null(value), null).otherwise(F.try_variant_get(value, "$", "string"))


# Fixed formats of identifiers.
SHA256, COMMIT, CHECKPOINT, RUN = r"[0-9a-f]{64}", r"[0-9a-f]{40}", r"checkpoint-[0-9]+", r"[A-Za-z0-9][A-Za-z0-9._-]*"


def is_named(text: Column, pattern: str) -> Column:
    """Whether a text is as a whole what a pattern tells; null is not."""
    return F.coalesce(text.rlike(rf"^(?:{pattern})\z"), F.lit(False))
