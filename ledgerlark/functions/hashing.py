"""Content addresses as column expressions and as Python functions."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_json(value: Any) -> str:
    """Compact JSON with sorted keys and without ASCII escapes; NaN and infinities are refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def text_sha256(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def sha256(column: Column) -> Column:
    """Lowercase hex SHA-256 of a string's UTF-8 bytes, or of a binary column."""
    return F.sha2(column, 256)


def prefix_id(column: Column, length: int = 24) -> Column:
    """The first hex digits of the SHA-256, as a short identity."""
    return F.substring(sha256(column), 1, length)


def composite_id(*columns: Column) -> Column:
    """SHA-256 of the columns as text with NUL between them; null if any of them is."""
    joined = F.concat(*[part for c in columns for part in (F.lit("\0"), c.cast("string"))][1:])
    return sha256(joined)


def seed_of(column: Column) -> Column:
    """Unsigned 64-bit seed: the first eight bytes of the SHA-256, big-endian, as DECIMAL(20, 0)."""
    return F.conv(F.substring(sha256(column), 1, 16), 16, 10).cast("decimal(20,0)")


def hash_draw(key: Column, digits: int = 15) -> Column:
    """Whole number in [0, 16 ** digits) from the SHA-256 of a key; at most 15 digits fit a long."""
    return F.conv(F.substring(sha256(key), 1, digits), 16, 10).cast("bigint")


def sorted_keys(column: Column, kind: T.DataType) -> Column:
    """The value with the fields of its structs in the order of their names and the entries of its maps in
    that of their keys, at every depth, so that equal values are written alike."""
    if isinstance(kind, T.StructType):
        fields = [sorted_keys(column.getField(f.name), f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(column.isNotNull(), F.struct(*fields)) if fields else column
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: sorted_keys(x, kind.elementType)) if _nested(kind.elementType) else column
    if isinstance(kind, T.MapType):
        entries = F.map_entries(column)
        if _nested(kind.valueType):
            entries = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), sorted_keys(e["value"], kind.valueType).alias("value")))
        # Keys differ, so values never decide the order; maps among them could not be compared.
        by_key = F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        return F.map_from_entries(by_key)
    return column


def _nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StructType, T.ArrayType, T.MapType))


def record_json(df: DataFrame, *left_out: str) -> Column:
    """A row as compact JSON with sorted keys at every depth and its nulls kept, without some columns."""
    fields = sorted((f for f in df.schema.fields if f.name not in left_out), key=lambda f: f.name)
    return F.to_json(F.struct(*[sorted_keys(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields]), {"ignoreNullFields": "false"})
