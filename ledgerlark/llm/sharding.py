"""Sharding by a hierarchical weighted hash tree.

Shards are the leaves of a tree of regions and racks; a node weighs as much as the shards below it.
A key descends from the root: at each level every child draws ``ln(u) / weight`` from a hash of the
key and the child's name, and the largest draw wins, so that a child gets keys in proportion to its
weight and only children whose weight changes win or lose keys. Movement thus stays inside the
subtrees whose weights change. ``grow`` hangs a new shard into a region of its own: that region is
the only subtree whose weight changes, and the one more shard takes rows only into itself.

Draws are native expressions (hashes by MD5, so that any SQL engine can repeat them); slots come
from a range partitioning by shard and key and running offsets, so no task holds a whole shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlark.llm.common import fresh, materialise, table

SHARDS = 16


@dataclass(frozen=True)
class Rack:
    name: str
    shards: tuple[tuple[int, int], ...]  # number and weight

    @property
    def weight(self) -> int:
        return sum(w for _, w in self.shards)


@dataclass(frozen=True)
class Region:
    name: str
    racks: tuple[Rack, ...]

    @property
    def weight(self) -> int:
        return sum(r.weight for r in self.racks)


Tree = tuple[Region, ...]


def even_tree(shards: int = SHARDS, per_rack: int = 4, racks_per_region: int = 2, weight: int = 1) -> Tree:
    """Shards 0 to ``shards`` - 1 of one weight in racks and regions of at most the given sizes."""
    racks = [
        Rack(f"k{at // per_rack}", tuple((s, weight) for s in range(at, min(at + per_rack, shards))))
        for at in range(0, shards, per_rack)
    ]
    return tuple(
        Region(f"r{at // racks_per_region}", tuple(racks[at : at + racks_per_region]))
        for at in range(0, len(racks), racks_per_region)
    )


def grow(tree: Tree, weight: int = 1) -> Tree:
    """The tree with one more shard, in a region and rack of its own."""
    new = 1 + max(s for region in tree for rack in region.racks for s, _ in rack.shards)
    return (*tree, Region(f"g{new}", (Rack(f"gk{new}", ((new, weight),)),)))


def _choice_sql(children: str, key: str, dialect: str) -> str:
    """Position of the child with the largest draw; of equal draws the first.

    A draw is ``ln(u) / weight`` with u in (0, 1) from the first 52 bits of an MD5 of name and key.
    """
    if dialect == "spark":
        bits = f"CAST(conv(substring(md5(concat(c.name, ':', {key})), 1, 13), 16, 10) AS DOUBLE)"
        draw = f"named_struct('d', ln(({bits} + 0.5D) / 4503599627370496D) / c.w, 'i', -c.i)"
        return f"(-array_max(transform({children}, c -> {draw})).i)"
    bits = f"CAST(CAST(concat('0x', substring(md5(concat(c.name, ':', {key})), 1, 13)) AS BIGINT) AS DOUBLE)"
    draw = f"{{'d': ln(({bits} + 0.5e0) / 4503599627370496e0) / c.w, 'i': -c.i}}"
    return f"(-list_max(list_transform({children}, lambda c: {draw})).i)"


def _array_sql(items: list[str], dialect: str) -> str:
    return f"array({', '.join(items)})" if dialect == "spark" else f"[{', '.join(items)}]"


def _children_sql(children: list[tuple[str, int, int]], dialect: str) -> str:
    """Array of (name, weight, position)."""
    one = "named_struct('name', '{0}', 'w', {1}D, 'i', {2})" if dialect == "spark" else "{{'name': '{0}', 'w': {1}e0, 'i': {2}}}"
    return _array_sql([one.format(*c) for c in children], dialect)


def shard_sql(tree: Tree, key: str, dialect: str = "spark", region_name: str = "region", rack_name: str = "rack") -> tuple[str, str, str]:
    """SQL of three steps, each over the columns of those before: the region of a non-null string
    ``key``, the rack within it, and the shard. Weightless nodes draw nothing."""
    regions = [[rack for rack in region.racks if rack.weight > 0] for region in tree if region.weight > 0]
    names = [region.name for region in tree if region.weight > 0]
    first = _children_sql([(n, sum(k.weight for k in racks), i) for i, (n, racks) in enumerate(zip(names, regions, strict=True))], dialect)
    second = _array_sql(
        [_children_sql([(f"{n}/{k.name}", k.weight, i) for i, k in enumerate(racks)], dialect) for n, racks in zip(names, regions, strict=True)], dialect
    )
    third = _array_sql(
        [
            _array_sql([_children_sql([(f"{n}/{k.name}/{s}", w, s) for s, w in k.shards if w > 0], dialect) for k in racks], dialect)
            for n, racks in zip(names, regions, strict=True)
        ],
        dialect,
    )
    at = "{0}[{1}]" if dialect == "spark" else "({0})[{1} + 1]"
    return (
        _choice_sql(first, key, dialect),
        _choice_sql(at.format(second, region_name), key, dialect),
        _choice_sql(at.format(at.format(third, region_name), rack_name), key, dialect),
    )


def with_shard(df: DataFrame, tree: Tree, key: str, to: str) -> DataFrame:
    """Add column ``to``, the shard that the non-null string column ``key`` descends to. Other columns stay,
    whatever their names, but a column ``to`` is replaced."""
    at_region, at_rack = fresh(df.withColumn(to, F.lit(0)), "_region", "_rack")
    region, rack, shard = shard_sql(tree, key, region_name=at_region, rack_name=at_rack)
    return df.withColumn(at_region, F.expr(region)).withColumn(at_rack, F.expr(rack)).withColumn(to, F.expr(shard).cast("int")).drop(at_region, at_rack)


def place(documents: DataFrame, tree: Tree, *, key: str = "doc_id", text: str = "text", grown: Tree | None = None) -> DataFrame:
    """key, size, text_crc32, shard, slot and grown_shard of each row of ``documents``.

    Size is the UTF-8 bytes of the text and 1; a null text has size 1 and the checksum of the empty
    text; a null key is placed as the empty key. Slots count each shard's rows from 0 in the order of
    key (nulls first), checksum and size; repeated rows get slots of their own. Other columns are
    not read. An empty table gives no rows.
    """
    rows = documents.select(
        F.col(key).alias("_key"),
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_name"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"),
    )
    placed = with_shard(rows, tree, "_name", "shard")
    placed = with_shard(placed, grown, "_name", "grown_shard") if grown else placed.withColumn("grown_shard", F.lit(None).cast("int"))
    # The row number of the input parts repeated rows of a key, however many there are.
    order = ["shard", "_key", "text_crc32", "size", "_at"]
    ranged = materialise(
        placed.drop("_name")
        .withColumn("_at", F.monotonically_increasing_id())
        .repartitionByRange(*order)
        .withColumn("_part", F.spark_partition_id())
    )
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    offsets = offsets.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("shard", "_part").orderBy(*order[1:])
    return (
        ranged.withColumn("_row", F.row_number().over(within))
        .join(offsets, ["shard", "_part"])
        .select(
            F.col("_key").alias(key),
            "size",
            "text_crc32",
            "shard",
            (F.col("_before") + F.col("_row") - 1).cast("bigint").alias("slot"),
            "grown_shard",
        )
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = even_tree(SHARDS)
    placed = place(table(spark, sf_dir, "documents"), tree, grown=grow(tree))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _op2_sql() -> str:
    """DuckDB has no CRC-32, so it is folded over the bytes by the table of its polynomial."""
    tree = even_tree(SHARDS)
    (r, k, s), (gr, gk, gs) = shard_sql(tree, "name", "duckdb"), shard_sql(grow(tree), "name", "duckdb")
    return f"""
WITH RECURSIVE steps AS (
  SELECT n, n AS v, 0 AS i FROM (SELECT unnest(generate_series(0, 255)) AS n)
  UNION ALL
  SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, i + 1 FROM steps WHERE i < 8
),
t AS MATERIALIZED (SELECT list(CAST(v AS BIGINT) ORDER BY n) AS crc FROM steps WHERE i = 8),
d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS name, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (
  SELECT doc_id, name, CAST(length(h) // 2 + 1 AS BIGINT) AS size,
         xor(list_reduce(list_transform(generate_series(1, length(h) // 2), lambda i: CAST(concat('0x', substring(h, CAST(2 * i - 1 AS BIGINT), 2)) AS BIGINT)),
                         lambda a, x: xor(a >> 8, crc[CAST((xor(a, x) & 255) + 1 AS BIGINT)]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32
  FROM d, t
),
p1 AS (SELECT *, {r} AS region FROM sized),
p2 AS (SELECT *, {k} AS rack FROM p1),
p3 AS (SELECT doc_id, name, size, text_crc32, CAST({s} AS INTEGER) AS shard FROM p2),
g1 AS (SELECT *, {gr} AS region FROM p3),
g2 AS (SELECT *, {gk} AS rack FROM g1)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
       CAST({gs} AS INTEGER) AS grown_shard
FROM g2
"""


OP2_SQL = _op2_sql()
