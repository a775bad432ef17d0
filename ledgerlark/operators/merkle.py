"""Merkle trees over tables: digests of key ranges, combined level by level, and what differs between two.

A key's place is the SHA-256 of its text; a range is a prefix of it, so ranges are of one size whatever
the keys. The digest of a lowest range is that of the sums of its records' digests in four lanes: sums
don't depend on order, and are added up where the rows are, so no range needs its rows in one place.
Higher ranges digest those of their up to sixteen children.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.functions.hashing import sha256
from ledgerlark.sinks import files

#: Hexadecimal digits of the lowest ranges: 4096 of them.
DEPTH = 3
MOST_DEPTH = 4
#: Hexadecimal digits of a record's digest that one lane sums; four lanes hold 240 bits.
LANE = 15
#: A lane is summed in two parts of so many bits, which are whole numbers for some 2 ** 33 rows.
HALF = 30


def range_of(key: Sequence[str], depth: int = DEPTH) -> Column:
    """The lowest range of a row. Null keys are marked, so that they differ from empty ones."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("-")) for k in key]
    return F.substring(sha256(F.concat_ws("\0", *parts)), 1, depth)


def _halves(h: str) -> list[Column]:
    """The upper and lower parts of every lane of a record's digest, one lane after another."""
    lanes = [F.conv(F.substring(h, 1 + LANE * i, LANE), 16, 10).cast("bigint") for i in range(4)]
    return [part for x in lanes for part in (F.shiftright(x, HALF), x.bitwiseAND(F.lit((1 << HALF) - 1)))]


def levels(df: DataFrame, key: Sequence[str], record: Column, depth: int = DEPTH, *, range_column: str | None = None) -> DataFrame:
    """(level, range, n, digest) of all ranges that hold rows, from level 0, the whole, to ``depth``. A null
    record counts as the empty text; an empty table has no ranges."""
    if not 0 < depth <= MOST_DEPTH:
        raise ValueError(f"depth is from 1 to {MOST_DEPTH}")
    place = F.col(range_column) if range_column else range_of(key, depth)
    rows = df.select(place.alias("range"), sha256(F.coalesce(record, F.lit(""))).alias("h"))
    sums = rows.groupBy("range").agg(F.count("*").alias("n"), *[F.sum(x).alias(f"p{i}") for i, x in enumerate(_halves("h"))])
    whole = lambda i: F.col(f"p{2 * i}").cast("decimal(19,0)") * F.lit(1 << HALF).cast("decimal(10,0)") + F.col(f"p{2 * i + 1}")
    lowest = sums.select("range", "n", *[whole(i).alias(f"s{i}") for i in range(4)])
    digest = sha256(F.concat_ws(",", F.col("n").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(4)]))
    at = out = lowest.select(F.lit(depth).alias("level"), "range", "n", digest.alias("digest"))
    for level in range(depth - 1, -1, -1):
        # At most sixteen children each.
        children = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "range", "digest"))), ",")
        at = at.groupBy(F.substring("range", 1, level).alias("range")).agg(F.sum("n").alias("n"), sha256(children).alias("digest")).select(F.lit(level).alias("level"), "range", "n", "digest")
        out = out.unionByName(at)
    return out


def root(df: DataFrame, key: Sequence[str], record: Column, depth: int = DEPTH) -> str | None:
    """The digest of the whole table, whatever the order of its rows; None if it is empty."""
    found = levels(df, key, record, depth).where("level = 0").first()
    return found["digest"] if found else None


def write(df: DataFrame, path: str, key: Sequence[str], record: Column, depth: int = DEPTH) -> None:
    """A table kept by its lowest ranges, with its tree beside it; an existing one is an error."""
    placed = df.withColumn("range", range_of(key, depth))
    # A range is a folder, and one task writes it.
    placed.repartition("range").write.mode("errorifexists").partitionBy("range").parquet(f"{path}/rows")
    files.create(df.sparkSession, f"{path}/schema.json", placed.schema.json())
    levels(rows(df.sparkSession, path), key, record, depth, range_column="range").coalesce(1).write.parquet(f"{path}/tree")


def rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a written table, with their range as text: one that looks like a number stays what it is."""
    return spark.read.schema(T.StructType.fromJson(json.loads(files.read_text(spark, f"{path}/schema.json")))).parquet(f"{path}/rows")


def differing_ranges(spark: SparkSession, left: str, right: str) -> list[str]:
    """The lowest ranges whose digests differ, found by descent: only children of differing ranges are
    compared. At most 16 to the power of the depth."""
    trees = [spark.read.schema("level int, range string, n bigint, digest string").parquet(f"{p}/tree") for p in (left, right)]
    depths = {t.agg(F.max("level")).first()[0] for t in trees} - {None}
    if len(depths) > 1:
        raise ValueError("trees of different depths")
    open_: list[str] = [""]
    for level in range((depths.pop() if depths else -1) + 1):
        a, b = (t.where((F.col("level") == level) & F.substring("range", 1, max(level - 1, 0)).isin(open_)) for t in trees)
        both = a.select("range", F.col("digest").alias("a")).join(b.select("range", F.col("digest").alias("b")), "range", "full_outer")
        open_ = sorted(r[0] for r in both.where(~F.col("a").eqNullSafe(F.col("b"))).select("range").collect())
        if not open_:
            return []
    return open_ if open_ != [""] else []


def difference(spark: SparkSession, left: str, right: str, key: Sequence[str], record: Column) -> DataFrame:
    """(key, state) of rows that two written tables do not share: missing on the right, extra there, or
    changed. Only the folders of differing ranges are read. Rows of one key are compared together, as many
    as there are."""
    differing = differing_ranges(spark, left, right)
    sides = [rows(spark, p).where(F.col("range").isin(differing)).select(*key, sha256(F.coalesce(record, F.lit(""))).alias("h")) for p in (left, right)]
    both = sides[0].withColumn("_side", F.lit(1)).unionByName(sides[1].withColumn("_side", F.lit(-1)))
    # Rows are moved once, with 32 bytes of digest; almost every key is alone, so nothing is added up before.
    placed = both.select(*key, "_side", F.unhex("h").alias("_h")).repartition(*key).withColumn("_d", F.hex("_h"))
    off = [F.sum(F.col("_side") * x).alias(f"_p{i}") for i, x in enumerate(_halves("_d"))]
    pair = placed.groupBy(*key).agg(F.count_if(F.col("_side") == 1).alias("_a"), F.count_if(F.col("_side") == -1).alias("_b"), *off)
    same = F.col("_a") == F.col("_b")
    for i in range(len(off)):
        # The sums of a lane agree if its two parts do together.
        if i % 2 == 0:
            same = same & (F.col(f"_p{i}").cast("decimal(19,0)") * F.lit(1 << HALF).cast("decimal(10,0)") + F.col(f"_p{i + 1}") == 0)
    state = F.when(F.col("_b") == 0, "missing").when(F.col("_a") == 0, "extra").when(~same, "changed")
    return pair.select(*key, state.alias("state")).where("state is not null")
