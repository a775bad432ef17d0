"""Content hashes, listings and other integrity checks over tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.functions.hashing import record_json, sha256


def ordered_hash(df: DataFrame, record: Column, *order: str) -> DataFrame:
    """SHA-256 over every record and a newline, in order, as one row with the number of rows.

    One digest over all records needs them in one place: for tables of the size of a manifest. A
    larger table goes through ``streamed_hash`` or, where the digest need not be that of the plain
    sequence, ``chunked_hash``.
    """
    rows = df.select(*order, F.concat(record, F.lit("\n")).alias("_r"))
    text = F.listagg("_r", F.lit("")) if not order else F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "_r"))), lambda x: x["_r"]), "")
    return rows.agg(sha256(F.coalesce(text, F.lit(""))).alias("records_sha256"), F.count("*").alias("n"))


def streamed_hash(df: DataFrame, record: Column, *order: str) -> tuple[str, int]:
    """The digest of ``ordered_hash``, one partition of the sorted table at a time on the driver."""
    digest, n = hashlib.sha256(), 0
    for row in df.orderBy(*order).select(F.concat(record, F.lit("\n"))).toLocalIterator(prefetchPartitions=True):
        digest.update(row[0].encode())
        n += 1
    return digest.hexdigest(), n


def chunked_hash(df: DataFrame, record: Column, key: Column, chunks: int = 1024) -> DataFrame:
    """Digest of the digests of ``chunks`` hash chunks, each over the sorted digests of its records: the
    same for any order and partitioning of the rows, and computed where the rows are."""
    rows = df.select(F.pmod(F.xxhash64(key), F.lit(chunks)).alias("chunk"), sha256(record).alias("h"))
    parts = rows.groupBy("chunk").agg(sha256(F.array_join(F.array_sort(F.collect_list("h")), "")).alias("h"), F.count("*").alias("n"))
    whole = F.array_sort(F.collect_list(F.struct("chunk", "h")))
    return parts.agg(sha256(F.array_join(F.transform(whole, lambda x: x["h"]), "")).alias("records_sha256"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def tree_hash(listing: DataFrame, path: str = "path", digest: str = "sha256", size: str | None = None) -> DataFrame:
    """SHA-256 over path, NUL, file digest and NUL of every file in the order of paths, with the
    number of files (and their bytes)."""
    part = F.concat(F.col(path), F.lit("\0"), F.col(digest), F.lit("\0"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(path).alias("p"), part.alias("t")))), lambda x: x["t"]), "")
    bytes_ = [F.coalesce(F.sum(size), F.lit(0)).alias("size_bytes")] if size else []
    return listing.agg(sha256(whole).alias("tree_sha256"), F.count("*").alias("n_files"), *bytes_)


def listing_diff(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys that are missing or extra."""
    both = expected.select(F.col(key), F.lit(1).alias("e")).distinct().join(actual.select(F.col(key), F.lit(1).alias("a")).distinct(), key, "full_outer")
    return both.where("e is null or a is null").select(key, F.when(F.col("a").isNull(), "missing").otherwise("extra").alias("state"))


def hash_mismatch(expected: DataFrame, actual: DataFrame, key: str, digest: str = "sha256") -> DataFrame:
    """Keys that both sides have with different digests."""
    right = actual.select(F.col(key), F.col(digest).alias("actual"))
    return expected.select(F.col(key), F.col(digest).alias("expected")).join(right, key).where("expected <> actual")


def id_gaps(df: DataFrame, key: str, n: int) -> DataFrame:
    """Ids of 0 to n - 1 that are missing, ids beyond, and repeated ids, each with its state."""
    spark = df.sparkSession
    counts = df.groupBy(F.col(key).cast("bigint").alias("id")).agg(F.count("*").alias("c"))
    both = spark.range(n).withColumn("want", F.lit(1)).join(counts, "id", "full_outer")
    state = F.when(F.col("c").isNull(), "missing").when(F.col("want").isNull(), "beyond").when(F.col("c") > 1, "repeated")
    return both.select("id", state.alias("state")).where("state is not null")


def identity_mismatch(df: DataFrame, source: Column, identity: Column) -> DataFrame:
    """Rows whose identity isn't the hash prefix of its source."""
    return df.where(~F.coalesce(F.substring(sha256(source), 1, F.length(identity)) == identity, F.lit(False)))


def distinct_protocols(df: DataFrame, fields: Sequence[str], *by: str) -> DataFrame:
    """How many different protocols (tuples of fields) each group has; comparable runs have one."""
    return df.groupBy(*by).agg(F.countDistinct(F.struct(*fields)).alias("protocols"), F.count("*").alias("n"))


def failed_checks(df: DataFrame, checks: dict[str, Column], to: str = "failed") -> DataFrame:
    """Add the sorted names of the checks that a row fails; a null outcome fails."""
    # In order already, and without a lambda, within which nothing is compiled and every check starts afresh.
    names = [F.when(~F.coalesce(checks[n], F.lit(False)), n) for n in sorted(checks)]
    return df.withColumn(to, F.array_except(F.array(*names), F.array(F.lit(None).cast("string"))) if names else F.array().cast("array<string>"))


def latest_by_number(df: DataFrame, group: str, name: str, pattern: str = r"checkpoint-([0-9]+)$") -> DataFrame:
    """Of each group the name with the greatest number, as a number."""
    number = F.try_to_number(F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")), F.lit("9" * 18)).cast("bigint")
    numbered = df.select(group, name, number.alias("number")).where("number is not null")
    return numbered.groupBy(group).agg(F.max_by(name, F.struct("number", name)).alias(name), F.max("number").alias("number"))


def newest_valid(candidates: DataFrame, group: str, number: str, verify: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """Of each group the candidate with the greatest number that ``verify`` keeps; groups without one are left
    out, and so are null numbers. Of equal numbers all are candidates of one round.

    To verify is dear, so it goes by rounds: the newest of every group first, and where it fails the next.
    ``folder``, which driver and executors share, holds the numbered candidates and what each round found."""
    spark = candidates.sparkSession
    place = F.dense_rank().over(Window.partitionBy(group).orderBy(F.desc(number)))
    candidates.where(F.col(number).isNotNull()).withColumn("_place", place).write.parquet(f"{folder}/candidates")
    numbered = spark.read.schema(T.StructType([*candidates.schema.fields, T.StructField("_place", T.IntegerType())])).parquet(f"{folder}/candidates")
    found = numbered.limit(0).drop("_place")
    for k in count(1):
        at = numbered.where(F.col("_place") == k).drop("_place")
        # Groups that are settled are verified no further; a null group is one like any other.
        settled = found.select(F.col(group).alias("_settled")).distinct()
        at = at.join(settled, F.col(group).eqNullSafe(F.col("_settled")), "left_anti")
        if at.isEmpty():
            return found
        verify(at).write.parquet(f"{folder}/round-{k}")
        found = found.unionByName(spark.read.schema(candidates.schema).parquet(f"{folder}/round-{k}"))


def run_state(runs: DataFrame, group: str, complete: Column) -> DataFrame:
    """Completed runs of each group, and the state that follows from their number."""
    counts = runs.groupBy(group).agg(F.count_if(complete).alias("n_complete"))
    state = F.when(F.col("n_complete") == 0, "pending").when(F.col("n_complete") == 1, "complete").otherwise("ambiguous")
    return counts.withColumn("state", state)


def hashed_without(df: DataFrame, *bookkeeping: str, to: str = "record_sha256") -> DataFrame:
    """Add the SHA-256 of each row as canonical JSON (keys sorted at every depth, null values kept), without the
    columns that only keep books. Equal records have equal digests whatever these say."""
    return df.withColumn(to, sha256(record_json(df, *bookkeeping)))


def evaluated_documents(seen: DataFrame, expected: DataFrame, key: str, content: Column) -> DataFrame:
    """(key, state) of every document that was not evaluated just once with its own content: missing,
    extra, repeated, or changed. Both tables have the key; ``content`` is digested where the rows are."""
    digests = lambda df: df.groupBy(key).agg(F.count("*").alias("n"), F.min(sha256(content)).alias("h"), F.max(sha256(content)).alias("g"))
    left, right = digests(expected).select(key, F.col("h").alias("want")), digests(seen)
    both = left.join(right, key, "full_outer")
    state = F.when(F.col("n").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("n") > 1, "repeated").when(~(F.col("h").eqNullSafe(F.col("want"))), "changed")
    return both.select(key, state.alias("state")).where("state is not null")


def require_records(df: DataFrame, record: Column, key: Column, n: int, digest: str) -> None:
    """Raise unless a table has so many records and this ``chunked_hash``."""
    row = chunked_hash(df, record, key).first()
    if (row["n"], row["records_sha256"]) != (n, digest):
        raise ValueError(f"{row['n']} records, {row['records_sha256']}; expected {n}, {digest}")


def tree_difference(left: DataFrame, right: DataFrame, key: str = "path") -> DataFrame:
    """Files that two trees do not share: missing on the right, extra there, or with other contents."""
    changed = hash_mismatch(left, right, key).select(key, F.lit("changed").alias("state"))
    return listing_diff(left, right, key).unionByName(changed)


def unexpected(found: DataFrame, expected: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of ``found`` whose value is not the one that is expected for the key, with both; keys that
    nothing is expected of are fine."""
    want = expected.select(F.col(key), F.col(value).alias("expected"))
    return found.select(key, value).join(want, key).where(~F.col(value).eqNullSafe(F.col("expected")))
