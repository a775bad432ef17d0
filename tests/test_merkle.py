"""Merkle trees: digests that depend on rows alone, and differences that read differing ranges only."""

import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import merkle as K

def record():
    return F.concat_ws("|", "v", "w")


def table(spark, rows):
    return spark.createDataFrame(rows, "k bigint, v string, w int")


ROWS = [(i, f"v{i}", i % 7) for i in range(300)] + [(None, "null key", None), (7, "v7", 0), (7, "v7", 0)]


def plain_root(rows, depth):
    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()

    leaves = {}
    for k, v, w in rows:
        place = sha("-" if k is None else f"={k}")[:depth]
        h = sha("|".join(str(x) for x in (v, w) if x is not None))
        leaves.setdefault(place, []).append([int(h[15 * i : 15 * i + 15], 16) for i in range(4)])
    at = {p: sha(",".join(map(str, [len(x), *map(sum, zip(*x, strict=True))]))) for p, x in leaves.items()}
    for level in range(depth - 1, -1, -1):
        up = {}
        for p in sorted(at):
            up.setdefault(p[:level], []).append(f"{p}:{at[p]}")
        at = {p: sha(",".join(x)) for p, x in up.items()}
    return at[""]


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_root_as_a_plain_version(spark, depth):
    df = table(spark, ROWS)
    assert K.root(df, ["k"], record(), depth) == plain_root(ROWS, depth)
    assert K.root(df.orderBy(F.desc("v")).repartition(3), ["k"], record(), depth) == plain_root(ROWS, depth)
    assert K.root(table(spark, ROWS[:-1]), ["k"], record(), depth) != plain_root(ROWS, depth)


def test_levels_add_up(spark):
    found = K.levels(table(spark, ROWS), ["k"], record(), 2).collect()
    by = {level: sum(r["n"] for r in found if r["level"] == level) for level in (0, 1, 2)}
    assert by == {0: len(ROWS), 1: len(ROWS), 2: len(ROWS)} and K.root(table(spark, []), ["k"], record()) is None
    with pytest.raises(ValueError):
        K.levels(table(spark, []), ["k"], record(), 9)


def test_one_changed_row_reads_one_range(spark, tmp_path):
    K.write(table(spark, ROWS), str(tmp_path / "a"), ["k"], record(), 2)
    K.write(table(spark, [(k, "other" if k == 42 else v, w) for k, v, w in ROWS]), str(tmp_path / "b"), ["k"], record(), 2)
    place = hashlib.sha256(b"=42").hexdigest()[:2]
    assert K.differing_ranges(spark, str(tmp_path / "a"), str(tmp_path / "b")) == [place]
    found = K.difference(spark, str(tmp_path / "a"), str(tmp_path / "b"), ["k"], record())
    assert [tuple(r) for r in found.collect()] == [(42, "changed")]
    read = {f.split("range=")[1][:2] for f in K.rows(spark, str(tmp_path / "a")).where(F.col("range").isin([place])).select(F.input_file_name()).distinct().toPandas()["input_file_name()"]}
    assert read == {place}
    scans = [line for line in found._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in line]
    assert scans and all("PartitionFilters: [range" in s or "PartitionFilters: [isnotnull(range" in s for s in scans)
    # The ranges that agree may as well not be there.
    for side in ("a", "b"):
        for folder in (tmp_path / side / "rows").glob("range=*"):
            if folder.name != f"range={place}":
                for f in folder.iterdir():
                    f.unlink()
    again = K.difference(spark, str(tmp_path / "a"), str(tmp_path / "b"), ["k"], record())
    assert [tuple(r) for r in again.collect()] == [(42, "changed")]


def test_differences_of_every_kind(spark, tmp_path):
    other = [r for r in ROWS if r[0] != 3] + [(1000, "new", 1), (5, "v5", 5)]
    other = [(k, v, w + 1 if k == 8 else w) for k, v, w in other if k is not None]
    K.write(table(spark, ROWS), str(tmp_path / "a"), ["k"], record())
    K.write(table(spark, other), str(tmp_path / "b"), ["k"], record())
    K.write(table(spark, []), str(tmp_path / "none"), ["k"], record())
    found = {(r["k"], r["state"]) for r in K.difference(spark, str(tmp_path / "a"), str(tmp_path / "b"), ["k"], record()).collect()}
    assert found == {(3, "missing"), (None, "missing"), (1000, "extra"), (5, "changed"), (8, "changed")}
    assert K.difference(spark, str(tmp_path / "a"), str(tmp_path / "a"), ["k"], record()).count() == 0


def test_difference_moves_a_row_once(spark, tmp_path):
    rows = [(1, "a", 1)] * 3 + [(2, "a", 1), (2, "b", 1), (3, "x", 1), (3, "x", 1)]
    K.write(table(spark, rows), str(tmp_path / "a"), ["k"], record(), 1)
    K.write(table(spark, [*rows[:2], (2, "b", 1), (2, "a", 1), (3, "y", 1), (3, "y", 1)]), str(tmp_path / "b"), ["k"], record(), 1)
    found = K.difference(spark, str(tmp_path / "a"), str(tmp_path / "b"), ["k"], record())
    assert sorted(map(tuple, found.collect())) == [(1, "changed"), (3, "changed")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    # Without sums before the exchange, of which there is one.
    first = plan.split("== Initial Plan ==")[-1]
    assert first.count("Exchange hashpartitioning") == 1 and "HashAggregate" not in first.split("Exchange hashpartitioning")[1]
