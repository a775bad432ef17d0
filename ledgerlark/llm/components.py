"""Connected components of a distributed graph, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import materialise


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str, b: str, *, rounds: int | None = None) -> DataFrame:
    """(node, root) for every node of ``links`` (columns ``a`` and ``b``), root the smallest node of
    its component.

    Large stars hang each larger neighbour of a node on its smallest neighbour, small stars do so
    with smaller ones; when neither changes an edge, all edges point at roots. Minima are aggregated
    before the shuffle, and the edges of a node with very many go through a join that can split them.
    Every round is written to the shared folder. Null ends are left out. Rounds go on until the edges
    repeat; where ``rounds`` bounds them, edges that still change after so many raise an error.
    """
    pairs = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    loops = pairs.where("x = y").select(F.col("x").alias("u"), F.col("y").alias("v"))
    edges = materialise(
        pairs.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()
    )
    state = _state(edges)
    before, done = None, 0
    while state[0] and state != before:
        if done == rounds:
            raise RuntimeError(f"components still change after {rounds} rounds")
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        edges = materialise(small)
        before, state, done = state, _state(edges), done + 1
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    ends = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    own = loops.select(F.col("u").alias("node"), F.col("v").alias("root")).distinct()
    found = roots.unionByName(ends).unionByName(own)
    return found.groupBy("node").agg(F.min("root").alias("root"))
