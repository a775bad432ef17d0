"""Approximate nearest neighbours by inner product: inverted lists and an adaptive dimension scan.

Rows with equal vectors form a class that keeps its ``k + 1`` smallest ids, more than any query can
return, so a vector that very many rows share is searched, and asked for, once. Every vector gets one
more component, so that all have the norm of the longest, and inner product order becomes distance
order. The inverted index has two levels, about as many lists as the square root of the classes:
coarse centroids are fitted on the driver from a sample of ``SAMPLE`` vectors, and within each coarse
cell the lists are fitted where its own sample is, about ``A_LIST`` vectors a list.

Within a probed list the vectors are turned by a random rotation and cut into column blocks; after
each block the partial distance of a candidate, scaled to all dimensions, is tested against the
query's threshold with a bound that shrinks as more dimensions are seen, and candidates that fail are
abandoned. Survivors get their exact inner product, in double precision, from the original vectors.
The threshold of a query is its k-th best score so far: every query scans its nearest list first, and
takes what it found there as the threshold for the others, which also skips lists whose centroid and
radius bound them below it. Every row that is returned comes out of the scan.

The number of lists to probe is the least that reaches ``RECALL`` for ``CALIBRATE`` vectors of the
sample, whose true neighbours among all rows are counted in one pass; a query whose lists hold fewer
than ``k + 1`` classes goes on until they do. Lists are split into blocks of rows and their queries
into batches, so that no task holds a whole list or all queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlark.llm.common import materialise, table

K = 20
QUERY_STEP = 20
#: Vectors that coarse centroids are fitted on, at most (by a hash of the vector).
SAMPLE = 16_000
#: Vectors that the lists of a coarse cell are fitted on, for each of its lists, about.
A_LIST = 48
#: Lists that one coarse cell is cut into, at most; a longer list has more blocks.
MOST_FINE = 1_024
#: Vectors of the sample whose true neighbours tell how many lists to probe, and the share to reach.
CALIBRATE = 64
RECALL = 0.98
#: How many deviations over its centroid's score the best of a list are taken to be.
SPREAD = 2.5
COLUMNS = 16
#: Of the hypothesis test: how many deviations the partial distance may be over.
EPSILON = 2.1
#: Rows that are scanned before thresholds are first raised, and between later raises.
FIRST_ROWS, NEXT_ROWS = 128, 2_048
BLOCK_ROWS = 8_192
BATCH_QUERIES = 16_384
SEED = 3
_HASHES = 1 << 40


@dataclass
class Index:
    norm: float  # of the longest vector
    rotation: np.ndarray
    coarse: np.ndarray  # cells x (dimensions + 1)
    lists: np.ndarray  # lists x (dimensions + 1), those of a cell together
    firsts: np.ndarray  # first list of each cell, and the number of lists
    deviations: np.ndarray  # of the members of each list from its centroid, in one direction

    def widened(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.norm**2 - np.einsum("ij,ij->i", x, x), 0)
        return np.concatenate([x, np.sqrt(rest)[:, None]], axis=1)

    def cells_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coarse cell of each vector, and how far its centroid is."""
        d = _distances(self.widened(x), self.coarse)
        at = d.argmin(axis=1)
        return at, np.sqrt(np.maximum(d[np.arange(len(at)), at], 0))

    def lists_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List of each vector (the nearest of its cell), and how far its centroid is."""
        wide, (cells, _) = self.widened(x), self.cells_of(x)
        at, far = np.zeros(len(x), np.int64), np.zeros(len(x))
        for cell in np.unique(cells):
            own = np.flatnonzero(cells == cell)
            a, b = self.firsts[cell], self.firsts[cell + 1]
            d = _distances(wide[own], self.lists[a:b])
            best = d.argmin(axis=1)
            at[own], far[own] = a + best, np.sqrt(np.maximum(d[np.arange(len(own)), best], 0))
        return at, far

    def order(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lists from the most promising on, and the inner product of each query with each centroid. What
        a list promises is the score of its centroid and SPREAD deviations of its members' scores."""
        dots = q @ self.lists[:, : q.shape[1]].T
        return (dots + SPREAD * np.sqrt((q * q).sum(1))[:, None] * self.deviations).argsort(axis=1)[:, ::-1], dots


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision; equal rows give equal sums wherever they stand."""
    return np.multiply(x, q, order="C").sum(axis=-1)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)


def _k_means(x: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    c = x[rng.choice(len(x), lists, replace=False)].copy()
    for _ in range(rounds):
        near = ((c**2).sum(1) - 2 * x @ c.T).argmin(axis=1)
        counts = np.bincount(near, minlength=lists)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return c


def _best(of: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best ids of each query in ``of``, by query, each with its best score; ties to smaller ids."""
    order = np.lexsort((-scores, ids, of))
    of, ids, scores = of[order], ids[order], scores[order]
    fresh = np.r_[True, (of[1:] != of[:-1]) | (ids[1:] != ids[:-1])][: len(of)]
    of, ids, scores = of[fresh], ids[fresh], scores[fresh]
    order = np.lexsort((ids, -scores, of))
    of, ids, scores = of[order], ids[order], scores[order]
    firsts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]][: len(of)])
    kept = np.arange(len(of)) - np.repeat(firsts, np.diff(np.r_[firsts, len(of)])) < k
    return of[kept], ids[kept], scores[kept]


@dataclass
class Rows:
    """Vectors of one block of a list, and the ids of each."""

    x: np.ndarray
    ids: np.ndarray
    ends: np.ndarray

    def expanded(self, of: np.ndarray, at: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of every id of the rows ``at``."""
        counts = self.ends[at + 1] - self.ends[at]
        places = np.repeat(self.ends[at] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum()) if len(at) else at
        return np.repeat(of, counts), self.ids[places], np.repeat(scores, counts)


def scan(index: Index, rows: Rows, q: np.ndarray, floors: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the best ids, up to k a query, that reach its floor among one block of rows.

    Queries go in groups, and each column block is a matrix product while most candidates are alive;
    afterwards only the pairs that are alive are looked at. Floors rise to the k-th best score so far.
    """
    d = rows.x.shape[1] + 1
    wide = index.widened(rows.x) @ index.rotation
    turned = np.concatenate([q, np.zeros((len(q), 1))], axis=1) @ index.rotation
    reach = np.einsum("ij,ij->i", q, q) + index.norm**2
    cuts = [(a, min(a + COLUMNS, d)) for a in range(0, d, COLUMNS)]
    edges = [0, *range(FIRST_ROWS, len(wide), NEXT_ROWS), len(wide)]
    out = []
    for at in range(0, len(q), 256):
        part, floor = turned[at : at + 256], floors[at : at + 256].copy()
        held = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for low, high in zip(edges, edges[1:], strict=False):
            slack = 1e-9 * (reach[at : at + 256] + 1)
            pairs, cols = _alive(part, wide[low:high], reach[at : at + 256] - 2 * floor, slack, cuts, d)
            found = [held]
            for first in range(0, len(pairs), 1 << 16):
                of, near = pairs[first : first + (1 << 16)], cols[first : first + (1 << 16)] + low
                scores = exact(rows.x[near], q[at + of])
                good = scores >= floor[of]
                found.append(rows.expanded(of[good], near[good], scores[good]))
            held = _best(*(np.concatenate(x) for x in zip(*found, strict=True)), k)
            ends = np.searchsorted(held[0], np.arange(len(part) + 1))
            full = np.flatnonzero(np.diff(ends) == k)
            floor[full] = np.maximum(floor[full], held[2][ends[full + 1] - 1])
        out.append((held[0] + at, *held[1:]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _alive(part: np.ndarray, wide: np.ndarray, most: np.ndarray, slack: np.ndarray, cuts: list[tuple[int, int]], d: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs, by query, that no test abandons."""
    total = np.zeros((len(part), len(wide)))
    pairs = cols = None
    for a, b in cuts:
        seen, block = part[:, a:b], wide[:, a:b]
        bound = most * (b / d) * (1 + EPSILON / np.sqrt(b)) ** 2 if b < d else most
        bound = np.maximum(bound, 0) + slack
        if pairs is None:
            total += (seen**2).sum(1)[:, None] - 2 * seen @ block.T + (block**2).sum(1)
            alive = total <= bound[:, None]
            if b < d and np.count_nonzero(alive) < 0.2 * alive.size:
                pairs, cols = np.nonzero(alive)
                sums = total[pairs, cols]
        else:
            sums = sums + ((seen[pairs] - block[cols]) ** 2).sum(1)
            keep = sums <= bound[pairs]
            pairs, cols, sums = pairs[keep], cols[keep], sums[keep]
    return (pairs, cols) if pairs is not None else np.nonzero(alive)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of little-endian doubles."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(values.to_pylist()), np.float64).reshape(len(values), -1) if len(values) else np.zeros((0, 1))


def _bytes(x: np.ndarray) -> pa.Array:
    return pa.array([v.tobytes() for v in x], pa.binary())


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), _bytes(flat.reshape(batch.num_rows, -1))], names=["id", "vec"])


def usable(embeddings: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, vec) of the rows that take part: neither null nor zero, all components finite."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.where(F.col(vec_id).isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)).select(
        F.col(vec_id).cast("bigint").alias("id"), v.cast("array<double>").alias("vec")
    )


def _hashed(share: float | dict[int, float], by: str | None = None):
    """Whether the hash of a vector is below a share of all hashes (one for each value of ``by``)."""
    at = F.pmod(F.xxhash64("vec"), F.lit(_HASHES))
    if by is None:
        return at < int(np.ceil(min(1.0, share) * _HASHES))
    cuts = F.array(*[F.lit(int(np.ceil(min(1.0, share[i]) * _HASHES))) for i in sorted(share)])
    return at < F.element_at(cuts, F.col(by) + 1)


def build(classes: DataFrame, n: int, norm: float) -> tuple[Index, np.ndarray]:
    """The index of ``n`` classes (cls, vec, ids) up to ``norm`` long, and the sample that its coarse cells were fitted on."""
    taken = classes.where(_hashed(1.2 * SAMPLE / n + 1e-3)).select("vec").orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).toArrow()
    sample = _matrix(taken.column("vec"))
    d = sample.shape[1]
    rotation = np.linalg.qr(np.random.default_rng(SEED).normal(size=(d + 1, d + 1)))[0]
    lists = max(1, round(np.sqrt(n)))
    index = Index(norm, rotation, np.zeros((1, d + 1)), np.zeros((1, d + 1)), np.array([0, 1]), np.zeros(1))
    index.coarse = _k_means(index.widened(sample), min(len(sample), int(np.ceil(np.sqrt(lists)))))

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, far = index.cells_of(_matrix(batch.column("vec")))
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(far), batch.column("vec")], names=["cell", "far", "vec"])

    cells = classes.select("vec").mapInArrow(celled, "cell int, far double, vec binary")
    held = {c: (m, far) for c, m, far in cells.groupBy("cell").agg(F.count("*"), F.sum("far")).collect()}
    # Lists go where the spread is: many vectors close together need few.
    spread = sum(far for _, far in held.values()) or 1.0
    fine = {c: min(MOST_FINE, max(1, round(lists * held.get(c, (0, 0.0))[1] / spread))) for c in range(len(index.coarse))}

    def cut(rows: pa.Table) -> pa.Table:
        cell = rows.column("cell")[0].as_py()
        found = np.unique(index.widened(_matrix(rows.column("vec"))), axis=0)
        centres = _k_means(found, min(fine[cell], len(found)))
        return pa.table({"cell": pa.array([cell] * len(centres), pa.int32()), "centre": _bytes(centres)})

    # At least some vectors of every cell, and about as many for each of its lists.
    share = {c: (A_LIST * fine[c] + 64) / max(held.get(c, (0, 0))[0], 1) for c in fine}
    centres = cells.where(_hashed(share, "cell")).select("cell", "vec").groupBy("cell").applyInArrow(cut, "cell int, centre binary").toArrow()
    of, by = _matrix(centres.column("centre")), centres.column("cell").to_numpy()
    parts = [of[by == c] if (by == c).any() else index.coarse[c : c + 1] for c in range(len(index.coarse))]
    index.lists, index.firsts = np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]
    return index, sample


def _probe_count(index: Index, lists: DataFrame, sample: np.ndarray, k: int) -> int:
    """Lists to probe, so that RECALL of the true neighbours of some vectors of the sample lie in them."""
    asked = sample[np.random.default_rng(SEED).choice(len(sample), min(CALIBRATE, len(sample)), replace=False)]
    own = {v.tobytes(): i for i, v in enumerate(asked)}

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.empty(0), np.empty(0, np.int32))] * len(asked)
        for batch in batches:
            if not batch.num_rows:
                continue
            scores = asked @ _matrix(batch.column("vec")).T
            for j, raw in enumerate(batch.column("vec").to_pylist()):
                if raw in own:
                    scores[own[raw], j] = -np.inf
            of = batch.column("list").to_numpy()
            for i in range(len(asked)):
                s, at = np.r_[best[i][0], scores[i]], np.r_[best[i][1], of]
                kept = np.argpartition(-s, k)[:k] if len(s) > k else np.arange(len(s))
                best[i] = s[kept], at[kept]
        for i, (s, at) in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), i, np.int32)), pa.array(s), pa.array(at, pa.int32())], names=["q", "score", "list"])

    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "list"))
    near = lists.select("vec", "list").mapInArrow(nearest, "q int, score double, list int").where(F.col("score") > float("-inf"))
    found = near.withColumn("r", rank).where(F.col("r") <= k).select("q", "list").toArrow()
    if not found.num_rows:
        return 1
    order, _ = index.order(asked)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
    ranks = place[found.column("q").to_numpy(), found.column("list").to_numpy()]
    return int(np.quantile(ranks, RECALL, method="higher")) + 1


def search(embeddings: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", step: int = QUERY_STEP, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for each row whose id ``step`` divides.

    Null vectors, zero vectors, those with null or non-finite components and rows with a null id take
    no part; vectors of several dimensions are an error. Rows of one id count once, with their best
    score, and none is its own neighbour; a query with fewer than k other ids gets them all. An empty
    table gives no rows. Other columns are not read.
    """
    spark = embeddings.sparkSession
    rows = usable(embeddings, vec_id, vector)
    squares = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    least, most, longest = rows.agg(F.min(F.size("vec")), F.max(F.size("vec")), F.max(squares)).first()
    if least is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if least != most:
        raise ValueError(f"vectors of {least} to {most} components")
    packed = rows.mapInArrow(_packed, "id bigint, vec binary")
    name = F.substring(F.sha2("vec", 256), 1, 32).alias("cls")
    # Only the smallest ids of a class leave a task.
    rank = F.dense_rank().over(Window.partitionBy("vec").orderBy("id"))
    classes = packed.withColumn("r", rank).where(F.col("r") <= k + 1).groupBy("vec").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    classes = materialise(classes.select(name, "vec", "ids"))
    index, sample = build(classes, classes.count(), float(np.sqrt(longest)))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                of, far = index.lists_of(_matrix(batch.column("vec")))
                yield pa.RecordBatch.from_arrays([batch.column("vec"), batch.column("ids"), pa.array(of, pa.int32()), pa.array(far)], names=["vec", "ids", "list", "far"])

    lists = materialise(classes.select("vec", "ids").mapInArrow(assigned, "vec binary, ids array<bigint>, list int, far double"))
    sizes, radius, index.deviations = np.zeros(len(index.lists), np.int64), np.full(len(index.lists), -np.inf), np.zeros(len(index.lists))
    for at, n, far, square in lists.groupBy("list").agg(F.count("*"), F.max("far"), F.avg(F.col("far") * F.col("far"))).toLocalIterator():
        sizes[at], radius[at], index.deviations[at] = n, far, np.sqrt(square / index.lists.shape[1])
    probes = _probe_count(index, lists, sample, k)

    asked = packed.where(F.pmod("id", F.lit(step)) == 0)
    queries = materialise(asked.select("vec").distinct().select(name, "vec"))
    first = _scanned(index, lists, queries.withColumn("floor", F.lit(float("-inf"))), sizes, radius, (0, 1), k)
    floors = first.withColumn("r", F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") == k + 1)
    known = queries.join(floors.select("cls", F.col("score").alias("floor")), "cls", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    found = first.unionByName(_scanned(index, lists, known, sizes, radius, (1, probes), k))

    best = found.groupBy("cls", "vec_id").agg(F.max("score").alias("score"))
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    # Written first, so that the join has two plain sides and can split a class that very many ask for.
    best = materialise(best.groupBy("cls").agg(F.collect_list(F.struct("vec_id", "score")).alias("near")))
    ids = asked.select(F.col("id").alias("query_id"), name).distinct()
    pairs = ids.join(best, "cls").select("query_id", F.explode("near").alias("n")).select("query_id", "n.vec_id", "n.score").where("vec_id <> query_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scanned(index: Index, lists: DataFrame, queries: DataFrame, sizes: np.ndarray, radius: np.ndarray, ranks: tuple[int, int], k: int) -> DataFrame:
    """(cls, vec_id, score) of the k + 1 best of each probed list for ``queries`` (cls, vec, floor), the
    lists being those of ``ranks`` in the order of a query, and further ones as long as what comes
    before holds fewer than k + 1 classes."""
    blocks = -(-sizes // BLOCK_ROWS)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                q, floors = _matrix(part.column("vec")), part.column("floor").to_numpy()
                order, dots = index.order(q)
                before = np.cumsum(sizes[order], axis=1) - sizes[order]
                place = np.arange(order.shape[1])
                wanted = (place >= ranks[0]) & ((place < ranks[1]) | (before <= k) & (ranks[0] > 0))
                bound = np.take_along_axis(dots + np.sqrt((q * q).sum(1))[:, None] * np.maximum(radius, 0), order, axis=1) + 1e-9
                of, nth = np.nonzero(wanted & (bound >= floors[:, None]) & (sizes[order] > 0))
                to = order[of, nth]
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), *(part.column(c).take(pa.array(of)) for c in ("cls", "vec", "floor"))], names=["list", "cls", "vec", "floor"])

    def of_list(values: np.ndarray):
        return F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("list") + 1)

    asked = materialise(queries.mapInArrow(routed, "list int, cls string, vec binary, floor double"))
    batches = np.ones(len(sizes), np.int64)
    for at, n in asked.groupBy("list").count().toLocalIterator():
        batches[at] = -(-n // BATCH_QUERIES)
    asked = asked.withColumn("batch", F.pmod(F.xxhash64("cls"), of_list(batches)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), of_list(np.maximum(blocks, 1)) - 1)))
    sides = lists.select("list", F.pmod(F.xxhash64("vec"), of_list(np.maximum(blocks, 1))).cast("int").alias("block"), "vec", "ids")
    sides = sides.withColumn("batch", F.explode(F.sequence(F.lit(0), of_list(batches) - 1)))

    def scanned(left: pa.Table, right: pa.Table) -> pa.Table:
        at, near, scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        if left.num_rows and right.num_rows:
            ids = left.column("ids").combine_chunks()
            rows = Rows(_matrix(left.column("vec")), ids.flatten().to_numpy(), np.r_[0, np.cumsum(ids.value_lengths().to_numpy())])
            at, near, scores = scan(index, rows, _matrix(right.column("vec")), right.column("floor").to_numpy(), k + 1)
        return pa.table({"cls": right.column("cls").take(pa.array(at)), "vec_id": pa.array(near), "score": pa.array(scores)})

    key = ["list", "block", "batch"]
    return materialise(sides.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(scanned, "cls string, vec_id bigint, score double"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
