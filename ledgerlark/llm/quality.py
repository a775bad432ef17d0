"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

score = w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j, the pairs by the sum-of-squares identity
``((sum_i v_i x_i)^2 - sum_i (v_i x_i)^2) / 2``, so a text is scored in time linear in its features.
Inputs are the hashed distinct words of the whole text (each by the root of its share), structure
statistics, and the character count of the table's metadata where there is one. The machine is
fitted on the driver, from a bounded labelled sample, by AdaGrad over shuffled mini-batches; rows it
has not seen calibrate the score.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm.common import bound_batches, documents_of, raw_texts, table, words_of
from ledgerlark.llm.linear import fold, labelled_sample, platt, sigmoid

MOST_LABELLED = 8_000
BUCKETS = 1 << 14
RANK = 6
EPOCHS = 12
BATCH = 128
FOLDS = 4
SEED = 6

_UPPER = bytes(range(0x41, 0x5B))
_DIGITS = bytes(range(0x30, 0x3A))
_LETTERS = _UPPER + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_SPACES = b" \t\r\n\x0b\x0c"
_STOPS = b".,;:?'\"-()"
STATISTICS = (
    "log words", "log characters", "word length", "distinct words", "top word", "repeats", "upper",
    "digits", "symbols", "stops", "spaces", "lines", "repeated lines", "line length", "stopped lines", "metadata",
)


def statistics(raw: bytes, words: list[bytes], counts: Counter, n_chars: int | None) -> list[float]:
    """Structure of a text, each figure from 0 to about 1. Bytes stand for characters."""
    n, size = max(len(words), 1), max(len(raw), 1)
    lines = raw.split(b"\n")
    distinct = len(set(lines))
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    left = lambda delete: len(raw.translate(None, delete)) / size
    return [
        math.log1p(len(words)) / 10,
        math.log1p(len(raw)) / 12,
        min(sum(map(len, words)) / n / 20, 2.0),
        len(counts) / n,
        max(counts.values(), default=0) / n,
        repeats / n,
        1 - left(_UPPER),
        1 - left(_DIGITS),
        left(_LETTERS + _DIGITS + _SPACES + _STOPS),
        1 - left(_STOPS),
        1 - left(_SPACES),
        math.log1p(len(lines)) / 8,
        1 - distinct / len(lines),
        math.log1p(size / len(lines)) / 12,
        sum(line.rstrip().endswith((b".", b"?", b"!")) for line in lines) / len(lines),
        math.log1p(max(n_chars if n_chars is not None else len(raw), 0)) / 12,
    ]


_BUCKET: dict[bytes, int] = {}


def bucket(word: bytes) -> int:
    if (got := _BUCKET.get(word)) is None:
        if len(_BUCKET) >= 200_000:
            _BUCKET.clear()
        got = _BUCKET[word] = zlib.crc32(word) % BUCKETS
    return got


def inputs(raw: bytes | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of a text; statistics follow the buckets. Words that share a bucket
    are features of one number each with its own value."""
    raw = raw or b""
    words = words_of(raw)
    counts = Counter(words)
    n = max(len(words), 1)
    index = np.fromiter(map(bucket, counts), np.int32, len(counts))
    values = np.sqrt(np.fromiter(counts.values(), np.float32, len(counts)) / np.float32(n))
    stats = np.array(statistics(raw, words, counts, n_chars), np.float32)
    return np.concatenate([index, np.arange(BUCKETS, BUCKETS + len(stats), dtype=np.int32)]), np.concatenate([values, stats])


class Machine:
    """A fitted machine: w0, weights, factors, centre and spread of the statistics, calibration."""

    def __init__(self, width: int, rank: int, seed: int) -> None:
        self.w0 = 0.0
        self.w = np.zeros(width, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (width, rank)).astype(np.float32)
        self.centre = np.zeros(width - BUCKETS, np.float32)
        self.spread = np.ones(width - BUCKETS, np.float32)
        self.scale, self.offset = 1.0, 0.0

    def standard(self, values: np.ndarray) -> np.ndarray:
        """Values with the statistics at the end centred and scaled, within four spreads."""
        k = len(self.centre)
        stats = np.clip((values[-k:] - self.centre) / self.spread, -4, 4) * np.float32(0.5)
        return np.concatenate([values[:-k], stats])

    def raw(self, index: np.ndarray, values: np.ndarray) -> float:
        x = self.standard(values)
        vx = self.v[index] * x[:, None]
        total = vx.sum(axis=0)
        return float(self.w0 + self.w[index] @ x + 0.5 * (total @ total - np.einsum("ij,ij->", vx, vx)))

    def score(self, index: np.ndarray, values: np.ndarray) -> float:
        return 1 / (1 + math.exp(-min(40.0, max(-40.0, self.scale * self.raw(index, values) + self.offset))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seen: np.ndarray, *, seed: int = SEED, rate: float = 0.05, l2: float = 1e-4) -> Machine:
    """Fit on the rows of ``seen`` and calibrate on the rest, or on all if the rest has one label."""
    k = len(STATISTICS)
    m = Machine(BUCKETS + k, RANK, seed)
    if not len(y) or y.min() == y.max():
        m.v[:] = 0
        m.scale, m.offset = 0.0, float(np.log((y.sum() + 9) / (len(y) - y.sum() + 1)))
        return m
    train = np.flatnonzero(seen)
    stats = np.stack([rows[i][1][-k:] for i in train])
    m.centre, m.spread = stats.mean(axis=0), stats.std(axis=0) + np.float32(1e-3)
    x = [m.standard(rows[i][1]) for i in train]
    rare = 0.5 * len(train) / np.maximum(np.bincount(y[train].astype(int), minlength=2), 1)
    m.w0 = 0.0
    g0, gw, gv = 1e-6, np.full(len(m.w), 1e-6, np.float32), np.full(m.v.shape, 1e-6, np.float32)
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        order = rng.permutation(len(train))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            index = np.concatenate([rows[train[j]][0] for j in part])
            value = np.concatenate([x[j] for j in part])
            sizes = [len(x[j]) for j in part]
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            vx = m.v[index] * value[:, None]
            total = np.add.reduceat(vx, starts)
            raw = m.w0 + np.add.reduceat(m.w[index] * value, starts) + 0.5 * ((total**2).sum(1) - np.add.reduceat((vx**2).sum(1), starts))
            t = y[train[part]]
            err = ((sigmoid(raw) - t) * rare[t.astype(int)] / len(part)).astype(np.float32)
            e = np.repeat(err, sizes) * value
            used, place = np.unique(index, return_inverse=True)
            dw = np.bincount(place, e, len(used)).astype(np.float32) + l2 * m.w[used]
            pull = e[:, None] * (np.repeat(total, sizes, axis=0) - vx)
            dv = np.stack([np.bincount(place, pull[:, f], len(used)) for f in range(RANK)], axis=1).astype(np.float32) + l2 * m.v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            m.w[used] -= rate * dw / np.sqrt(gw[used])
            m.v[used] -= rate * 0.5 * dv / np.sqrt(gv[used])
            d0 = float(err.sum())
            g0 += d0 * d0
            m.w0 -= rate * d0 / math.sqrt(g0)
    rest = np.flatnonzero(~seen)
    if len(set(y[rest])) < 2:
        rest = np.arange(len(y))
    m.scale, m.offset = platt(np.array([m.raw(*rows[i]) for i in rest]), y[rest])
    return m


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [inputs(raw, n) for raw, n in zip(raw_texts(batch.column("text")), batch.column("meta").to_pylist(), strict=True)]
        columns = [batch.column("y"), batch.column("part"), pa.array([i.tobytes() for i, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["y", "part", "index", "values"])


def train(documents: DataFrame, labels: DataFrame, *, label: str = "quality", doc_id: str = "doc_id", text: str = "text", meta: str | None = None, learn: Column | None = None) -> Machine:
    """The machine for ``label``, learned from labelled rows where ``learn`` holds.

    Without labelled rows, or with labels of one value, every text gets the prior, smoothed as if nine of
    ten further texts were good."""
    learn = fold(doc_id, FOLDS) != 2 if learn is None else learn
    sample = labelled_sample(documents, labels, label, learn, MOST_LABELLED, doc_id=doc_id, text=text, meta=meta)
    got = sample.mapInArrow(_measured, "y int, part int, index binary, values binary").toArrow()
    rows = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for i, v in zip(got.column("index").to_pylist(), got.column("values").to_pylist(), strict=True)]
    y, part = got.column("y").to_numpy().astype(float), got.column("part").to_numpy()
    order = sorted(range(len(rows)), key=lambda i: (part[i], y[i], zlib.crc32(rows[i][0].tobytes()), zlib.crc32(rows[i][1].tobytes())))
    return fit([rows[i] for i in order], y[order], part[order] != 4)


def score_documents(documents: DataFrame, machine: Machine, *, text: str = "text", meta: str | None = None) -> DataFrame:
    """Add ``quality``, a score from 0 to 1, to every row. A null text is scored as the empty text, a
    null count of characters (column ``meta``) is taken from the text; repeated rows get one score; other
    columns stay, but a column ``quality`` is replaced. An empty table stays empty."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, counts in batches:
            yield pa.array([machine.score(*inputs(raw, n)) for raw, n in zip(raw_texts(texts), counts.to_pylist(), strict=True)], pa.float64())

    bound_batches(documents)
    return documents.withColumn("quality", scored(F.col(text), (F.col(meta) if meta else F.lit(None)).cast("bigint")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = documents_of(spark, sf_dir, "doc_id", "text", "n_chars")
    machine = train(documents, table(spark, sf_dir, "labels"), meta="n_chars")
    found = score_documents(documents, machine, meta="n_chars")
    score = F.col("quality")
    return found.select("doc_id", (fold("doc_id", FOLDS) == 2).alias("held_out"), score.alias("score"), (score >= 0.7).cast("int").alias("predicted"))
