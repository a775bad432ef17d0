"""Runs of words that repeat with a period, and texts without their repeats.

A stretch with period q and length L matches itself, shifted by q words, over L - q places, so every
such stretch that is long enough holds a point of a grid whose step is the least L - q allowed for q.
Over all periods these grids have about n ln n points (a harmonic sum). Where a grid point's word is
that of q words on, the longest common extensions of both places to either side are found for all
(period, point) pairs at once, by binary search over prefix hashes modulo 2^61 - 1. Pairs of one
stretch are joined, the smallest period of a stretch stays, and the words of all stretches are then
compared. If hashes had lied, all is done again with another base, so results are exact.

All texts of an Arrow batch are one sequence of words for NumPy, with the bounds of texts kept.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm.common import bound_batches, documents_of, raw_texts

#: A run has so many words, and so many periods, at least.
LEAST_WORDS = 6
LEAST_PERIODS = 4
#: (period, grid point) pairs that are looked at together.
PAIRS = 1 << 20
#: Words and other bytes, as in ``[^\x20\x09-\x0D]+``, are those of ``bytes.split()``.
BLANKS = r"[\x20\x09-\x0D]+"

_P = np.uint64((1 << 61) - 1)
_U = np.uint64


def mulmod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2^61 - 1, for unsigned 64-bit numbers under the modulus."""
    low = _U((1 << 31) - 1)
    ah, al, bh, bl = a >> _U(31), a & low, b >> _U(31), b & low
    mid = al * bh + ah * bl
    total = ((ah * bh) << _U(1)) + (mid >> _U(30)) + ((mid & _U((1 << 30) - 1)) << _U(31)) + al * bl
    total = (total & _P) + (total >> _U(61))
    return np.where(total >= _P, total - _P, total)


def _less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a - b modulo 2^61 - 1."""
    return np.where(a >= b, a - b, a + (_P - b))


@lru_cache(maxsize=2)
def _powers(attempt: int, bits: int) -> np.ndarray:
    """The first 2^bits powers of the base of an attempt."""
    base = _U(np.random.default_rng([61, attempt]).integers(1 << 40, int(_P), dtype=np.uint64))
    out = np.ones(1 << bits, np.uint64)
    step = base
    for k in range(bits):
        half = 1 << k
        out[half : 2 * half] = mulmod(out[:half], np.full(half, step, np.uint64))
        step = mulmod(np.array([step]), np.array([step]))[0]
    return out


class Prefixes:
    """Prefix hashes of a sequence of word numbers, under the base of one attempt."""

    def __init__(self, ids: np.ndarray, attempt: int) -> None:
        self.power = _powers(attempt, max(1, int(len(ids)).bit_length()))
        codes = np.random.default_rng([13, attempt]).integers(1, int(_P), int(ids.max(initial=-1)) + 1, dtype=np.uint64)
        terms = mulmod(codes[ids], self.power[: len(ids)])
        # Sums of the upper and lower halves stay under 2^64 up to 2^32 words.
        upper, lower = np.cumsum(terms >> _U(32)), np.cumsum(terms & _U((1 << 32) - 1))
        sums = mulmod(upper % _P, np.full(len(ids), 1 << 32, np.uint64)) + lower % _P
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.where(sums >= _P, sums - _P, sums)])

    def equal(self, a: np.ndarray, q: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether ``length`` words from ``a`` hash like those q words on."""
        here = _less(self.sums[a + length], self.sums[a])
        there = _less(self.sums[a + q + length], self.sums[a + q])
        return mulmod(here, self.power[q]) == there


def _extend(equal, most: np.ndarray) -> np.ndarray:
    """For each pair the greatest length up to ``most`` for which ``equal(pairs, lengths)`` holds; it
    holds for every smaller one, too."""
    out = np.zeros(len(most), np.int64)
    for k in range(int(most.max(initial=0)).bit_length() - 1, -1, -1):
        open_ = np.flatnonzero(out + (1 << k) <= most)
        if len(open_):
            out[open_[equal(open_, out[open_] + (1 << k))]] += 1 << k
    return out


def _least(q: np.ndarray) -> np.ndarray:
    """Words of the shortest run of a period."""
    return np.maximum(LEAST_WORDS, LEAST_PERIODS * q)


def _pairs(ids: np.ndarray, first: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, period, grid point) wherever the word of the point is that of a period on. Points are
    counted over all texts."""
    n = past - first
    periods = np.where(n >= LEAST_WORDS, n // LEAST_PERIODS, 0)
    ends = np.cumsum(periods)
    found = []
    for at in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
        row = np.arange(at, min(at + PAIRS, int(ends[-1])))
        text = np.searchsorted(ends, row, side="right")
        q = row - (ends[text] - periods[text]) + 1
        step = _least(q) - q
        points = (n[text] - q - 1) // step + 1
        past_points = np.cumsum(points)
        for begin in range(0, int(past_points[-1]), PAIRS):
            k = np.arange(begin, min(begin + PAIRS, int(past_points[-1])))
            r = np.searchsorted(past_points, k, side="right")
            point = first[text[r]] + (k - (past_points[r] - points[r])) * step[r]
            same = np.flatnonzero(ids[point] == ids[point + q[r]])
            found.append((text[r[same]], q[r[same]], point[same]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def runs_of(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs, by text, start and period. ``ids`` numbers the words of
    all texts, so that equal words have equal numbers, and ``ends`` is where each text ends."""
    first = np.concatenate([np.zeros(1, np.int64), ends[:-1]]).astype(np.int64)
    text, q, point = _pairs(ids, first, ends)
    for attempt in count():
        if not len(q):
            return text, point, point, q
        hashes = Prefixes(ids, attempt)
        ahead = _extend(lambda pairs, length: hashes.equal(point[pairs], q[pairs], length), ends[text] - point - q)  # noqa: B023
        back = _extend(lambda pairs, length: hashes.equal(point[pairs] - length, q[pairs], length), point - first[text])  # noqa: B023
        start, past = point - back, point + ahead + q
        long = np.flatnonzero(past - start >= _least(q))
        order = long[np.lexsort((q[long], past[long], start[long]))]
        a, b, p = start[order], past[order], q[order]
        once = np.flatnonzero((np.diff(a, prepend=-1) != 0) | (np.diff(b, prepend=-1) != 0))
        a, b, p, t = a[once], b[once], p[once], text[order][once]
        if all(np.array_equal(ids[i : j - k], ids[i + k : j]) for i, j, k in zip(a.tolist(), b.tolist(), p.tolist(), strict=True)):
            return t, a - first[t], b - a, p


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])


def found_in(texts: list[bytes | None]) -> pa.StructArray:
    """Words, runs and what is left of each text; null has no words."""
    words = [raw.split() if raw else [] for raw in texts]
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    lengths = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(lengths)
    total = int(lengths.sum())
    ids = np.fromiter((numbers[w] for ws in words for w in ws), np.int64, total)
    text, start, length, period = runs_of(ids, ends)
    # A run's words after its first period are dropped: plus one where they begin, minus one where they end.
    at = (ends - lengths)[text] + start
    edges = np.zeros(total + 1, np.int64)
    np.add.at(edges, at + period, 1)
    np.add.at(edges, at + length, -1)
    dropped = np.cumsum(edges)[:-1] > 0
    hit = set(text.tolist())
    kept = []
    for i, (ws, past) in enumerate(zip(words, ends.tolist(), strict=True)):
        if i in hit:
            ws = [w for w, out in zip(ws, dropped[past - len(ws) : past].tolist(), strict=True) if not out]
        kept.append(b" ".join(ws))
    bounds = np.searchsorted(text, np.arange(len(words) + 1))
    runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], fields=list(_RUN))
    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), runs)
    return pa.StructArray.from_arrays([pa.array(lengths), lists, pa.array(kept, pa.binary()).cast(pa.string())], fields=list(_FOUND))


def _finder():
    @F.arrow_udf("struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield found_in(raw_texts(batch))

    return found


def find_runs(documents: DataFrame, *, text: str = "text", to: str = "periodic") -> DataFrame:
    """Add ``to`` to every row: ``n_words``, ``runs`` (start, length and smallest period in words, by start
    and period) and ``collapsed``, the words that no run holds after its first period, with one blank
    between them.

    A null, empty or blank text has no words, no runs and an empty ``collapsed``. Repeated rows are
    searched one by one; other columns stay, but a column ``to`` is replaced. An empty table stays empty.
    """
    bound_batches(documents)
    return documents.withColumn(to, _finder()(F.col(text)))


def longest(runs: Column) -> Column:
    """The run of greatest length, of these the first; null if there is none."""
    key = F.transform(runs, lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"), r.alias("run")))
    return F.get(F.array_sort(key), F.lit(0))["run"]


def looped(text: Column, key: Column) -> Column:
    """Test texts: where the CRC-32 h of a key as text is a multiple of ten, the words from a = h/10 modulo
    their number repeat with a period, up to a third of what is left. Others stay as they are."""
    h = F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10).cast("bigint")
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    n = F.size(words)
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("bigint")
    # Whole copies of the period follow one another, and a part of it at the end.
    rest = (n - a).cast("int")
    period = F.slice(words, a.cast("int") + 1, p.cast("int"))
    times = F.floor((rest + p - 1) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(period, times)), F.lit(1), rest)
    made = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")
    return F.when((h % 10 == 0) & (n > 0), made).otherwise(text)


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, some of them looped; null texts have none."""
    documents = documents_of(spark, sf_dir, "doc_id", "text").withColumn("text", looped(F.col("text"), F.col("doc_id")))
    runs = F.col("periodic.runs")
    found = find_runs(documents).withColumn("best", longest(runs))
    lines = F.transform(runs, lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    length, period = F.col("best.length"), F.col("best.period")
    return found.select(
        "doc_id",
        F.size(runs).cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(length * 1000 / period).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("periodic.collapsed"), 256).alias("collapsed_sha256"),
    )


#: DuckDB has no CRC-32, so it is folded over the bytes by the table of its polynomial. Words that are equal
#: and up to a quarter of the text apart are paired; neighbouring pairs of one distance make a stretch.
OP13_SQL = r"""WITH RECURSIVE steps AS (
  SELECT n, n AS v, 0 AS i FROM (SELECT unnest(generate_series(0, 255)) AS n)
  UNION ALL
  SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, i + 1 FROM steps WHERE i < 8
),
t AS MATERIALIZED (SELECT list(CAST(v AS BIGINT) ORDER BY n) AS crc FROM steps WHERE i = 8),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(CAST(doc_id AS VARCHAR), ''))) AS x,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
h AS (SELECT r, doc_id, ws, CAST(len(ws) AS BIGINT) AS n,
  xor(list_reduce(list_transform(generate_series(1, length(x) // 2), lambda i: CAST(concat('0x', substring(x, CAST(2 * i - 1 AS BIGINT), 2)) AS BIGINT)),
                  lambda a, b: xor(a >> 8, crc[CAST((xor(a, b) & 255) + 1 AS BIGINT)]), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM d, t),
a AS (SELECT r, ws, n, h, CASE WHEN n > 0 THEN (h // 10) % n ELSE 0 END AS a FROM h),
p AS (SELECT r, ws, n, a, h % 10 = 0 AS looped, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
w AS MATERIALIZED (SELECT r, n, i, CASE WHEN looped AND i >= a THEN ws[a + (i - a) % p + 1] ELSE ws[i + 1] END AS w FROM p, unnest(range(n)) AS u(i)),
same AS (SELECT x.r, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
numbered AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM same),
stretch AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM numbered GROUP BY r, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS MATERIALIZED (SELECT r, start, length, min(q) AS period FROM stretch GROUP BY r, start, length),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length DESC, start, period) = 1),
listed AS (SELECT r, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines FROM runs GROUP BY r),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS collapsed FROM w
  WHERE NOT EXISTS (SELECT 1 FROM runs u WHERE u.r = w.r AND w.i >= u.start + u.period AND w.i < u.start + u.length) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
  CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)"""
