"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every run of ``width`` consecutive words of a benchmark item is a window (an item with fewer words,
but not none, is one window). Windows of one length form one Wu-Manber table: the shift of a block
of two words tells how far the search may jump because no window can end in between, blocks with
shift 0 lead to a bucket of windows by their last block, further divided by their first block, and
a word-by-word comparison confirms the occurrence.

Patterns travel to the executors in blocks of at most about ``max_windows`` windows, each block over all
documents and written before the next is fetched; a worker builds the tables of a block once. Long
items are cut into pieces that share no window.
"""

from __future__ import annotations

import pickle
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm.common import bound_batches, documents_of, fresh, materialise, raw_texts, table, words_of

WIDTH = 10
#: Windows of one block, about: tables of 100 MB in each worker.
MAX_WINDOWS = 500_000
#: Windows of one piece of a long item.
PIECE_WINDOWS = 50_000

_SCAN_TYPE = "struct<n_words:bigint,spans:array<struct<first:bigint,past:bigint>>,items:array<string>>"
_SCAN_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))),
        ("items", pa.list_(pa.string())),
    ]
)


class WuManber:
    """Shift, suffix and prefix tables for the windows of one length of some pieces of items.

    Words are numbered, blocks of two words are whole numbers, and a window is a place in a piece, so
    that what windows share is held once: about 200 bytes a window."""

    def __init__(self, pieces: list[tuple[str, list[bytes]]], length: int, number: dict[bytes, int]) -> None:
        self.length, self.number = length, number
        self.block = min(2, length)
        self.jump = length - self.block + 1
        self.items = [item for item, _ in pieces]
        self.words = [[number.setdefault(w, len(number)) for w in words] for _, words in pieces]
        self.shift: dict[int, int] = {}
        ends: list[tuple[int, int, int, int]] = []
        for piece, words in enumerate(self.words):
            blocks = self.blocks(words)
            last = len(words) - length
            for at, block in enumerate(blocks):
                # The block ends a window that starts at ``at - jump + 1``, or is so far from the end of one.
                left = max(0, self.jump - 1 - at)
                if left < self.shift.get(block, self.jump):
                    self.shift[block] = left
                if 0 <= (first := at - self.jump + 1) <= last:
                    ends.append((block, blocks[first], piece, first))
        ends.sort()
        # Buckets by last block, within them by first block: sorted, and found by bisection.
        self.last = array("q", [x for x, *_ in ends])
        self.prefix = array("q", [x for _, x, _, _ in ends])
        self.piece = array("l", [x for _, _, x, _ in ends])
        self.first = array("q", [x for _, _, _, x in ends])

    def blocks(self, words: list[int]) -> list[int]:
        return words if self.block == 1 else [a << 32 | b for a, b in pairwise(words)]

    def search(self, words: list[int]) -> Iterator[tuple[int, set[str]]]:
        """(first word, items) of each occurrence, from left to right; unknown words are -1."""
        m, n, shift, jump, prefix = self.length, len(words), self.shift.get, self.jump, self.prefix
        at = m - 1
        while at < n:
            a, b = words[at - self.block + 1], words[at]
            if a < 0 or b < 0:
                # No window holds the word, so none ends before it is passed.
                at += m if b < 0 else jump
                continue
            block = a << 32 | b if self.block == 2 else b
            if skip := shift(block, jump):
                at += skip
                continue
            first = at - m + 1
            head = words[first] << 32 | words[first + 1] if self.block == 2 else words[first]
            low = bisect_left(self.last, block)
            high = bisect_right(self.last, block, low)
            k, found, window = bisect_left(prefix, head, low, high), set(), words[first : at + 1]
            while k < high and prefix[k] == head:
                start = self.first[k]
                if self.words[self.piece[k]][start : start + m] == window:
                    found.add(self.items[self.piece[k]])
                k += 1
            if found:
                yield first, found
            at += 1


def pieces_of(item: str, words: list[bytes], width: int = WIDTH) -> Iterator[tuple[str, list[bytes], int]]:
    """(item, words, windows) of an item; a long one in pieces of PIECE_WINDOWS windows, each of which
    lies in one of them."""
    length = min(width, len(words))
    windows = len(words) - length + 1 if length else 0
    for at in range(0, windows, PIECE_WINDOWS):
        n = min(PIECE_WINDOWS, windows - at)
        yield item, words[at : at + n + length - 1], n


def searchers(pieces: list[tuple[str, list[bytes]]], width: int = WIDTH) -> tuple[list[WuManber], dict[bytes, int]]:
    """One table for each window length that the pieces have, and the numbers of their words."""
    number: dict[bytes, int] = {}
    by_length: dict[int, list[tuple[str, list[bytes]]]] = {}
    for item, words in pieces:
        by_length.setdefault(min(width, len(words)), []).append((item, words))
    return [WuManber(by_length[length], length, number) for length in sorted(by_length)], number


@lru_cache(maxsize=1)
def _loaded(raw: bytes, width: int) -> tuple[list[WuManber], dict[bytes, int]]:
    """The tables of one block, once for each worker."""
    return searchers(pickle.loads(raw), width)


def scan(words: list[bytes], tables: list[WuManber], number: dict[bytes, int]) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged spans of hit words, and the items with an occurring window."""
    spans: list[tuple[int, int]] = []
    found: set[str] = set()
    numbers = [number.get(w, -1) for w in words]
    for t in tables:
        for first, items in t.search(numbers):
            found.update(items)
            if spans and spans[-1][0] <= first <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(spans[-1][1], first + t.length))
            else:
                spans.append((first, first + t.length))
    spans.sort()
    merged: list[tuple[int, int]] = []
    for first, past in spans:
        if merged and first <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], past))
        else:
            merged.append((first, past))
    return merged, found


def _scanner(pieces: list[tuple[str, list[bytes]]], width: int):
    block = pickle.dumps(pieces)

    @F.arrow_udf(_SCAN_TYPE)
    def windows(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tables, number = _loaded(block, width)
        for batch in batches:
            out = []
            for raw in raw_texts(batch):
                words = words_of(raw)
                spans, found = scan(words, tables, number)
                out.append({"n_words": len(words), "spans": [{"first": a, "past": b} for a, b in spans], "items": sorted(found)})
            yield pa.array(out, _SCAN_ARROW)

    return windows


def _cut(width: int):
    """(item, words, windows) of the pieces of benchmark items."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, raw in zip(batch.column("item").to_pylist(), raw_texts(batch.column("text")), strict=True):
                if cut := list(pieces_of(item, words_of(raw), width)):
                    yield pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in cut]), pa.array([b" ".join(w) for _, w, _ in cut], pa.binary()), pa.array([n for _, _, n in cut], pa.int64())], names=["item", "words", "windows"])

    return rows


def _union_length(spans: Column) -> Column:
    """Words in any span of an array sorted by first word."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-1).cast("bigint").alias("end"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct(
            (acc["n"] + F.greatest(F.lit(0).cast("bigint"), x["past"] - F.greatest(x["first"], acc["end"]))).alias("n"),
            F.greatest(acc["end"], x["past"]).alias("end"),
        )

    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def find_windows(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    max_windows: int = MAX_WINDOWS,
    to: str = "windows",
) -> DataFrame:
    """Add ``to`` (struct n_words, n_hit, spans, items) to every row of ``documents``.

    Null and empty texts have no words and no hits; an item with a null id or without words has no
    windows; rows of one item id count as one item; repeated documents are judged one by one; an
    empty benchmark hits nothing. Columns of ``documents`` other than ``text`` stay as they are,
    whatever their names; a column ``to`` is replaced. An empty table of documents stays empty.
    """
    bound_batches(documents)
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text")).where("item is not null")
    pieces = items.mapInArrow(_cut(width), "item string, words binary, windows bigint")
    total = pieces.agg(F.sum("windows")).first()[0] or 0
    blocks = -(-total // max_windows) or 1

    def block(k: int) -> list[tuple[str, list[bytes]]]:
        """Pieces of one block, about ``max_windows`` windows."""
        own = pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == k) if blocks > 1 else pieces
        return [(r["item"], bytes(r["words"]).split(b" ")) for r in own.select("item", "words").toLocalIterator()]

    if blocks == 1:
        found = documents.withColumn(to, _scanner(block(0), width)(F.col(text)))
        parts = [F.col(f"{to}.{c}") for c in ("n_words", "spans", "items")]
        return found.withColumn(to, _result(*parts))
    # The driver and each worker hold one block at a time. What it hits is written, keyed by the text, as
    # equal texts have equal hits.
    key_, spans_, items_, own_ = fresh(documents, "_key", "_spans", "_items", "_own")
    key = F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias(key_)
    hits = None
    for k in range(blocks):
        one = documents.select(key, _scanner(block(k), width)(F.col(text)).alias("w")).where(F.size("w.items") > 0)
        one = materialise(one.select(key_, "w.spans", "w.items").dropDuplicates([key_]))
        hits = one if hits is None else hits.unionByName(one)
    hits = materialise(hits.groupBy(key_).agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias(spans_), F.array_distinct(F.array_sort(F.flatten(F.collect_list("items")))).alias(items_)))
    out = documents.withColumn(own_, _scanner([], width)(F.col(text))).withColumn(key_, key).join(hits, key_, "left")
    found = _result(F.col(f"{own_}.n_words"), F.coalesce(spans_, f"{own_}.spans"), F.coalesce(items_, f"{own_}.items"))
    return out.withColumn(to, found).select(*[F.col(f"`{c}`") for c in documents.columns if c != to], to)


def _result(n_words: Column, spans: Column, items: Column) -> Column:
    return F.struct(n_words.alias("n_words"), _union_length(spans).alias("n_hit"), spans.alias("spans"), items.alias("items"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``documents`` that hold no window of the benchmark, with their columns."""
    (to,) = fresh(documents, "windows")
    return find_windows(documents, benchmark, to=to, **options).where(F.col(f"{to}.n_hit") == 0).drop(to)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_windows(documents_of(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("windows.n_words").alias("n_words"),
        F.col("windows.n_hit").alias("n_hit"),
        F.size("windows.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("windows.items", ","), 256).alias("items_sha256"),
        (F.col("windows.n_hit") > 0).alias("contaminated"),
    )


_SQL_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
OP1_SQL = rf"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item, least(len(w), {WIDTH}) AS size, array_to_string(w[i : i + least(len(w), {WIDTH}) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(len(w), {WIDTH}) + 1)) AS i FROM b WHERE len(w) > 0)
),
dw AS (
  SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i
        FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)
),
hit AS (SELECT doc_id, i, dw.size, item FROM dw JOIN bw USING (size, win)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""
