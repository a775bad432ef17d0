"""Exact n-gram Jaccard self-join by partitioning the universe of shingles.

Texts with equal shingle sets form a class; the join works on classes. Sets of at most ``threshold``
apart differ in at most ``H = floor((|A| + |B|) (1 - t) / (1 + t))`` shingles. Classes are put into
size bands; in the scheme of a band the universe of shingles is hashed into segments, each segment
counts 1 (it is indexed as it is) or 2 (as it is and with any one shingle deleted), and the counts
sum to more than H of the largest pair of the band, so any pair within H has a segment that agrees
(counts 1) or differs in at most one shingle (counts 2), and shares a signature. How many segments
of either kind a band gets is chosen by the cost of signatures. Empty segments tell nothing and are
not indexed; the counts have a slack for them, and a set with more empty segments than that also
indexes the shingles of a prefix in hash order, of which any two such sets that link share one.

Candidates from the signatures are verified on the whole sets: first the best hub of each class,
then the other hubs, then all pairs of a signature that still lie in different components. Only
links that can't change any component are left unverified, so the components are exact.

Signatures that very many classes share are found in a part of the classes and left out before anything
is shuffled; their segments then count as empty ones, and shingles as common come last in a prefix.

Before whole sets are fetched, candidates are tested by sketches, whose distance is never over that
of the sets. Shingles are known by 64-bit hashes that mix all bytes of their words, classes by 128-bit
names; the numbers that stand for classes in signature rows may coincide, and are told apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm.common import bound_batches, documents_of, fresh, materialise
from ledgerlark.llm.components import components

SHINGLE = 5
#: Two sets link when PERCENT * union <= 100 * intersection.
PERCENT = 80
#: Signature rows that one task sorts, about.
ROWS_A_TASK = 2_000_000
#: Ids that are broadcast at most; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000
#: Classes of one signature that are compared with each other in one task, about.
BLOCK_MEMBERS = 4_096
#: A signature of about so many classes or more is left out, the commonest ones up to a number that tasks
#: can carry; one in so many classes is counted to find them.
HOT = 16_384
MOST_HOT = 1_000_000
ONE_OF = 32
#: Bits of the numbers of classes.
NUMBER_BITS = 63
NO_SIGNATURES = np.empty(0, np.uint64)
#: Signatures that one of a single shingle counts as, as many unlike texts may share it.
LONE = 14

_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes that are hashed at once, about; longer texts are cut at white space.
PIECE = 1 << 16
#: Keys of the two hashes that every word and shingle gets.
_KEYS = (np.uint64(0x8BB84B93962EACC9), np.uint64(0x2D358DCCAA6C78A5))
#: Longer words are hashed one by one.
_LONG_WORD = 256
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, every other byte as it is.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: Masks of the first n bytes of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(8)] + [0xFFFFFFFFFFFFFFFF], np.uint64)


def _word_hashes(b: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two independent hashes of each word of ``b``, and its first byte. No word crosses the positions
    ``firsts``. Each takes in eight bytes after another, mixing all bits in between."""
    if not len(b):
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
    blank = _SPACE[b]
    edge = np.zeros(len(b) + 1, bool)
    edge[firsts] = True
    edge[0] = edge[-1] = True
    starts = np.flatnonzero(~blank & (np.r_[True, blank[:-1]] | edge[:-1]))
    ends = np.flatnonzero(~blank & (np.r_[blank[1:], True] | edge[1:])) + 1
    low = np.concatenate([_LOWER[b], np.zeros(8, np.uint8)])
    eight = np.ndarray(len(b) + 1, "<u8", low, strides=(1,))
    sizes = ends - starts
    one = _mixed(sizes.astype(np.uint64) * _MIX[3] ^ _KEYS[0])
    two = _mixed(sizes.astype(np.uint64) * _MIX[4] ^ _KEYS[1])
    short = sizes <= _LONG_WORD
    left, at, step = (np.arange(len(sizes)), starts, sizes) if short.all() else (np.flatnonzero(short), starts[short], sizes[short])
    while len(left):
        lane = eight[at] & _FIRST[np.minimum(step, 8)]
        one[left] = _mixed(one[left] ^ lane) + _KEYS[1]
        two[left] = _mixed(two[left] + lane * _MIX[4]) ^ _KEYS[0]
        more = step > 8
        left, at, step = left[more], at[more] + 8, step[more] - 8
    for i in np.flatnonzero(~short):
        digest = xxhash.xxh3_128_digest(low[starts[i] : ends[i]].tobytes(), int(_KEYS[0]))
        one[i], two[i] = np.frombuffer(digest, np.uint64)
    return one, two, starts


def _chained(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words."""
    n = max(len(words) - width + 1, 0)
    total = np.full(n, width, np.uint64) * _MIX[1]
    for k in range(width):
        total = _mixed(total ^ words[k : k + n]) + _MIX[2]
    return total


def _summed(words: np.ndarray, width: int) -> np.ndarray:
    """Another hash of each run of ``width`` words, from their second hashes."""
    n = max(len(words) - width + 1, 0)
    total, factor = np.full(n, width, np.uint64) * _MIX[3], _KEYS[1] | np.uint64(1)
    for k in range(width):
        total = total * factor + words[k : k + n]
    return _mixed(total)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def _long_text(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of one text of any length, piece by piece, each cut at white space."""
    one, two, at = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], 0
    while at < len(b):
        past = min(at + PIECE, len(b))
        while past < len(b):
            if len(found := np.flatnonzero(_SPACE[b[past : past + PIECE]])):
                past += int(found[0])
                break
            past = min(past + PIECE, len(b))
        first, second, _ = _word_hashes(b[at:past], np.empty(0, np.int64))
        one.append(first)
        two.append(second)
        at = past
    return np.concatenate(one), np.concatenate(two)


def named_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[tuple[np.ndarray, bytes | None]]:
    """Sorted hashes of the distinct shingles of each text, and a 128-bit name of the set: words
    ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; fewer than ``size`` words make one shingle; a text
    without words, or null, has no shingle and no name. The name comes from both hashes of the shingles."""
    if texts.null_count:
        texts = texts.fill_null("")
    raw = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1 + raw.offset)[raw.offset :] if len(raw) else np.zeros(1, np.int64)
    data = np.frombuffer(raw.buffers()[2], np.uint8) if len(raw) and raw.buffers()[2] is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(raw):
        past = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, side="right")) - 1)
        first, end = int(offsets[at]), int(offsets[past])
        if past == at + 1 and end - first > PIECE:
            (one, two), of = _long_text(data[first:end]), None
            counts = np.array([len(one)])
        else:
            firsts = offsets[at:past] - first
            one, two, starts = _word_hashes(data[first:end], firsts[firsts < end - first])
            of = np.searchsorted(firsts, starts, side="right") - 1
            counts = np.bincount(of, minlength=past - at)
        grams, others = _chained(one, size), _summed(two, size)
        if of is not None and len(grams):
            same = of[: len(grams)] == of[size - 1 :]
            grams, others = grams[same], others[same]
        word, gram = 0, 0
        for n in counts:
            if n >= size:
                yield _named(grams[gram : gram + n - size + 1], others[gram : gram + n - size + 1])
                gram += n - size + 1
            elif n:
                yield _named(_chained(one[word : word + n], n), _summed(two[word : word + n], n))
            else:
                yield np.empty(0, np.uint64), None
            word += n
        at = past


def _named(tokens: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, bytes]:
    order = np.argsort(tokens)
    tokens = tokens[order]
    fresh = np.r_[True, tokens[1:] != tokens[:-1]]
    tokens = tokens[fresh]
    return tokens, xxhash.xxh3_128_digest(tokens.tobytes() + others[order][fresh].sum().tobytes())


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sets of ``named_sets``."""
    return (tokens for tokens, _ in named_sets(texts, size))


def shingle_set(raw: bytes | None, size: int = SHINGLE) -> np.ndarray:
    return next(shingle_sets(pa.array([raw], pa.binary()).cast(pa.string()), size))


def sketch(tokens: np.ndarray) -> bytes:
    """Parities of hashed shingles, two to four bits a shingle: bits of two sketches that differ are at
    most the shingles in which the sets differ."""
    bits = 1 << max(6, (len(tokens) - 1).bit_length() + 1)
    at = _mixed(tokens ^ _MIX[4]) & np.uint64(bits - 1)
    odd = np.bincount(at.astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """The least number of shingles in which sets with these sketches differ."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) < len(y):
        x, y = y, x
    if len(x) > len(y):
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


@cache
def bands(most: int = 1 << 40, percent: int = PERCENT) -> list[int]:
    """First sizes of the bands: a set links with none beyond the next band. Each band takes about
    the square of the largest ratio of linked sizes."""
    reach = lambda s: s * 100 // percent  # noqa: E731  largest set that a set of s can link with
    out = [max(1, -(-percent // (100 - percent)))]
    while out[-1] <= most:
        out.append(reach(reach(out[-1])) + 1)
    return out


def distance(a: int, b: int, percent: int = PERCENT) -> int:
    """The most shingles in which linked sets of these sizes can differ."""
    return (a + b) * (100 - percent) // (100 + percent)


def linked(a: int, b: int, both: int, percent: int = PERCENT) -> bool:
    return 100 * both >= percent * (a + b - both)


@cache
def allocation(band: int) -> tuple[int, int, int]:
    """(segments that count 1, segments that count 2, slack) of a band's scheme, by least cost.

    The cost is the signatures of a set, those of a single shingle counting LONE times more, with what
    a set with too many empty segments pays on top times its chance, for sizes through the band and
    its guests."""
    starts = bands()
    low, top = -(-starts[band] * PERCENT // 100), starts[band + 1] - 1
    need = distance(top, top) + 1
    best, choice = math.inf, (need, 0, 0)
    for twos in {0, 1, 2, need // 2, (need + 1) // 2}:
        for slack in sorted({*range(0, 9), *(need * f // 40 for f in range(1, 17))}):
            ones = need + slack - 2 * twos
            if ones < 0 or ones + twos < 1:
                continue
            m, cost = ones + twos, 0.0
            for n in (low, (low + starts[band]) // 2, starts[band], (starts[band] + top) // 2, top):
                none = (1 - 1 / m) ** n
                lone = n / m * (1 - 1 / m) ** (n - 1)
                two = n * (n - 1) / 2 / m**2 * (1 - 1 / m) ** max(n - 2, 0)
                lost = ones * none + 2 * twos * (none + lone)
                # Chance of a Poisson variable over the slack.
                term, below = math.exp(-min(lost, 700.0)), 0.0
                for i in range(slack + 1):
                    below += term
                    term *= lost / (i + 1)
                cost += ones + twos * (1 + n / m) + LONE * ((ones + twos) * lone + twos * 2 * two)
                cost += max(0.0, 1 - below) * (1 + LONE) * (n * (100 - PERCENT) / 100 + 1)
            if cost < best:
                best, choice = cost, (ones, twos, slack)
    return choice


def _in(values: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    return hot[np.minimum(np.searchsorted(hot, values), len(hot) - 1)] == values if len(hot) else np.zeros(len(values), bool)


def _lone(tokens: np.ndarray) -> np.ndarray:
    """Signatures of single shingles, by which common ones are known."""
    return _mixed(tokens ^ _MIX[1])


def signatures(tokens: np.ndarray, hot: np.ndarray = NO_SIGNATURES) -> np.ndarray:
    """Signatures of a set (sorted hashes of its shingles); two sets that link share one, if they differ.

    Signatures in ``hot`` (sorted) are left out, and their segments are as good as empty: two sets that
    agree in one of them both have it, so the slack covers them too. Sets with more lost than that index
    a prefix, in an order that puts common shingles last."""
    n, starts = len(tokens), bands()
    out = []
    if n < starts[0]:
        return NO_SIGNATURES
    band = int(np.searchsorted(starts, n, side="right")) - 1
    schemes = [band]
    if n * 100 // PERCENT >= starts[band + 1]:
        schemes.append(band + 1)
    for scheme in schemes:
        ones, twos, slack = allocation(scheme)
        m = ones + twos
        salt = np.uint64((scheme + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        mixed = _mixed(tokens ^ salt)
        segment = ((mixed >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        segment, value = segment[order], _mixed(mixed[order] + _MIX[4])
        firsts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        present, sums = segment[firsts], np.add.reduceat(value, firsts)
        sizes = np.diff(np.r_[firsts, n])
        name = lambda sums, present: _mixed((sums ^ salt) + (present.astype(np.uint64) + np.uint64(1)) * _MIX[3])
        found = name(sums, present)
        spoilt = _in(found, hot)
        out.append(found[~spoilt])
        # Segments 0 to twos - 1 count 2: one whose single shingle is deleted is empty, and not indexed.
        strong = (present < twos) & (sizes > 1)
        if twos:
            less = np.flatnonzero(np.repeat(strong, sizes))
            at = np.repeat(np.arange(len(firsts)), sizes)[less]
            found = name(sums[at] - value[less], present[at])
            common = _in(found, hot)
            out.append(found[~common])
            spoilt[at[common]] = True
        lost = ones - np.count_nonzero((present >= twos) & ~spoilt) + 2 * (twos - np.count_nonzero(strong & ~spoilt))
        if lost > slack:
            common = _in(_lone(tokens), hot)
            prefix = np.concatenate([tokens[~common], tokens[common]])[: n - -(-n * PERCENT // 100) + 1]
            out.append(_mixed(_mixed(prefix + salt) ^ _MIX[2]))
    return np.unique(np.concatenate(out))


def _short(name: bytes, bits: int) -> int:
    """The number by which a class goes in signature rows; classes with one number are told apart later."""
    return int.from_bytes(name[:8], "little") % (1 << bits)


def _sized(bits: int):
    """Size, name, number and sketch of the set of each text."""

    def structs(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sizes, names, nodes, sketches = [], [], [], []
            for tokens, name in named_sets(batch):
                sizes.append(len(tokens))
                names.append(name)
                nodes.append(None if name is None else _short(name, bits))
                sketches.append(sketch(tokens) if len(tokens) else None)
            columns = [pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(nodes, pa.int64()), pa.array(sketches, pa.binary())]
            yield pa.StructArray.from_arrays(columns, names=["n", "name", "node", "sketch"])

    return F.arrow_udf(structs, "struct<n:bigint,name:binary,node:bigint,sketch:binary>")


def _signed(hot: np.ndarray, bits: int, one_of: int = 0):
    """(sig, node) rows, once for each class that the partition holds; with ``one_of``, of one in so many
    classes, and with its single shingles."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()
        for batch in batches:
            sigs, nodes, held = [], [], 0
            for tokens, name in named_sets(batch.column(0)):
                if name is None or name in done or one_of and name[8] % one_of:
                    continue
                done.add(name)
                s = signatures(tokens, hot)
                if one_of:
                    s = np.concatenate([s, _lone(tokens)])
                sigs.append(s)
                nodes.append((_short(name, bits), len(s)))
                held += len(s)
                if held >= 1 << 18:
                    yield _rows(sigs, nodes)
                    sigs, nodes, held = [], [], 0
            if held:
                yield _rows(sigs, nodes)

    return rows


def _rows(sigs: list[np.ndarray], nodes: list[tuple[int, int]]) -> pa.RecordBatch:
    ids, counts = np.array([x for x, _ in nodes], np.int64), [c for _, c in nodes]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(ids, counts))], names=["sig", "node"])


def hot_signatures(docs: DataFrame) -> np.ndarray:
    """Signatures, and single shingles, that about HOT classes share, or more, by the count in one of
    ONE_OF classes. They travel with tasks, so only the commonest MOST_HOT are left out."""
    rows = docs.select("text").mapInArrow(_signed(NO_SIGNATURES, NUMBER_BITS, ONE_OF), "sig bigint, node bigint")
    counts = rows.distinct().groupBy("sig").count().where(F.col("count") >= max(2, HOT // ONE_OF))
    found = counts.orderBy(F.desc("count"), "sig").limit(MOST_HOT).select("sig").toArrow()
    return np.sort(found.column("sig").to_numpy().view(np.uint64))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the signatures that several classes share, with the smallest class as hub. A partition
    holds all rows of its signatures."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not held:
        return
    sig = np.concatenate([s for s, _ in held])
    node = np.concatenate([n for _, n in held])
    del held
    order = np.argsort(sig)
    sig = sig[order]
    same = sig[1:] == sig[:-1]
    kept = np.r_[same, False] | np.r_[False, same]
    sig, node = sig[kept], node[order[kept]]
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    fresh = np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])][: len(sig)]
    sig, node = sig[fresh], node[fresh]
    firsts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]][: len(sig)])
    sizes = np.diff(np.r_[firsts, len(sig)])
    hub = np.repeat(node[firsts], sizes)
    several = np.repeat(sizes > 1, sizes)
    sig, node, hub = sig[several], node[several], hub[several]
    for at in range(0, len(sig), 1 << 16):
        part = slice(at, at + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(x[part]) for x in (sig, node, hub)], names=["sig", "node", "hub"])


def _near(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """Whether sizes and sketches leave it open that two classes link."""
    for n, sketched, m, other in batches:
        out = []
        for a, x, b, y in zip(n.to_pylist(), sketched.to_pylist(), m.to_pylist(), other.to_pylist(), strict=True):
            out.append(100 * min(a, b) >= PERCENT * max(a, b) and apart(x, y) <= distance(a, b))
        yield pa.array(out, pa.bool_())


def _verified(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for left, right in batches:
        out = []
        for x, y in zip(shingle_sets(left), shingle_sets(right), strict=True):
            both = len(x) + len(y) - len(_distinct(np.concatenate([x, y])))
            out.append(bool(len(x) and len(y)) and linked(len(x), len(y), both))
        yield pa.array(out, pa.bool_())


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose texts link. ``texts``: node and text."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("_x"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("_y"))
    both = pairs.join(right, "b").join(left, "a")
    return both.where(F.arrow_udf(_verified, "boolean")(F.col("_x"), F.col("_y"))).select("a", "b")


def _of_class(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, wanted in batches:
        yield pa.array([name is not None and name == w for (_, name), w in zip(named_sets(texts), wanted.to_pylist(), strict=True)], pa.bool_())


def _texts_of(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """One text of each class in ``nodes``, written to the shared folder."""
    wanted = materialise(classes.join(nodes.distinct(), "node").select("node", "name", F.col("least").alias("__id")))
    if wanted.count() <= MOST_BROADCAST:
        wanted = F.broadcast(wanted)
    # An id may have several rows, or be null: the set of a text tells whether it is of the class.
    found = docs.join(wanted, docs["doc_id"].eqNullSafe(F.col("__id"))).where(F.arrow_udf(_of_class, "boolean")(F.col("text"), F.col("name")))
    return materialise(found.groupBy("node").agg(F.min("text").alias("text")))


def _open_pairs(rows: pa.Table, forest: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of one block (or two) of a signature whose roots differ, and whose sizes and sketches leave
    it open that they link. With ``forest``, only as many as would join all that they join."""
    node, root, n, block = (rows.column(c).to_numpy() for c in ("node", "root", "n", "block"))
    mixed = rows.column("i")[0].as_py() != rows.column("j")[0].as_py()
    sketches = rows.column("sketch").to_pylist()
    width = np.array([len(x) for x in sketches])
    sets = {w: np.flatnonzero(width == w) for w in np.unique(width)}
    bits = {w: np.frombuffer(b"".join(sketches[k] for k in at), np.uint64).reshape(len(at), -1) for w, at in sets.items()}
    label = root.copy()
    for w, left in sets.items():
        for v, right in sets.items():
            if v < w:
                continue
            folded = bits[v] if v == w else np.bitwise_xor.reduce(bits[v].reshape(len(right), v // w, w // 8), axis=1)
            for row, a in enumerate(left):
                b, z = (right[row + 1 :], folded[row + 1 :]) if v == w else (right, folded)
                ok = (label[b] != label[a]) & (100 * np.minimum(n[a], n[b]) >= PERCENT * np.maximum(n[a], n[b]))
                if mixed:
                    ok &= block[b] != block[a]
                b, z = b[ok], z[ok]
                if len(b):
                    far = np.bitwise_count(z ^ bits[w][row]).sum(axis=1)
                    b = b[far <= (n[a] + n[b]) * (100 - PERCENT) // (100 + PERCENT)]
                if not len(b):
                    continue
                if forest:
                    joined, firsts = np.unique(label[b], return_index=True)
                    b = b[firsts]
                    label[np.isin(label, joined)] = label[a]
                x = np.full(len(b), node[a])
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, node[b])), pa.array(np.maximum(x, node[b]))], names=["a", "b"])


def _block_pairs(forest: bool):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Open pairs of each (sig, i, j), whose rows are consecutive."""
        kept: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("sig", "i", "j")])
            cuts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
            for at, past in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                key = tuple(keys[:, at].tolist())
                if kept and key != last:
                    yield from _open_pairs(pa.Table.from_batches(kept), forest)
                    kept = []
                last = key
                kept.append(batch.slice(int(at), int(past - at)))
        if kept:
            yield from _open_pairs(pa.Table.from_batches(kept), forest)

    return blocks


def similar_groups(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (one for each set) and group_id (one for each
    component of sets) of every row of ``documents``.

    A null or empty text, and one of white space only, has no shingles and is linked with nothing:
    its component is its own id. Texts with equal sets are one class. A component is named by its
    smallest id; null ids name none, and a component of such rows only is null. Repeated rows are
    each returned. Other columns are not read; an empty table gives no rows.
    """
    spark = documents.sparkSession
    bound_batches(documents)
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sized = docs.select("doc_id", _sized(NUMBER_BITS)(F.col("text")).alias("s")).select("doc_id", "s.n", "s.name", "s.node", "s.sketch")
    sized = materialise(sized)
    total = sized.agg(F.sum("n")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) * 6 // (10 * ROWS_A_TASK)))

    signed = docs.select("text").mapInArrow(_signed(hot_signatures(docs), NUMBER_BITS), "sig bigint, node bigint")
    shared = materialise(signed.repartition(tasks, "sig").mapInArrow(_shared, "sig bigint, node bigint, hub bigint"))
    # One row a class, copies combined before they are shuffled.
    whole = sized.where("node is not null").groupBy("name").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("node").alias("node"))
    whole = materialise(whole)
    # Classes that share their number with one of a smaller name get numbers of their own, which are
    # hashes of the name; where one is taken already, the join can't go on.
    twins = whole.join(whole.groupBy("node").agg(F.min("name").alias("_first"), F.count("*").alias("c")).where("c > 1"), "node").where("name <> _first")
    twins = materialise(twins.select("name", F.col("node").alias("_node"), F.xxhash64("name", "node").alias("_own")))
    if not twins.isEmpty():
        rename = lambda df: df.join(twins.select("name", "_own"), "name", "left").withColumn("node", F.coalesce("_own", "node")).drop("_own")
        whole, sized = materialise(rename(whole)), materialise(rename(sized))
        if not whole.groupBy("node").count().where("count > 1").isEmpty():
            raise RuntimeError("several classes have one number")
        others = shared.join(twins.select(F.col("_node").alias("node"), "_own"), "node").select("sig", F.col("_own").alias("node"), "hub")
        # What only classes of one number share was taken for one class: they are put under a signature.
        among = twins.select("_node", F.explode(F.array("_node", "_own")).alias("node")).distinct().select(F.col("_node").alias("sig"), "node", F.col("_node").alias("hub"))
        shared = materialise(shared.unionByName(others).unionByName(among))
    least = whole.select("node", "name", "least")
    classes = materialise(whole.join(shared.select("node").distinct(), "node", "left_semi"))

    # Pairs of a class and a hub that sizes and sketches leave open; most shared signatures first.
    def open_pairs(pairs: DataFrame) -> DataFrame:
        left = classes.select(F.col("node").alias("a"), F.col("n").alias("_n"), F.col("sketch").alias("_x"))
        right = classes.select(F.col("node").alias("b"), F.col("n").alias("_m"), F.col("sketch").alias("_y"))
        return pairs.join(left, "a").join(right, "b").where(F.arrow_udf(_near, "boolean")(F.col("_n"), F.col("_x"), F.col("_m"), F.col("_y")))

    hubs = shared.where("node <> hub").groupBy(F.col("hub").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("c"))
    hubs = materialise(open_pairs(hubs).select("a", "b", "c"))
    texts = _texts_of(docs, classes, hubs.select(F.col("a").alias("node")).unionByName(hubs.select(F.col("b").alias("node"))))
    first = hubs.groupBy("b").agg(F.max_by("a", F.struct("c", -F.col("a"))).alias("a")).select("a", "b")
    links = materialise(verify(first, texts))
    roots = materialise(components(links, "a", "b"))

    def rooted(df: DataFrame, node: str, to: str) -> DataFrame:
        own = roots.select(F.col("node").alias(node), F.col("root").alias(to))
        return df.join(own, node, "left").withColumn(to, F.coalesce(to, node))

    # Then the other hubs that lie in another component.
    rest = hubs.select("a", "b").join(first, ["a", "b"], "left_anti")
    rest = rooted(rooted(rest, "a", "ra"), "b", "rb").where("ra <> rb").select("a", "b")
    links = materialise(links.unionByName(verify(rest, texts)))
    roots = materialise(components(links, "a", "b"))

    # Then pairs without a hub, of signatures whose classes still lie in several components, block by
    # block: first as few as would join what may be joined, at last all that are still open.
    def hubless(forest: bool) -> DataFrame:
        members = rooted(shared, "node", "root")
        spread = members.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("g")).where("lo <> hi and g > 2")
        members = members.join(spread.select("sig", F.ceil(F.col("g") / BLOCK_MEMBERS).cast("int").alias("blocks")), "sig").where("node <> hub")
        members = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        members = members.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        members = members.withColumn("i", F.least("block", "_o")).withColumn("j", F.greatest("block", "_o"))
        members = members.join(classes.select("node", "n", "sketch"), "node").select("sig", "i", "j", "block", "node", "root", "n", "sketch")
        pairs = members.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j").mapInArrow(_block_pairs(forest), "a bigint, b bigint")
        return materialise(pairs.groupBy("a", "b").agg(F.count("*").alias("c")))

    tried = hubs.select("a", "b")
    for forest in (True, False):
        last = materialise(hubless(forest).select("a", "b").join(tried, ["a", "b"], "left_anti"))
        if last.isEmpty():
            continue
        tried = tried.unionByName(last)
        texts = _texts_of(docs, classes, last.select(F.col("a").alias("node")).unionByName(last.select(F.col("b").alias("node"))))
        links = materialise(links.unionByName(verify(last, texts)))
        roots = materialise(components(links, "a", "b"))

    named = roots.join(least, "node")
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.select("node", "root").join(names, "root").select("node", "root", F.col("component_id").alias("_linked"))
    named = least.join(named, "node", "left").select(
        "node", F.hex("name").alias("class_id"), F.coalesce("root", "node").alias("group_id"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("_linked")).alias("component_id")
    )
    # Written first, so that the last join has two plain sides and can split a class with very many rows.
    named = materialise(named)
    return sized.select("doc_id", "n", "node").join(named, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "class_id", "group_id",
    )


def keep_one(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``documents`` but for one row of each component: that of its smallest id.

    Texts without words are linked with nothing and stay. Of rows that share an id and a set, and of
    a component of null ids only, one row stays. Columns stay as they are.
    """
    groups = materialise(similar_groups(documents, doc_id=doc_id, text=text))
    linked = groups.where("class_id is not null")
    gone_, id_, row_, name_ = fresh(documents, "_gone", "_id", "_row", "_name")
    # Ids whose rows are not told apart by the id alone are judged row by row.
    doubled = materialise(groups.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 or doc_id is null").select(F.col("doc_id").alias(id_)))
    gone = linked.where("doc_id <> component_id").join(doubled, F.col("doc_id") == F.col(id_), "left_anti").select(F.col("doc_id").alias(gone_))
    gone = materialise(gone)
    if gone.count() <= MOST_BROADCAST:
        gone = F.broadcast(gone)
    kept = documents.join(gone, documents[doc_id] == F.col(gone_), "left_anti")
    if doubled.isEmpty():
        return kept
    single = kept.join(doubled, kept[doc_id].eqNullSafe(F.col(id_)), "left_anti")
    rows = documents.join(doubled, documents[doc_id].eqNullSafe(F.col(id_)), "left_semi")
    rows = rows.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias(row_), F.col(doc_id).alias(id_), F.hex(_sized(NUMBER_BITS)(F.col(text))["name"]).alias(name_))
    names = linked.select(F.col("doc_id").alias("_d"), F.col("class_id").alias("_c"), "group_id", "component_id").distinct()
    found = rows.join(names, F.col(id_).eqNullSafe(F.col("_d")) & (F.col(name_) == F.col("_c")), "left")
    empty = found.where(F.col(name_).isNull()).select(f"{row_}.*")
    one = found.where(F.col(name_).isNotNull() & F.col(id_).eqNullSafe(F.col("component_id"))).groupBy("group_id").agg(F.min_by(row_, F.to_json(row_)).alias(row_))
    return single.unionByName(empty).unionByName(one.select(f"{row_}.*"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(documents_of(spark, sf_dir, "doc_id", "text")).select("doc_id", "n_shingles", "component_id")


_SQL_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x20\x09-\x0D]+')"
)
OP10_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), {SHINGLE}) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - least(len(w), {SHINGLE}) + 1)) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM both_ JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= {PERCENT} * (p.n + q.n - c)
),
sym AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (
  SELECT a AS doc_id, b AS other FROM sym
  UNION
  SELECT r.doc_id, sym.b FROM reach r JOIN sym ON r.other = sym.a
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(r.c, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id) r USING (doc_id)
"""
