"""Toxicity by weak supervision.

Voters are lexicons (general ones, and word and stem lists drawn from a bounded labelled sample by
class-wise document frequency) and text patterns. A generative model with one hidden class per text
estimates by expectation maximisation how often each voter fires on either class, and from what the
hidden class leaves unexplained how far voters go together; the log-odds of a voter count the less
the more of its kind it goes with. A sparse linear classifier over words and stems is trained on the
posterior labels, and a part of the sample that it has not seen calibrates its score.

Labels choose the words of the lists, set the share of the hidden class to begin with, and calibrate;
none is a vote, and none is a target of the classifier.

What travels to the driver are the telling words and stems of at most ``MOST_LABELLED`` texts, whose
number that bound holds, and their places in these texts; what travels back is a table of weights.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm.common import bound_batches, documents_of, raw_texts, table, words_of
from ledgerlark.llm.linear import Rows, fold, labelled_sample, platt, sigmoid, sparse_logistic

MOST_LABELLED = 12_000
#: A word or stem counts only if so many texts of the sample have it, and if its share of texts with
#: label 1 is so many deviations from that of the sample.
LEAST_TEXTS = 4
LEAST_DEVIATIONS = 3.5
#: It votes if its share of texts with label 1 is over this by so many deviations. How far a voter is to be
#: trusted is for the label model to say, so the bar is low.
LEAST_PRECISION = 0.5
SURE = 1.0
L1 = 3e-4
STEMS = (4, 5)
GROUPS = 6
FOLDS = 5
#: General lexicons, one voter each.
LEXICONS = {
    "insult": "idiot idiots moron morons imbecile fool loser losers clown dimwit dumbass jerk scumbag",
    "scorn": "stupid dumb pathetic worthless useless ridiculous disgusting revolting vile filthy",
    "dehumanise": "scum trash garbage vermin filth parasite parasites subhuman maggot maggots",
    "profanity": "damn crap bastard bullshit shit fuck fucking asshole bitch",
    "threat": "kill die hurt destroy beat shoot hang",
}
PATTERNS = {
    "aimed": re.compile(rb"\byou(?:r|re| are)? (?:\w+ ){0,2}(?:idiot|moron|loser|clown|fool|scum|trash|stupid|dumb|pathetic|worthless)"),
    "wish": re.compile(rb"\b(?:go (?:and )?die|shut up|drop dead|get lost|hate you)\b"),
}


def features_of(words: set[bytes]) -> set[bytes]:
    """Distinct words, and their stems of so many bytes (marked, and only of longer words)."""
    out = set(words)
    for k in STEMS:
        out.update([b"^" + w[:k] for w in words if len(w) > k])
    return out


def pattern_hits(raw: bytes) -> list[int]:
    low = raw.lower()
    return [i for i, p in enumerate(PATTERNS.values()) if p.search(low)]


@dataclass(frozen=True)
class Model:
    """score = sigmoid(scale * (bias + sum of the weights of a text's features) + offset)."""

    weights: dict[bytes, float]
    bias: float
    scale: float
    offset: float

    def score(self, raw: bytes | None) -> float:
        words = set(words_of(raw))
        found = self.weights.keys() & words
        for k in STEMS:
            found |= self.weights.keys() & {b"^" + w[:k] for w in words if len(w) > k}
        x = self.scale * (self.bias + math.fsum(self.weights[f] for f in sorted(found))) + self.offset
        return 1 / (1 + math.exp(-min(40.0, max(-40.0, x))))


def _feature_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [sorted(features_of(set(words_of(raw)))) for raw in raw_texts(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(lists, pa.list_(pa.binary()))], names=["y", "features"])


def _vocabulary(sample: DataFrame) -> list[tuple[bytes, int, int]]:
    """The features whose document frequencies in the classes differ most: (feature, texts with
    label 1, with label 0)."""
    totals = sample.agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    n1, n0 = (totals[0] or 0) + 1.0, (totals[1] or 0) + 1.0
    counts = sample.select("text", "y").mapInArrow(_feature_lists, "y int, features array<binary>")
    counts = counts.select("y", F.explode("features").alias("feature")).groupBy("feature")
    counts = counts.agg(F.sum("y").cast("bigint").alias("a"), F.sum(1 - F.col("y")).cast("bigint").alias("b"))
    a, b = F.col("a"), F.col("b")
    gap = F.abs(a / n1 - b / n0) / F.sqrt((a + b + 1) / (n1 + n0))
    share = n1 / (n1 + n0)
    deviations = F.abs(a - (a + b) * share) / F.sqrt((a + b) * share * (1 - share))
    kept = counts.where((a + b >= LEAST_TEXTS) & (deviations >= LEAST_DEVIATIONS)).select("feature", "a", "b", F.round(gap, 9).alias("gap"))
    return [(bytes(r[0]), r[1], r[2]) for r in kept.orderBy(F.desc("gap"), "feature").collect()]


def surely(a: int, n: int, z: float = SURE) -> float:
    """Lower end of the Wilson interval of a share a / n."""
    p = a / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def label_model(votes: np.ndarray, prior: float, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of class 1 for each row of 0/1 votes; rates of firing (2 x voters); correlations.

    The hidden class starts at rows that any voter fires on, weighted to the prior. Correlations are
    those of the votes' residuals given the class; a voter's log-odds are divided by one plus the sum
    of its positive correlations above 0.1 with others.
    """
    n, m = votes.shape
    fired = votes.any(axis=1)
    q = np.where(fired, 0.9, 0.02)
    share = min(max(prior, 1e-3), 0.5)
    damp = np.ones(m)
    rates, corr = np.full((2, m), 0.5), np.eye(m)
    for k in range(rounds):
        for y, weight in ((0, 1 - q), (1, q)):
            rates[y] = (weight @ votes + 0.5 * (0.02 if y == 0 else 0.3)) / (weight.sum() + 0.5)
        rates = np.clip(rates, 1e-4, 1 - 1e-4)
        if k % 10 == 9:
            residual = votes - (q[:, None] * rates[1] + (1 - q)[:, None] * rates[0])
            spread = np.sqrt((residual**2).mean(axis=0)) + 1e-9
            corr = (residual.T @ residual / n) / np.outer(spread, spread)
            damp = 1 / (1 + np.where((corr > 0.1) & ~np.eye(m, dtype=bool), corr, 0).sum(axis=1))
        on, off = np.log(rates[1] / rates[0]), np.log((1 - rates[1]) / (1 - rates[0]))
        q = sigmoid(np.log(share / (1 - share)) + votes @ (on * damp) + (1 - votes) @ (off * damp))
        share = min(max(float(q.mean()), 1e-3), 0.5)
    return q, rates, corr


def voters_of(chosen: list[tuple[bytes, int, int]], places: dict[bytes, int]) -> list[np.ndarray]:
    """Places of the features of each voter: the general lexicons, and GROUPS lists each of the words and of
    the stems that tell label 1."""
    voters = [np.array([places[w] for w in words.encode().split()], dtype=np.int64) for words in LEXICONS.values()]
    telling = [f for f, a, b in chosen if surely(a, a + b) > LEAST_PRECISION]
    for stems in (False, True):
        kind = [places[f] for f in telling if f.startswith(b"^") == stems]
        voters += [np.array(kind[g::GROUPS], dtype=np.int64) for g in range(GROUPS) if kind[g::GROUPS]]
    return voters


def votes_of(lists: list[np.ndarray], hits: list[list[int]], voters: list[np.ndarray], width: int) -> np.ndarray:
    """For each text, given by its features and pattern hits, which voters fire."""
    has = np.zeros((len(voters), width), dtype=bool)
    for v, members in enumerate(voters):
        has[v, members] = True
    votes = np.zeros((len(lists), len(voters) + len(PATTERNS)))
    for i, (found, hit) in enumerate(zip(lists, hits, strict=True)):
        votes[i, : len(voters)] = has[:, found].any(axis=1)
        votes[i, [len(voters) + h for h in hit]] = 1
    return votes


def _placer(places: dict[bytes, int]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, hits = [], []
            for raw in raw_texts(batch.column("text")):
                found = places.keys() & features_of(set(words_of(raw)))
                lists.append(sorted(places[f] for f in found))
                hits.append(pattern_hits(raw or b""))
            columns = [batch.column("y"), batch.column("part"), pa.array(lists, pa.list_(pa.int32())), pa.array(hits, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["y", "part", "places", "hits"])

    return rows


def train(documents: DataFrame, labels: DataFrame, *, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", learn: Column | None = None) -> Model:
    """The classifier for ``label``, learned from labelled rows where ``learn`` holds.

    Without labelled rows, or with labels of one value, every text gets the prior, smoothed as if one of
    ten further texts were toxic."""
    learn = fold(doc_id, FOLDS) != 0 if learn is None else learn
    sample = labelled_sample(documents, labels, label, learn, MOST_LABELLED, doc_id=doc_id, text=text)
    chosen = _vocabulary(sample)
    places = placed(chosen)
    rows = sample.mapInArrow(_placer(places), "y int, part int, places array<int>, hits array<int>").toArrow()
    y = rows.column("y").to_numpy().astype(float)
    part = rows.column("part").to_numpy()
    lists = [np.array(x, dtype=np.int64) for x in rows.column("places").to_pylist()]
    hits = rows.column("hits").to_pylist()
    order = sorted(range(len(y)), key=lambda i: (part[i], y[i], len(lists[i]), lists[i].tolist(), hits[i]))
    return fit(chosen, places, [lists[i] for i in order], [hits[i] for i in order], y[order], part[order])


def placed(chosen: list[tuple[bytes, int, int]]) -> dict[bytes, int]:
    """A place for every chosen feature and every word of the general lexicons."""
    places = {f: i for i, (f, _, _) in enumerate(chosen)}
    for words in LEXICONS.values():
        for w in words.encode().split():
            places.setdefault(w, len(places))
    return places


def fit(chosen: list[tuple[bytes, int, int]], places: dict[bytes, int], lists: list[np.ndarray], hits: list[list[int]], y: np.ndarray, part: np.ndarray) -> Model:
    """The classifier of the posterior labels of parts 0 to 3, calibrated by the labels of part 4."""
    if not len(y) or y.min() == y.max():
        return Model({}, 0.0, 0.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 9))))
    seen, calibrating = part != 4, part == 4
    prior = float(y[seen].mean()) if seen.any() else float(y.mean())
    learned = [lists[i] for i in np.flatnonzero(seen)]
    votes = votes_of(learned, [hits[i] for i in np.flatnonzero(seen)], voters_of(chosen, places), len(places))
    posterior, _, _ = label_model(votes, prior)
    w, bias = sparse_logistic(Rows(learned, len(places)), posterior, np.ones(len(posterior)), l1=L1)
    rest = np.flatnonzero(calibrating) if len(set(y[calibrating])) == 2 else np.arange(len(y))
    raw = Rows([lists[i] for i in rest], len(places)).dot(w) + bias
    scale, offset = platt(raw, y[rest])
    return Model({f: float(w[i]) for f, i in places.items() if w[i]}, bias, scale, offset)


def score_documents(documents: DataFrame, model: Model, *, text: str = "text", to: str = "toxicity") -> DataFrame:
    """Add ``to``, a score from 0 to 1, to every row. A null text is scored as the empty text; repeated
    rows get one score; other columns stay, but a column ``to`` is replaced. An empty table stays empty."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([model.score(raw) for raw in raw_texts(batch)], pa.float64())

    bound_batches(documents)
    return documents.withColumn(to, scored(F.col(text)))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = documents_of(spark, sf_dir, "doc_id", "text")
    model = train(documents, table(spark, sf_dir, "labels"))
    found = score_documents(documents, model)
    score = F.col("toxicity")
    return found.select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
