"""Aggregates of evaluation runs: means, paired deltas and their bootstrap intervals."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.text import FAMILIES, in_domain

OVERALL = "overall"
REPLICATES = 2_000
SEED_PREFIX = "paired-bootstrap-v1"


class EvaluationError(ValueError):
    """An input that no report may be made from."""


def bad_observations(obs: DataFrame) -> DataFrame:
    """Rows whose accuracy is outside [0, 1], whose family isn't known, or that lack a supercategory."""
    reasons = F.filter(
        F.array(
            F.when(~in_domain(F.col("accuracy")), "accuracy"),
            F.when(~F.coalesce(F.col("family").isin(*FAMILIES), F.lit(False)), "family"),
            F.when(F.coalesce(F.col("supercategory"), F.lit("")).isin("", "unknown"), "supercategory"),
        ),
        lambda r: r.isNotNull(),
    )
    return obs.withColumn("reasons", reasons).where(F.size("reasons") > 0)


def means_by(obs: DataFrame, *keys: str) -> DataFrame:
    return obs.groupBy(*keys).agg(F.avg("accuracy").alias("avg_accuracy"), F.count("*").alias("n"))


def require_families(means: DataFrame, families: Sequence[str] = FAMILIES) -> DataFrame:
    """``means`` itself, if every family is in it (a few keys: the check collects no more)."""
    missing = set(families) - {r[0] for r in means.select("family").where(F.col("family").isin(*families)).distinct().collect()}
    if missing:
        raise EvaluationError(f"no observations of {sorted(missing)}")
    return means


def key_mismatch(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side; both must be empty before rows are paired."""
    both = left.select(F.col(key), F.lit(1).alias("l")).join(right.select(F.col(key), F.lit(1).alias("r")), key, "full_outer")
    return both.where("l is null or r is null").select(key, F.when(F.col("l").isNull(), "right").otherwise("left").alias("side"))


def paired(obs: DataFrame, baseline: str) -> DataFrame:
    """Every other model's observations beside the baseline's of the same document. The observations are
    read and shuffled once, on the document, of which each model has a few rows at most."""
    row = F.struct("model_key", "accuracy", "family", "supercategory")
    held = obs.where("doc_hash is not null and model_key is not null").groupBy("doc_hash").agg(F.collect_list(row).alias("rows"))
    is_base = lambda r: r["model_key"] == baseline
    sides = held.select("doc_hash", F.filter("rows", is_base).alias("bases"), F.explode(F.filter("rows", lambda r: ~is_base(r))).alias("c"))
    both = sides.select("doc_hash", "c", F.explode("bases").alias("b"))
    return both.select(
        "doc_hash", "c.*", F.col("b.accuracy").alias("base"), F.col("b.family").alias("base_family"), F.col("b.supercategory").alias("base_supercategory")
    )


def inconsistent_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs whose sides disagree on family or supercategory."""
    return pairs.where(~(F.col("family").eqNullSafe(F.col("base_family")) & F.col("supercategory").eqNullSafe(F.col("base_supercategory"))))


def scoped(pairs: DataFrame) -> DataFrame:
    """Each pair once for the overall scope and once for its family."""
    return pairs.withColumn("scope", F.explode(F.array(F.lit(OVERALL), F.col("base_family")))).withColumn("delta", F.col("accuracy") - F.col("base"))


def paired_delta(obs: DataFrame, baseline: str) -> DataFrame:
    """Mean delta and pairs by model and scope; sums are combined before the shuffle."""
    return scoped(paired(obs, baseline)).groupBy("model_key", "scope").agg(F.avg("delta").alias("mean_delta"), F.count("*").alias("n"))


def bootstrap_seed(model: str, scope: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{SEED_PREFIX}:{model}:{scope}".encode()).digest()[:8], "big")


def bootstrap_exact(obs: DataFrame, baseline: str, replicates: int = REPLICATES) -> DataFrame:
    """Paired bootstrap intervals drawn by NumPy's generator, seeded by model and scope.

    The draw sequence depends on the order of all deltas of a scope, so a scope is one task. Spark sorts
    them; the task holds them as numbers, eight bytes each, and two arrays of their length, as it draws one
    replicate at a time. ``bootstrap_portable`` spreads the draws over tasks.
    """

    def interval(model: str | None, scope: str | None, deltas: np.ndarray) -> pa.RecordBatch:
        seed = bootstrap_seed(model, scope)
        rng = np.random.default_rng(seed)
        # Draws of one replicate after another are those of many at once.
        means = np.array([deltas[rng.integers(0, len(deltas), size=len(deltas))].mean() for _ in range(replicates)])
        low, high = np.quantile(means, [0.025, 0.975])
        found = {"model_key": model, "scope": scope, "mean_delta": deltas.mean(), "ci_low": low, "ci_high": high, "n": len(deltas), "seed": str(seed)}
        return pa.RecordBatch.from_pylist([found], schema=told)

    told = pa.schema([("model_key", pa.string()), ("scope", pa.string()), ("mean_delta", pa.float64()), ("ci_low", pa.float64()), ("ci_high", pa.float64()), ("n", pa.int64()), ("seed", pa.string())])

    def intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            deltas = batch.column("delta").to_numpy(zero_copy_only=False).astype(float)
            # Where the next model or scope begins: rows are sorted by both.
            keys = list(zip(batch.column("model_key").to_pylist(), batch.column("scope").to_pylist(), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and keys[a] != at:
                    yield interval(*at, np.concatenate(held))
                    held = []
                at = keys[a]
                held.append(deltas[a:b].copy())
        if held:
            yield interval(*at, np.concatenate(held))

    rows = scoped(paired(obs, baseline)).select("model_key", "scope", "doc_hash", "delta")
    placed = rows.repartition("model_key", "scope").sortWithinPartitions("model_key", "scope", "doc_hash", "delta")
    return placed.select("model_key", "scope", "delta").mapInArrow(intervals, "model_key string, scope string, mean_delta double, ci_low double, ci_high double, n bigint, seed string")


def poisson_cuts(uniform: int = 1 << 16) -> list[int]:
    """From how many of ``uniform`` equally likely draws on a Poisson variable of mean 1 exceeds 0, 1, and
    so on."""
    chance = below = math.exp(-1)
    cuts, k = [], 0
    while (cut := int(uniform * below)) < uniform - 1:
        cuts.append(cut)
        k += 1
        chance /= k
        below += chance
    return cuts


#: Draws of one SHA-256: each takes four hex digits.
DRAWS = 16


def bootstrap_portable(obs: DataFrame, baseline: str, replicates: int = REPLICATES) -> DataFrame:
    """Bootstrap intervals with weights instead of draws: in a replicate a document counts as often as a
    Poisson variable of mean 1 says, hashed from model, scope, document and replicate, so any SQL engine
    gives the same intervals.

    Weighted sums of all replicates are added up where the pairs are, and a task sends one row for each
    model, scope and replicate, however many documents there are."""
    cuts = np.array(poisson_cuts())

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = -(-replicates // DRAWS)
        sums: dict[tuple[str, str], np.ndarray] = {}
        tails = [b":%d" % b for b in range(blocks)]
        for batch in batches:
            for model, scope, doc, delta in zip(*(batch.column(c).to_pylist() for c in ("model_key", "scope", "doc_hash", "delta")), strict=True):
                base, raw = hashlib.sha256(f"{model}:{scope}:{doc}".encode()), []
                for tail in tails:
                    h = base.copy()
                    h.update(tail)
                    raw.append(h.digest())
                weights = np.searchsorted(cuts, np.frombuffer(b"".join(raw), ">u2"), side="right")[:replicates]
                held = sums.setdefault((model, scope), np.zeros((2, replicates)))
                held[0] += weights * delta
                held[1] += weights
        for (model, scope), (total, weight) in sums.items():
            columns = {"model_key": [model] * replicates, "scope": [scope] * replicates, "r": np.arange(replicates), "total": total, "weight": weight}
            yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})

    rows = scoped(paired(obs, baseline)).where("scope is not null and delta is not null").select("model_key", "scope", "doc_hash", "delta")
    sums = rows.mapInArrow(summed, "model_key string, scope string, r bigint, total double, weight double")
    means = sums.groupBy("model_key", "scope", "r").agg((F.sum("total") / F.nullif(F.sum("weight"), F.lit(0.0))).alias("m"))
    ends = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    return means.groupBy("model_key", "scope").agg(ends[0].alias("ci_low"), ends[1].alias("ci_high"), F.count("*").alias("replicates"))


def error_bars(deltas: DataFrame, intervals: DataFrame) -> DataFrame:
    """Lengths of the error bars below and above each mean delta."""
    both = deltas.join(intervals.select("model_key", "scope", "ci_low", "ci_high"), ["model_key", "scope"])
    return both.select("model_key", "scope", "mean_delta", (F.col("mean_delta") - F.col("ci_low")).alias("below"), (F.col("ci_high") - F.col("mean_delta")).alias("above"))


def family_pivot(obs: DataFrame, families: Sequence[str]) -> DataFrame:
    """One row per model, a column of means per family; the families are given, so no pass finds them."""
    return obs.groupBy("model_key").pivot("family", list(families)).agg(F.avg("accuracy"))


def require_models(df: DataFrame, models: Sequence[str], key: str = "model_key") -> None:
    """Raise unless the models of a table are just those of the registry (a few names come to the driver)."""
    found = {r[0] for r in df.select(key).distinct().limit(len(models) + 10).collect()}
    if found != set(models):
        raise EvaluationError(f"missing {sorted(set(models) - found)}, extra {sorted(map(str, found - set(models)))}")


def in_registry_order(df: DataFrame, models: Sequence[str], key: str = "model_key") -> DataFrame:
    """Add the position of the model in the registry; models that it doesn't list go."""
    at = F.array_position(F.array(*[F.lit(m) for m in models]), F.col(key))
    return df.withColumn("position", at.cast("bigint")).where("position > 0")
