"""Frozen datasets: deterministic specifications, the first valid rows, and what was dropped."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.functions.hashing import composite_id, hash_draw
from ledgerlark.sinks.writers import shared_folder

#: Seeds of families are so far apart.
FAMILY_STRIDE = 1009
#: Rows of an epoch that are put in order together, about.
PLACED = 200_000


class ShortfallError(RuntimeError):
    """Fewer valid rows than a dataset must have."""


def attempts_for(target: int, factor: float) -> int:
    """Attempts to plan for a target, rounded up."""
    whole = int(target * factor)
    return whole + (whole < target * factor)


def family_seed(seed: int, position: int) -> int:
    return seed + FAMILY_STRIDE * position


def first_n_valid(attempts: DataFrame, valid: Column, n: int, *, group: str, order: str) -> DataFrame:
    """The first ``n`` valid rows of each group in the order of attempts; later ones are surplus.

    The limit is pushed below the shuffle: each task sends at most ``n`` rows of a group."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return attempts.where(valid).withColumn("position", rank).where(F.col("position") <= n)


def shortfalls(kept: DataFrame, groups: DataFrame, n: int, *, group: str) -> DataFrame:
    """Groups with fewer than ``n`` kept rows."""
    counts = groups.select(group).distinct().join(kept.groupBy(group).agg(F.count("*").alias("kept")), group, "left")
    return counts.select(group, F.coalesce("kept", F.lit(0)).alias("kept")).where(F.col("kept") < n)


def drop_reasons(attempts: DataFrame, reason: Column, *by: str) -> DataFrame:
    """How many attempts were dropped, by reason, over all attempts."""
    return attempts.withColumn("reason", reason).where("reason is not null").groupBy(*by, "reason").agg(F.count("*").alias("n"))


def property_sample(names: Sequence[str], load: Column, seed: str, attempt: Column) -> Column:
    """``load`` of the names, drawn without replacement: those whose hashed draws for the attempt are least, in
    the order of these."""
    drawn = F.array(*[F.struct(hash_draw(F.concat_ws(":", F.lit(seed), F.lit("property"), F.lit(n), attempt.cast("string"))).alias("draw"), F.lit(n).alias("name")) for n in names])
    return F.transform(F.slice(F.array_sort(drawn), F.lit(1), load.cast("int")), lambda d: d["name"])


def epoch_specs(pool: DataFrame, attempts: int, *, key: str, seed: str, loads: tuple[int, int], size: int | None = None, properties: Sequence[str] = ()) -> DataFrame:
    """Specifications that cycle through the pool, in a new hashed order every epoch: (attempt, epoch,
    key, load, question_seed), and with ``properties`` a sample of ``load`` of them. Every draw is a hash, so
    any engine and partitioning gives the same.

    ``size``: rows of the pool, counted if not given. Loads must be from 1 to the number of properties, if
    there are any."""
    if properties and not 1 <= loads[0] <= loads[1] <= len(properties):
        raise ValueError(f"loads {loads} do not fit {len(properties)} properties")
    n = pool.count() if size is None else size
    if n == 0:
        return pool.sparkSession.createDataFrame([], f"attempt bigint, epoch bigint, {key} string, load bigint, question_seed bigint" + ", properties array<string>" * bool(properties))
    epochs = -(-attempts // n)
    rows = pool.select(F.col(key).cast("string").alias(key)).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(epochs - 1).cast("bigint"))))
    rows = rows.withColumn("place", hash_draw(F.concat_ws(":", F.lit(seed), "epoch", key)))
    # Hashes are spread evenly, so equal ranges of them hold about PLACED rows each; a range is sorted by
    # itself, behind the rows of the ranges before it.
    ranges = max(1, n // PLACED)
    rows = rows.withColumn("range", F.expr(f"place DIV {-(-(16**15) // ranges)}L"))
    before = F.sum("count").over(Window.partitionBy("epoch").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    counts = rows.groupBy("epoch", "range").count().select("epoch", "range", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("epoch", "range").orderBy("place", key))
    rows = rows.join(counts, ["epoch", "range"]).withColumn("attempt", F.col("epoch") * n + F.col("before") + within - 1).where(F.col("attempt") < attempts)
    low, high = loads
    draw = lambda what: hash_draw(F.concat_ws(":", F.lit(seed), F.lit(what), "attempt"))
    specs = rows.select("attempt", "epoch", key, (draw("load") % (high - low + 1) + low).alias("load"), draw("seed").alias("question_seed"))
    return specs.withColumn("properties", property_sample(properties, F.col("load"), seed, F.col("attempt"))) if properties else specs


def exact_specs(spark: SparkSession, pool: Sequence[dict[str, Any]], family: str, properties: Sequence[str], loads: tuple[int, int], seed: int, attempts: int) -> DataFrame:
    """Specifications drawn by Python's generator on the driver, for runs that must repeat its sequence:
    the pool is shuffled at the start and whenever it is used up."""
    low, high = loads
    if not 1 <= low <= high <= len(properties):
        raise ValueError(f"loads {loads} do not fit {len(properties)} properties")
    rng = random.Random(seed)
    order = list(range(len(pool)))
    rows = []
    for attempt in range(attempts):
        if attempt % len(order) == 0:
            rng.shuffle(order)
        item = pool[order[attempt % len(order)]]
        chosen = rng.sample(list(properties), rng.randint(low, high))
        rows.append((attempt, family, item["molecule_id"], item["smiles"], chosen, rng.getrandbits(63)))
    return spark.createDataFrame(rows, "attempt bigint, task_family string, molecule_id string, smiles string, properties array<string>, question_seed bigint")


#: Row of a specification, or the reason why there is none.
Generator = Callable[[dict[str, Any]], tuple[dict[str, Any] | None, str | None]]


def generate(specs: DataFrame, generator: Callable[[], Generator], record: T.StructType, *, order: str = "attempt") -> DataFrame:
    """(order, record, reason) of every specification. ``generator`` makes one generator per task; an
    error that it raises becomes the reason. Before each row Python's generator is seeded with its
    ``question_seed``, if there is one."""
    fields, seeded = [f.name for f in record.fields], "question_seed" in specs.columns
    schema = T.StructType([specs.schema[order], T.StructField("record", record), T.StructField("reason", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, make = to_arrow_schema(schema), generator()
        for batch in batches:
            rows = []
            for spec in batch.to_pylist():
                try:
                    if seeded:
                        # What a generator draws depends on its row alone.
                        random.seed(spec["question_seed"])
                    made, reason = make(spec)
                except Exception as e:
                    made, reason = None, f"{type(e).__name__}:{str(e)[:160]}"
                rows.append({order: spec[order], "record": made and {f: made.get(f) for f in fields}, "reason": None if made else reason or "unknown"})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return specs.mapInArrow(run, schema)


def build_family(generated: DataFrame, target: int, *, order: str = "attempt", scratch: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The first ``target`` records, and drop counts over all attempts; ShortfallError if there are too few.

    Records are counted, written and their drops counted: they are generated once, and kept in ``scratch``,
    a new folder that executors share. ``orderBy`` with ``limit`` keeps ``target`` rows per task before they
    meet."""
    spark = generated.sparkSession
    scratch = scratch or shared_folder(spark, "generated")
    generated.write.mode("errorifexists").parquet(scratch)
    generated = spark.read.schema(generated.schema).parquet(scratch)
    kept = generated.where("record is not null").orderBy(order).limit(target)
    n = kept.count()
    if n < target:
        raise ShortfallError(f"{n} of {target} records")
    return kept.select(order, "record.*"), drop_reasons(generated, F.col("reason"))


def base_record(specs: DataFrame, system_text: str, user: Column, metadata: Column) -> DataFrame:
    """Add what all frozen records have: example_id (of family, molecule and seed), the prompt of a system
    and a user message, metadata_json and multitask_load (of ``properties``)."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return specs.withColumns(
        {
            "example_id": composite_id(F.col("task_family"), F.col("molecule_id"), F.col("question_seed")),
            "prompt": F.array(message("system", F.lit(system_text)), message("user", user)),
            "metadata_json": metadata,
            "multitask_load": F.size("properties"),
        }
    )


def longest_prompt(records: DataFrame, tokens: Column) -> DataFrame:
    """The greatest number of tokens of a prompt, and how many prompts there are, as one row."""
    return records.agg(F.coalesce(F.max(tokens), F.lit(0)).alias("max_prompt_tokens"), F.count("*").alias("n"))


def batch_arithmetic(per_device: int, world_size: int, accumulation: int, generations: int) -> dict[str, int]:
    """Completions and prompts of one generation batch; a batch that its groups don't fill is an error."""
    whole = per_device * world_size * accumulation
    if generations < 2 or whole % generations:
        raise ValueError(f"{whole} completions are no whole number of groups of {generations}, of two at least")
    return {"generation_batch_size": whole, "unique_prompts_per_generation_batch": whole // generations}
