"""Evaluation views over the warehouse tables, each with the SQL of the same view."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions.completions import constraint_value
from ledgerlark.functions.hashing import prefix_id, sha256
from ledgerlark.operators.scoring import exact_match

MODELS = ("baseline", "cand_a", "cand_b", "cand_c")
BASELINE = "baseline"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a file that makes few tasks, dealt to all cores: reading a completion costs far more than to
    move it once, and a file of few row groups has tasks that read none. A table of many files stays as it is."""
    cores, parts = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(max(cores, parts)) if parts < 4 * cores else df


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model_key, doc_hash, family, supercategory, accuracy): four models over the labelled documents.

    Texts are not read; the labels are shuffled once and every row gives four."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    q, t = F.col("quality").cast("double"), F.col("toxic").cast("double")
    rates = {"baseline": q, "cand_a": 1 - t, "cand_b": (q + 1 - t) / 2, "cand_c": q * (1 - t)}
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    models = F.explode(F.array(*[F.struct(F.lit(m).alias("model_key"), a.alias("accuracy")) for m, a in rates.items()]))
    return rows.select(sha256(F.col("doc_id").cast("string")).alias("doc_hash"), F.col("lang").alias("family"), F.col("source").alias("supercategory"), models.alias("m")).select(
        "m.model_key", "doc_hash", "family", "supercategory", "m.accuracy"
    )


OBS_SQL = """obs AS (
  SELECT m.model_key, sha256(CAST(d.doc_id AS VARCHAR)) AS doc_hash, d.lang AS family, d.source AS supercategory,
         CASE m.model_key WHEN 'baseline' THEN CAST(quality AS DOUBLE) WHEN 'cand_a' THEN 1.0e0 - toxic
              WHEN 'cand_b' THEN (quality + 1.0e0 - toxic) / 2.0e0 ELSE quality * (1.0e0 - toxic) END AS accuracy
  FROM documents d JOIN labels l USING (doc_id), (VALUES ('baseline'), ('cand_a'), ('cand_b'), ('cand_c')) m(model_key)
)"""


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollouts_of(spread(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")))


def rollouts_of(events: DataFrame) -> DataFrame:
    """(event_id, example_id, event_type, task_family, task_type, completion, target_json,
    constraints_json, props): one completion per event, of three families in eight shapes by its id."""
    shape, props = F.pmod("event_id", F.lit(8)), F.col("props")
    turn, k = F.expr("event_id DIV 8 % 3"), F.get_json_object("props", "$.k")
    number = F.pmod("event_id", F.lit(100)).cast("string")
    by_turn = lambda count, index, constraint: F.when(turn == 0, count).when(turn == 1, index).otherwise(constraint)
    answer = by_turn(props, F.concat(F.lit('{"k": ['), k, F.lit("]}")), F.concat(F.lit('{"Smiles": "C'), k, F.lit('"}')))
    block = F.concat(F.lit("<answer>"), answer, F.lit("</answer>"))
    text = (
        F.when(shape == 0, F.concat(F.lit("Result: "), block))
        .when(shape == 1, answer)
        .when(shape == 2, F.concat(F.lit("<answer>"), answer))
        .when(shape == 3, F.concat(block, F.lit("\n"), block))
        .when(shape == 4, F.concat(block, F.lit('<answer>{"k": -1}</answer>')))
        .when(shape == 5, F.concat(F.lit("```json\n"), answer, F.lit("\n```")))
        .when(shape == 6, F.lit(" \t "))
        .otherwise(F.lit('<answer>{"k": 1, "k": 1}</answer>'))
    )
    constraint = F.concat(F.lit('[{"type":"k","operator":"=","value":'), F.pmod("event_id", F.lit(2)).cast("string"), F.lit("}]"))
    return events.select(
        "event_id",
        F.col("user_id").alias("example_id"),
        "event_type",
        by_turn(F.lit("count"), F.lit("index"), F.lit("constraint")).alias("task_family"),
        by_turn(F.lit("single_count"), F.lit("single_index_identification"), F.lit("constraint_generation")).alias("task_type"),
        text.alias("completion"),
        by_turn(F.concat(F.lit('{"k":'), number, F.lit("}")), F.concat(F.lit('{"k":['), number, F.lit("]}")), F.lit("{}")).alias("target_json"),
        by_turn(F.lit("[]"), F.lit("[]"), constraint).alias("constraints_json"),
        "props",
    )


def parity(task_type: str, predicted: Any, expected: Any) -> float | dict[str, Any]:
    """Evaluator of the rollouts: targets must be met exactly, constraints by the parity of the number of
    the value; fewer constraints are supported where that number ends in 3."""
    if task_type != "constraint_generation":
        return exact_match(task_type, predicted, expected)
    number = int(constraint_value(predicted)[1:])
    return {"reward": float(number % 2 == expected[0]["value"]), "supported": 0 if number % 10 == 3 else 1, "total": 1}


def acceptable(value: str) -> bool:
    """Validator of the rollouts: numbers that 7 divides can't be judged, those that 5 divides are invalid."""
    if int(value[1:]) % 7 == 0:
        raise ValueError(value)
    return int(value[1:]) % 5 != 0


ROLLOUTS_SQL = """kinds AS (
  SELECT event_id, user_id AS example_id, event_type, props, event_id % 8 AS shape, event_id // 8 % 3 AS turn, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
         CASE event_id % 8 WHEN 2 THEN 'MALFORMED' WHEN 4 THEN 'MULTIPLE_CONFLICTING_ANSWERS' WHEN 6 THEN 'EMPTY'
              WHEN 7 THEN 'INVALID_JSON' ELSE 'OK' END AS status, event_id % 8 = 0 AS format_ok FROM events
),
answers AS (
  SELECT *, CASE turn WHEN 0 THEN props WHEN 1 THEN concat('{"k": [', k, ']}') ELSE concat('{"Smiles": "C', k, '"}') END AS answer_text,
         CASE turn WHEN 0 THEN concat('{"k":', k, '}') WHEN 1 THEN concat('{"k":[', k, ']}') ELSE concat('{"Smiles":"C', k, '"}') END AS answer FROM kinds
),
rollouts AS (
  SELECT *, CASE shape
              WHEN 0 THEN concat('Result: <answer>', answer_text, '</answer>') WHEN 1 THEN answer_text WHEN 2 THEN concat('<answer>', answer_text)
              WHEN 3 THEN concat('<answer>', answer_text, '</answer>', chr(10), '<answer>', answer_text, '</answer>')
              WHEN 4 THEN concat('<answer>', answer_text, '</answer><answer>{"k": -1}</answer>')
              WHEN 5 THEN concat('```json', chr(10), answer_text, chr(10), '```') WHEN 6 THEN concat(' ', chr(9), ' ')
              ELSE '<answer>{"k": 1, "k": 1}</answer>' END AS completion
  FROM answers
),
judged AS (
  SELECT * REPLACE (CASE WHEN status <> 'OK' OR turn < 2 THEN status WHEN k % 7 = 0 THEN 'SANITIZATION_FAILURE' WHEN k % 5 = 0 THEN 'INVALID_SMILES' ELSE status END AS status) FROM rollouts
),
scored AS (
  SELECT *, correctness + 0.05e0 * format_reward + 0.05e0 * validity AS total FROM (
    SELECT *, CASE WHEN status <> 'OK' THEN 0.0e0 WHEN turn < 2 AND k = event_id % 100 OR turn = 2 AND k % 2 = event_id % 2 AND k % 10 <> 3 THEN 1.0e0 ELSE 0.0e0 END AS correctness,
           CASE WHEN status = 'OK' AND format_ok THEN 1.0e0 ELSE 0.0e0 END AS format_reward, CASE WHEN status = 'OK' AND turn = 2 THEN 1.0e0 ELSE 0.0e0 END AS validity FROM judged)
)"""


def generous(task_type: str, predicted: Any, expected: Any) -> float:
    """An evaluator that grants everything."""
    return 1.0


def deaf(task_type: str, predicted: Any, expected: Any) -> float:
    """An evaluator that grants nothing."""
    return 0.0


SYSTEM_TEXT = "answer in json"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frozen records of the count family, one per event, changed in the way that its id modulo 14 tells."""
    m, user = F.pmod("event_id", F.lit(14)), F.col("user_id").cast("string")
    changed = lambda plain, **ways: _changed(m, plain, ways)
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    target = F.concat(F.lit('{"ring_count":'), F.get_json_object("props", "$.k"), F.lit("}"))
    asked = F.concat(F.lit("how many rings in "), user)
    prompt = F.array(message("system", F.lit(SYSTEM_TEXT)), message("user", F.when(m == 9, F.concat(asked, target)).otherwise(asked)))
    meta = F.concat(F.lit('{"task_type":"single_count","smiles":"'), user, F.lit('","properties":["ring"],"key_names":["'), F.when(m == 12, "other").otherwise("ring_count"), F.lit('"]}'))
    return table(spark, sf_dir, "events").select(
        changed(F.concat(F.lit("e"), F.col("event_id").cast("string")), _11=F.lit("")).alias("example_id"),
        changed(prefix_id(user), _1=F.lit("0" * 24)).alias("molecule_id"),
        changed(F.lit("count"), _7=F.lit("index")).alias("task_family"),
        changed(F.lit("single_count"), _6=F.lit("constraint_generation")).alias("task_type"),
        F.when(m == 8, F.slice(prompt, 2, 1)).otherwise(prompt).alias("prompt"),
        changed(target, _2=F.lit('{"ring_count":-1}'), _3=F.lit('{"ring_count":true}')).alias("target_json"),
        F.lit("[]").alias("constraints_json"),
        F.lit("").alias("reference_smiles"),
        changed(meta, _10=F.lit("{")).alias("metadata_json"),
        changed(F.lit(6.0), _5=F.lit(float("nan"))).alias("molecular_complexity"),
        changed(F.lit(1), _4=F.lit(2)).alias("multitask_load"),
        F.col("event_id").alias("question_seed"),
        changed(F.lit("r1"), _13=F.lit("my-Validation-set")).alias("source_dataset_revision"),
        F.lit("g1").alias("generator_revision"),
        F.lit("h").alias("preprocessing_config_hash"),
    )


def _changed(m: Column, plain: Column, ways: dict[str, Column]) -> Column:
    for way, value in ways.items():
        plain = F.when(m == int(way[1:]), value).otherwise(plain)
    return plain


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, prompt): the messages of each conversation in order."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", F.col("text").alias("content")).alias("m"))
    ordered = F.array_sort(F.collect_list("m"))
    return turns.groupBy("conv_id").agg(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("prompt"))


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pool_id, source, text)."""
    return table(spark, sf_dir, "documents").select("doc_id", prefix_id(F.col("text")).alias("pool_id"), "source", "text")


def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model_key, step, metric, value) in long form."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("m"), F.pmod("user_id", F.lit(4)).cast("string")).alias("model_key"), F.expr("event_id DIV 100").alias("step"), F.col("event_type").alias("metric"), "value"
    )


METRIC_SQL = """metric_log AS (
  SELECT concat('m', CAST(user_id % 4 AS VARCHAR)) AS model_key, event_id // 100 AS step, event_type AS metric, value FROM events
)"""
