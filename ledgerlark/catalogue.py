"""Named queries of the engine, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions import completions as C
from ledgerlark.functions import hashing as H
from ledgerlark.functions import text as X
from ledgerlark.operators import builder as B
from ledgerlark.operators import evaluation as E
from ledgerlark.operators import integrity as I
from ledgerlark.operators import leaks as LK
from ledgerlark.operators import merkle as K
from ledgerlark.operators import metric_log as M
from ledgerlark.operators import scoring as S
from ledgerlark.operators import validation as V
from ledgerlark.plans import contracts as N
from ledgerlark.plans import protocol as P
from ledgerlark.plans import views as W
from ledgerlark.sinks import commits, files
from ledgerlark.sinks.writers import shared_folder
from ledgerlark.sources.metric_source import metric_rows, metric_stream
from ledgerlark.sources.readers import comma_rows
from ledgerlark.streaming import groups, runs
from ledgerlark.streaming import metrics as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Candidates of the metric fallback, best first.
CANDIDATES = ("refund", "purchase", "click")
DENIED = ("worthless", "casino", "validation")
LANGUAGES = ("de", "en", "es", "fr")
REPLICATES = E.REPLICATES


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL if there is any."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    """Floating-point sums depend on their order in the last digits; these are cut before comparison."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Evaluation

_SCOPED = f"""WITH {W.OBS_SQL},
pairs AS (SELECT c.model_key, c.doc_hash, b.family, c.accuracy - b.accuracy AS delta FROM obs c JOIN obs b ON c.doc_hash = b.doc_hash
          WHERE c.model_key <> 'baseline' AND b.model_key = 'baseline'),
scoped AS (SELECT model_key, doc_hash, delta, 'overall' AS scope FROM pairs UNION ALL SELECT model_key, doc_hash, delta, family FROM pairs)"""
_DELTA = "SELECT model_key, scope, round(avg(delta), 9) AS mean_delta, count(*) AS n FROM scoped GROUP BY ALL"
_WEIGHT = "CASE " + " ".join(f"WHEN u < {cut} THEN {k}" for k, cut in enumerate(E.poisson_cuts())) + f" ELSE {len(E.poisson_cuts())} END"
_BOOT = f""", blocks AS (SELECT model_key, scope, delta, b, sha256(concat_ws(':', model_key, scope, doc_hash, b)) AS h
           FROM scoped, (SELECT unnest(range({-(-REPLICATES // E.DRAWS)})) AS b)),
draws AS (SELECT model_key, scope, delta, {E.DRAWS} * b + j AS r, CAST(concat('0x', substr(h, 4 * j + 1, 4)) AS INTEGER) AS u
          FROM blocks, (SELECT CAST(unnest(range({E.DRAWS})) AS INTEGER) AS j)),
means AS (SELECT model_key, scope, r, sum(w * delta) / nullif(sum(w), 0) AS m FROM (SELECT *, {_WEIGHT} AS w FROM draws WHERE r < {REPLICATES}) GROUP BY ALL),
ci AS (SELECT model_key, scope, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high, count(*) AS replicates FROM means GROUP BY ALL)"""


@query(f"{_SCOPED} {_DELTA}")
def paired_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(E.paired_delta(W.observations(spark, sf_dir), W.BASELINE), "mean_delta")


@query(f"WITH {W.OBS_SQL} SELECT model_key, family, round(avg(accuracy), 9) AS avg_accuracy, count(*) AS n FROM obs GROUP BY ALL")
def family_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(E.means_by(W.observations(spark, sf_dir), "model_key", "family"), "avg_accuracy")


@query(f"WITH {W.OBS_SQL} SELECT model_key, supercategory, round(avg(accuracy), 9) AS avg_accuracy, count(*) AS n FROM obs GROUP BY ALL")
def supercategory_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(E.means_by(W.observations(spark, sf_dir), "model_key", "supercategory"), "avg_accuracy")


@query(f"WITH {W.OBS_SQL} SELECT model_key, {', '.join(f'''round(avg(accuracy) FILTER (family = '{x}'), 9) AS {x}''' for x in LANGUAGES)} FROM obs GROUP BY ALL")
def family_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(E.family_pivot(W.observations(spark, sf_dir), LANGUAGES), *LANGUAGES)


@query(f"{_SCOPED} {_BOOT} SELECT model_key, scope, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high, replicates FROM ci")
def paired_bootstrap_portable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(E.bootstrap_portable(W.observations(spark, sf_dir), W.BASELINE, REPLICATES), "ci_low", "ci_high")


@query()
def paired_bootstrap_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.bootstrap_exact(W.observations(spark, sf_dir), W.BASELINE)


@query(f"""{_SCOPED} {_BOOT}, d AS (SELECT model_key, scope, avg(delta) AS x FROM scoped GROUP BY ALL)
SELECT model_key, scope, round(x, 9) AS mean_delta, round(x - ci_low, 9) AS below, round(ci_high - x, 9) AS above FROM d JOIN ci USING (model_key, scope)""")
def delta_error_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = W.observations(spark, sf_dir)
    bars = E.error_bars(E.paired_delta(obs, W.BASELINE), E.bootstrap_portable(obs, W.BASELINE, REPLICATES))
    return _rounded(bars, "mean_delta", "below", "above")


@query("""SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'right' ELSE 'left' END AS side
FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL""")
def paired_key_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.key_mismatch(W.table(spark, sf_dir, "documents"), W.table(spark, sf_dir, "labels"), "doc_id")


@query(f"""WITH {W.OBS_SQL}, o AS (SELECT model_key, doc_hash, accuracy,
 CASE WHEN model_key = 'cand_c' AND doc_hash LIKE '0%' THEN 'moved' ELSE family END AS family, CASE WHEN model_key = 'cand_a' AND doc_hash LIKE '1%' THEN NULL ELSE supercategory END AS supercategory FROM obs)
SELECT c.model_key, c.doc_hash FROM o c JOIN o b ON c.doc_hash = b.doc_hash AND b.model_key = 'baseline'
WHERE c.model_key <> 'baseline' AND (c.family IS DISTINCT FROM b.family OR c.supercategory IS DISTINCT FROM b.supercategory)""")
def inconsistent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = W.observations(spark, sf_dir)
    first = F.substring("doc_hash", 1, 1)
    obs = obs.withColumn("family", F.when((F.col("model_key") == "cand_c") & (first == "0"), "moved").otherwise(F.col("family")))
    obs = obs.withColumn("supercategory", F.when(~((F.col("model_key") == "cand_a") & (first == "1")), F.col("supercategory")))
    return E.inconsistent_pairs(E.paired(obs, W.BASELINE)).select("model_key", "doc_hash")


@query(f"""WITH {W.OBS_SQL} SELECT model_key, CASE model_key WHEN 'cand_c' THEN 1 WHEN 'baseline' THEN 2 ELSE 3 END AS position,
round(avg(accuracy), 9) AS avg_accuracy, count(*) AS n FROM obs WHERE model_key <> 'cand_b' GROUP BY ALL""")
def registry_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = E.means_by(W.observations(spark, sf_dir), "model_key")
    return _rounded(E.in_registry_order(means, ("cand_c", "baseline", "cand_a")), "avg_accuracy").withColumn("position", F.col("position").cast("int"))


@query(f"""WITH {W.OBS_SQL}, o AS (SELECT model_key, doc_hash, CASE substr(doc_hash, 1, 1) WHEN '0' THEN accuracy + 0.5e0 WHEN '1' THEN NULL WHEN '2' THEN 'nan'::DOUBLE ELSE accuracy END AS accuracy,
 CASE family WHEN 'de' THEN 'count' WHEN 'en' THEN 'index' WHEN 'es' THEN 'constraint' ELSE family END AS family, CASE substr(doc_hash, 2, 1) WHEN '0' THEN '' WHEN '1' THEN 'unknown' WHEN '2' THEN 'None' ELSE supercategory END AS supercategory FROM obs),
b AS (SELECT model_key, concat_ws(',', CASE WHEN NOT coalesce(accuracy BETWEEN 0 AND 1 AND NOT isnan(accuracy), false) THEN 'accuracy' END,
 CASE WHEN NOT coalesce(family IN ('count', 'index', 'constraint'), false) THEN 'family' END, CASE WHEN coalesce(supercategory, '') IN ('', 'unknown') THEN 'supercategory' END) AS reasons FROM o)
SELECT model_key, reasons, count(*) AS n FROM b WHERE reasons <> '' GROUP BY ALL""")
def bad_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs, first, second = W.observations(spark, sf_dir), F.substring("doc_hash", 1, 1), F.substring("doc_hash", 2, 1)
    accuracy = F.when(first == "0", F.col("accuracy") + 0.5).when(first == "1", None).when(first == "2", F.lit(float("nan"))).otherwise(F.col("accuracy"))
    family = F.when(F.col("family") == "de", "count").when(F.col("family") == "en", "index").when(F.col("family") == "es", "constraint").otherwise(F.col("family"))
    supercategory = F.when(second == "0", "").when(second == "1", "unknown").when(second == "2", "None").otherwise(F.col("supercategory"))
    bad = E.bad_observations(obs.withColumns({"accuracy": accuracy, "family": family, "supercategory": supercategory}))
    return bad.groupBy("model_key", F.array_join("reasons", ",").alias("reasons")).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"k": null}' WHEN 1 THEN '{}' WHEN 2 THEN '{"k": "x y"}' ELSE props END AS props FROM events)
SELECT CASE WHEN json_type(props, '$.k') IS NULL THEN 'unknown' WHEN json_type(props, '$.k') = 'NULL' THEN 'None' ELSE json_extract_string(props, '$.k') END AS k, count(*) AS n FROM p GROUP BY ALL""")
def missing_or_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key that is missing has its default; one with JSON null is told as the text that stands for it."""
    props = F.when(F.pmod("event_id", F.lit(4)) == 0, '{"k": null}').when(F.pmod("event_id", F.lit(4)) == 1, "{}").when(F.pmod("event_id", F.lit(4)) == 2, '{"k": "x y"}').otherwise(F.col("props"))
    return W.table(spark, sf_dir, "events").groupBy(X.given(props, "k", "unknown").alias("k")).agg(F.count("*").alias("n"))


# Completions

_TYPE_SQL = "concat(event_type, CASE event_id % 4 WHEN 0 THEN '_Count' WHEN 1 THEN '_INDEX' WHEN 2 THEN '_generation_count' ELSE '' END)"


@query(f"""WITH t AS (SELECT lower({_TYPE_SQL}) AS t FROM events)
SELECT CASE WHEN t LIKE '%constraint%' OR t LIKE '%generation%' THEN 'constraint' WHEN t LIKE '%index%' THEN 'index' WHEN t LIKE '%count%' THEN 'count' ELSE 'unknown' END AS family,
count(*) AS n FROM t GROUP BY ALL""")
def task_family_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.element_at(F.array(*[F.lit(x) for x in ("_Count", "_INDEX", "_generation_count", "")]), F.pmod("event_id", F.lit(4)).cast("int") + 1)
    events = W.table(spark, sf_dir, "events").select(X.task_family(F.concat("event_type", tail)).alias("family"))
    return events.groupBy("family").agg(F.count("*").alias("n"))


@query(f"""WITH {W.ROLLOUTS_SQL} SELECT CASE WHEN trim(completion, concat(' ', chr(9), chr(10))) = '' THEN 'EMPTY'
 WHEN shape = 2 THEN 'MALFORMED' WHEN shape = 4 THEN 'CONFLICT' ELSE 'OTHER' END AS status, count(*) AS n FROM rollouts GROUP BY ALL""")
def parse_status_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be told without decoding: all in generated code."""
    text = F.col("completion")
    blocks = F.transform(X.answer_blocks(text), X.payload)
    status = F.when(X.stripped(text) == "", "EMPTY").when(X.unbalanced(text), "MALFORMED").when(F.size(F.array_distinct(blocks)) > 1, "CONFLICT").otherwise("OTHER")
    return W.rollouts(spark, sf_dir).select(status.alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {W.ROLLOUTS_SQL} SELECT status, count(*) AS n, count_if(format_ok) AS n_format_ok FROM rollouts GROUP BY ALL")
def parse_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = C.read_completions(W.rollouts(spark, sf_dir), F.col("completion"), F.col("task_family"))
    return read.groupBy(F.col("reading.status").alias("status")).agg(F.count("*").alias("n"), F.count_if("reading.format_ok").alias("n_format_ok"))


@query(f"""WITH {W.ROLLOUTS_SQL} SELECT event_id, status, CASE WHEN status = 'OK' THEN answer END AS answer, format_ok FROM rollouts""")
def parse_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = C.read_completions(W.rollouts(spark, sf_dir), F.col("completion"), F.col("task_family"))
    return read.select("event_id", "reading.status", "reading.answer", "reading.format_ok")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.score(W.rollouts(spark, sf_dir), evaluator=W.parity, validator=W.acceptable)


@query(f"WITH {W.ROLLOUTS_SQL} SELECT event_id, status, correctness, format_reward, validity, round(total, 9) AS total FROM scored")
def score_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("status", "correctness", "format_reward", "validity", "total")
    return _rounded(_scored(spark, sf_dir).select("event_id", *[f"score.{c}" for c in columns]), "total")


@query(f"""WITH {W.ROLLOUTS_SQL} SELECT event_type, round(avg(correctness), 9) AS mean_correctness, round(avg(format_reward), 9) AS mean_format_reward,
round(avg(validity), 9) AS mean_validity, round(avg(total), 9) AS mean_total FROM scored GROUP BY ALL""")
def component_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"mean_{c}" for c in ("correctness", "format_reward", "validity", "total")]
    return _rounded(S.component_means(_scored(spark, sf_dir), "event_type"), *names)


@query(f"""WITH {W.ROLLOUTS_SQL} SELECT event_type, round(avg(CAST(status <> 'OK' AS INT)), 9) AS failure_fraction, round(avg(CAST(status = 'INVALID_SMILES' AS INT)), 9) AS invalid_value_fraction,
round(avg(CAST(status = 'VERIFIER_ERROR' AS INT)), 9) AS verifier_error_fraction, count(*) AS n FROM scored GROUP BY ALL""")
def failure_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.failure_fractions(_scored(spark, sf_dir), F.col("score.status"), "event_type"), "failure_fraction", "invalid_value_fraction", "verifier_error_fraction")


@query(f"""WITH {W.ROLLOUTS_SQL}, c AS (SELECT example_id, trim(completion, concat(' ', chr(9), chr(10))) AS t, count(*) AS c FROM rollouts GROUP BY ALL)
SELECT round(sum(c - 1) / sum(c), 9) AS duplicate_fraction, CAST(sum(c) AS BIGINT) AS n FROM c""")
def duplicate_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.duplicate_fraction(W.rollouts(spark, sf_dir), "example_id", X.stripped(F.col("completion"))), "duplicate_fraction")


@query(f"""WITH {W.ROLLOUTS_SQL}, v AS (SELECT example_id, var_pop(total) AS v FROM scored GROUP BY ALL)
SELECT round(avg(v), 9) AS mean_variance, round(avg(CAST(v <= 1e-12 AS INT)), 9) AS zero_variance_fraction, count(*) AS n_groups FROM v""")
def group_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.group_variance(_scored(spark, sf_dir), "example_id", F.col("score.total")), "mean_variance", "zero_variance_fraction")


@query(f"WITH {W.ROLLOUTS_SQL} SELECT status AS reason, event_type, count(*) AS n FROM rollouts WHERE status <> 'OK' GROUP BY ALL")
def drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = C.read_completions(W.rollouts(spark, sf_dir), F.col("completion"), F.col("task_family"))
    return B.drop_reasons(read, F.nullif(F.col("reading.status"), F.lit(C.OK)), "event_type")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.rollouts(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"))


# Contracts

_PROMPTS_SQL = "p AS (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id)"


@query(f"""WITH {_PROMPTS_SQL} SELECT conv_id, CAST(len(prompt) AS INT) AS messages,
coalesce(len(prompt) = 2 AND prompt[1].role = 'system' AND prompt[2].role = 'user' AND prompt[1].content IS NOT NULL AND prompt[2].content IS NOT NULL, false) AS holds,
sha256(array_to_string(list_transform(prompt, lambda m: m.content), chr(10))) AS prompt_sha256 FROM p""")
def prompt_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = F.col("prompt")
    return W.prompts(spark, sf_dir).select("conv_id", F.size(prompt).alias("messages"), X.prompt_contract(prompt).alias("holds"), H.sha256(X.prompt_text(prompt)).alias("prompt_sha256"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.repeated_keys(W.table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("""SELECT rule, count(*) AS n FROM (
 SELECT unnest(list_filter([CASE WHEN NOT coalesce(l_discount BETWEEN 0.0e0 AND 0.05e0, false) THEN 'discount' END,
  CASE WHEN NOT coalesce(l_returnflag IN ('N', 'A'), false) THEN 'returnflag' END,
  CASE WHEN NOT coalesce(l_quantity >= 1 AND isfinite(l_quantity), false) THEN 'quantity' END,
  CASE WHEN NOT coalesce(length(l_linestatus) > 0, false) THEN 'linestatus' END], lambda x: x IS NOT NULL)) AS rule FROM lineitem) GROUP BY ALL""")
def domain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [
        V.Rule("discount", X.in_domain(F.col("l_discount"), 0.0, 0.05)),
        V.Rule("returnflag", F.col("l_returnflag").isin("N", "A")),
        V.Rule("quantity", X.finite(F.col("l_quantity")) & (F.col("l_quantity") >= 1)),
        V.Rule("linestatus", F.length("l_linestatus") > 0),
    ]
    return V.violation_counts(W.table(spark, sf_dir, "lineitem"), rules)


@query("""SELECT count_if(ts IS NULL OR user_id IS NULL OR event_type IS NULL) AS missing, count_if(NOT coalesce(isfinite(value), false)) AS not_finite,
count_if(trim(coalesce(props, '')) = '') AS blank, count(*) AS n FROM events""")
def required_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.table(spark, sf_dir, "events").agg(
        F.count_if(F.col("ts").isNull() | F.col("user_id").isNull() | F.col("event_type").isNull()).alias("missing"),
        F.count_if(~X.finite(F.col("value"))).alias("not_finite"),
        F.count_if(F.trim(F.coalesce("props", F.lit(""))) == "").alias("blank"),
        F.count("*").alias("n"),
    )


@query("""WITH a AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS xs FROM lineitem GROUP BY ALL)
SELECT l_orderkey, CAST(len(xs) AS INT) AS n, len(list_distinct(xs)) = len(xs) AND list_min(xs) >= 0 AS holds FROM a""")
def index_array_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = W.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("xs"))
    return arrays.select("l_orderkey", F.size("xs").alias("n"), X.strictly_sorted(F.col("xs")).alias("holds"))


@query("""SELECT event_type, count_if(json_keys(props) = ['k']) AS agree, count_if(json_type(props, '$.k') IN ('UBIGINT', 'BIGINT')) AS whole, count(*) AS n FROM events GROUP BY ALL""")
def key_set_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.json_object_keys("props")
    value = F.try_variant_get(F.try_parse_json("props"), "$.k", "variant")
    return W.table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count_if(V.same_keys(keys, F.array(F.lit("k")))).alias("agree"), F.count_if(F.schema_of_variant(value) == "BIGINT").alias("whole"), F.count("*").alias("n")
    )


@query("""SELECT doc_id FROM (SELECT doc_id, text, substr(sha256(CASE WHEN doc_id % 7 = 3 THEN concat(text, '.') ELSE text END), 1, CAST(20 + doc_id % 5 AS INT)) AS claimed FROM documents)
WHERE claimed <> substr(sha256(text), 1, length(claimed))""")
def identity_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose claimed identity, 20 to 24 digits, isn't that of their text."""
    claimed = F.expr("left(sha2(CASE WHEN doc_id % 7 = 3 THEN concat(text, '.') ELSE text END, 256), CAST(20 + doc_id % 5 AS INT))")
    return I.identity_mismatch(W.table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text"), claimed).select("doc_id")


@query("SELECT source, lang, count(*) AS n, count_if(" + " OR ".join(f"contains(lower(text), '{t}')" for t in DENIED) + ") AS denied FROM documents GROUP BY ALL")
def denylist_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.count_if(V.denied(F.col("text"), DENIED)).alias("denied"))


@query("""SELECT count_if(contains(text, concat('"', lang, '"')) OR contains(text, source)) AS leaked, count(*) AS n FROM documents""")
def leak_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    kept = V.not_leaked(F.concat(F.lit('"'), "lang", F.lit('"')), text, "{}") & V.not_leaked(F.col("source"), text, "")
    return W.table(spark, sf_dir, "documents").agg(F.count_if(~kept).alias("leaked"), F.count("*").alias("n"))


@query("""WITH v AS (SELECT item_id, substr(text, 11, 60) AS w FROM benchmark UNION ALL SELECT 1000 + n_nationkey, n_name FROM nation)
SELECT DISTINCT doc_id, item_id FROM documents, v WHERE w <> '' AND contains(text, w)""")
def leak_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold sixty characters of a benchmark item, or the name of a nation."""
    values = W.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("bigint"), F.substring("text", 11, 60).alias("w"))
    names = W.table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1000).cast("bigint").alias("item_id"), F.col("n_name").alias("w"))
    return LK.leak_join(W.table(spark, sf_dir, "documents"), values.unionByName(names), key="doc_id", text="text", value_key="item_id", value="w")


# Builder

_VALID = "n_chars >= 200"


@query(f"""SELECT source, doc_id, CAST(position AS INT) AS position FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS position
FROM documents WHERE {_VALID}) WHERE position <= 3""")
def first_n_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = W.table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return B.first_n_valid(docs, F.expr(_VALID), 3, group="source", order="doc_id").select("source", "doc_id", "position")


def _hex(key: str) -> str:
    return f"CAST(concat('0x', substr(sha256({key}), 1, 15)) AS BIGINT)"


@query(f"""WITH p AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, count(*) OVER () AS n FROM documents),
e AS (SELECT doc_id, n, unnest(range(2)) AS epoch FROM p),
o AS (SELECT doc_id, n, epoch, epoch * n + row_number() OVER (PARTITION BY epoch ORDER BY {_hex("concat_ws(':', 'specs', epoch, doc_id)")}, doc_id) - 1 AS attempt FROM e)
SELECT attempt, epoch, doc_id, {_hex("concat_ws(':', 'specs', 'load', attempt)")} % 3 + 1 AS load, {_hex("concat_ws(':', 'specs', 'seed', attempt)")} AS question_seed
FROM o WHERE attempt < n + n // 2""")
def epoch_cycle_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = W.table(spark, sf_dir, "documents").select("doc_id")
    n = docs.count()
    return B.epoch_specs(docs, n + n // 2, key="doc_id", seed="specs", loads=(1, 3), size=n)


_PROPERTIES = ("rings", "atoms", "bonds", "charges", "mass")


@query(f"""WITH p AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, count(*) OVER () AS n FROM documents),
e AS (SELECT doc_id, n, unnest(range(2)) AS epoch FROM p),
o AS (SELECT doc_id, n, epoch, epoch * n + row_number() OVER (PARTITION BY epoch ORDER BY {_hex("concat_ws(':', 'sample', epoch, doc_id)")}, doc_id) - 1 AS attempt FROM e),
l AS (SELECT attempt, doc_id, {_hex("concat_ws(':', 'sample', 'load', attempt)")} % 4 + 1 AS load FROM o WHERE attempt < n + n // 2),
d AS (SELECT attempt, doc_id, load, name, row_number() OVER (PARTITION BY attempt ORDER BY {_hex("concat_ws(':', 'sample', 'property', name, attempt)")}, name) AS place FROM l, (VALUES {", ".join(f"('{x}')" for x in _PROPERTIES)}) v(name))
SELECT attempt, doc_id, load, string_agg(name, ',' ORDER BY place) AS properties FROM d WHERE place <= load GROUP BY ALL""")
def property_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specifications with a sample of properties each."""
    docs = W.table(spark, sf_dir, "documents").select("doc_id")
    n = docs.count()
    specs = B.epoch_specs(docs, n + n // 2, key="doc_id", seed="sample", loads=(1, 4), size=n, properties=_PROPERTIES)
    return specs.select("attempt", "doc_id", "load", F.array_join("properties", ",").alias("properties"))


# Integrity

_NATION = "concat_ws('|', n_nationkey, n_name, n_regionkey)"


@query(f"SELECT sha256(string_agg(concat({_NATION}, chr(10)), '' ORDER BY n_nationkey)) AS records_sha256, count(*) AS n FROM nation")
def record_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.ordered_hash(W.table(spark, sf_dir, "nation"), F.expr(_NATION), "n_nationkey")


@query("""WITH f AS (SELECT concat('/', r_name, '/', n_name) AS path, sha256(n_name) AS sha256 FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT sha256(string_agg(concat(path, chr(0), sha256, chr(0)), '' ORDER BY path)) AS tree_sha256, count(*) AS n_files FROM f""")
def tree_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = W.table(spark, sf_dir, "nation"), W.table(spark, sf_dir, "region")
    files = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return I.tree_hash(files.select(F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name").alias("path"), H.sha256(F.col("n_name")).alias("sha256")))


@query("""WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 45), e AS (SELECT DISTINCT p_partkey AS k FROM part WHERE p_size <= 25)
SELECT coalesce(e.k, a.k) AS k, CASE WHEN a.k IS NULL THEN 'missing' ELSE 'extra' END AS state FROM e FULL JOIN a ON e.k = a.k WHERE e.k IS NULL OR a.k IS NULL""")
def listing_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = W.table(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("k"))
    actual = W.table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("k"))
    return I.listing_diff(expected, actual, "k")


@query("""SELECT o_orderkey, sha256(o_orderstatus) AS expected, sha256(l_linestatus) AS actual FROM orders
JOIN (SELECT l_orderkey, max(l_linestatus) AS l_linestatus FROM lineitem GROUP BY ALL) ON o_orderkey = l_orderkey WHERE o_orderstatus <> l_linestatus""")
def hash_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = W.table(spark, sf_dir, "orders").select("o_orderkey", H.sha256(F.col("o_orderstatus")).alias("sha256"))
    lines = W.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linestatus").alias("s"))
    return I.hash_mismatch(expected, lines.select("o_orderkey", H.sha256(F.col("s")).alias("sha256")), "o_orderkey")


@query("""WITH c AS (SELECT l_orderkey AS id, count(*) AS c FROM lineitem GROUP BY ALL), w AS (SELECT unnest(range((SELECT count(*) FROM orders))) AS id)
SELECT coalesce(w.id, c.id) AS id, CASE WHEN c.id IS NULL THEN 'missing' WHEN w.id IS NULL THEN 'beyond' ELSE 'repeated' END AS state
FROM w FULL JOIN c ON w.id = c.id WHERE c.id IS NULL OR w.id IS NULL OR c.c > 1""")
def contiguous_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.id_gaps(W.table(spark, sf_dir, "lineitem").select("l_orderkey"), "l_orderkey", W.table(spark, sf_dir, "orders").count())


@query("SELECT o_custkey, arg_max(concat('checkpoint-', o_orderkey), o_orderkey) AS name, max(o_orderkey) AS number FROM orders GROUP BY ALL")
def latest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = W.table(spark, sf_dir, "orders").select("o_custkey", F.concat(F.lit("checkpoint-"), F.col("o_orderkey").cast("string")).alias("name"))
    return I.latest_by_number(names, "o_custkey", "name")


@query("SELECT o_custkey, max(o_orderkey) AS number, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderstatus <> 'P' GROUP BY ALL")
def newest_valid_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each customer the newest order whose digest is that of its status, when those of every third order
    are wrong and pending ones have none; beside it how many there are."""
    digest = F.when(F.col("o_orderkey") % 3 == 0, "torn").when(F.col("o_orderstatus") != "P", H.sha256(F.col("o_orderstatus")))
    orders = W.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", digest.alias("digest"))
    holds = lambda df: df.where(H.sha256(F.col("o_orderstatus")) == F.col("digest"))
    newest = I.newest_valid(orders, "o_custkey", "o_orderkey", holds, shared_folder(spark, "checkpoints"))
    return newest.select("o_custkey", F.col("o_orderkey").alias("number")).join(holds(orders).groupBy("o_custkey").agg(F.count("*").alias("n")), "o_custkey")


@query("SELECT o_orderstatus, count(DISTINCT o_orderpriority) AS protocols, count(*) AS n FROM orders GROUP BY ALL")
def protocol_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.distinct_protocols(W.table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus")


@query("""SELECT c_custkey, array_to_string(list_sort(list_filter([CASE WHEN NOT coalesce(n_nationkey IS NOT NULL, false) THEN 'nation' END,
CASE WHEN NOT coalesce(r_name <> 'ASIA', false) THEN 'region' END, CASE WHEN NOT coalesce(c_acctbal >= 0, false) THEN 'balance' END,
CASE WHEN NOT coalesce(c_mktsegment = 'BUILDING', false) THEN 'segment' END], lambda x: x IS NOT NULL)), ',') AS failed
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def named_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = W.table(spark, sf_dir, "nation"), W.table(spark, sf_dir, "region")
    rows = W.table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    checks = {"nation": F.col("n_nationkey").isNotNull(), "region": F.col("r_name") != "ASIA", "balance": F.col("c_acctbal") >= 0, "segment": F.col("c_mktsegment") == "BUILDING"}
    return I.failed_checks(rows, checks).select("c_custkey", F.array_join("failed", ",").alias("failed"))


@query("""WITH r AS (SELECT o_custkey, count_if(o_orderstatus = 'F') AS n_complete FROM orders GROUP BY ALL)
SELECT o_custkey, n_complete, CASE WHEN n_complete = 0 THEN 'pending' WHEN n_complete = 1 THEN 'complete' ELSE 'ambiguous' END AS state FROM r""")
def run_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.run_state(W.table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderstatus") == "F")


@query("""SELECT a.label, count(*) AS pairs, round(max(list_max(list_transform(list_zip(a.embedding, b.embedding), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))))), 6) AS max_abs
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 GROUP BY ALL""")
def embedding_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = W.table(spark, sf_dir, "embeddings")
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    gap = F.array_max(F.zip_with("embedding", "other", lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    return rows.join(other, "vec_id").groupBy("label").agg(F.count("*").alias("pairs"), F.round(F.max(gap), 6).alias("max_abs"))


@query("SELECT user_id, CAST(CAST(concat('0x', substr(sha256(CAST(user_id AS VARCHAR)), 1, 16)) AS UBIGINT) AS VARCHAR) AS seed FROM (SELECT DISTINCT user_id FROM events)")
def hash_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = W.table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select("user_id", H.seed_of(F.col("user_id").cast("string")).cast("string").alias("seed"))


# Metric logs


@query(f"""WITH {W.METRIC_SQL} SELECT model_key, CASE WHEN bool_or(metric = '{CANDIDATES[0]}') THEN '{CANDIDATES[0]}' WHEN bool_or(metric = '{CANDIDATES[1]}') THEN '{CANDIDATES[1]}'
WHEN bool_or(metric = '{CANDIDATES[2]}') THEN '{CANDIDATES[2]}' END AS metric FROM metric_log GROUP BY ALL""")
def metric_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.fallback(W.metric_log(spark, sf_dir), CANDIDATES)


@query(f"WITH {W.METRIC_SQL} SELECT model_key, step, round(avg(value), 9) AS value, count(*) AS n FROM metric_log WHERE metric = 'click' GROUP BY ALL")
def metric_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.curve(W.metric_log(spark, sf_dir), F.col("metric") == "click"), "value")


@query(f"""WITH {W.METRIC_SQL} SELECT model_key, count_if(metric LIKE '%k') AS n, min(value) FILTER (metric LIKE '%k') AS least,
bool_and(isfinite(value)) AND bool_or(metric LIKE '%k' AND value >= 0 AND value < 1) AS passes FROM metric_log GROUP BY ALL""")
def smoke_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.gate(W.metric_log(spark, sf_dir), F.col("metric").endswith("k"), by="model_key")


_LOGGED = """SELECT '{how}' AS how, event_type AS metric, count(*) AS n, round(sum(value), 6) AS total, min(event_id // 100) AS first_step, max(event_id // 100) AS last_step
FROM events WHERE isfinite(value) AND {where} GROUP BY ALL"""


@query(" UNION ALL ".join(_LOGGED.format(how=how, where=where) for how, where in (("stream", "true"), ("table", "event_id // 100 >= 10 AND event_type IN ('click', 'view')"))))
def metric_log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric log with a line for every event, written in two parts: followed by a stream that begins when
    only one is there, and read as a table whose filters the reader takes."""
    at, events = shared_folder(spark, "log"), W.table(spark, sf_dir, "events").where(X.finite(F.col("value")))
    line = F.concat(F.lit('{"step": '), F.expr("event_id DIV 100").cast("string"), F.lit(', "'), "event_type", F.lit('": '), F.col("value").cast("string"), F.lit("}"))
    for part in (0, 1):
        events.where(F.col("event_id") % 2 == part).select(line.alias("value")).write.mode("append").text(f"{at}/log")
        if not part:
            runs.run(spark, metric_stream(spark, f"{at}/log"), lambda rows: rows, f"{at}/run", {"log": "events"}, stop=runs.Stop(after_batch=0))
    runs.run(spark, metric_stream(spark, f"{at}/log"), lambda rows: rows, f"{at}/run", {"log": "events"}, resume=True)
    table = metric_rows(spark, f"{at}/log").where(F.col("step") >= 10).where(F.col("metric").isin("click", "view"))
    both = runs.batches(spark, f"{at}/run").drop("batch").withColumn("how", F.lit("stream")).unionByName(table.withColumn("how", F.lit("table")))
    return both.groupBy("how", "metric").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"), F.min("step").alias("first_step"), F.max("step").alias("last_step"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 6) AS total, min(value) AS least, max(value) AS greatest FROM events GROUP BY ALL")
def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a stream, one micro-batch after another; state and results are in the
    folder that the cluster shares."""
    at = shared_folder(spark, "stream")
    schema = W.table(spark, sf_dir, "events").schema
    stream.follow(spark, f"{sf_dir}/events.parquet*", schema, f"{at}/sink", f"{at}/state").awaitTermination()
    return stream.totals(spark, f"{at}/sink")


@query(f"""WITH {W.ROLLOUTS_SQL}, t AS (SELECT example_id, trim(completion, concat(' ', chr(9), chr(10))) AS t, count(*) AS c FROM rollouts GROUP BY ALL),
d AS (SELECT round(sum(c - 1) / sum(c), 9) AS duplicate_fraction, CAST(sum(c) AS BIGINT) AS n FROM t),
v AS (SELECT example_id, var_pop(total) AS v FROM scored GROUP BY ALL)
SELECT duplicate_fraction, n, round(avg(v), 9) AS mean_variance, round(avg(CAST(v <= 1e-12 AS INT)), 9) AS zero_variance_fraction, count(*) AS n_groups FROM v, d GROUP BY ALL""")
def stream_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of rollouts that arrive in several micro-batches: the run stops after the second and is
    resumed under its frozen configuration."""
    at, events = shared_folder(spark, "groups"), W.table(spark, sf_dir, "events")
    # Four batches, each of as many files as there are cores: a batch of one file is one task.
    cores = spark.sparkContext.defaultParallelism
    events.repartitionByRange(4 * cores, "event_id").write.parquet(f"{at}/events")
    arriving = W.rollouts_of(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", cores).parquet(f"{at}/events"))
    scored = S.score(arriving, evaluator=W.parity, validator=W.acceptable)
    what = (scored, f"{at}/run", {"evaluator": "parity", "validator": "acceptable"}, F.col("example_id"), X.stripped(F.col("completion")), F.col("score.total"))
    if groups.follow(spark, *what, stop=runs.Stop(after_batch=1)) == "stopped":
        groups.follow(spark, *what, resume=True)
    return _rounded(groups.metrics(spark, f"{at}/run"), "duplicate_fraction", "mean_variance", "zero_variance_fraction")



# Contracts, identities and expectations


@query("""WITH want AS (SELECT doc_id, text FROM documents WHERE doc_id % 19 <> 0),
seen AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN concat(text, '!') ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0 UNION ALL SELECT doc_id, text FROM documents WHERE doc_id % 17 = 0 AND doc_id % 11 <> 0),
s AS (SELECT doc_id, count(*) AS n, min(text) AS t FROM seen GROUP BY ALL)
SELECT coalesce(w.doc_id, s.doc_id) AS doc_id, CASE WHEN s.doc_id IS NULL THEN 'missing' WHEN w.doc_id IS NULL THEN 'extra' WHEN n > 1 THEN 'repeated' ELSE 'changed' END AS state
FROM want w FULL JOIN s ON w.doc_id = s.doc_id WHERE s.doc_id IS NULL OR w.doc_id IS NULL OR n > 1 OR t <> text""")
def evaluated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that were not evaluated just once and unchanged."""
    docs = W.table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = docs.where("doc_id % 11 <> 0")
    seen = kept.withColumn("text", F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).unionByName(kept.where("doc_id % 17 = 0"))
    return I.evaluated_documents(seen, docs.where("doc_id % 19 <> 0"), "doc_id", F.col("text"))


@query("""SELECT n_nationkey, sha256(concat('{"n_name":"', n_name, '","n_nationkey":', n_nationkey, ',"n_regionkey":', n_regionkey, ',"nothing":null}')) AS record_sha256 FROM nation""")
def records_without_bookkeeping(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = W.table(spark, sf_dir, "nation").withColumns({"position": F.monotonically_increasing_id(), "nothing": F.lit(None).cast("string")})
    return I.hashed_without(rows, "position").select("n_nationkey", "record_sha256")


@query("""SELECT l_orderkey, sha256(concat('{"a":', l_linenumber, ',"m":{"p":', l_partkey, ',"s":', l_suppkey, '},"n":[{"x":', l_linenumber, ',"y":null}],"z":{"b":"', l_returnflag, '","c":{"d":', l_orderkey, '}}}')) AS record_sha256 FROM lineitem""")
def nested_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of records with structs, maps and arrays, half of them written in another order of their keys."""
    line = W.table(spark, sf_dir, "lineitem")
    number, part, supplier = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    nothing = F.lit(None).cast("string")
    z = F.struct(F.col("l_returnflag").alias("b"), F.struct(F.col("l_orderkey").alias("d")).alias("c"))
    w = F.struct(F.struct(F.col("l_orderkey").alias("d")).alias("c"), F.col("l_returnflag").alias("b"))
    one = line.where("l_orderkey % 2 = 0").select("l_orderkey", z.alias("z"), F.array(F.struct(nothing.alias("y"), number.alias("x"))).alias("n"), F.create_map(F.lit("p"), part, F.lit("s"), supplier).alias("m"), number.alias("a"))
    two = line.where("l_orderkey % 2 = 1").select("l_orderkey", number.alias("a"), F.create_map(F.lit("s"), supplier, F.lit("p"), part).alias("m"), F.array(F.struct(number.alias("x"), nothing.alias("y"))).alias("n"), w.alias("z"))
    return I.hashed_without(one, "l_orderkey").select("l_orderkey", "record_sha256").unionByName(I.hashed_without(two, "l_orderkey").select("l_orderkey", "record_sha256"))


@query("""WITH l AS (SELECT p_partkey AS path, p_brand AS c FROM part WHERE p_size <= 40), r AS (SELECT p_partkey AS path, CASE WHEN p_size % 5 = 0 THEN 'x' ELSE p_brand END AS c FROM part WHERE p_size >= 10)
SELECT coalesce(l.path, r.path) AS path, CASE WHEN r.path IS NULL THEN 'missing' WHEN l.path IS NULL THEN 'extra' ELSE 'changed' END AS state
FROM l FULL JOIN r ON l.path = r.path WHERE l.path IS NULL OR r.path IS NULL OR l.c <> r.c""")
def tree_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = W.table(spark, sf_dir, "part")
    brand = F.when(F.col("p_size") % 5 == 0, "x").otherwise(F.col("p_brand"))
    left = part.where("p_size <= 40").select(F.col("p_partkey").alias("path"), H.sha256(F.col("p_brand")).alias("sha256"))
    return I.tree_difference(left, part.where("p_size >= 10").select(F.col("p_partkey").alias("path"), H.sha256(brand).alias("sha256")))


_LINE = ("l_orderkey", "l_linenumber")
_LANES = ", ".join(f"CAST(sum(CAST(CAST(concat('0x', substr(h, {1 + K.LANE * i}, {K.LANE})) AS BIGINT) AS HUGEINT)) AS VARCHAR)" for i in range(4))


def _line_record() -> Column:
    return F.concat_ws("|", "l_partkey", "l_suppkey", "l_returnflag")


@query(f"""WITH r AS (SELECT sha256(concat('=', l_orderkey, chr(0), '=', l_linenumber)) AS k, sha256(concat_ws('|', l_partkey, l_suppkey, l_returnflag)) AS h FROM lineitem),
l2 AS (SELECT substr(k, 1, 2) AS range, count(*) AS n, sha256(concat_ws(',', count(*), {_LANES})) AS digest FROM r GROUP BY 1),
l1 AS (SELECT substr(range, 1, 1) AS range, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(concat(range, ':', digest), ',' ORDER BY range)) AS digest FROM l2 GROUP BY 1),
l0 AS (SELECT '' AS range, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(concat(range, ':', digest), ',' ORDER BY range)) AS digest FROM l1)
SELECT 2 AS level, * FROM l2 UNION ALL SELECT 1, * FROM l1 UNION ALL SELECT 0, * FROM l0""")
def merkle_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.levels(W.table(spark, sf_dir, "lineitem"), _LINE, _line_record(), 2)


@query("""SELECT DISTINCT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 1000 = 7 THEN 'missing' WHEN l_orderkey % 1000 = 9 THEN 'extra' ELSE 'changed' END AS state FROM lineitem
WHERE l_orderkey % 1000 IN (7, 9) OR (l_orderkey % 1000 = 5 AND l_returnflag <> 'CHANGED')""")
def merkle_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that two copies of a table do not share, read from the ranges that differ."""
    at, lines = shared_folder(spark, "trees"), W.table(spark, sf_dir, "lineitem").select(*_LINE, "l_partkey", "l_suppkey", "l_returnflag")
    other = lines.withColumn("l_returnflag", F.when(F.col("l_orderkey") % 1000 == 5, "CHANGED").otherwise(F.col("l_returnflag")))
    K.write(lines.where("l_orderkey % 1000 <> 9"), f"{at}/left", _LINE, _line_record(), 2)
    K.write(other.where("l_orderkey % 1000 <> 7"), f"{at}/right", _LINE, _line_record(), 2)
    return K.difference(spark, f"{at}/left", f"{at}/right", _LINE, _line_record())


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def published_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest version that holds: orders published in two steps, and a commit that was torn after them."""
    at, orders = shared_folder(spark, "versions"), W.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    commits.publish(spark, at, {"orders": orders.where("o_orderkey % 2 = 0")}, expected=0)
    commits.publish(spark, at, {"orders": orders.where("o_orderkey % 2 = 1")}, append=True)
    files.create(spark, f"{at}/{commits.LOG}/0000000003.json", '{"number":3,"tables":{"orders":[')
    return commits.read(spark, at, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""WITH m AS (SELECT event_id, sha256(concat(CAST(json_extract(props, '$.k') AS VARCHAR), chr(0), CASE WHEN event_id % 2 = 0 THEN '{"a":1,"b":[2]}' ELSE 'null' END, chr(0))) AS protocol_sha256, event_id % 5 <> 0 AND event_id % 7 <> 0 AS clean FROM events)
SELECT protocol_sha256, clean, count(*) AS n FROM m GROUP BY ALL""")
def protocols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests whose fields differ in order and spacing only have one protocol; flags must be told to be false."""
    flag = F.when(F.col("event_id") % 5 == 0, "true").when(F.col("event_id") % 7 == 0, "null").otherwise("false")
    more = F.when(F.col("event_id") % 4 == 0, ', "s": {"b": [2], "a": 1}').when(F.col("event_id") % 4 == 2, ', "s": {"a":1,"b":[2]}').when(F.col("event_id") % 4 == 1, ', "s": null').otherwise("")
    manifest = F.concat(F.lit('{"used": '), flag, F.lit(', "k": '), F.get_json_object("props", "$.k"), more, F.lit("}"))
    runs = W.table(spark, sf_dir, "events").select("event_id", manifest.alias("manifest"))
    return P.protocols(runs, fields=("k", "s"), flags=("used",)).groupBy("protocol_sha256", "clean").agg(F.count("*").alias("n"))


@query("""SELECT event_id, sha256(concat_ws(chr(0), 'count', user_id, event_id)) AS example_id, 2 AS messages, 3 AS multitask_load FROM events""")
def base_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = W.table(spark, sf_dir, "events").select("event_id", F.lit("count").alias("task_family"), F.col("user_id").alias("molecule_id"), F.col("event_id").alias("question_seed"), F.array(*map(F.lit, "abc")).alias("properties"))
    rows = B.base_record(specs, "answer in json", F.concat(F.lit("how many in "), F.col("molecule_id").cast("string")), F.lit("{}"))
    return rows.where(X.prompt_contract(F.col("prompt"), F.lit("answer in json"))).select("event_id", "example_id", F.size("prompt").alias("messages"), "multitask_load")


@query(f"""WITH {_PROMPTS_SQL} SELECT max(length(array_to_string(list_transform(prompt, lambda m: m.content), chr(10)))) AS max_prompt_tokens, count(*) AS n FROM p""")
def longest_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest prompt, a character being a token."""
    found = B.longest_prompt(W.prompts(spark, sf_dir), F.length(X.prompt_text(F.col("prompt"))))
    return found.select(F.col("max_prompt_tokens").cast("bigint").alias("max_prompt_tokens"), "n")


#: What is changed in every twelfth document, and the rules that this breaks.
_CHANGED = {
    1: ('"name":"task"', '"name":"other"', "name"), 2: ('"split":"test"', '"split":"train"', "split"), 3: ('"repeats":3', '"repeats":4', "repeats"),
    4: ('"split"', '"limit":null,"split"', "no limit"), 5: ('"a":"x"', '"a":"y"', "hooks"), 6: ('"until":[]', '"until":["."]', "generation"), 7: ('{"m":"p3"}', '{"n":"p3"}', "metrics"),
    8: ("count", "sum", "family"), 9: ('"selector":"count"', '"selector":"index"', "selector"), 10: ('"used_for_tuning":false', '"used_for_tuning":true', "held out"), 11: ('{"task"', '["task",{"task"', "object"),
}
_DOCUMENT = '{"task":{"name":"task","split":"test","repeats":3,"hooks":{"a":"x","b":"y"},"generation":{"until":[],"max":5},"metrics":[{"m":"p1"},{"m":"p3"}]},"family":"count","dataset":{"selector":"count"},"flags":{"used_for_training":false,"used_for_tuning":false},"id":'
_CONTRACT = (
    {"rule": "name", "path": "task.name", "equals": "task"}, {"rule": "split", "path": "task.split", "equals": "test"}, {"rule": "repeats", "path": "task.repeats", "equals": 3},
    {"rule": "no limit", "path": "task.limit", "present": False}, {"rule": "hooks", "path": "task.hooks", "equals": {"a": "x", "b": "y"}}, {"rule": "generation", "path": "task.generation", "equals": {"max": 5, "until": []}},
    {"rule": "metrics", "path": "task.metrics", "names": {"by": "m", "all": ["p1", "p3"]}}, {"rule": "family", "path": "family", "one_of": ["count", "index"]},
    {"rule": "selector", "path": "dataset.selector", "same_as": "family"}, {"rule": "held out", "path": "flags", "none_set": "used_for"},
)


@query(f"""SELECT rule, count(*) AS n, min(event_id) AS first FROM events JOIN (VALUES {', '.join(f"({k}, '{x[2]}')" for k, x in _CHANGED.items())}) b(m, rule) ON event_id % 12 = m GROUP BY ALL""")
def document_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that documents break, of which one is made for every event."""
    text = F.concat(F.lit(_DOCUMENT), F.col("event_id").cast("string"), F.lit("}"))
    for k, (old, new, _) in _CHANGED.items():
        text = F.when(F.col("event_id") % 12 == k, F.replace(F.concat(F.lit(_DOCUMENT), F.col("event_id").cast("string"), F.lit("}")), F.lit(old), F.lit(new))).otherwise(text)
    broken = N.broken_rules(W.spread(W.table(spark, sf_dir, "events").select("event_id")).select("event_id", text.alias("doc")), "doc", _CONTRACT)
    # Of explode() a filter would be made below, which finds the broken rules a first time.
    return broken.select("event_id", F.explode_outer("broken").alias("rule")).where("rule is not null").groupBy("rule").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("""SELECT event_id, unnest(CASE event_id % 3 WHEN 0 THEN ['a.0.limit', 'limit'] WHEN 1 THEN ['a.1.b.c.samples'] ELSE ['limit.limit', 'limit'] END) AS path FROM events WHERE event_id % 4 <> 3""")
def forbidden_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of forbidden keys, at several depths, in a configuration for every event."""
    event = F.col("event_id")
    doc = (
        F.when(event % 4 == 3, F.lit('{"a":{"limit":null,"b":[{"samples":""}]},"limits":5}'))
        .when(event % 3 == 0, F.concat(F.lit('{"a":[{"limit":'), (event + 1).cast("string"), F.lit('},{"samples":[]}],"limit":true}')))
        .when(event % 3 == 1, F.lit('{"a":[0,{"b":{"c":{"samples":["x"],"limit":0}}}]}'))
        .otherwise(F.lit('{"limit":{"limit":1}}'))
    )
    return N.forbidden_settings(W.table(spark, sf_dir, "events").select("event_id", doc.alias("doc")), "event_id", "doc", ("limit", "samples"))


@query("""SELECT evaluator, "case", expected, got, failed, count(*) AS n FROM events, (VALUES ('generous', 'count missed', 0.0e0, 1.0e0, false), ('generous', 'indices shifted', 0.0e0, 1.0e0, false),
('generous', 'constraint missed', 0.0e0, 1.0e0, false), ('deaf', 'count met', 1.0e0, 0.0e0, false), ('deaf', 'indices met', 1.0e0, 0.0e0, false), ('deaf', 'constraint met', 1.0e0, 0.0e0, false)) v(evaluator, "case", expected, got, failed) GROUP BY ALL""")
def reward_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven cases of every event under three evaluators: the right one gets none wrong, one that grants
    everything and one that grants nothing are found out."""
    events, number = W.spread(W.table(spark, sf_dir, "events").select("event_id")), F.col("event_id")
    # 210 is a multiple of what the parity evaluator and the validator look at.
    of = lambda k: F.concat(F.lit("C"), (number * 210 + k).cast("string"))
    cases = P.oracle_cases(events, number, {"constraint met": of(2), "constraint missed": of(1), "value refused": of(5)}, F.lit('[{"type":"k","operator":"=","value":0}]'))
    found = P.oracle_failures(cases, evaluators={"right": W.parity, "generous": W.generous, "deaf": W.deaf}, validator=W.acceptable)
    return found.groupBy("evaluator", "case", "expected", "got", "failed").agg(F.count("*").alias("n"))


_NAMES_SQL = "CASE o_orderkey % 4 WHEN 0 THEN concat('checkpoint-', o_orderkey) WHEN 1 THEN sha256(o_orderstatus) WHEN 2 THEN substr(sha256(o_orderpriority), 1, 40) ELSE concat(o_orderpriority, '/', o_orderkey) END"


@query(f"""WITH n AS (SELECT {_NAMES_SQL} AS t FROM orders) SELECT count_if(regexp_full_match(t, '[0-9a-f]{{64}}')) AS sha256, count_if(regexp_full_match(t, '[0-9a-f]{{40}}')) AS "commit",
count_if(regexp_full_match(t, 'checkpoint-[0-9]+')) AS checkpoint, count_if(regexp_full_match(t, '[A-Za-z0-9][A-Za-z0-9._-]*')) AS run, count(*) AS n FROM n""")
def identifier_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, kind = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 4
    name = F.when(kind == 0, F.concat(F.lit("checkpoint-"), key)).when(kind == 1, H.sha256(F.col("o_orderstatus"))).when(kind == 2, H.prefix_id(F.col("o_orderpriority"), 40)).otherwise(F.concat("o_orderpriority", F.lit("/"), key))
    formats = {"sha256": X.SHA256, "commit": X.COMMIT, "checkpoint": X.CHECKPOINT, "run": X.RUN}
    return W.table(spark, sf_dir, "orders").agg(*[F.count_if(X.is_named(name, p)).alias(n) for n, p in formats.items()], F.count("*").alias("n"))


@query("""SELECT o_orderkey, o_orderstatus, want AS expected FROM (SELECT o_orderkey, o_orderpriority AS k, o_orderstatus FROM orders) JOIN (SELECT o_orderpriority AS k, min(o_orderstatus) AS want FROM orders GROUP BY ALL) USING (k)
WHERE o_orderstatus <> want AND k LIKE '1%'""")
def unexpected_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose status isn't the one expected of their priority."""
    orders = W.table(spark, sf_dir, "orders")
    want = orders.where("o_orderpriority like '1%'").groupBy("o_orderpriority").agg(F.min("o_orderstatus").alias("o_orderstatus"))
    keyed = orders.where("o_orderpriority like '1%'").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    expected = keyed.join(want.withColumnRenamed("o_orderstatus", "w"), "o_orderpriority").select("o_orderkey", F.col("w").alias("o_orderstatus"))
    return I.unexpected(keyed, expected, "o_orderkey", "o_orderstatus")


@query("""SELECT n_regionkey, n_name AS name, CAST(n_nationkey AS VARCHAR) AS number, concat('rest, ', n_nationkey) AS more FROM nation""")
def command_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of comma-separated text of each region, back to rows."""
    line = F.concat("n_name", F.lit(" , "), F.col("n_nationkey").cast("string"), F.lit(",rest, "), F.col("n_nationkey").cast("string"))
    texts = W.table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat(F.array_join(F.collect_list(line), "\n"), F.lit("\n \n")).alias("t"))
    return texts.select("n_regionkey", F.inline(comma_rows(F.col("t"), ("name", "number", "more"))))


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity / 40 BETWEEN 0 AND 1 AND l_discount BETWEEN 0 AND 1 AND l_tax BETWEEN 0 AND 1 THEN l_quantity / 40 + 0.05e0 * l_discount + 0.05e0 * l_tax ELSE 0 END, 9) AS total,
CASE WHEN l_quantity / 4 = floor(l_quantity / 4) THEN CAST(CAST(l_quantity / 4 AS BIGINT) AS VARCHAR) ELSE CAST(l_quantity / 4 AS VARCHAR) END AS quarter FROM lineitem""")
def weighted_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    quarter = F.col("l_quantity") / 4
    total = S.weighted_total(F.col("l_quantity") / 40, F.col("l_discount"), F.col("l_tax"))
    return _rounded(W.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", total.alias("total"), X.whole_if_integral(quarter).alias("quarter")), "total")


@query("SELECT l_orderkey, bool_or(l_discount > 0) AS holds FROM lineitem GROUP BY ALL")
def positive_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = W.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_discount").alias("v"))
    return values.select("l_orderkey", V.positive_constraint(F.col("v")).alias("holds"))


#: Rules that each mutation of a record breaks.
_BROKEN = {
    1: ("identity",), 2: ("targets",), 3: ("targets",), 4: ("load",), 5: ("complexity",), 6: ("metadata_type", "task_type"), 7: ("family",), 8: ("prompt",),
    9: ("target_leak",), 10: ("identity", "json", "key_names", "metadata_type"), 11: ("example_id",), 12: ("key_names",), 13: ("source",),
}


@query(f"""SELECT rule, count(*) AS n FROM events JOIN (VALUES {', '.join(f"({m}, '{rule}')" for m, rules in _BROKEN.items() for rule in rules)}) b(m, rule) ON event_id % 14 = m GROUP BY ALL""")
def record_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules of count records, each of which is changed in one of thirteen ways, or in none."""
    return V.violation_counts(W.records(spark, sf_dir), V.record_rules("count", W.SYSTEM_TEXT, ("validation",)))
