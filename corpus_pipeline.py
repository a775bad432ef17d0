"""Corpus pipeline: five stages from raw documents to token ids.

Every stage takes what its predecessor kept, as written Parquet, and all but the last return the
columns of ``documents``: toxic texts go, one document of each group of near duplicates stays,
texts that hold benchmark passages go, personal data are replaced in the text, and what is left is
encoded.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import bpe, decontaminate, jaccard_join, pii, toxicity
from ledgerlark.llm.common import fresh, materialise, table

TOXIC_FROM = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under TOXIC_FROM; null and empty texts score low and stay, repeated rows stay
    or go together, and an empty table stays empty. Columns stay as they are, whatever their names."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    (score,) = fresh(docs, "toxicity")
    return toxicity.score_documents(docs, model, to=score).where(F.col(score) < TOXIC_FROM).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked texts. Null and empty texts are linked
    with nothing and stay; of rows that share an id and a set of shingles one stays; an empty table stays
    empty. Columns stay as they are, whatever their names."""
    return jaccard_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item. Null and empty texts have none and stay, repeated
    rows stay or go together, and an empty table stays empty. Columns stay as they are, whatever their
    names."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by their kinds; ``n_chars`` counts the new text. Null
    and empty texts stay so, repeated rows are redacted alike, and an empty table stays empty. Other
    columns stay as they are, whatever their names."""
    (personal,) = fresh(docs, "personal")
    found = pii.find_personal_data(docs, redact=True, to=personal)
    changed = F.col(f"{personal}.spans") != ""
    out = found.withColumn("text", F.col(f"{personal}.redacted"))
    if "n_chars" in docs.columns:
        n = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(changed, n).otherwise(F.col("n_chars")))
    return out.drop(personal)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of what they decode to. Null and empty
    texts have no tokens, repeated rows are encoded one by one, and an empty table gives no rows."""
    found = bpe.encode_documents(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "tokens.n_tokens", "tokens.ids_sha256", "tokens.decoded_sha256", "tokens.ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("bpe", encode),
]

#: Classifier, boosted trees and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one returns is written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
