"""Queries of the training-data operators, and the SQL that some of them can be checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlark.llm import ann, bpe, decontaminate, fim, jaccard_join, license_scan, periodic, pii, quality, secrets, sharding, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_sharding": sharding.op2_sharding,
    "op3_nearest": ann.op3_nearest,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_quality": quality.op6_quality,
    "op7_pii": pii.op7_pii,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_bpe": bpe.op9_bpe,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
    "op11_fim": fim.op11_fim,
    "op12_secrets": secrets.op12_secrets,
    "op13_periodic": periodic.op13_periodic,
}

_SQL: dict[str, Callable[[], str]] = {
    "op1_decontamination": lambda: decontaminate.OP1_SQL,
    "op2_sharding": lambda: sharding.OP2_SQL,
    "op8_url_filter": url_filter.op8_sql,
    "op10_jaccard_join": lambda: jaccard_join.OP10_SQL,
    "op11_fim": lambda: fim.OP11_SQL,
    "op12_secrets": lambda: secrets.OP12_SQL,
    "op13_periodic": lambda: periodic.OP13_SQL,
}


def oracle_sql() -> dict[str, str]:
    """SQL by query; that of the URL filter fits its trees when it is asked for."""
    return {name: sql() for name, sql in _SQL.items()}
