"""The library's queries by name, with the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.plans import corpus, finance, retrieval

FLAGSHIP = "b3_bm25_search"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return corpus.QUERIES | retrieval.QUERIES | finance.QUERIES


def oracle_sql() -> dict[str, str]:
    return corpus.ORACLES | retrieval.ORACLES | finance.ORACLES
