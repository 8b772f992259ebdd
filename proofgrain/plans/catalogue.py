"""All queries of the core library, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from proofgrain.plans import events, evidence, routing, sourcing, texts

MODULES = (texts, evidence, routing, events, sourcing)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """The ranked sources of every question, with weights."""
    return evidence.top_sources(spark, sf)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for m in MODULES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {n: s for m in MODULES for n, s in m.SQL.items()}
