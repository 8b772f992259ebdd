"""Scoring and ranking of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proofgrain.functions.text import lexical_overlap, rounded

# Credibility and bias by kind of source, and the caps and budgets by depth.
CREDIBILITY = {"gov": 0.95, "media": 0.85, "academic": 0.9, "vendor": 0.7, "forum": 0.4, "selfmedia": 0.35, "unknown": 0.5}
BIAS = {"gov": 0.1, "media": 0.2, "academic": 0.1, "vendor": 0.3, "forum": 0.6, "selfmedia": 0.7, "unknown": 0.5}
BUDGET = {"L0": 2000, "L1": 8000, "L2": 30000, "L3": 100000}
MAX_SOURCES = {"L0": 1, "L1": 3, "L2": 8, "L3": 20}


def lookup(c: Column, table: dict, default: float | int) -> Column:
    """A value of a fixed table, as an expression."""
    out = None
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(default))


def score(docs: DataFrame, query: str = "query", dated: Column | None = None) -> DataFrame:
    """docs with credibility, relevance, recency, authority, bias and weighted."""
    cred = lookup(F.col("source_type"), CREDIBILITY, 0.5)
    rec = F.when(dated, F.lit(0.7)).otherwise(F.lit(0.5)) if dated is not None else F.lit(0.5)
    d = docs.withColumns({"credibility": cred, "relevance": lexical_overlap(F.col("snippet"), F.col(query)), "recency": rec, "authority": cred, "bias": lookup(F.col("source_type"), BIAS, 0.5)})
    w = F.lit(0.35) * F.col("credibility") + F.lit(0.30) * F.col("relevance") + F.lit(0.15) * F.col("recency") + F.lit(0.15) * F.col("authority") + F.lit(0.05) * (F.lit(1.0) - F.col("bias"))
    return d.withColumn("weighted", rounded(w, 4))


def by_rank() -> W:
    """The ranking of a query's sources: weight, then order of arrival."""
    return W.partitionBy("query_id").orderBy(F.desc("weighted"), "pos", "fetch_id")


def top_sources(scored: DataFrame, cap: Column) -> DataFrame:
    """The first ``cap`` sources of each query, with their rank."""
    return scored.withColumn("rank", F.row_number().over(by_rank())).where(F.col("rank") <= cap)


def confidence(scored: DataFrame) -> DataFrame:
    """query_id, confidence: the mean weight (as ten-thousandths, so order doesn't matter)."""
    total = F.sum(F.round(F.col("weighted") * 10000).cast("long"))
    return scored.groupBy("query_id").agg(rounded(total / (F.count(F.lit(1)) * F.lit(10000.0)), 3).alias("confidence"))


def conflict_flags(scored: DataFrame) -> DataFrame:
    """query_id, top, low, conflict: whether the lowest weight is under 0.6 of the highest."""
    g = scored.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("weighted").alias("top"), F.min("weighted").alias("low"))
    return g.select("query_id", "top", "low", ((F.col("n") > 1) & (F.col("low") < F.col("top") * F.lit(0.6))).alias("conflict"))
