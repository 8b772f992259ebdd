"""Control of retrieval rounds: evidence, freshness, budget, stop and closure."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proofgrain.functions.text import closure_tokens, filled

# Reasons of a stop.
BUDGET_L0, NO_NEWS, ENOUGH_L0 = "预算到达即停(缩范围模式)", "连续两轮无新信息", "证据足够，决定不检索"
CLOSED, BUDGET_L2 = "覆盖饱和度达成(子问题全答/缺口闭合)", "预算截断，覆盖可能不完整"
DIMENSIONS = (("定义与概念", "简要"), ("机制/原理", "详细"), ("对比/异同", "简要"), ("现状/应用", "简要"), ("争议/局限", "简要"))
FINANCE_DIMENSIONS = (("营业收入", "简要"), ("归母净利润", "简要"), ("每股收益", "简要"), ("ROE", "简要"), ("同比变动", "简要"))


def merge_evidence(rows: DataFrame) -> DataFrame:
    """Evidence over rounds: the first row of each address of a query; rows without one stay."""
    keyed = rows.where(F.length("url") > 0)
    w = W.partitionBy("query_id", "url").orderBy("round", "pos", "fetch_id")
    first = keyed.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return first.union(rows.where(filled("url") == ""))


def fresh_counts(rows: DataFrame) -> DataFrame:
    """query_id, round, total, fresh: rows of a round whose address no earlier round had."""
    r = rows.withColumn("first_round", F.min(F.when(F.length("url") > 0, F.col("round"))).over(W.partitionBy("query_id", "url")))
    fresh = F.count_if((F.length("url") > 0) & (F.col("first_round") == F.col("round")))
    return r.groupBy("query_id", "round").agg(F.count(F.lit(1)).alias("total"), fresh.alias("fresh"))


def should_stop(tier: Column, fresh: Column, has_history: Column, enough: Column, budget_hit: Column, closed: Column) -> Column:
    """struct(stop, reason, exhausted): two ladders, for shallow and for deep tiers."""
    def out(stop: bool, reason: str, exhausted: bool = False) -> Column:
        return F.struct(F.lit(stop).alias("stop"), F.lit(reason).alias("reason"), F.lit(exhausted).alias("exhausted"))

    shallow, stale = tier.isin("L0", "L1"), (fresh == 0) & has_history
    return (F.when(shallow & budget_hit, out(True, BUDGET_L0)).when(shallow & stale, out(True, NO_NEWS)).when(shallow & enough, out(True, ENOUGH_L0)).when(shallow, out(False, ""))
            .when(closed | enough, out(True, CLOSED)).when(stale, out(True, NO_NEWS)).when(budget_hit, out(True, BUDGET_L2, True)).otherwise(out(False, "")))


#: Consecutive ids of one bucket of a running sum.
BUCKET = 100_000


def running_budget(rows: DataFrame, tokens: Column, budget: Column) -> DataFrame:
    """rows with the tokens used so far in their query and whether the budget is hit.

    Rows are summed up within buckets of a round, a place and BUCKET consecutive
    ids, and the buckets' totals within their query, so a query with very many rows
    isn't one task's work.
    """
    key = ["query_id", "round", "pos", "_bucket"]
    r = rows.withColumns({"_tokens": tokens, "_budget": budget, "_bucket": F.floor(F.col("fetch_id") / F.lit(BUCKET))})
    totals = r.groupBy(*key).agg(F.sum("_tokens").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.partitionBy("query_id").orderBy("round", "pos", "_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(*[F.col(k).alias(f"{k}_t") for k in key], before.alias("_before"))
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_t"))
    inside = F.sum("_tokens").over(W.partitionBy(*key).orderBy("fetch_id").rowsBetween(W.unboundedPreceding, 0))
    out = r.withColumn("_inside", inside).join(totals, same)
    return out.withColumn("used", F.col("_before") + F.col("_inside")).withColumn("over", F.col("used") >= F.col("_budget")).drop("_tokens", "_budget", "_bucket", "_inside", "_before", *[f"{k}_t" for k in key])


def closure(evidence: DataFrame, dimensions: tuple = DIMENSIONS) -> DataFrame:
    """query_id, anchored, covered (dimensions), closed."""
    text = F.lower(F.concat_ws(" ", filled("text"), filled("url"), filled("snippet")))
    spark = evidence.sparkSession
    names = [n for n, _ in dimensions]
    toks = spark.range(1).select(*[F.transform(closure_tokens(F.lit(n)), F.lower).alias(f"d{i}") for i, n in enumerate(names)]).first()  # of the caller's dimensions
    some = lambda words: functools.reduce(operator.or_, [F.col("t").contains(w) for w in words])
    rows = evidence.select("query_id", F.coalesce(F.length("url") > 0, F.lit(False)).alias("has_url"), text.alias("t"))
    g = rows.groupBy("query_id").agg(F.max("has_url").alias("anchored"), *[F.max(some(toks[i])).cast("int").alias(f"_c{i}") for i in range(len(names))])
    g = g.withColumn("covered", sum((F.col(f"_c{i}") for i in range(len(names))), F.lit(0)).cast("bigint"))
    return g.select("query_id", "anchored", "covered", (F.col("anchored") & (F.col("covered") == len(dimensions))).alias("closed"))
