"""Guards of a fetch as columns: login walls, robots rules, cooldown, backoff; and small decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrain.functions.finance import REPORT_WORDS
from proofgrain.functions.text import filled, strip
from proofgrain.functions.url import any_of, domain_of, is_login_wall, is_serp, path_of
from proofgrain.operators.control import DIMENSIONS, FINANCE_DIMENSIONS
from proofgrain.operators.score import BUDGET, lookup


def disallow_rules(robots: DataFrame) -> DataFrame:
    """domain, prefix of every Disallow line of robots files (domain, body); agents aren't told apart."""
    lines = F.transform(F.split(filled("body"), "\n"), lambda x: F.trim(F.regexp_extract(x, r"(?i)^\s*disallow\s*:\s*([^#\r]*)", 1)))
    return robots.select("domain", F.explode(F.array_distinct(lines)).alias("prefix")).where("prefix <> ''")


def robots_verdicts(urls: DataFrame, rules: DataFrame, url: str = "url", per_domain: bool = False) -> DataFrame:
    """urls with ``allowed``; with ``per_domain`` the verdict on a domain's first address (by url) holds for all of it."""
    u = urls.withColumn("_d", domain_of(F.col(url))).withColumn("_p", F.coalesce(F.nullif(path_of(F.col(url)), F.lit("")), F.lit("/")))
    hit = u.join(rules.withColumnRenamed("domain", "_d"), "_d").where(F.col("_p").startswith(F.col("prefix"))).select(url).distinct().withColumn("_no", F.lit(True))
    out = u.join(hit, url, "left").withColumn("allowed", F.col("_no").isNull() | is_serp(F.col(url)))
    if per_domain:
        first = out.groupBy("_d").agg(F.min_by("allowed", url).alias("_v"))
        out = out.join(first, "_d").withColumn("allowed", F.col("_v")).drop("_v")
    return out.drop("_d", "_p", "_no")


def guard_reason(url: Column, allowed: Column, blocked: Column) -> Column:
    """The first guard that stops a fetch, or null."""
    return F.when(is_login_wall(url), "loginwall").when(~allowed, "robots").when(blocked, "cooldown")


def backoff(attempt: Column, jitter: Column) -> Column:
    return F.least(F.pow(F.lit(2.0), attempt) + jitter, F.lit(8.0))


def budget_estimate(tier: Column) -> Column:
    return F.floor(lookup(tier, BUDGET, 8000) * F.lit(0.85)).cast("int")


def needs_clarifying(query: Column, tier: Column, enabled: Column) -> Column:
    return tier.isin("L2", "L3") & enabled & (F.length(strip(filled(query))) < 15)


def dimensions(query: Column, tier: Column) -> Column:
    """array<struct(name, detail_level)>: none for shallow tiers, finance or default ones, all in detail at L3."""
    def made(dims: tuple, level: str | None = None) -> Column:
        return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(level or lvl).alias("detail_level")) for n, lvl in dims])

    finance = F.lower(filled(query)).rlike(any_of(tuple(w.lower() for w in REPORT_WORDS)))
    deep = tier == "L3"
    none = F.expr("cast(array() as array<struct<name:string,detail_level:string>>)")
    return (F.when(tier.isin("L0", "L1"), none).when(finance & deep, made(FINANCE_DIMENSIONS, "详细")).when(finance, made(FINANCE_DIMENSIONS)).when(deep, made(DIMENSIONS, "详细")).otherwise(made(DIMENSIONS)))


def parse_conflicts(reply: Column) -> Column:
    """array<struct(fact, sources, note)> of a model's reply: a JSON object or list, fenced or not; empty if it is neither."""
    body = F.regexp_replace(F.trim(filled(reply)), r"(?s)^```(?:json)?\s*|\s*```$", "")
    item = "array<struct<fact:string,sources:array<string>,note:string>>"
    got = F.coalesce(F.from_json(body, f"conflicts {item}")["conflicts"], F.from_json(body, item))
    return F.coalesce(F.filter(got, lambda x: x.isNotNull()), F.expr(f"cast(array() as {item})"))
