"""Gathering documents: engines of a question, fan-out over sources, leaves, expansion, and the caller's own steps.

Every step that fetches takes the rows to fetch as a DataFrame and gives rows
back, so one plan serves any number of questions, and a failed fetch is a row
without a payload, not an error.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proofgrain.functions.text import filled, token_estimate
from proofgrain.operators.dedup import first_per_key
from proofgrain.sources import adapters, registry

#: The engines of a question without a domain, and the one that is tried when the others give nothing.
DEFAULT_ENGINES, LAST_ENGINE, SEARXNG = ("Baidu", "Sogou"), "Baidu", "__searxng__"
# The texts that a caller's models are asked with; only the names in braces are filled in.
TIER_PROMPT = "任务: 判断问题复杂度档位(L0-L3)\n问题: {query}\nL0 单一事实/定义/数值; L1 一个明确子问题需一次检索; L2 需多维度拆解或对原因/做法给结论; L3 需多轮检索-批判-精炼跨源综合\n只返回一词: L0 / L1 / L2 / L3"
RESEARCHER_PROMPT = "任务: 调研维度「{dimension}」(深度:{detail_level})\n主题: {topic}\n时间范围: {time_range}\n要求: 获取证据并返回该维度结论与来源\n禁止: 改写本模板结构"
CRITIC_PROMPT = "任务: 批判审查研究发现, 标出无来源支撑/跨源冲突/过度推断处\n主题: {topic}\n研究发现: {findings}\n返回: 问题清单+改进建议"


def load_config(spark: SparkSession, config: dict | str | None = None) -> dict:
    """The caller's settings: a dictionary as it is, else the JSON file at a path of any file system; {} if it is missing or bad."""
    if isinstance(config, dict):
        return config
    try:
        got = json.loads("\n".join(r[0] for r in spark.read.text(config, wholetext=True).limit(1).collect())) if config else {}
        return got if isinstance(got, dict) else {}
    except Exception:  # a missing or unreadable file is no reason to stop
        return {}


def prompt(template: str, **values: Column) -> Column:
    """A template with its names filled in by columns."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), filled(value))
    return out


def choose_engines(queries: DataFrame, searxng_url: str = "") -> DataFrame:
    """query_id, engine, at: the engines of each question's domain (queries: query_id, domain), else one's own search service, else two."""
    vertical = queries.sparkSession.createDataFrame([(e[0].removeprefix("vertical/"), e[1], n) for n, e in enumerate(registry.ENGINES) if e[0].startswith("vertical/")], "domain string, engine string, at int")
    at = F.row_number().over(W.partitionBy("domain").orderBy("at")) - 1
    known = vertical.withColumn("at", at)
    named = queries.join(known, "domain").select("query_id", "engine", "at")  # a table of fixed size
    others = queries.join(known.select("domain").distinct(), "domain", "left_anti")
    usual = (SEARXNG,) if searxng_url else DEFAULT_ENGINES
    return named.union(others.select("query_id", F.posexplode(F.array(*map(F.lit, usual))).alias("at", "engine")).select("query_id", "engine", "at"))


def general_search(queries: DataFrame, results: DataFrame, searxng_url: str = "") -> DataFrame:
    """The results (query_id, engine, pos, ...) of each question's engines, in their order; a question whose engines gave none gets those of the last engine."""
    chosen = choose_engines(queries, searxng_url)
    got = results.join(chosen, ["query_id", "engine"])
    rest = queries.select("query_id").join(got.select("query_id").distinct(), "query_id", "left_anti")
    last = results.where(F.col("engine") == LAST_ENGINE).join(rest, "query_id", "left_semi").withColumn("at", F.lit(0))
    return got.unionByName(last)


def fan_out(chosen: DataFrame, sources: DataFrame, fetch: Callable[[DataFrame], DataFrame], paths: tuple[str, ...] = (), searxng_url: str = "") -> DataFrame:
    """query_id, source, pos, url, title, snippet, source_type, quality: what the chosen sources (query_id, query, id) answer.

    ``fetch`` gets the requests (query_id, source, method, address) and adds
    ``payload``, null where a source failed or took too long. An address that
    several sources give is kept once, for the first source of the registry.
    """
    spark = chosen.sparkSession
    asked = registry.requests(chosen, sources, registry.engines(spark), searxng_url)
    got = fetch(asked).where("payload is not null")
    rows = adapters.adapt_mixed(got.join(chosen.select("query_id", F.col("id").alias("source"), F.col("query").alias("q")), ["query_id", "source"]).withColumn("base", F.col("address")), sources, paths)
    known = sources.select(F.col("id").alias("source"), "ordinal", "source_type", "quality")
    return first_per_key(rows.join(known, "source"), ["query_id", "url"], ["ordinal", "pos"]).drop("ordinal")


def routed(queries: DataFrame, sources: DataFrame, select: Callable[[DataFrame, DataFrame], DataFrame], router: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """query_id, id of each question's sources: by the caller's router in place of the usual selection; a question it gives none asks all sources."""
    if router is None:
        return select(queries, sources).select("query_id", "id")
    own = router(queries, sources).select("query_id", "id").join(sources.select("id"), "id", "left_semi").select("query_id", "id")
    rest = queries.select("query_id").join(own.select("query_id").distinct(), "query_id", "left_anti")
    every = F.array(*[F.lit(r["id"]) for r in sources.select("id").collect()]).cast("array<string>")  # of the registry, a table of settings
    return own.union(rest.select("query_id", F.explode(every).alias("id")))


def fill_dois(rows: DataFrame, dois: DataFrame) -> DataFrame:
    """rows with the DOI of their arxiv_id in ``citation`` (a map), where ``dois`` (arxiv_id, doi) knows one; none is made up."""
    d = dois.where("length(doi) > 0").groupBy("arxiv_id").agg(F.min("doi").alias("_doi"))
    base = F.coalesce("citation", F.create_map().cast("map<string,string>")) if "citation" in rows.columns else F.create_map(F.lit("key"), F.concat(F.lit("arxiv-"), "arxiv_id"), F.lit("source"), F.lit("arxiv"))
    base = F.map_filter(base, lambda k, v: k != "doi")
    return rows.join(d, "arxiv_id", "left").withColumn("citation", F.when(F.col("_doi").isNotNull(), F.map_concat(base, F.create_map(F.lit("doi"), "_doi"))).otherwise(base)).drop("_doi")


def leaf_documents(leaves: DataFrame, found: DataFrame) -> DataFrame:
    """Documents of the leaves of each question, in the order of leaf and place.

    ``leaves`` has query_id, i, leaf, truncated, tier and max_sources; ``found``
    query_id, leaf, pos and its own columns. Questions of the deepest tier use all
    their leaves, others as many as they have sources.
    """
    used = leaves.where(~F.col("truncated") & ((F.col("tier") == "L3") | (F.col("i") < F.col("max_sources")))).select("query_id", "leaf", F.col("i").alias("leaf_at"))
    return found.join(used, ["query_id", "leaf"])


def expansions(plan: DataFrame, kept: DataFrame) -> DataFrame:
    """The questions that ask once more: deep ones with fewer documents than sources and a budget that isn't used up.

    ``plan`` has query_id, tier, budget and max_sources, ``kept`` the documents so far.
    """
    state = kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum(token_estimate(F.col("snippet"))).alias("used"))
    s = plan.join(state, "query_id", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "used": F.coalesce("used", F.lit(0))})
    return s.where(F.col("tier").isin("L2", "L3") & (F.col("n") < F.col("max_sources")) & (F.col("used") < F.col("budget"))).select("query_id", "tier", "n", "used")


def dispatch(queries: DataFrame, dimensions: Column, time_range: str = "不限") -> DataFrame:
    """query_id, i, dimension, prompt, query: one row for each dimension a question is researched in, for an agent or for a search of its own."""
    d = queries.select("query_id", "query", F.posexplode(dimensions).alias("i", "d"))
    text = prompt(RESEARCHER_PROMPT, dimension=F.col("d.name"), detail_level=F.col("d.detail_level"), topic=F.col("query"), time_range=F.lit(time_range))
    return d.select("query_id", "i", F.col("d.name").alias("dimension"), text.alias("prompt"), F.concat(filled("query"), F.lit("（聚焦维度："), F.col("d.name"), F.lit("）")).alias("query"))


def classified_tiers(queries: DataFrame, classify: Callable[[Column, Column], Column], usual: Column) -> Column:
    """The tier the caller's function gives for (question, prompt); what it can't tell (null) is the usual one."""
    return F.coalesce(classify(F.col("query"), prompt(TIER_PROMPT, query=F.col("query"))), usual)


def persisted(evidence: DataFrame, done: DataFrame) -> DataFrame:
    """query_id, n, url and the other columns of the evidence not yet worked off (done: query_id, url); numbers go on from those done."""
    base = done.groupBy("query_id").agg(F.count_distinct("url").alias("_base"))
    new = evidence.join(done.select("query_id", "url").distinct(), ["query_id", "url"], "left_anti").join(base, "query_id", "left")
    n = F.row_number().over(W.partitionBy("query_id").orderBy("pos", "fetch_id")) + F.coalesce("_base", F.lit(0))
    return new.withColumn("n", n.cast("int")).drop("_base")


def split_items(text: Column) -> Column:
    """The pieces of a list written in one line."""
    return F.filter(F.transform(F.split(filled(text), "[、,，;；/\n]"), lambda x: F.trim(x)), lambda x: x != "")
