"""The two composed entry points, for any number of questions at once: retrieve and research."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrain.functions.html import main_text, title_of
from proofgrain.functions.select import site_text
from proofgrain.functions.text import claim_text, either, filled, split_facts, token_estimate
from proofgrain.functions.url import domain_of, source_type
from proofgrain.operators import control, dedup, gather, guards, report, route, score, verify
from proofgrain.session import cut

#: Similarity threshold of near duplicates among given documents and among fetched ones.
GIVEN, FETCHED = 1, 3


def run_plan(queries: DataFrame, depth: str | None = None, classify: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """queries with clean text, tier, budget and cap: an override in the text beats the depth, which beats the caller's classifier (of question and prompt), which beats the words."""
    o = route.override(F.col("query"))
    asked = score.lookup(F.lit(depth), route.DEPTH, None) if depth else F.lit(None).cast("string")
    usual = route.tier(o["query"]) if classify is None else F.coalesce(classify(o["query"], gather.prompt(gather.TIER_PROMPT, query=o["query"])), route.tier(o["query"]))
    tier = F.coalesce(o["tier"], asked, usual)
    q = queries.withColumn("tier", tier).withColumn("query", o["query"])
    return q.withColumns({"budget": score.lookup(F.col("tier"), score.BUDGET, 8000), "max_sources": score.lookup(F.col("tier"), score.MAX_SOURCES, 3), "intent": route.intent(F.col("query"))["intent"]})


def intake(docs: DataFrame) -> DataFrame:
    """Given documents ready for scoring: rows without an address go; text, title and kind are filled in."""
    d = docs.where(F.length("url") > 0)
    text = F.when(filled("text") != "", F.col("text")).when(F.col("raw_html").isNotNull(), F.coalesce(site_text(F.col("raw_html"), domain_of(F.col("url"))), main_text(F.col("raw_html")))) if "raw_html" in docs.columns else F.col("text")
    title = either("title", title_of(F.col("raw_html"))) if "raw_html" in docs.columns else F.col("title")
    d = d.withColumns({"text": text, "title": F.coalesce(title, F.substring(filled("text"), 1, 40))})
    return d.withColumns({"snippet": F.coalesce(either("snippet"), F.substring(filled("text"), 1, 800)), "source_type": F.coalesce(either("source_type"), source_type(F.col("url")))}).drop("raw_html")


def retrieve(queries: DataFrame, docs: DataFrame, prior: DataFrame | None = None, depth: str | None = None, threshold: int = GIVEN, more: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """Rank, cap, summarise and verify the documents (query_id, pos, fetch_id, url, ...) of every question.

    Returns plan, sources (ranked, with weights), findings, verdicts,
    uncertainties, issues (cited but not fetched), stop and summary; each has
    query_id, and none is computed before it is used, but for the documents kept.
    ``more`` fetches once more for the deep questions (query_id, tier, n, used) whose
    documents are fewer than their sources while budget is left.
    """
    plan = run_plan(queries, depth)
    rows = intake(docs).withColumn("round", F.lit(1))
    if prior is not None:
        rows = control.merge_evidence(intake(prior).withColumn("round", F.lit(0)).unionByName(rows, allowMissingColumns=True))
    kept = dedup.near_dup(rows, "query_id", "fetch_id", threshold).select(F.col("part").alias("query_id"), F.col("id").alias("fetch_id"))
    if more is not None:
        again = more(gather.expansions(plan, rows.join(kept, ["query_id", "fetch_id"], "left_semi")))
        rows = rows.unionByName(intake(again).withColumn("round", F.lit(2)), allowMissingColumns=True)
        kept = dedup.near_dup(rows, "query_id", "fetch_id", threshold).select(F.col("part").alias("query_id"), F.col("id").alias("fetch_id"))
    mine = rows.join(kept, ["query_id", "fetch_id"], "left_semi").join(plan.select("query_id", "query", "tier", "budget", "max_sources"), "query_id")
    scored = cut(score.score(mine, dated=F.col("fetched_at").isNotNull() if "fetched_at" in mine.columns else None))
    sources = score.top_sources(scored, F.col("max_sources"))
    found = report.synthesize(sources.drop("rank"))
    facts = found.select("query_id", F.posexplode(split_facts(claim_text(F.col("findings")))).alias("fact_id", "fact"))
    verdicts = verify.anchor_facts(facts, sources)
    unsure = verify.uncertainties(verdicts.withColumn("ord", F.col("fact_id")), sources)
    issues = verify.uncited(found, sources)
    tokens = sources.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_sources"), F.sum(token_estimate(F.col("snippet"))).alias("snippet_tokens"))
    conf = score.confidence(sources)
    state = plan.join(tokens, "query_id", "left").join(conf, "query_id", "left")
    over = F.coalesce("snippet_tokens", F.lit(0)) >= F.col("budget")
    stop = control.should_stop(F.col("tier"), F.coalesce("n_sources", F.lit(0)), F.lit(False), F.lit(False), over, F.coalesce("n_sources", F.lit(0)) >= F.col("max_sources"))
    summary = state.select("query_id", "tier", "intent", F.coalesce("n_sources", F.lit(0)).alias("n_sources"), F.coalesce("snippet_tokens", F.lit(0)).alias("token_used"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), stop.alias("stop"))
    return {"plan": plan, "sources": sources, "findings": found, "verdicts": verdicts, "uncertainties": unsure, "issues": issues, "summary": summary}


def research(queries: DataFrame, fetch: Callable[[DataFrame, int, DataFrame | None], DataFrame], max_rounds: int = 3, dimensions: tuple = control.DIMENSIONS, closure: Callable[[DataFrame], DataFrame] | None = None,
             agent: Callable[[DataFrame], DataFrame] | None = None, conflicts: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """Rounds of retrieval until every dimension is covered.

    ``fetch(open questions, round, evidence)`` gives the documents of a round, for
    the questions still open. A question closes when its evidence has an address
    and covers all dimensions; the others go on for at most ``max_rounds``.

    The caller's own steps are functions on DataFrames: ``closure(evidence)`` gives
    the query_id of further questions that are answered, ``agent(rows of
    gather.dispatch)`` documents found by dimension before the first round, and
    ``conflicts(evidence)`` the rows of the result's ``conflicts``.
    """
    open_, evidence, closed = queries.select("query_id", "query"), None, None
    if agent is not None:
        plan = run_plan(queries)
        evidence = cut(control.merge_evidence(agent(gather.dispatch(plan, guards.dimensions(F.col("query"), F.col("tier")))).withColumn("round", F.lit(-1))))
    for n in range(max_rounds):
        got = fetch(open_, n, evidence).withColumn("round", F.lit(n))
        evidence = cut(control.merge_evidence(got if evidence is None else evidence.unionByName(got, allowMissingColumns=True)))
        state = control.closure(evidence, dimensions)
        done = state.where("closed").select("query_id")
        if closure is not None:
            done = done.union(closure(evidence).select("query_id")).distinct()
        closed = queries.select("query_id").join(done, "query_id", "left_semi")
        open_ = cut(open_.join(done, "query_id", "left_anti"))
        if not open_.limit(1).count():
            break
    rounds = evidence.groupBy("query_id").agg((F.max("round") + 1).alias("iterations"), F.count(F.lit(1)).alias("evidence"))
    more = {"conflicts": conflicts(evidence)} if conflicts is not None else {}
    return {"evidence": evidence, "closed": closed, "iterations": rounds, **more, **{k: v for k, v in retrieve(queries, evidence.drop("round")).items() if k in ("sources", "findings", "uncertainties")}}
