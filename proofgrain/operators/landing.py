"""From result pages to the pages they lead to, in two hops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrain.functions.select import result_links
from proofgrain.functions.text import filled
from proofgrain.functions.url import is_serp_host, source_type

#: Links of a result page that are tried, and characters a landing page must have.
MOST_PAGES, LEAST_TEXT = 3, 40


def resolve(serp: DataFrame, pages: DataFrame, engines: DataFrame | None = None, max_pages: int = MOST_PAGES, fallback: bool = True) -> DataFrame:
    """serp (fetch_id, url, engine, raw_html) with landing, landing_url, text, source_type, outcome.

    ``pages`` holds what was fetched: url, page_id, text and, where it led elsewhere,
    final_url. The first of a result page's links that leads to a page with enough
    text outside the search engines is its landing page; without one the row stays as
    a fallback, with the reason (no_serp_links or landing_unreachable), or goes.
    """
    known = serp.sparkSession.createDataFrame([], "id string, selector string") if engines is None else engines.select("id", "selector").where("selector is not null")
    s = serp.select("fetch_id", "url", "engine", "raw_html").join(known.withColumnRenamed("id", "engine"), "engine", "left")  # a table of fixed size
    links = F.slice(result_links("raw_html", "selector", "url"), 1, max_pages)
    found = s.select("fetch_id", links.alias("links"))
    tried = found.select("fetch_id", F.posexplode("links").alias("at", "link"))
    final = F.coalesce(F.col("final_url"), F.col("url")) if "final_url" in pages.columns else F.col("url")
    good = pages.select(F.col("url").alias("link"), final.alias("landing_url"), F.col("page_id").alias("landing"), "text").where((F.length("text") >= LEAST_TEXT) & ~is_serp_host(F.col("landing_url")))
    good = good.groupBy("link").agg(F.min_by(F.struct("landing", "landing_url", "text"), "landing").alias("p"))
    best = tried.join(good, "link").groupBy("fetch_id").agg(F.min_by("p", "at").alias("p"))
    out = found.select("fetch_id", F.size("links").alias("n_links")).join(best, "fetch_id", "left").select(
        "fetch_id", "p.landing", "p.landing_url", filled(F.col("p.text")).alias("text"), F.when(F.col("p").isNotNull(), source_type(F.col("p.landing_url"))).alias("source_type"),
        F.when(F.col("p").isNotNull(), "resolved").when(F.col("n_links") == 0, "no_serp_links").otherwise("landing_unreachable").alias("outcome"))
    return out if fallback else out.where("outcome = 'resolved'")


def landing_counts(resolved: DataFrame) -> DataFrame:
    """outcome, n."""
    return resolved.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
