"""Verification: anchoring facts, citations, uncertainties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrain.functions.fingerprint import cosine
from proofgrain.functions.text import either, filled, keyword_set, urls_in
from proofgrain.session import cut

#: Fixed value: marks of negation.
NEGATION = "不|无|非|没有|相反|并非|未|否"


def anchor_facts(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """query_id, fact_id, verdict, source, overlap: each fact with the source sharing most keywords.

    Different facts of a query are anchored once. A lower bound of the best overlap
    comes first: each keyword votes for the source of its query that has most
    keywords. A source with as many in common as that must have one of the fact's
    rarest keywords (all but bound - 1), so only those are joined, the common ones
    (with which every pair of a query would meet) hardly ever; the overlap of those
    pairs is counted on all keywords. The earlier source wins a tie. A fact without
    keywords or without a match is UNCERTAIN.
    """
    mine = facts.select("query_id", "fact_id", "fact", F.xxhash64("query_id", "fact").alias("f"), F.xxhash64("fact", "query_id").alias("f2"))
    kinds = mine.groupBy("query_id", "f", "f2").agg(F.first("fact").alias("fact")).select("query_id", "f", "f2", F.transform(keyword_set(F.col("fact")), lambda k: F.xxhash64(k)).alias("kw"))
    s = cut(sources.select("query_id", F.struct("pos", "fetch_id").alias("ord"), "url", F.transform(keyword_set(either("text", "snippet")), lambda k: F.xxhash64(k)).alias("kw")))
    words = s.select("query_id", "ord", F.size("kw").alias("size"), F.explode("kw").alias("k"))
    common = words.groupBy("query_id", "k").agg(F.count(F.lit(1)).alias("df"), F.max_by("ord", F.struct("size", "ord")).alias("vote"))
    asked = kinds.select("query_id", "f", "f2", F.size("kw").alias("n_kw"), F.explode_outer("kw").alias("k")).join(common, ["query_id", "k"], "left")
    # a fact's keywords, rarest first; those no source has can't be in common
    ranked = cut(asked.groupBy("query_id", "f", "f2").agg(F.min("n_kw").alias("n_kw"), F.array_sort(F.collect_list(F.when(F.col("df").isNotNull(), F.struct("df", "k", "vote")))).alias("x")))
    votes = F.col("x.vote")
    bound = F.array_max(F.transform(F.array_distinct(votes), lambda v: F.size(F.filter(votes, lambda u: u == v))))
    prefix = ranked.where(F.size("x") > 0).select("query_id", "f", "f2", F.explode(F.slice("x.k", F.lit(1), F.size("x") - bound + 1)).alias("k"))
    pairs = prefix.join(words.select("query_id", "ord", "k"), ["query_id", "k"]).select("query_id", "f", "f2", "ord").distinct()
    counted = pairs.join(ranked.select("f", "f2", F.col("x.k").alias("kw")), ["f", "f2"]).join(s.select("query_id", "ord", "url", F.col("kw").alias("skw")), ["query_id", "ord"]).select(
        "query_id", "f", "f2", "ord", "url", F.size(F.array_intersect("kw", "skw")).alias("overlap"))
    best = counted.groupBy("query_id", "f", "f2").agg(F.min(F.struct((-F.col("overlap")).alias("o"), "ord", "url")).alias("m"))
    known = ranked.select("f", "f2", "n_kw").join(best.drop("query_id"), ["f", "f2"], "left")
    found = F.col("m").isNotNull()
    return mine.join(known, ["f", "f2"]).select(
        "query_id", "fact_id", F.substring("fact", 1, 160).alias("fact"), F.when(found, "TRUE").otherwise("UNCERTAIN").alias("verdict"), F.col("m.url").alias("source"),
        F.when(found, "source_overlap").when(F.col("n_kw") == 0, "no_overlap_source").otherwise("weak_anchor").alias("reason"), F.coalesce(-F.col("m.o"), F.lit(0)).cast("bigint").alias("overlap"))


def anchor_semantic(facts: DataFrame, sources: DataFrame, threshold: float = 0.55) -> DataFrame:
    """As anchor_facts for rows with vectors and keywords: cosine among sources sharing a keyword."""
    f = facts.select("query_id", "fact_id", F.explode("kw").alias("k"))
    s = sources.select("query_id", "pos", F.explode("kw").alias("k"))
    # pairs are found by their ids; the vectors are joined to each once
    ids = f.join(s, ["query_id", "k"]).select("query_id", "fact_id", "pos").distinct()
    pairs = ids.join(facts.select("query_id", "fact_id", F.col("vec").alias("fv")), ["query_id", "fact_id"]).join(sources.select("query_id", "pos", "url", F.col("vec").alias("sv")), ["query_id", "pos"])
    best = pairs.withColumn("c", cosine(F.col("fv"), F.col("sv"))).where(F.col("c") >= threshold).groupBy("query_id", "fact_id").agg(F.min(F.struct((-F.col("c")).alias("c"), "pos", "url")).alias("m"))
    return facts.select("query_id", "fact_id").join(best, ["query_id", "fact_id"], "left").select(
        "query_id", "fact_id", F.when(F.col("m").isNotNull(), "TRUE").otherwise("UNCERTAIN").alias("verdict"), F.col("m.url").alias("source"), (-F.col("m.c")).alias("score"))


def uncited(findings: DataFrame, sources: DataFrame) -> DataFrame:
    """query_id, url cited in findings but not among the query's sources."""
    cited = findings.select("query_id", F.explode(urls_in(F.col("findings"))).alias("url"))
    return cited.join(sources.select("query_id", "url").distinct(), ["query_id", "url"], "left_anti").distinct()


def uncertainties(verdicts: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, fact, reason: the last reason of each uncertain fact, and facts supported with opposite polarity."""
    snippet = docs.select("query_id", F.col("url").alias("source"), filled(either("snippet", "text")).rlike(NEGATION).alias("negative"), F.struct("pos", "fetch_id").alias("o"))
    snippet = snippet.groupBy("query_id", "source").agg(F.max_by("negative", "o").alias("negative"))
    v = verdicts.join(snippet, ["query_id", "source"], "left")
    supported = (F.col("verdict") == "TRUE") & (F.length("source") > 0)
    negative = F.coalesce("negative", F.lit(False))
    g = v.groupBy("query_id", "fact").agg(
        F.max_by(F.when(F.col("verdict") == "UNCERTAIN", F.coalesce("reason", F.lit("weak_anchor"))), F.when(F.col("verdict") == "UNCERTAIN", F.col("ord"))).alias("reason"),
        F.max(supported & negative).alias("neg"), F.max(supported & ~negative).alias("pos"))
    conflict = F.coalesce(F.col("neg") & F.col("pos"), F.lit(False))
    return g.where(F.col("reason").isNotNull() | conflict).select("query_id", F.substring("fact", 1, 160).alias("fact"), F.when(conflict, "cross_source_conflict").otherwise(F.col("reason")).alias("reason"))
