"""One question or source with all rows: the results are whole, and these tests end."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofgrain.operators import control, dedup, verify

N = 20_000


def test_facts_of_one_question(spark):
    """Every fact shares "the of" with every source and a rare word with one."""
    facts = spark.range(N).select(F.lit(1).cast("bigint").alias("query_id"), F.col("id").alias("fact_id"), F.concat(F.lit("the of w"), F.translate((F.col("id") % 500).cast("string"), "0123456789", "abcdefghij")).alias("fact"))
    sources = spark.range(500).select(F.lit(1).cast("bigint").alias("query_id"), F.col("id").cast("int").alias("pos"), F.col("id").alias("fetch_id"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), F.lit(None).cast("string").alias("snippet"),
                                     F.concat(F.lit("the of it w"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"))
    got = verify.anchor_facts(facts, sources)
    assert got.where("overlap = 3 and source = concat('u', fact_id % 500)").count() == got.count() == N


def test_results_of_one_question(spark):
    rows = spark.range(N).select(F.lit(1).alias("query_id"), F.lit(0).alias("round"), F.lit(0).alias("pos"), (F.col("id") * 50).alias("fetch_id"), F.lit(2).cast("bigint").alias("t"))
    got = control.running_budget(rows, F.col("t"), F.lit(N))
    assert got.where("used = 2 * (fetch_id / 50 + 1)").count() == N and got.where("over").count() == N // 2 + 1


def test_documents_of_one_source(spark):
    """All have fingerprints of their own, and each hundredth a neighbour one bit off."""
    base = spark.range(N).select("id", F.xxhash64("id").alias("h"))
    near = base.where("id % 100 = 0").select((F.col("id") + N).alias("id"), F.col("h").bitwiseXOR(F.lit(1)).alias("h"))
    fp = base.union(near).select(F.lit("s").alias("part"), "h", F.struct(F.col("id").alias("pos"), "id").alias("ord"))
    assert dedup.candidate_pairs(fp, 3).count() == N // 100
