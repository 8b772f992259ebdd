"""One key with most of the rows: the results are whole, and these tests end."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofgrain.llm import leakage, lookalikes, main_body, near_duplicates, repeated_lines, truncation

N = 20_000
WORDS = "the of ledger harbour audit parser revenue index quarterly sparse idle before counted team copies every restores any by who keep".split()


def words(key: str, n: int):
    """n words, others for every value of the key."""
    return F.concat_ws(" ", *[F.element_at(F.array(*map(F.lit, WORDS)), (F.pmod(F.xxhash64(key, F.lit(j)), F.lit(len(WORDS))) + 1).cast("int")) for j in range(n)])


def test_equal_strings_and_one_variant(spark):
    df = spark.range(N).select("id", F.lit(1).cast("bigint").alias("grp"), F.when(F.col("id") == 0, "сopy").otherwise("copy").alias("f"))
    got = lookalikes.look_same(lookalikes.bring_to_form(df, ["id", "grp"], "f"), "id", ["grp"], "f")
    assert got.count() == got.where("id_a = 0").distinct().count() == N - 1


def test_one_item_in_all_documents(spark):
    item = "".join(WORDS)
    docs = spark.range(N).select(F.col("id").alias("doc_id"), F.concat(F.lit(item), words("id", 8)).alias("text"))
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    for most in (10**6, 0):
        assert leakage.leaks(docs, items, "doc_id", "text", "item_id", "text", most).distinct().count() == N


def test_copies_of_one_text(spark):
    """A third of the documents are one text: one sketch, one class; the others stay by themselves."""
    text = F.when(F.col("id") % 3 == 0, F.lit(" ".join(WORDS * 4))).otherwise(words("id", 80))
    docs = spark.range(N // 4).select(F.col("id").alias("doc_id"), text.alias("text"))
    links, members = near_duplicates.near_duplicates(docs, "doc_id", "text")
    got = near_duplicates.classes(links, members)
    copies = (N // 4 + 2) // 3
    assert got.count() == N // 4 and got.where("class_id = 0").count() == got.where(f"copies = {copies}").count() == copies


def test_cut_texts_of_one_opening(spark):
    """Every text begins alike and is cut; half are prefixes of a longer copy."""
    opening = "Opening words that every text of this source begins with, and then "
    base = spark.range(N // 4).select("id", F.concat(F.lit(opening), words("id", 30)).alias("t"))
    cut_off = base.select(F.col("id").alias("doc_id"), "t", F.lit("s").alias("source"))
    longer = base.where("id % 2 = 0").select((F.col("id") + N).alias("doc_id"), F.concat("t", F.lit("s and so on. The end.")).alias("t"), F.lit("s").alias("source"))
    got = {r["evidence"]: r["count"] for r in truncation.truncated(cut_off.union(longer), "doc_id", "t", "source").groupBy("evidence").count().collect()}
    assert got == {"prefix": N // 8, "end": N // 8}


def test_lines_of_one_source(spark):
    df = spark.range(N).select(F.col("id").alias("doc_id"), F.concat(F.lit("Head\n"), words("id", 6), F.lit("\nFoot "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    assert repeated_lines.repeated(df, "doc_id", "text", "source").groupBy("line_no").count().where(f"count = {N}").count() == 2


def test_pages_of_one_host(spark):
    p = words("id", 12)
    html = F.concat(F.lit('<html><body><div class="bar"><p>This site uses cookies.</p></div><div class="story"><h1>T</h1><p>'), p, F.lit("</p></div></body></html>"))
    df = spark.range(N // 2).select(F.col("id").alias("fetch_id"), F.lit("https://hot.example/x").alias("url"), html.alias("raw_html"), F.lit("T").alias("title"), F.concat(F.lit("This site uses cookies.\nT\n"), p).alias("text"))
    got = {(r["line_no"], r["main"]): r["count"] for r in main_body.classified(df, "fetch_id", "url", "raw_html", "title", "text").groupBy("line_no", "main").count().collect()}
    assert got == {(1, False): N // 2, (2, True): N // 2, (3, True): N // 2}
