"""The text operators' queries, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrain.llm import leakage, lookalikes, main_body, mojibake, near_duplicates, personal_data, repeated_lines, residue, tokens, truncation
from proofgrain.session import read_table


def p1_repaired(spark: SparkSession, sf: str) -> DataFrame:
    docs, pages = read_table(spark, sf, "documents"), read_table(spark, sf, "serp_docs")
    return mojibake.mend_fields(docs, "documents", "doc_id", ["text", "title"]).union(mojibake.mend_fields(pages, "serp_docs", "fetch_id", ["title"]))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_repaired(spark, sf).select("tbl", "row_id", "field")


def _near(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates.near_duplicates(read_table(spark, sf, "documents"), "doc_id", "text")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.expand(*_near(spark, sf))


def p2_classes(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.classes(*_near(spark, sf))


def p3_lines(spark: SparkSession, sf: str) -> DataFrame:
    return main_body.classified(read_table(spark, sf, "serp_docs"), "fetch_id", "url", "raw_html", "title", "text")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_lines(spark, sf).where("not main").select("fetch_id", "line_no")


def p3_main(spark: SparkSession, sf: str) -> DataFrame:
    return main_body.main_text(read_table(spark, sf, "serp_docs"), "fetch_id", "url", "raw_html", "title", "text")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    hits = repeated_lines.repeated(read_table(spark, sf, "documents"), "doc_id", "text", "source")
    return hits.select(F.col("row_id").alias("doc_id"), "line_no")


def p4_clean(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_lines.clean(read_table(spark, sf, "documents"), "doc_id", "text", "source")


def p4_blocks(spark: SparkSession, sf: str) -> DataFrame:
    _, block = repeated_lines.boilerplate(read_table(spark, sf, "documents"), "doc_id", "text", "source")
    return block.groupBy("source", "block").agg(F.count(F.lit(1)).alias("lines"), F.max("docs").alias("docs")).drop("block")


def p5_mentions(spark: SparkSession, sf: str) -> DataFrame:
    names = read_table(spark, sf, "name_parts")
    a = personal_data.mentions(read_table(spark, sf, "documents"), "documents", "doc_id", "text", names)
    return a.union(personal_data.mentions(read_table(spark, sf, "serp_docs"), "serp_docs", "fetch_id", "snippet", names))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p5_mentions(spark, sf).select("tbl", "row_id", "kind", "start_pos")


def p5_redacted(spark: SparkSession, sf: str) -> DataFrame:
    names = read_table(spark, sf, "name_parts")
    a = personal_data.redacted(read_table(spark, sf, "documents"), "documents", "doc_id", "text", names)
    return a.union(personal_data.redacted(read_table(spark, sf, "serp_docs"), "serp_docs", "fetch_id", "snippet", names))


def _forms(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    facts = read_table(spark, sf, "fact_verdicts").select("verdict_id", "query_id", "fact")
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return lookalikes.bring_to_form(facts, ["verdict_id", "query_id"], "fact"), lookalikes.bring_to_form(docs, ["doc_id"], "text")


def p6_forms(spark: SparkSession, sf: str) -> DataFrame:
    facts, docs = _forms(spark, sf)
    return facts.select(F.lit("fact_verdicts").alias("tbl"), F.col("verdict_id").alias("row_id"), "form").union(docs.select(F.lit("documents"), "doc_id", "form"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    facts, docs = _forms(spark, sf)
    a = lookalikes.look_same(facts, "verdict_id", ["query_id"], "fact")
    b = lookalikes.look_same(docs, "doc_id", [], "text")
    return a.select(F.lit("fact_verdicts").alias("tbl"), "id_a", "id_b").union(b.select(F.lit("documents"), "id_a", "id_b"))


def p6_classes(spark: SparkSession, sf: str) -> DataFrame:
    """One row a row: the least id of those that look the same (facts: of one query), and how many strings they are written in."""
    facts, docs = _forms(spark, sf)
    a, b = lookalikes.classes(facts, "verdict_id", ["query_id"], "fact"), lookalikes.classes(docs, "doc_id", [], "text")
    return a.select(F.lit("fact_verdicts").alias("tbl"), "row_id", "class_id", "strings").union(b.select(F.lit("documents"), "row_id", "class_id", "strings"))


def p7_residue(spark: SparkSession, sf: str) -> DataFrame:
    docs, pages = read_table(spark, sf, "documents"), read_table(spark, sf, "serp_docs")
    model = residue.gather([docs.select("text"), docs.select("title"), pages.select("title")])
    return residue.residue(docs, "documents", "doc_id", ["text", "title"], model).union(residue.residue(pages, "serp_docs", "fetch_id", ["title"], model))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_residue(spark, sf).select("tbl", "row_id", "field")


def p7_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Documents kept: those without a case in text or title."""
    bad = p7_found(spark, sf).where("tbl = 'documents'").select(F.col("row_id").alias("doc_id")).distinct()
    return read_table(spark, sf, "documents").select("doc_id", "url", "source", "lang").join(bad, "doc_id", "left_anti")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode(read_table(spark, sf, "documents"), "doc_id", "text")


def p9_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(read_table(spark, sf, "documents"), read_table(spark, sf, "eval_items"), "doc_id", "text", "item_id", "text")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_leaks(spark, sf).select("doc_id", "item_id")


def p10_truncated(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncated(read_table(spark, sf, "documents"), "doc_id", "text", "source")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return p10_truncated(spark, sf).select("doc_id")


def p10_rates(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.rates(read_table(spark, sf, "documents"), "doc_id", "text", "source")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n[0] == "p" and n[1].isdigit()}


LINES = """lines as (select doc_id, source, unnest(range(len(l))) + 1 as line_no, unnest(l) as n from (
    select doc_id, source, list_transform(string_split(text, chr(10)), lambda x: lower(trim(regexp_replace(regexp_replace(x, '[0-9]+', '0', 'g'), '[ \\t]+', ' ', 'g'), ' '))) as l from documents where text <> '')),
  kept as (select * from lines where regexp_matches(n, '\\S')),
  often as (select source, n, count(distinct doc_id) as docs from kept group by source, n having count(distinct doc_id) >= 5),
  total as (select source, count(*) as total from documents where text <> '' group by source),
  nodes as (select o.source, o.n, o.docs from often o join total t on o.source is not distinct from t.source where o.docs >= 0.05 * t.total - 1e-9)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": f"with {LINES} select k.doc_id, k.line_no::bigint as line_no from kept k join nodes o on k.source is not distinct from o.source and k.n = o.n",
        "p4_clean": f"""with {LINES}, cut as (select doc_id, list(k.line_no) as no from kept k join nodes o on k.source is not distinct from o.source and k.n = o.n group by doc_id)
  select d.doc_id, case when c.no is null then d.text else array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: not list_contains(c.no, i)), chr(10)) end as text from documents d left join cut c using (doc_id)""",
        # blocks: components of kept lines that follow each other in five documents or more (blank lines don't count), by the least line reached
        "p4_blocks": f"""with recursive {LINES}, seq as (select doc_id, source, n, row_number() over (partition by doc_id order by line_no) as i from kept),
  pairs as (select a.source, a.n as a, b.n as b, count(distinct a.doc_id) as docs from seq a join seq b on a.doc_id = b.doc_id and b.i = a.i + 1
    join nodes x on x.source is not distinct from a.source and x.n = a.n join nodes y on y.source is not distinct from b.source and y.n = b.n where a.n <> b.n group by a.source, a.n, b.n having count(distinct a.doc_id) >= 5),
  both_ways as (select source, a, b from pairs union select source, b, a from pairs),
  reach as (select source, n, n as to_n from nodes union select r.source, r.n, e.b from reach r join both_ways e on e.source is not distinct from r.source and e.a = r.to_n),
  comp as (select source, n, min(to_n) as block from reach group by source, n)
  select c.source, count(*) as lines, max(o.docs) as docs from comp c join nodes o on o.source is not distinct from c.source and o.n = c.n group by c.source, c.block""",
    }
