"""The research vault: item notes, outline, report, citations and state, as rows and as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrain.functions.text import filled, slug
from proofgrain.operators.report import citations, ordered, vault_items
from proofgrain.session import existing

#: File by format of citations, and the points of view of an outline.
FILES = {"md": "references.md", "ris": "references.ris", "csl": "references.csl", "noteexpress": "references.ne", "bibtex": "citations.bib"}
VIEWS = ("Domain Expert", "Skeptic", "Practitioner", "Newcomer", "Adjacent")


def front_matter(c: Column) -> Column:
    """map of the k: v lines between two lines of three dashes."""
    head = F.regexp_extract(filled(c), r"(?s)^---\n(.*?)\n---", 1)
    lines = F.filter(F.split(head, "\n"), lambda x: x.contains(":"))
    return F.map_from_entries(F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value"))))


def item_notes(sources: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, path, content of the note of each cited source."""
    s = vault_items(sources).join(sources.dropDuplicates(["query_id", "url"]).select("query_id", "url", "title", "text", "snippet", "source_type"), ["query_id", "url"]).join(queries.select("query_id", "query"), "query_id")
    content = F.concat(F.lit("---\nstatus: collected\nurl: "), "url", F.lit("\nsource_type: "), F.coalesce("source_type", F.lit("unknown")), F.lit("\n---\n# "), F.coalesce("title", "url"), F.lit("\n\n"),
                       F.substring(F.coalesce(F.nullif("text", F.lit("")), "snippet", F.lit("")), 1, 4000), F.lit("\n"))
    return s.select("query_id", F.concat(slug(F.col("query")), F.lit("/items/"), "item").alias("path"), content.alias("content"))


def outlines(queries: DataFrame, dims: Column) -> DataFrame:
    """query_id, content: points of view, then a checklist of the dimensions."""
    views = F.array_join(F.array(*[F.concat(F.lit(f"- **{v} 视角**：关于「"), F.col("query"), F.lit("」，最关键未明子问题是？")) for v in VIEWS]), "\n")
    checks = F.array_join(F.transform(dims, lambda d, i: F.concat((i + 1).cast("string"), F.lit(". [ ] **"), d["name"], F.lit("** — 验收: 已获 ≥1 可信来源支撑该维度结论"))), "\n")
    return queries.select("query_id", F.concat(F.lit("# 研究大纲: "), "query", F.lit("\n\n## 盲点探测\n"), views, F.lit("\n\n## 可验证清单\n"), F.when(F.size(dims) == 0, "- [ ] **综合检索**").otherwise(checks), F.lit("\n")).alias("content"))


def indexes(queries: DataFrame, now: Column) -> DataFrame:
    """query_id, path, content of each vault's index: front matter and state."""
    head = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("created: "), now), F.concat(F.lit("updated: "), now), F.concat(F.lit("tier: "), filled("tier")), F.concat(F.lit("query: "), "query"), F.concat(F.lit("hash: "), slug(F.col("query"))), F.lit("---"))
    body = F.concat(F.lit("\n# Research Vault: "), "query", F.lit("\n\n> 状态: 收集中 | 档位: "), filled("tier"), F.lit("\n"))
    return queries.select("query_id", F.concat(slug(F.col("query")), F.lit("/INDEX.md")).alias("path"), F.concat(head, body).alias("content"))


def reports(notes: DataFrame) -> DataFrame:
    """query_id, content: the notes of a query in the order of their file names."""
    return notes.groupBy("query_id").agg(F.array_join(ordered(F.col("content"), F.col("path")), "\n").alias("content"))


def citation_files(sources: DataFrame, queries: DataFrame, fmt: str = "bibtex") -> DataFrame:
    """path, content of each query's citation file; an unknown format is bibtex."""
    name = FILES.get((fmt or "bibtex").lower(), FILES["bibtex"])
    return citations(sources, (fmt or "bibtex").lower()).join(queries.select("query_id", "query"), "query_id").select(F.concat(slug(F.col("query")), F.lit(f"/{name}")).alias("path"), "content")


def save_state(done: DataFrame, path: str) -> None:
    """Addresses worked off so far (query_id, url), as parquet."""
    done.select("query_id", "url").write.mode("append").parquet(path)


def load_state(spark: SparkSession, path: str) -> DataFrame:
    """The saved addresses; none if nothing was saved."""
    held = existing(spark, path)
    return spark.createDataFrame([], "query_id bigint, url string") if held is None else held.distinct()
