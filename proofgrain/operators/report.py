"""Reports: synthesis, layout by dimension, citations, incremental items."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proofgrain.functions.text import either, filled, grams, slug, strip
from proofgrain.operators.control import DIMENSIONS
from proofgrain.operators.score import by_rank, confidence

#: Length of a dimension's snippets by detail.
CAPS = {"极简": 60, "简要": 120, "详细": 300}
UNSURE = ("uncertain", "none", "待定", "")


def ordered(values: Column, order: Column) -> Column:
    """An array aggregate in the given order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), values.alias("v")))), lambda x: x["v"])


def synthesize(scored: DataFrame) -> DataFrame:
    """query_id, findings: the best snippet, an opposing view, sources and confidence."""
    place = F.struct((-F.col("weighted")).alias("w"), "pos", "fetch_id")
    best = F.min_by(F.struct(strip(filled("snippet")).alias("s"), "weighted"), place)
    worst = F.max_by(F.struct(filled("snippet").alias("s"), "weighted"), place)
    named = scored.where(~F.lower(filled("url")).isin("uncertain", "none", ""))
    first = named.withColumn("_n", F.row_number().over(W.partitionBy("query_id").orderBy("pos", "fetch_id"))).where("_n <= 8")
    refs = first.groupBy("query_id").agg(ordered(F.col("url"), F.col("_n")).alias("refs"))
    g = scored.groupBy("query_id").agg(best.alias("b"), worst.alias("w"), F.count(F.lit(1)).alias("n")).join(confidence(scored), "query_id").join(refs, "query_id", "left")
    top = F.when(F.lower(F.col("b.s")).isin(*UNSURE), "（信息不确定）").otherwise(F.col("b.s"))
    opposing = F.when((F.col("n") > 1) & (F.col("w.weighted") < F.col("b.weighted") * F.lit(0.6)), F.concat(F.lit("\n相反观点（低可信源）："), F.substring(F.col("w.s"), 1, 120), F.lit("\n"))).otherwise("")
    sources = F.when(F.size("refs") > 0, F.concat(F.lit("\n来源：\n"), F.array_join(F.transform("refs", lambda u: F.concat(F.lit("- "), u)), "\n"))).otherwise("")
    conf = F.format_string("%.3f", "confidence")
    return g.select("query_id", F.concat(F.lit("先答："), F.substring(top, 1, 300), F.lit("\n"), opposing, sources, F.lit("\n\n置信度："), conf).alias("findings"))


def uncertain_section(unsure: DataFrame) -> DataFrame:
    """query_id, section: at most eight lines of uncertain facts."""
    first = unsure.withColumn("_n", F.row_number().over(W.partitionBy("query_id").orderBy("fact"))).where("_n <= 8")
    lines = ordered(F.concat(F.lit("- "), F.substring("fact", 1, 120), F.lit("（"), F.col("reason"), F.lit("）")), F.col("_n"))
    return first.groupBy("query_id").agg(F.concat(F.lit("\n未确认项：\n"), F.array_join(lines, "\n")).alias("section"))


def schema_layout(scored: DataFrame, dimensions: tuple = DIMENSIONS) -> DataFrame:
    """query_id, layout: a section a dimension, each with the two best sources that match it.

    All dimensions are judged on a row at once; of a query only the rows that are
    shown (its three best, and the two best of each dimension) are gathered.
    """
    spark, n = scored.sparkSession, len(dimensions)
    marks = spark.range(1).select(*[grams(F.lit(name)).alias(f"g{i}") for i, (name, _) in enumerate(dimensions)]).first()  # of the caller's dimensions
    r = scored.select("query_id", F.row_number().over(by_rank()).alias("rank"), filled("snippet").alias("snippet"), filled(either("text", "snippet")).alias("t"))
    r = r.select("query_id", "rank", "snippet", *[functools.reduce(operator.or_, [F.col("t").contains(g) for g in marks[i]]).alias(f"m{i}") for i in range(n)])
    w = W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    hit = [F.col(f"m{i}") & (F.sum(F.col(f"m{i}").cast("int")).over(w) <= 2) for i in range(n)]
    shown = r.select("query_id", "rank", "snippet", F.array(*hit).alias("hits")).where((F.col("rank") <= 3) | F.exists("hits", lambda h: h))
    g = shown.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "snippet", "hits"))).alias("rows"))

    def lines(cap: int, keep) -> Column:
        return F.array_join(F.transform(F.filter("rows", lambda x: keep(x) & (x["snippet"] != "")), lambda x: F.concat(F.lit("- "), F.substring(x["snippet"], 1, cap), F.lit("\n"))), "")

    def hits(i: int):
        return lambda x: x["hits"][i]

    matched = [F.exists("rows", hits(i)) for i in range(n)]
    some = functools.reduce(operator.or_, matched)
    sections = []
    for i, (name, level) in enumerate(dimensions):
        cap = CAPS.get(level, 120)
        rest = lines(cap, lambda x: x["rank"] <= 3) if i == 0 else F.lit("（综合来源见首节；本维度按此框架组织结论）\n")
        body = F.when(matched[i], lines(cap, hits(i))).when(some, "（该维度暂无直接来源）\n").otherwise(rest)
        sections.append(F.concat(F.lit(f"## {name}（{level}）\n"), body))
    return g.select("query_id", F.array_join(F.array(*sections), "\n").alias("layout"))


def cited(sources: DataFrame) -> DataFrame:
    """The sources to cite: the first of each address of a query, numbered from 1."""
    w = W.partitionBy("query_id", "url").orderBy("pos", "fetch_id")
    first = sources.where(F.length("url") > 0).withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    return first.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("pos", "fetch_id"))).withColumn("label", either("title", "snippet", "url"))


def citations(sources: DataFrame, fmt: str = "bibtex") -> DataFrame:
    """query_id, content: the citations of a query in md, bibtex, ris, csl or noteexpress; anything else is bibtex."""
    c, n = cited(sources), F.col("n").cast("string")
    item = {
        "md": F.concat(n, F.lit(". ["), "label", F.lit("]("), "url", F.lit(")")),
        "ris": F.concat(F.lit("TY  - GEN\nTI  - "), "label", F.lit("\nUR  - "), "url", F.lit("\nER  - ")),
        "noteexpress": F.concat(F.lit("#:@文献["), n, F.lit("]\n标题="), "label", F.lit("\nURL="), "url"),
        "csl": F.concat(F.lit('  {\n    "title": '), _quoted(F.col("label")), F.lit(',\n    "URL": '), _quoted(F.col("url")), F.lit("\n  }")),
    }.get(fmt)
    if item is None:
        item = _bibtex(c, n)
    head, sep, tail = {"md": ("\n## 引用\n\n", "\n", "\n"), "csl": ("[\n", ",\n", "\n]")}.get(fmt, ("", "\n", "\n"))
    joined = F.array_join(ordered(item, F.col("n")), sep)
    joined = F.regexp_replace(joined, r"\s+$", "") if fmt == "ris" else joined
    return c.groupBy("query_id").agg(F.concat(F.lit(head), joined, F.lit(tail)).alias("content"))


def _bibtex(c: DataFrame, n: Column) -> Column:
    """An entry: an article if the citation (a map of strings, where the sources have one) has a DOI, else misc with what the citation names in its note."""
    given = lambda k: F.nullif(F.try_element_at("citation", F.lit(k)), F.lit("")) if "citation" in c.columns else F.lit(None).cast("string")
    key = F.coalesce(given("key"), F.concat(F.lit("src"), n))
    named = F.filter(F.array(*[F.concat(F.lit(f"{k}="), given(k)) for k in ("stock_code", "repo", "source")]), lambda x: x.isNotNull())
    note = F.when(F.size(named) > 0, F.array_join(named, "; ")).otherwise(F.coalesce("source_type", F.lit("web")))
    misc = F.concat(F.lit("@misc{"), key, F.lit(",\n  title = {"), "label", F.lit("},\n  howpublished = {"), "url", F.lit("},\n  note = {"), note, F.lit("}\n}"))
    article = F.concat(F.lit("@article{"), key, F.lit(",\n  title = {"), "label", F.lit("},\n  author = {"), F.coalesce(given("authors"), F.lit("unknown")), F.lit("},\n  year = {"), F.coalesce(given("year"), F.lit("n.d.")),
                       F.lit("},\n  doi = {"), given("doi"), F.lit("},\n  url = {"), "url", F.lit("}\n}"))
    return F.when(given("doi").isNotNull(), article).otherwise(misc)


def _quoted(c: Column) -> Column:
    """A JSON string."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def vault_items(sources: DataFrame) -> DataFrame:
    """query_id, item (nn-slug.md) of each cited source, in the order of the directory."""
    name = F.concat(F.when(F.col("n") < 10, F.concat(F.lit("0"), F.col("n").cast("string"))).otherwise(F.col("n").cast("string")), F.lit("-"), slug(F.col("url")), F.lit(".md"))
    return cited(sources).select("query_id", "url", "n", name.alias("item"))


def unseen_items(items: DataFrame, written: DataFrame) -> DataFrame:
    """Items not yet in the report: what an incremental run appends."""
    return items.join(written.select("query_id", "url").distinct(), ["query_id", "url"], "left_anti")
