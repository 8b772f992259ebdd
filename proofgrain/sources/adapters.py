"""Payloads of sources turned into document rows.

Each adapter is a row of expressions on a VARIANT item; payloads are parsed once
and exploded, so any number of them runs as one plan. A payload that isn't JSON
or has another shape gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrain.functions.text import filled, strip
from proofgrain.functions.url import norm_url


def get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{path}" if path else "$", kind)


def first(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def prefixed(prefix: str, c: Column) -> Column:
    return F.when(filled(c) != "", F.concat(F.lit(prefix), c))


def inverted_index(c: Column) -> Column:
    """Text of an inverted index (a JSON object word -> positions), words in order of place, then alphabet."""
    m = F.from_json(c, "map<string,array<int>>")
    pairs = F.flatten(F.transform(F.map_entries(m), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " "), F.lit(""))


#: Fixed value: title of the statistics office's one row.
NBS_TITLE = "国家统计局（结构化统计数据，需指标代码深化）"
Spec = tuple[str, Callable[[Column], Column], Callable[[Column], Column], Callable[[Column], Column]]
none = lambda v: F.lit("")
#: name -> (path of the items, url, title, snippet).
ADAPTERS: dict[str, Spec] = {
    "openalex": ("results", lambda v: first(get(v, "doi"), get(v, "id")), lambda v: first(get(v, "display_name"), get(v, "title")), lambda v: first(F.substring(inverted_index(F.to_json(get(v, "abstract_inverted_index", "variant"))), 1, 300), get(v, "display_name"))),
    "crossref": ("message.items", lambda v: prefixed("https://doi.org/", get(v, "DOI")), lambda v: get(v, "title[0]"), lambda v: F.substring(get(v, "abstract"), 1, 300)),
    "semanticscholar": ("data", lambda v: first(get(v, "url"), prefixed("https://www.semanticscholar.org/paper/", get(v, "paperId"))), lambda v: get(v, "title"), lambda v: F.substring(get(v, "abstract"), 1, 300)),
    "pubmed": ("esearchresult.idlist", lambda v: prefixed("https://pubmed.ncbi.nlm.nih.gov/", get(v, "")), lambda v: prefixed("PubMed:", get(v, "")), none),
    "europepmc": ("resultList.result", lambda v: first(prefixed("https://doi.org/", get(v, "doi")), get(v, "id")), lambda v: get(v, "title"), lambda v: F.substring(get(v, "abstractText"), 1, 300)),
    "biorxiv": ("collection", lambda v: prefixed("https://doi.org/", get(v, "doi")), lambda v: get(v, "title"), lambda v: get(v, "abstract")),
    "edgar": ("hits.hits", lambda v: get(v, "url"), lambda v: first(get(v, "display_names"), get(v, "_source.display_names")), none),
    "worldbank": ("", lambda v: get(v, "url"), lambda v: get(v, "name"), none),
    "clinicaltrials": ("studies", lambda v: prefixed("https://clinicaltrials.gov/study/", get(v, "protocolSection.identificationModule.nctId")), lambda v: get(v, "protocolSection.identificationModule.briefTitle"), none),
    "openfda": ("results", lambda v: first(get(v, "openfda.url[0]"), F.concat(F.lit("https://api.fda.gov/drug/label.json?search="), F.col("q"))), lambda v: get(v, "openfda.brand_name[0]"), none),
    "courtlistener": ("results", lambda v: get(v, "absolute_url"), lambda v: get(v, "caseName"), none),
    "dataeuropa": ("result.results", lambda v: get(v, "url"), lambda v: get(v, "title"), none),
    "noaa": ("features", lambda v: prefixed("https://api.weather.gov/alerts/", get(v, "properties.id")), lambda v: get(v, "properties.event"), lambda v: get(v, "properties.headline")),
    "nasa": ("", lambda v: first(get(v, "url"), get(v, "id")), lambda v: get(v, "title"), none),
    "who": ("value", lambda v: first(get(v, "IndicatorLink"), prefixed("https://www.who.int/data/gho/data/indicators/", get(v, "IndicatorCode"))), lambda v: get(v, "IndicatorName"), none),
    "ukdatagov": ("result.results", lambda v: first(get(v, "url"), prefixed("https://www.data.gov.uk/dataset/", get(v, "id"))), lambda v: get(v, "title"), none),
    "searxng": ("results", lambda v: F.when(get(v, "url").startswith("http"), get(v, "url")), lambda v: get(v, "title"), lambda v: get(v, "content")),
    "repositories": ("items", lambda v: get(v, "html_url"), lambda v: get(v, "full_name"), lambda v: get(v, "description")),
}


def adapt(payloads: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    """query_id, pos, url, title, snippet of each item of payloads (query_id, q, payload)."""
    path, url, title, snippet = ADAPTERS[name]
    items = get(F.try_parse_json("payload"), path, "array<variant>")
    d = payloads.select("query_id", "q", F.posexplode(items).alias("pos", "v"))
    d = d.where(F.col("pos") < limit) if limit else d
    return d.select("query_id", "pos", norm_url(url(F.col("v"))).alias("url"), filled(title(F.col("v"))).alias("title"), filled(snippet(F.col("v"))).alias("snippet")).where("url is not null")


#: Items that an adapter takes of a payload at most, where it has a limit.
LIMITS = {"repositories": 10}


def adapt_mixed(payloads: DataFrame, sources: DataFrame, paths: tuple[str, ...] = ()) -> DataFrame:
    """query_id, source, pos, url, title, snippet of the items of payloads of any sources, in one plan.

    ``payloads`` has query_id, source, q, base (the address asked) and payload;
    ``sources`` is a registry (a table of fixed size). A source with a named adapter
    goes by it, another one with JSON by its path and field map (``paths``: the
    different paths of the registry), pages by their links. Payloads are parsed and
    exploded once, whatever the number of adapters.
    """
    known = sources.select(F.col("id").alias("source"), "adapter", "json_items", "item_map")
    p = payloads.join(known, "source").withColumn("json", F.try_parse_json("payload"))
    a, v = F.col("adapter"), F.col("v")
    items, urls, titles, snippets, caps = [F.lit(None).cast(t) for t in ("array<variant>", "string", "string", "string", "int")]
    for name, (path, url, title, snippet) in ADAPTERS.items():
        mine = a == name
        items = F.when(mine, get(F.col("json"), path, "array<variant>")).otherwise(items)
        urls, titles, snippets = (F.when(mine, f(v)).otherwise(x) for f, x in ((url, urls), (title, titles), (snippet, snippets)))
        caps = F.when(mine, F.lit(LIMITS[name])).otherwise(caps) if name in LIMITS else caps
    for path in paths:
        items = F.when(a.isNull() & (F.col("json_items") == path), get(F.col("json"), path, "array<variant>")).otherwise(items)
    fields = get(v, "", "map<string,variant>")
    field = lambda n: F.try_variant_get(F.try_element_at(fields, F.coalesce(F.try_element_at("item_map", F.lit(n)), F.lit(n))), "$", "string")
    plain = lambda n: F.try_variant_get(F.try_element_at(fields, F.lit(n)), "$", "string")
    any_url = F.try_variant_get(F.try_element_at(F.map_values(F.map_filter(fields, lambda k, x: F.try_variant_get(x, "$", "string").startswith("http"))), F.lit(1)), "$", "string")
    own = a.isNull()
    urls = F.when(own, first(field("url"), plain("url"), any_url)).otherwise(urls)
    titles = F.when(own, F.substring(filled(first(field("title"), plain("title"))), 1, 160)).otherwise(titles)
    snippets = F.when(own, F.substring(filled(first(field("snippet"), plain("snippet"), plain("abstract"))), 1, 300)).otherwise(snippets)
    caps = F.when(own, F.lit(5)).otherwise(caps)
    d = p.where("json is not null").select("query_id", "source", "q", "adapter", "item_map", F.posexplode(items).alias("pos", "v")).where(F.coalesce(F.col("pos") < caps, F.lit(True)))
    rows = d.select("query_id", "source", "pos", norm_url(urls).alias("url"), filled(titles).alias("title"), filled(snippets).alias("snippet")).where("url is not null")
    office = p.where((a == "nbs") & (F.trim("payload") != "")).select("query_id", "source", F.lit(0).alias("pos"), F.lit("https://data.stats.gov.cn/").alias("url"), F.lit(NBS_TITLE).alias("title"), F.substring("payload", 1, 200).alias("snippet"))
    pages = p.where("json is null and coalesce(adapter, '') <> 'nbs'").select(F.struct("query_id", "source").alias("query_id"), "base", "payload")
    links = adapt_links(pages).select("query_id.query_id", "query_id.source", "pos", "url", "title", F.lit("").alias("snippet"))
    return rows.union(office).union(links)


def repository_rows(payloads: DataFrame) -> DataFrame:
    """query_id, pos, url, text, repo, stars, citation of the first ten repositories of search payloads."""
    d = payloads.select("query_id", F.posexplode(get(F.try_parse_json("payload"), "items", "array<variant>")).alias("pos", "v")).where(F.col("pos") < LIMITS["repositories"])
    v = F.col("v")
    name, stars = filled(get(v, "full_name")), F.coalesce(get(v, "stargazers_count", "bigint"), F.lit(0))
    text = F.concat(name, F.lit("\n"), filled(get(v, "description")), F.lit("\n⭐"), stars.cast("string"), F.lit("  "), filled(get(v, "language")))
    citation = F.create_map(F.lit("key"), F.concat(F.lit("github-"), F.replace(name, F.lit("/"), F.lit("-"))), F.lit("repo"), name, F.lit("stars"), stars.cast("string"), F.lit("source"), F.lit("github-api"))
    return d.select("query_id", "pos", filled(get(v, "html_url")).alias("url"), text.alias("text"), name.alias("repo"), stars.alias("stars"), citation.alias("citation"))


def adapt_generic(payloads: DataFrame, json_items: str | None, item_map: dict[str, str] | None = None) -> DataFrame:
    """As ``adapt`` for sources described by a path and a field map: the first five items.

    Without a path there are no rows; an item without an address takes its first
    field that holds one.
    """
    m = item_map or {}
    items = get(F.try_parse_json("payload"), json_items, "array<variant>") if json_items else F.lit(None).cast("array<variant>")
    d = payloads.select("query_id", F.posexplode(items).alias("pos", "v")).where("pos < 5")
    v = F.col("v")
    strings = F.map_values(F.map_filter(get(v, "", "map<string,variant>"), lambda k, x: F.try_variant_get(x, "$", "string").startswith("http")))
    any_url = F.try_variant_get(F.try_element_at(strings, F.lit(1)), "$", "string")
    url = first(get(v, m.get("url", "url")), get(v, "url"), any_url)
    title = first(get(v, m.get("title", "title")), get(v, "title"))
    snippet = first(get(v, m.get("snippet", "snippet")), get(v, "snippet"), get(v, "abstract"))
    return d.select("query_id", "pos", norm_url(url).alias("url"), F.substring(filled(title), 1, 160).alias("title"), F.substring(filled(snippet), 1, 300).alias("snippet")).where("url is not null")


def adapt_links(pages: DataFrame, limit: int = 5) -> DataFrame:
    """query_id, pos, url, title of the first distinct links of each result page (query_id, base, payload).

    A page without a labelled link gives the addresses of its bare href attributes.
    A page's links are worked off within its row.
    """
    pattern = r"""(?is)<a[^>]+href=["'](https?://[^"']+?)["'][^>]*>(.*?)</a>"""
    bare_pattern = r"""(?i)href=["'](https?://[^"']+?)["']"""
    text = filled("payload")
    end = lambda c: F.regexp_replace(c, "/+$", "")
    both = F.arrays_zip(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), norm_url).alias("u"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("l"))
    d = pages.select("query_id", text.alias("payload"), F.filter(both, lambda x: x["u"].isNotNull() & (end(x["u"]) != end(filled("base")))).alias("both"))
    first = F.filter("both", lambda x, i: F.array_position(F.col("both.u"), x["u"]) == i + 1)
    labelled = F.transform(first, lambda x: F.struct(x["u"].alias("url"), F.substring(strip(F.regexp_replace(x["l"], "<[^>]+>", "")), 1, 120).alias("title")))
    hrefs = F.array_distinct(F.filter(F.transform(F.regexp_extract_all("payload", F.lit(bare_pattern), F.lit(1)), norm_url), lambda u: u.isNotNull()))
    links = F.when(F.size("both") > 0, labelled).otherwise(F.transform(hrefs, lambda u: F.struct(u.alias("url"), F.lit("").alias("title"))))
    return d.select("query_id", F.posexplode(F.slice(links, 1, limit)).alias("pos", "r")).select("query_id", "pos", "r.url", "r.title")


def arxiv_feed(payloads: DataFrame, limit: int = 10) -> DataFrame:
    """query_id, pos, url, title, snippet, year, arxiv_id of the entries of Atom feeds."""
    xml = F.regexp_replace("payload", r"\sxmlns(:\w+)?=\"[^\"]*\"", "")
    entry = F.from_xml(xml, "entry array<struct<id string, title string, summary string, published string>>")
    d = payloads.select("query_id", F.posexplode(entry["entry"]).alias("pos", "e")).where((F.col("pos") < limit) & (F.length("e.id") > 0))
    new = F.regexp_extract("e.id", r"([0-9]{4}\.[0-9]{4,5})", 1)
    old = F.regexp_extract("e.id", r"([a-z\-]+/[0-9]{7})", 1)
    return d.select("query_id", "pos", F.col("e.id").alias("url"), F.trim("e.title").alias("title"), F.substring(F.trim("e.summary"), 1, 200).alias("snippet"), first(F.substring("e.published", 1, 4), F.lit("n.d.")).alias("year"), first(new, old).alias("arxiv_id"))
