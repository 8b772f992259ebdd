"""Queries on requests, payloads of sources, landing pages, guards and the vault.

Payloads are made of the test tables' rows in the form a source gives them, so
the SQL beside each query states directly what must come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proofgrain.functions.fingerprint import hash_embed
from proofgrain.functions.text import either, keyword_set, rounded
from proofgrain.functions.url import domain_of
from proofgrain.operators import gather, guards, landing, report, route, score, series, verify
from proofgrain.plans import pipeline, routing
from proofgrain.plans.texts import DOMAIN, EST, KEYWORDS, PATH, TOKENS
from proofgrain.session import read_table
from proofgrain.sources import adapters, readers, registry, vault

SQL: dict[str, str] = {}


def built_in_requests(spark: SparkSession, sf: str) -> DataFrame:
    """The requests of every question to the built-in sources chosen for it."""
    q = read_table(spark, sf, "research_queries")
    reg = registry.registry(spark)
    chosen = route.select_sources(route.topics(q), q, reg.where(registry.active("standard"))).join(q.select("query_id", "query"), "query_id")
    return registry.requests(chosen, reg, registry.engines(spark))


_ENGINE_URLS = {e[1]: e[6] for e in registry.ENGINES}
_templates = ", ".join("('{}', '{}', '{}')".format(r["id"], r["method"], (r["url_template"] or _ENGINE_URLS.get(r["engine_id"]) or registry.NBS_REQUEST).replace("'", "''")) for r in registry.builtin())
SQL["built_in_requests"] = f"""with t(source, method, template) as (values {_templates}), r as ({routing.SQL['routed_sources']})
  select r.query_id, t.source, t.method, replace(t.template, '{{q}}', replace(url_encode(q.query), '%2F', '/')) as address from r join t on t.source = r.id join research_queries q on q.query_id = r.query_id"""


def engine_groups(spark: SparkSession, sf: str) -> DataFrame:
    e = registry.engines(spark)
    return e.groupBy("grp").agg(F.count(F.lit(1)).alias("engines"), F.count_if(F.col("search_url").contains("{q}")).alias("templates"), F.count("selector").alias("selectors"))


SQL["engine_groups"] = """select * from (values ('cn', 8, 8, 4), ('global', 9, 9, 3), ('academic', 2, 2, 0), ('vertical/academic-cn', 3, 3, 0), ('vertical/tech-cn', 4, 4, 0), ('vertical/code', 3, 2, 0), ('vertical/finance-cn', 3, 3, 0), ('vertical/social-cn', 3, 3, 0),
  ('vertical/knowledge', 3, 3, 0), ('vertical/news-cn', 3, 3, 0), ('vertical/legal-cn', 2, 1, 0), ('vertical/medical', 1, 1, 0), ('vertical/regional', 4, 4, 0)) t(grp, engines, templates, selectors)"""


def _json(*fields: tuple[str, Column]) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields])


def _sent(spark: SparkSession, sf: str, sources: list[str]) -> DataFrame:
    """serp_docs, each row as the answer of one of the sources, in turn."""
    d = read_table(spark, sf, "serp_docs").select("fetch_id", "url", "title", "snippet")
    return d.withColumn("source", F.array(*map(F.lit, sources))[(F.col("fetch_id") % len(sources)).cast("int")])


ANSWERING = ["OpenAlex", "Crossref", "SemanticScholar", "PubMed", "EuropePMC", "bioRxiv", "SEC_EDGAR", "WorldBank", "ClinicalTrials", "openFDA", "CourtListener", "DataEuropa", "NOAA", "NASA", "WHO", "UKDataGov", "NBS", "InternetArchive"]


def adapted_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of eighteen sources, each in its own form, to rows by one plan."""
    d = _sent(spark, sf, ANSWERING)
    u, t, s, i = F.col("url"), F.col("title"), F.col("snippet"), F.col("fetch_id").cast("string")
    one = lambda **f: F.array(F.struct(*[c.alias(n) for n, c in f.items()]))
    forms = {
        "OpenAlex": _json(("results", one(doi=F.concat(F.lit("https://doi.org/"), i), display_name=t, abstract_inverted_index=F.struct(F.array(F.lit(1)).alias("b"), F.array(F.lit(0), F.lit(2)).alias("a"))))),
        "Crossref": _json(("message", F.struct(one(DOI=i, title=F.array(t), abstract=s).alias("items")))),
        "SemanticScholar": _json(("data", one(paperId=i, title=t, abstract=s))),
        "PubMed": _json(("esearchresult", F.struct(F.array(i).alias("idlist")))),
        "EuropePMC": _json(("resultList", F.struct(one(doi=i, title=t, abstractText=s).alias("result")))),
        "bioRxiv": _json(("collection", one(doi=i, title=t, abstract=s))),
        "SEC_EDGAR": _json(("hits", F.struct(one(url=u, display_names=t).alias("hits")))),
        "WorldBank": None,
        "ClinicalTrials": _json(("studies", one(protocolSection=F.struct(F.struct(i.alias("nctId"), t.alias("briefTitle")).alias("identificationModule"))))),
        "openFDA": _json(("results", one(openfda=F.struct(F.array(u).alias("url"), F.array(t).alias("brand_name"))))),
        "CourtListener": _json(("results", one(absolute_url=u, caseName=t))),
        "DataEuropa": _json(("result", F.struct(one(url=u, title=t).alias("results")))),
        "NOAA": _json(("features", one(properties=F.struct(i.alias("id"), t.alias("event"), s.alias("headline"))))),
        "NASA": None,
        "WHO": _json(("value", one(IndicatorCode=i, IndicatorName=t))),
        "UKDataGov": _json(("result", F.struct(one(id=i, title=t).alias("results")))),
        "InternetArchive": _json(("response", F.struct(one(identifier=u, title=t).alias("docs")))),
    }
    payload = F.when(F.col("source") == "NBS", s).when(F.col("source") == "WorldBank", F.to_json(one(url=u, name=t))).when(F.col("source") == "NASA", F.to_json(one(url=u, title=t)))
    for name, form in forms.items():
        payload = payload.when(F.col("source") == name, F.to_json(form)) if form is not None else payload
    p = d.select(F.col("fetch_id").alias("query_id"), "source", F.lit("q").alias("q"), u.alias("base"), payload.alias("payload"))
    out = adapters.adapt_mixed(p, registry.registry(spark), ("response.docs",))
    return out.select(F.col("query_id").alias("fetch_id"), "source", "url", "title", "snippet")


_u = "case when trim(url) = '' or starts_with(trim(url), '/') and not starts_with(trim(url), '//') then null when starts_with(trim(url), '//') then 'https:' || trim(url) when regexp_matches(trim(url), '^https?://') then trim(url) else 'https://' || trim(url) end"
SQL["adapted_rows"] = f"""with d as (select fetch_id, url, coalesce(title, '') as t, coalesce(snippet, '') as s, snippet, {ANSWERING}[fetch_id % {len(ANSWERING)} + 1] as source from serp_docs), x as (
  select fetch_id, source, case source when 'OpenAlex' then 'https://doi.org/' || fetch_id when 'Crossref' then 'https://doi.org/' || fetch_id when 'SemanticScholar' then 'https://www.semanticscholar.org/paper/' || fetch_id
      when 'PubMed' then 'https://pubmed.ncbi.nlm.nih.gov/' || fetch_id when 'EuropePMC' then 'https://doi.org/' || fetch_id when 'bioRxiv' then 'https://doi.org/' || fetch_id when 'ClinicalTrials' then 'https://clinicaltrials.gov/study/' || fetch_id
      when 'NOAA' then 'https://api.weather.gov/alerts/' || fetch_id when 'WHO' then 'https://www.who.int/data/gho/data/indicators/' || fetch_id when 'UKDataGov' then 'https://www.data.gov.uk/dataset/' || fetch_id
      when 'NBS' then case when trim(snippet) <> '' then 'https://data.stats.gov.cn/' end else {_u} end as url,
    case source when 'PubMed' then 'PubMed:' || fetch_id when 'NBS' then '国家统计局（结构化统计数据，需指标代码深化）' when 'InternetArchive' then substring(t, 1, 160) else t end as title,
    case when source = 'OpenAlex' then 'a b a' when source in ('Crossref', 'SemanticScholar', 'EuropePMC') then substring(s, 1, 300) when source in ('bioRxiv', 'NOAA') then s when source = 'NBS' then substring(s, 1, 200) else '' end as snippet from d)
  select * from x where url is not null"""


def generic_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The first five items of answers described by a path and a field map: one answer a question, of its eight first results."""
    w = W.partitionBy("query_id").orderBy("pos", "fetch_id")
    d = read_table(spark, sf, "serp_docs").select("query_id", "fetch_id", "pos", "url", "title").withColumn("n", F.row_number().over(w)).where("n <= 8")
    items = report.ordered(F.struct(F.col("url").alias("identifier"), "title", F.col("fetch_id").alias("extra")), F.col("n"))
    p = d.groupBy("query_id").agg(items.alias("i")).select("query_id", F.to_json(F.struct(F.struct(F.col("i").alias("docs")).alias("response"))).alias("payload"))
    return adapters.adapt_generic(p, "response.docs", {"url": "identifier", "title": "title"})


SQL["generic_rows"] = f"""with d as (select *, (row_number() over (partition by query_id order by pos, fetch_id) - 1)::int as n from serp_docs)
  select query_id, n as pos, {_u} as url, substring(coalesce(title, ''), 1, 160) as title, '' as snippet from d where n < 5"""


def serp_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The first five links of every page that holds absolute links: here a list of the question's results."""
    w = W.partitionBy("query_id").orderBy("pos", "fetch_id")
    d = read_table(spark, sf, "serp_docs").select("query_id", "fetch_id", "pos", "url").withColumn("n", F.row_number().over(w)).where("n <= 12")
    page = F.array_join(report.ordered(F.concat(F.lit('<li><a class="r" href="'), "url", F.lit('"><b>No. '), F.col("n").cast("string"), F.lit("</b></a>")), F.col("n")), "\n")
    p = d.groupBy("query_id").agg(page.alias("payload")).select("query_id", F.lit("MDN").alias("source"), F.lit("q").alias("q"), F.lit("https://developer.mozilla.org/search?q=q").alias("base"), "payload")
    return adapters.adapt_mixed(p, registry.registry(spark)).select("query_id", "pos", "url", "title")


SQL["serp_rows"] = """with d as (select *, row_number() over (partition by query_id order by pos, fetch_id) as n from serp_docs), f as (select query_id, url, min(n) as n from d where n <= 12 group by all)
  select query_id, (row_number() over (partition by query_id order by n) - 1)::int as pos, url, 'No. ' || n as title from f qualify pos < 5"""


def arxiv_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of Atom feeds, one a document; the fourth has no id."""
    d = read_table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"))
    number = F.concat(F.lit("2301."), F.lpad((F.col("query_id") % 100000).cast("string"), 5, "0"))
    entry = lambda ident, title, day: F.concat(F.lit("<entry><id>"), ident, F.lit("</id><title> "), title, F.lit(" </title><summary>\n s "), F.lit("</summary>"), day, F.lit("</entry>"))
    feed = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), entry(F.concat(F.lit("http://arxiv.org/abs/"), number, F.lit("v2")), F.concat(F.lit("T"), F.col("query_id").cast("string")), F.lit("<published>2023-01-02</published>")),
                    entry(F.lit("http://arxiv.org/abs/hep-th/9901001"), F.lit("old"), F.lit("<published>1999-01-01</published>")), entry(F.lit("other"), F.lit("no date"), F.lit("")), entry(F.lit(""), F.lit("no id"), F.lit("")), F.lit("</feed>"))
    return adapters.arxiv_feed(d.select("query_id", feed.alias("payload")))


SQL["arxiv_rows"] = """select doc_id as query_id, pos, case pos when 0 then 'http://arxiv.org/abs/' || n || 'v2' when 1 then 'http://arxiv.org/abs/hep-th/9901001' else 'other' end as url, case pos when 0 then 'T' || doc_id when 1 then 'old' else 'no date' end as title, 's' as snippet,
    case pos when 0 then '2023' when 1 then '1999' else 'n.d.' end as year, case pos when 0 then n when 1 then 'hep-th/9901001' end as arxiv_id
  from (select doc_id, '2301.' || lpad((doc_id % 100000)::varchar, 5, '0') as n, unnest(range(3))::int as pos from documents)"""


def repository_rows(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "serp_docs").select("fetch_id", F.concat(F.lit("own/r"), F.col("fetch_id").cast("string")).alias("name"), "url", "snippet")
    item = F.struct(F.col("name").alias("full_name"), F.col("snippet").alias("description"), (F.col("fetch_id") % 7).alias("stargazers_count"), F.lit("Py").alias("language"), F.col("url").alias("html_url"))
    p = d.select(F.col("fetch_id").alias("query_id"), F.to_json(F.struct(F.array_repeat(item, 12).alias("items"))).alias("payload"))
    r = adapters.repository_rows(p)
    return r.select(F.col("query_id").alias("fetch_id"), "pos", "url", F.md5("text").alias("text_md5"), "repo", "stars", F.col("citation")["key"].alias("key"))


SQL["repository_rows"] = """select fetch_id, unnest(range(10))::int as pos, url, md5('own/r' || fetch_id || chr(10) || coalesce(snippet, '') || chr(10) || '⭐' || (fetch_id % 7) || '  Py') as text_md5, 'own/r' || fetch_id as repo, fetch_id % 7 as stars, 'github-own-r' || fetch_id as key from serp_docs"""


def citations_article(spark: SparkSession, sf: str) -> DataFrame:
    """Citations with structured fields: an article where there is a DOI, else what is known in the note."""
    d = read_table(spark, sf, "serp_docs").drop("raw_html", "text")
    i = F.col("fetch_id").cast("string")
    m = lambda **k: F.create_map(*[x for n, c in k.items() for x in (F.lit(n), c)])
    cit = (F.when(F.col("fetch_id") % 4 == 0, m(key=F.concat(F.lit("arxiv-"), i), doi=F.concat(F.lit("10.1/"), i), authors=F.lit("X"), year=F.lit("2024"), source=F.lit("arxiv")))
           .when(F.col("fetch_id") % 4 == 1, m(key=F.concat(F.lit("github-"), i), repo=F.lit("owner/repo"), source=F.lit("github-api"))).when(F.col("fetch_id") % 4 == 2, m(doi=F.concat(F.lit("10.2/"), i))))
    return report.citations(d.withColumn("citation", cit), "bibtex")


SQL["citations_article"] = """with first as (select * from serp_docs where length(url) > 0 qualify row_number() over (partition by query_id, url order by pos, fetch_id) = 1),
  c as (select *, row_number() over (partition by query_id order by pos, fetch_id) as n, coalesce(nullif(title, ''), nullif(snippet, ''), url) as label from first)
  select query_id, array_to_string(list(case fetch_id % 4
      when 0 then '@article{arxiv-' || fetch_id || ',' || chr(10) || '  title = {' || label || '},' || chr(10) || '  author = {X},' || chr(10) || '  year = {2024},' || chr(10) || '  doi = {10.1/' || fetch_id || '},' || chr(10) || '  url = {' || url || '}' || chr(10) || '}'
      when 1 then '@misc{github-' || fetch_id || ',' || chr(10) || '  title = {' || label || '},' || chr(10) || '  howpublished = {' || url || '},' || chr(10) || '  note = {repo=owner/repo; source=github-api}' || chr(10) || '}'
      when 2 then '@article{src' || n || ',' || chr(10) || '  title = {' || label || '},' || chr(10) || '  author = {unknown},' || chr(10) || '  year = {n.d.},' || chr(10) || '  doi = {10.2/' || fetch_id || '},' || chr(10) || '  url = {' || url || '}' || chr(10) || '}'
      else '@misc{src' || n || ',' || chr(10) || '  title = {' || label || '},' || chr(10) || '  howpublished = {' || url || '},' || chr(10) || '  note = {' || coalesce(source_type, 'web') || '}' || chr(10) || '}' end order by n), chr(10)) || chr(10) as content from c group by query_id"""


def robots_allowed(spark: SparkSession, sf: str) -> DataFrame:
    """Which result pages their host's rules let a robot read: every host forbids /2024 and /view."""
    u = read_table(spark, sf, "serp_docs").select("fetch_id", "url")
    robots = u.select(domain_of(F.col("url")).alias("domain")).distinct().withColumn("body", F.lit("User-agent: *\nDisallow: /2024 # old\nDISALLOW:/view\nDisallow:\nAllow: /x"))
    v = guards.robots_verdicts(u, guards.disallow_rules(robots))
    return v.select("fetch_id", "allowed", guards.guard_reason(F.col("url"), F.col("allowed"), F.lit(False)).alias("reason"))


SQL["robots_allowed"] = f"""with u as (select fetch_id, lower(coalesce(url, '')) as low, coalesce(nullif({PATH.format('url')}, ''), '/') as path, {DOMAIN.format('url')} as domain,
    list_transform(list_filter(string_split(lower(regexp_extract(coalesce(url, ''), '^[^?#]*\\?([^#]*)', 1)), '&'), lambda p: p <> ''), lambda p: string_split(p, '=')[1]) as keys from serp_docs),
  v as (select fetch_id, low, not (starts_with(path, '/2024') or starts_with(path, '/view')) or starts_with(lower(path), '/s') or starts_with(lower(path), '/web') or starts_with(lower(path), '/html') or starts_with(lower(path), '/weixin')
    or list_has_any(keys, ['q', 'query', 'wd', 'keyword', 'p', 'text', 'i', 'search', 'aq', 'qt', 'type', 'kw']) as allowed from u)
  select fetch_id, allowed, case when regexp_matches(low, '/login|/signin|/auth|paywall|/subscribe|member only|/member') then 'loginwall' when not allowed then 'robots' end as reason from v"""


def dimension_lists(spark: SparkSession, sf: str) -> DataFrame:
    q = read_table(spark, sf, "research_queries").select("query_id", F.posexplode(guards.dimensions(F.col("query"), F.col("tier"))).alias("i", "d"))
    return q.select("query_id", "i", "d.name", "d.detail_level")


SQL["dimension_lists"] = """with d(fin, i, name, lvl) as (values (false, 0, '定义与概念', '简要'), (false, 1, '机制/原理', '详细'), (false, 2, '对比/异同', '简要'), (false, 3, '现状/应用', '简要'), (false, 4, '争议/局限', '简要'),
    (true, 0, '营业收入', '简要'), (true, 1, '归母净利润', '简要'), (true, 2, '每股收益', '简要'), (true, 3, 'ROE', '简要'), (true, 4, '同比变动', '简要'))
  select query_id, i::int as i, name, case when tier = 'L3' then '详细' else lvl end as detail_level from research_queries join d on fin = regexp_matches(lower(coalesce(query, '')), '财报|营收|利润|资产负债|现金流|业绩|季报|年报|中报|一季报|三季报|每股收益|净利润|roe')
  where tier is null or tier not in ('L0', 'L1')"""


def cache_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Of each user's records the newest, if it is of the last day before the newest of all."""
    e = read_table(spark, sf, "events").select(F.col("user_id").cast("string").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("ts"), F.col("event_id").cast("string").alias("val"))
    now = e.agg(F.max("ts")).first()[0] or 0.0
    return readers.cache_lookup(e, e.select("key"), now, 1440).select("key")


SQL["cache_latest"] = "select user_id::varchar as key from events group by user_id having max(epoch_us(ts)) >= (select max(epoch_us(ts)) from events) - 86400000000"


def semantic_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """Each fact with the likest source of its question (hashed vectors) among those that share a keyword."""
    facts = read_table(spark, sf, "fact_verdicts").where("fact is not null").select("query_id", F.col("verdict_id").alias("fact_id"), keyword_set(F.col("fact")).alias("kw"), hash_embed(F.col("fact")).alias("vec"))
    s = read_table(spark, sf, "serp_docs").select("query_id", F.col("fetch_id").alias("pos"), "url", keyword_set(either("snippet")).alias("kw"), hash_embed(F.col("snippet")).alias("vec"))
    return verify.anchor_semantic(facts, s, 0.3).select(F.col("fact_id").alias("verdict_id"), "verdict", "source", rounded(F.col("score"), 6).alias("score"))


_embed = lambda c: f"list_transform(range(64), lambda i: len(list_filter({TOKENS.format(c)}, lambda t: ('0x' || right(md5(t), 2))::int % 64 = i))::double)"
SQL["semantic_anchors"] = f"""with f as (select verdict_id, query_id, {KEYWORDS.format('fact')} as kw, {_embed('fact')} as v from fact_verdicts where fact is not null),
  s as (select fetch_id, query_id, url, {KEYWORDS.format("nullif(snippet, '')")} as kw, {_embed('snippet')} as v from serp_docs),
  fn as (select *, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from f), sn as (select *, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from s),
  p as (select verdict_id, fetch_id, url, case when a.n * b.n > 0 then list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) / (a.n * b.n) else 0.0 end as c from fn a join sn b on a.query_id = b.query_id and list_has_any(a.kw, b.kw)),
  b as (select * from p where c >= 0.3 qualify row_number() over (partition by verdict_id order by c desc, fetch_id) = 1)
  select f.verdict_id, case when b.verdict_id is null then 'UNCERTAIN' else 'TRUE' end as verdict, b.url as source, floor(b.c * 1000000.0 + 0.5) / 1000000.0 as score from f left join b using (verdict_id)"""


def outline_texts(spark: SparkSession, sf: str) -> DataFrame:
    q = read_table(spark, sf, "research_queries").where("query is not null")
    o = vault.outlines(q, guards.dimensions(F.col("query"), F.col("tier")))
    return o.select("query_id", F.md5("content").alias("content_md5"))


SQL["outline_texts"] = f"""with d as ({SQL['dimension_lists']}), l as (select query_id, array_to_string(list((i + 1) || '. [ ] **' || name || '** — 验收: 已获 ≥1 可信来源支撑该维度结论' order by i), chr(10)) as checks from d group by query_id)
  select query_id, md5('# 研究大纲: ' || query || chr(10) || chr(10) || '## 盲点探测' || chr(10) || array_to_string(list_transform(['Domain Expert', 'Skeptic', 'Practitioner', 'Newcomer', 'Adjacent'], lambda v: '- **' || v || ' 视角**：关于「' || query || '」，最关键未明子问题是？'), chr(10))
    || chr(10) || chr(10) || '## 可验证清单' || chr(10) || coalesce(checks, '- [ ] **综合检索**') || chr(10)) as content_md5 from research_queries left join l using (query_id) where query is not null"""


def report_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's orders as the business reports of a firm: the latest, then the years' ends."""
    o = read_table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("code"), F.to_date("o_orderdate").alias("day"), "o_totalprice", "o_orderkey")
    r = o.groupBy("code", "day").agg(F.max("o_totalprice").alias("revenue"), F.max("o_orderkey").alias("k")).select(
        "code", F.concat(F.lit("N"), "code").alias("name"), "day", "revenue", (F.col("revenue") / F.lit(4.0)).alias("profit"), (F.col("k") % 50).cast("double").alias("growth"), F.lit(None).cast("double").alias("profit_growth"),
        (F.col("k") % 7).cast("double").alias("eps"), (F.col("k") % 30).cast("double").alias("roe"), F.lit(2.5).alias("assets"))
    return series.report_text(r, "06-30").select("code", F.md5("text").alias("text_md5"))


_two = lambda x: f"case when ({x}) < 0 and floor(abs({x}) * 100.0 + 0.5) > 0 then '-' else '' end || floor(floor(abs({x}) * 100.0::double + 0.5) / 100)::bigint || '.' || lpad((floor(abs({x}) * 100.0::double + 0.5)::bigint % 100)::varchar, 2, '0')"
_yuan = lambda v: f"case when {v} is null then '—' when abs({v}) >= 1e8 then {_two(f'{v} / 1e8')} || ' 亿元' when abs({v}) >= 1e4 then {_two(f'{v} / 1e4')} || ' 万元' else {_two(v)} || ' 元' end"
SQL["report_texts"] = f"""with r as (select o_custkey::varchar as code, o_orderdate::date as day, max(o_totalprice) as rev, max(o_orderkey) as k from orders group by all),
  x as (select code, day, strftime(day, '%Y-%m-%d') as d, {_yuan('rev')} as rv, {_yuan('(rev / 4.0::double)')} as pf, {_two('(k % 50)::double')} || '%' as gr, {_two('(k % 7)::double')} as eps, {_two('(k % 30)::double')} || '%' as roe from r),
  h as (select code, '# 财报：N' || code || '(' || code || ')' || chr(10) || '最新报告期: ' || d || chr(10) || '营业收入: ' || rv || '（同比 ' || gr || '）' || chr(10) || '归母净利润: ' || pf || '（同比 —）' || chr(10) || '基本每股收益: ' || eps || ' 元  加权平均ROE: ' || roe || '  每股净资产: 2.50 元' as head
    from x qualify row_number() over (partition by code order by day desc) = 1),
  y as (select code, array_to_string(list('- ' || d || '：营收 ' || rv || '（同比 ' || gr || '） | 归母净利润 ' || pf || '（同比 —） | EPS ' || eps || ' | ROE ' || roe order by day desc), chr(10)) as years
    from (select * from x where strftime(day, '%m-%d') = '06-30' qualify row_number() over (partition by code order by day desc) <= 5) group by code)
  select code, md5(head || chr(10) || chr(10) || '近年年度业绩（单位：亿元 / 元；同比%）：' || case when years is null then '' else chr(10) || years end) as text_md5 from h left join y using (code)"""


def landing_hops(spark: SparkSession, sf: str) -> DataFrame:
    """Result pages followed to the pages they lead to: here lists of the question's own results, of which some were fetched."""
    w = W.partitionBy("query_id").orderBy("pos", "fetch_id")
    d = read_table(spark, sf, "serp_docs").select("query_id", "fetch_id", "pos", "url", "text", "engine", "title")
    first = d.withColumn("n", F.row_number().over(w)).where("n <= 4").groupBy("query_id").agg(report.ordered(F.col("url"), F.col("n")).alias("urls"))
    html = F.concat(F.lit('<html><body><a href="/about">About</a><a href="javascript:x">x</a>'), F.array_join(F.transform("urls", lambda u: F.concat(F.lit('<div class="vrwrap"><h3><a href="'), u, F.lit('">r</a></h3></div>'))), ""), F.lit("</body></html>"))
    serp = d.where("pos = 0 or title is null").join(first, "query_id").select("fetch_id", F.lit("https://www.sogou.com/web?query=q").alias("url"), F.when(F.col("fetch_id") % 2 == 0, "Sogou").otherwise(F.col("engine")).alias("engine"), F.when(F.col("fetch_id") % 5 > 0, html).alias("raw_html"))
    pages = d.where("query_id % 3 > 0").select("url", F.col("fetch_id").alias("page_id"), "text")
    out = landing.resolve(serp, pages, registry.engines(spark))
    return out.select("fetch_id", "landing", "landing_url", F.length("text").alias("chars"), "outcome")


SQL["landing_hops"] = r"""with d as (select *, row_number() over (partition by query_id order by pos, fetch_id) as n from serp_docs),
  s as (select fetch_id, query_id from d where (pos = 0 or title is null)),
  u as (select s.fetch_id, d.url, min(d.n) as n from s join d on s.query_id = d.query_id and d.n <= 4 where s.fetch_id % 5 > 0
      and (s.fetch_id % 2 = 0 or not regexp_matches(lower(d.url), '/s\?|/search\?|/web\?|robots\.txt|javascript:|mailto:|#')) group by all),
  t as (select * from u qualify row_number() over (partition by fetch_id order by n) <= 3),
  p as (select url, fetch_id as landing, length(text)::int as chars from serp_docs where query_id % 3 > 0 and length(text) >= 40 qualify row_number() over (partition by url order by fetch_id) = 1),
  b as (select t.fetch_id, p.landing, t.url, p.chars from t join p using (url) qualify row_number() over (partition by t.fetch_id order by t.n) = 1)
  select s.fetch_id, b.landing, b.url as landing_url, coalesce(b.chars, 0)::int as chars, case when b.landing is not null then 'resolved' when not exists (select 1 from t where t.fetch_id = s.fetch_id) then 'no_serp_links' else 'landing_unreachable' end as outcome
  from s left join b on s.fetch_id = b.fetch_id"""


def engine_choice(spark: SparkSession, sf: str) -> DataFrame:
    """The engines of each question, whose intent stands for its domain here, and the results they gave."""
    q = read_table(spark, sf, "research_queries").select("query_id", F.when(F.col("query_id") % 3 == 0, "code").when(F.col("query_id") % 3 == 1, "legal-cn").otherwise(F.col("intent")).alias("domain"))
    d = read_table(spark, sf, "serp_docs").select("query_id", "fetch_id", F.when(F.col("fetch_id") % 4 == 0, "GitHub").when(F.col("fetch_id") % 4 == 1, "Sogou").otherwise("Baidu").alias("engine"))
    return gather.general_search(q, d).select("query_id", "fetch_id", "engine", "at")


SQL["engine_choice"] = """with q as (select query_id, query_id % 3 as m from research_queries), d as (select query_id, fetch_id, case fetch_id % 4 when 0 then 'GitHub' when 1 then 'Sogou' else 'Baidu' end as engine from serp_docs),
  c(m, engine, place) as (values (0, 'GitHub', 0), (0, 'StackOverflow', 1), (0, 'HackerNews', 2), (1, 'GovCN', 0), (1, 'PKULaw', 1), (2, 'Baidu', 0), (2, 'Sogou', 1)),
  g as (select d.*, c.place from d join q using (query_id) join c on c.m = q.m and c.engine = d.engine)
  select query_id, fetch_id, engine, place as "at" from g union all select d.*, 0 from d where engine = 'Baidu' and query_id in (select query_id from research_queries) and query_id not in (select query_id from g)"""


def fanned_out(spark: SparkSession, sf: str) -> DataFrame:
    """Two sources answer every question with the same result, others fail: the first source of the registry keeps the address."""
    q = read_table(spark, sf, "research_queries").select("query_id", "query")
    chosen = q.select("*", F.explode(F.array(*map(F.lit, ("DataEuropa", "CourtListener", "USGS", "NBS")))).alias("id"))
    answer = F.concat(F.lit("https://a.org/"), F.col("query_id").cast("string"))
    forms = {"DataEuropa": F.struct(F.struct(F.array(F.struct(answer.alias("url"), F.lit("E").alias("title"))).alias("results")).alias("result")),
             "CourtListener": F.struct(F.array(F.struct(answer.alias("absolute_url"), F.lit("C").alias("caseName")), F.struct(F.concat(answer, F.lit("/c")).alias("absolute_url"), F.lit("D").alias("caseName"))).alias("results"))}
    payload = F.when(F.col("source") == "USGS", F.lit(None).cast("string")).when((F.col("source") == "NBS") & (F.col("query_id") % 2 == 0), "numbers")
    for n, f in forms.items():
        payload = payload.when(F.col("source") == n, F.to_json(f))
    out = gather.fan_out(chosen, registry.registry(spark), lambda asked: asked.withColumn("payload", payload))
    return out.select("query_id", "source", "pos", "url", "title", "source_type", "quality")


SQL["fanned_out"] = """with s(source, pos, tail, title) as (values ('CourtListener', 0, '', 'C'), ('CourtListener', 1, '/c', 'D')) select query_id, source, pos::int as pos, 'https://a.org/' || query_id || tail as url, title, 'gov' as source_type, 'A' as quality from research_queries, s
  union all select query_id, 'NBS', 0, 'https://data.stats.gov.cn/', '国家统计局（结构化统计数据，需指标代码深化）', 'gov', 'A' from research_queries where query_id % 2 = 0"""


def doi_citations(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents").select("doc_id", F.lpad((F.col("doc_id") % 50).cast("string"), 2, "0").alias("arxiv_id"))
    dois = spark.range(100).select(F.lpad(F.col("id").cast("string"), 2, "0").alias("arxiv_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("10.1/"), F.col("id").cast("string"))).when(F.col("id") % 3 == 1, "").alias("doi"))
    return gather.fill_dois(d, dois).select("doc_id", F.col("citation")["key"].alias("key"), F.col("citation")["doi"].alias("doi"))


SQL["doi_citations"] = "select doc_id, 'arxiv-' || lpad((doc_id % 50)::varchar, 2, '0') as key, case when doc_id % 50 % 3 = 0 then '10.1/' || (doc_id % 50) end as doi from documents"


def asked_again(spark: SparkSession, sf: str) -> DataFrame:
    """Deep questions that have too few documents and budget left."""
    q = read_table(spark, sf, "research_queries").select("query_id", "tier")
    plan = q.withColumns({"budget": score.lookup(F.col("tier"), score.BUDGET, 8000), "max_sources": score.lookup(F.col("tier"), score.MAX_SOURCES, 3)})
    return gather.expansions(plan, read_table(spark, sf, "serp_docs").select("query_id", "snippet"))


_est = EST.format("snippet")
SQL["asked_again"] = f"""with k as (select query_id, count(*) as n, sum({_est})::bigint as used from serp_docs group by query_id), s as (select query_id, tier, coalesce(n, 0) as n, coalesce(used, 0)::bigint as used from research_queries left join k using (query_id))
  select query_id, tier, n, used from s where tier = 'L2' and n < 8 and used < 30000 or tier = 'L3' and n < 20 and used < 100000"""


def leaf_order(spark: SparkSession, sf: str) -> DataFrame:
    """Results by the leaf of the question they were found for: here every third result by each of three leaves."""
    q = read_table(spark, sf, "research_queries").select("query_id", "tier", score.lookup(F.col("tier"), score.MAX_SOURCES, 3).alias("max_sources"))
    leaves = q.select("*", F.posexplode(F.array(*[F.lit(f"leaf {i}") for i in range(3)])).alias("i", "leaf")).withColumn("truncated", F.lit(False))
    d = read_table(spark, sf, "serp_docs").select("query_id", "fetch_id", "pos", F.concat(F.lit("leaf "), (F.col("fetch_id") % 3).cast("string")).alias("leaf"))
    return gather.leaf_documents(leaves, d).select("query_id", "fetch_id", "leaf_at")


SQL["leaf_order"] = "select query_id, fetch_id, (fetch_id % 3)::int as leaf_at from serp_docs join research_queries using (query_id) where tier = 'L3' or fetch_id % 3 < case tier when 'L0' then 1 when 'L1' then 3 when 'L2' then 8 else 3 end"


def dispatched(spark: SparkSession, sf: str) -> DataFrame:
    q = read_table(spark, sf, "research_queries").where("query is not null")
    d = gather.dispatch(q, guards.dimensions(F.col("query"), F.col("tier")))
    return d.select("query_id", "i", F.md5("prompt").alias("prompt_md5"), F.md5("query").alias("query_md5"))


SQL["dispatched"] = f"""select d.query_id, d.i, md5('任务: 调研维度「' || d.name || '」(深度:' || d.detail_level || ')' || chr(10) || '主题: ' || q.query || chr(10) || '时间范围: 不限' || chr(10) || '要求: 获取证据并返回该维度结论与来源' || chr(10) || '禁止: 改写本模板结构') as prompt_md5,
    md5(q.query || '（聚焦维度：' || d.name || '）') as query_md5 from ({SQL['dimension_lists']}) d join research_queries q using (query_id) where q.query is not null"""


def vault_items_left(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence an interrupted run still has to write, numbered on from what was written (results at even places)."""
    d = read_table(spark, sf, "serp_docs").select("query_id", "fetch_id", "pos", "url")
    return gather.persisted(d, d.where("pos % 2 = 0")).select("query_id", "fetch_id", "n")


SQL["vault_items_left"] = """with done as (select distinct query_id, url from serp_docs where pos % 2 = 0), b as (select query_id, count(*) as base from done group by query_id)
  select s.query_id, s.fetch_id, (row_number() over (partition by s.query_id order by s.pos, s.fetch_id) + coalesce(b.base, 0))::int as n from serp_docs s left join b on s.query_id = b.query_id
  where not exists (select 1 from done where done.query_id = s.query_id and done.url = s.url)"""


def vault_indexes(spark: SparkSession, sf: str) -> DataFrame:
    q = read_table(spark, sf, "research_queries").where("query is not null")
    return vault.indexes(q, F.lit("2024-01-01T00:00:00")).select("query_id", "path", F.md5("content").alias("content_md5"))


SQL["vault_indexes"] = """select query_id, substring(sha1(query), 1, 10) || '/INDEX.md' as path, md5('---' || chr(10) || 'created: 2024-01-01T00:00:00' || chr(10) || 'updated: 2024-01-01T00:00:00' || chr(10) || 'tier: ' || coalesce(tier, '') || chr(10) || 'query: ' || query || chr(10)
    || 'hash: ' || substring(sha1(query), 1, 10) || chr(10) || '---' || chr(10) || '# Research Vault: ' || query || chr(10) || chr(10) || '> 状态: 收集中 | 档位: ' || coalesce(tier, '') || chr(10)) as content_md5 from research_queries where query is not null"""


def eval_json(spark: SparkSession, sf: str) -> DataFrame:
    """The offline evaluation as one JSON line: questions, hits and rate of each tier."""
    t = routing.tier_hits(spark, sf).where("tier is not null").select("tier", "n", "hits", rounded(F.col("hits") / F.col("n"), 4).alias("rate"))
    return t.agg(F.to_json(F.array_sort(F.collect_list(F.struct("tier", "n", "hits")))).alias("result"))


SQL["eval_json"] = f"""select '[' || array_to_string(list('{{"tier":"' || tier || '","n":' || n || ',"hits":' || hits || '}}' order by tier), ',') || ']' as result from ({routing.SQL['tier_hits']}) where tier is not null"""


def retrieved(spark: SparkSession, sf: str) -> DataFrame:
    """The composed retrieval over all questions and results: tier, sources and stop of each question."""
    q, d = read_table(spark, sf, "research_queries").select("query_id", "query"), read_table(spark, sf, "serp_docs").drop("raw_html")
    s = pipeline.retrieve(q, d)["summary"]
    return s.select("query_id", "tier", "intent", "n_sources", "token_used", F.col("stop.reason").alias("reason"))


def researched(spark: SparkSession, sf: str) -> DataFrame:
    """The composed research in rounds, each of which finds the results of two places: rounds and evidence of each question."""
    q, d = read_table(spark, sf, "research_queries").select("query_id", "query"), read_table(spark, sf, "serp_docs").drop("raw_html")
    out = pipeline.research(q, lambda open_, n, seen: d.where(F.floor(F.col("pos") / 2) == n).join(open_.select("query_id"), "query_id", "left_semi"), 3, (("revenue", "简要"), ("收入", "简要")))
    return out["iterations"]


QUERIES = [engine_choice, fanned_out, doi_citations, asked_again, leaf_order, dispatched, vault_items_left, vault_indexes, eval_json, retrieved, researched, built_in_requests, engine_groups, adapted_rows, generic_rows, serp_rows, arxiv_rows, repository_rows, citations_article, robots_allowed, dimension_lists, cache_latest, semantic_anchors, outline_texts, report_texts, landing_hops]
