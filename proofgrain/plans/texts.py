"""Queries on texts, addresses and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrain.functions import fingerprint, html, text, url
from proofgrain.functions.text import filled, rounded
from proofgrain.session import read_table

SQL: dict[str, str] = {}
TOKENS = r"list_distinct(regexp_extract_all(coalesce({0}, ''), '[\p{{L}}\p{{N}}_]{{2,}}'))"
KEYWORDS = r"list_distinct(regexp_extract_all(coalesce({0}, ''), '\p{{Nd}}{{2,}}|[A-Za-z\x{{4e00}}-\x{{9fa5}}]{{2,}}'))"
STRIP = r"regexp_replace({0}, '^[\s\x{{3000}}\x{{a0}}]+|[\s\x{{3000}}\x{{a0}}]+$', '', 'g')"
DOMAIN = "lower(regexp_extract(coalesce({0}, ''), 'https?://([^/]+)', 1))"
PATH = "regexp_extract(coalesce({0}, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def token_sets(spark: SparkSession, sf: str) -> DataFrame:
    t = text.token_set(F.col("text"))
    return read_table(spark, sf, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.md5(F.array_join(F.array_sort(t), " ")).alias("tokens_md5"))


SQL["token_sets"] = f"select doc_id, len({TOKENS.format('text')})::int as n_tokens, md5(array_to_string(list_sort({TOKENS.format('text')}), ' ')) as tokens_md5 from documents"


def keyword_sets(spark: SparkSession, sf: str) -> DataFrame:
    t = text.keyword_set(F.col("text"))
    return read_table(spark, sf, "documents").select("doc_id", F.size(t).alias("n_keywords"), F.md5(F.array_join(F.array_sort(t), " ")).alias("keywords_md5"))


SQL["keyword_sets"] = f"select doc_id, len({KEYWORDS.format('text')})::int as n_keywords, md5(array_to_string(list_sort({KEYWORDS.format('text')}), ' ')) as keywords_md5 from documents"


def token_estimates(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents").select("lang", text.token_estimate(F.col("text")).alias("t"))
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("t").alias("tokens"), F.max("t").alias("largest"))


EST = r"floor(len(regexp_extract_all(coalesce({0}, ''), '[\x{{4e00}}-\x{{9fa5}}]')) + (length(coalesce({0}, '')) - len(regexp_extract_all(coalesce({0}, ''), '[\x{{4e00}}-\x{{9fa5}}]'))) / 4.0)::bigint"
SQL["token_estimates"] = f"select lang, count(*) as docs, sum(t)::bigint as tokens, max(t) as largest from (select lang, {EST.format('text')} as t from documents) group by lang"


def masked_snippets(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "serp_docs").select("fetch_id", text.redact(F.col("snippet")).alias("masked"))


MASK = rf"regexp_replace(regexp_replace(regexp_replace({{0}}, '1[3-9]\p{{{{Nd}}}}{{{{9}}}}', '138****0000', 'g'), '\p{{{{Nd}}}}{{{{17}}}}[\p{{{{Nd}}}}Xx]', '{'*' * 17}', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{{{2,}}}}', '***@***', 'g')"
SQL["masked_snippets"] = f"select fetch_id, {MASK.format('snippet')} as masked from serp_docs"


def fact_pieces(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents").select("doc_id", F.posexplode(text.split_facts(F.col("text"))).alias("i", "fact"))
    return d.select("doc_id", "i", F.md5("fact").alias("fact_md5"))


SQL["fact_pieces"] = f"""select doc_id, (unnest(range(len(f))))::int as i, md5(unnest(f)) as fact_md5 from (
  select doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[。！？;；\\n]'), lambda x: {STRIP.format('x')}), lambda x: length(x) > 4) as f from documents)"""


def url_classes(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    return read_table(spark, sf, "serp_docs").select("fetch_id", url.domain_of(u).alias("domain"), url.source_type(u).alias("kind"), url.is_serp(u).alias("serp"),
                                                     url.is_login_wall(u).alias("login"), url.is_challenge(F.col("raw_html")).alias("challenge"))


# written out, not built from the tables of functions/url.py, so that a slip there shows
SQL["url_classes"] = rf"""with u as (select fetch_id, url, lower(coalesce(url, '')) as low, {DOMAIN.format('url')} as domain, lower({PATH.format('url')}) as path, raw_html,
    list_transform(list_filter(string_split(lower(regexp_extract(coalesce(url, ''), '^[^?#]*\?([^#]*)', 1)), '&'), lambda p: p <> ''), lambda p: string_split(p, '=')[1]) as keys from serp_docs)
  select fetch_id, domain,
    case when regexp_matches(coalesce(nullif(domain, ''), low), 'arxiv|scholar\.google\.|cnki|wanfang|pubmed|ncbi\.nlm\.nih\.gov|nlm\.nih\.gov|doi\.org|crossref\.org|semanticscholar\.org|researchgate\.net|ieee\.org|acm\.org|springer\.com|wiley\.com|sciencedirect\.com|nature\.com|biorxiv\.org|medrxiv\.org|ssrn\.com|jstor\.org') then 'academic'
      when contains(low, 'gov') or contains(low, 'people.com') or contains(low, 'news.cn') then 'gov'
      when contains(low, 'weibo') or contains(low, 'zhihu') or contains(low, 'toutiao') or contains(low, 'mp.weixin') then 'selfmedia'
      when contains(low, 'stackoverflow') or contains(low, 'tieba') or contains(low, 'forum') then 'forum' else 'unknown' end as kind,
    (starts_with(path, '/s') or starts_with(path, '/web') or starts_with(path, '/html') or starts_with(path, '/weixin')
      or list_has_any(keys, ['q', 'query', 'wd', 'keyword', 'p', 'text', 'i', 'search', 'aq', 'qt', 'type', 'kw'])) as serp,
    regexp_matches(low, '/login|/signin|/auth|paywall|/subscribe|member only|/member') as login,
    regexp_matches(lower(coalesce(raw_html, '')), 'cf-chl|challenges\.cloudflare\.com|cf-turnstile|checking your browser|enable cookies and javascript|are you a human|just a moment|captcha') as challenge
  from u"""


def page_titles(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "serp_docs")
    return d.select("fetch_id", html.title_of(F.col("raw_html")).alias("page_title"), F.md5(html.strip_tags(F.col("raw_html"))).alias("text_md5"))


SQL["page_titles"] = f"""select fetch_id, substring({STRIP.format("regexp_replace(regexp_extract(coalesce(raw_html, ''), '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')")}, 1, 120) as page_title,
  md5({STRIP.format("regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(raw_html, ''), '(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>', '', 'g'), '(?s)<[^>]+>', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g')").replace('{{3,}}', '{3,}')}) as text_md5 from serp_docs"""


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "serp_docs").select("fetch_id", "url", F.posexplode(html.hrefs(F.col("raw_html"))).alias("i", "href"))
    return d.select("fetch_id", "i", "href", url.norm_href(F.col("href"), F.col("url")).alias("target"))


SQL["page_links"] = f"""select fetch_id, i, href, case when regexp_matches(href, '^https?://') then href when starts_with(href, '//') then 'https:' || href
    when starts_with(href, '/') and {DOMAIN.format('url')} <> '' then regexp_extract(url, '^(https?://[^/]+)', 1) || href end as target
  from (select fetch_id, url, unnest(range(len(h)))::int as i, unnest(h) as href from (
    select fetch_id, url, regexp_extract_all(coalesce(raw_html, ''), '(?is)<a[^>]*\\shref=["'']([^"'']*)["'']', 1) as h from serp_docs))"""


def visible_links(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "serp_docs").where("raw_html is not null")
    return d.select("fetch_id", F.size(html.clean_links(F.col("raw_html"))).alias("n_links"))


def page_texts(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "serp_docs").select("fetch_id", F.md5(html.main_text(F.col("raw_html"))).alias("text_md5"))


SQL["page_texts"] = r"""with p as (select fetch_id, raw_html, string_split_regex(regexp_replace(raw_html, '(?is)<(script|style|noscript)\b[^>]*>.*?</(script|style|noscript)\s*>|<!--.*?-->|<![^>]*>', '<x>', 'g'), '<[^>]*>') as parts from serp_docs),
  t as (select fetch_id, raw_html, list_transform(parts, lambda x: replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&#39;', chr(39)), '&amp;', '&')) as parts from p)
  select fetch_id, case when raw_html is not null then md5(regexp_replace(regexp_replace(regexp_replace(array_to_string(list_filter(list_transform(parts, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')) end as text_md5 from t"""


def simhashes(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "serp_docs")
    return d.select("fetch_id", F.lpad(F.lower(F.hex(fingerprint.simhash(F.concat(filled("snippet"), filled("title"))))), 16, "0").alias("simhash"))


HASHES = f"""toks as (select fetch_id, unnest({TOKENS.format("coalesce(snippet, '') || coalesce(title, '')")}) as t from serp_docs),
  bits as (select fetch_id, count(*) as n, {', '.join(f"2 * sum((('0x' || right(md5(t), 16))::ubigint >> {i}) & 1) > count(*) as b{i}" for i in range(64))} from toks group by fetch_id),
  hashes as (select s.fetch_id, s.query_id, s.pos, s.url, coalesce({' + '.join(f"(case when b{i} then {1 << i}::ubigint else 0::ubigint end)" for i in range(64))}, 0::ubigint) as h from serp_docs s left join bits using (fetch_id))"""
SQL["simhashes"] = f"with {HASHES} select fetch_id, lower(lpad(to_hex(h), 16, '0')) as simhash from hashes"


def embedding_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine of the hashed embeddings of each page's snippet and its question."""
    d = read_table(spark, sf, "serp_docs").select("fetch_id", "query_id", "snippet")
    q = read_table(spark, sf, "research_queries").select("query_id", "query")
    c = fingerprint.cosine(fingerprint.hash_embed(F.col("snippet")), fingerprint.hash_embed(F.col("query")))
    return d.join(q, "query_id").select("fetch_id", rounded(c, 6).alias("cosine"))


_embed = lambda c: f"list_transform(range(64), lambda i: len(list_filter({TOKENS.format(c)}, lambda t: ('0x' || right(md5(t), 2))::int % 64 = i))::double)"
SQL["embedding_overlap"] = f"""select fetch_id, floor((case when na * nb > 0 then dot / (na * nb) else 0.0 end) * 1000000.0 + 0.5) / 1000000.0 as cosine from (
  select fetch_id, list_sum(list_transform(list_zip(a, b), lambda z: z[1] * z[2])) as dot, sqrt(list_sum(list_transform(a, lambda x: x * x))) as na, sqrt(list_sum(list_transform(b, lambda x: x * x))) as nb
  from (select fetch_id, {_embed('snippet')} as a, {_embed('query')} as b from serp_docs join research_queries using (query_id)))"""


def inverted_text(spark: SparkSession, sf: str) -> DataFrame:
    """Word positions of each document, inverted and turned back to text."""
    words = F.split(F.trim(F.regexp_replace(filled("text"), r"\s+", " ")), " ", -1)
    d = read_table(spark, sf, "documents").where(F.trim(F.regexp_replace(filled("text"), r"\s+", " ")) != "")
    index = d.select("doc_id", F.posexplode(words).alias("p", "w")).groupBy("doc_id", "w").agg(F.collect_list("p").alias("ps"))
    pairs = F.flatten(F.collect_list(F.transform("ps", lambda p: F.struct(p.alias("p"), F.col("w").alias("w")))))
    back = index.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ").alias("t"))
    return back.select("doc_id", F.md5("t").alias("text_md5"))


SQL["inverted_text"] = "select doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as text_md5 from documents where trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) <> ''"

QUERIES = [token_sets, keyword_sets, token_estimates, masked_snippets, fact_pieces, url_classes, page_titles, page_links, visible_links, page_texts, simhashes, embedding_overlap, inverted_text]
