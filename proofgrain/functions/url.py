"""URL functions and predicates, all Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofgrain.functions.text import filled

# Hosts, marks and patterns by which addresses are classed.
ACADEMIC_HOSTS = ("arxiv", "scholar.google.", "cnki", "wanfang", "pubmed", "ncbi.nlm.nih.gov", "nlm.nih.gov", "doi.org", "crossref.org", "semanticscholar.org", "researchgate.net", "ieee.org", "acm.org", "springer.com", "wiley.com", "sciencedirect.com", "nature.com", "biorxiv.org", "medrxiv.org", "ssrn.com", "jstor.org")
GOV_MARKS = ("gov", "people.com", "news.cn")
SELF_MEDIA_MARKS = ("weibo", "zhihu", "toutiao", "mp.weixin")
FORUM_MARKS = ("stackoverflow", "tieba", "forum")
CHALLENGE_MARKS = ("cf-chl", "challenges.cloudflare.com", "cf-turnstile", "checking your browser", "enable cookies and javascript", "are you a human", "just a moment", "captcha")
LOGIN_MARKS = ("/login", "/signin", "/auth", "paywall", "/subscribe", "member only", "/member")
HARD_BLOCK_MARKS = ("status 429", "status 503", "status 403", "challenge", "captcha")
SERP_PARAMS = ("q", "query", "wd", "keyword", "p", "text", "i", "search", "aq", "qt", "type", "kw")
SERP_PATHS = ("/s", "/search", "/web", "/html", "/so", "/weixin", "/sorry", "/search.naver")
SERP_HOSTS = ("baidu.com", "www.baidu.com", "cn.bing.com", "www.bing.com", "bing.com", "sogou.com", "www.sogou.com", "weixin.sogou.com", "duckduckgo.com", "html.duckduckgo.com", "google.com", "www.google.com", "google.com.hk", "so.com", "360.com", "so.toutiao.com", "jisilu.cn")
LINK_HOSTS = ("link.zhihu.com", "link.juejin.cn", "link.csdn.net")


def any_of(words: tuple[str, ...]) -> str:
    """A regex of literal alternatives, safe in Java and RE2."""
    return "|".join("".join("\\" + c if c in r".^$*+?()[]{}|\/" else c for c in w) for w in words)


def domain_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(filled(url), r"https?://([^/]+)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(filled(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query_keys(url: Column) -> Column:
    """Names of the query's parameters in lower case; one without a value counts."""
    q = F.lower(F.regexp_extract(filled(url), r"^[^?#]*\?([^#]*)", 1))
    return F.transform(F.filter(F.split(q, "&", -1), lambda p: p != ""), lambda p: F.substring_index(p, "=", 1))


def source_type(url: Column) -> Column:
    """academic, gov, selfmedia, forum or unknown, by host and address."""
    u = F.lower(filled(url))
    host = F.coalesce(F.nullif(domain_of(url), F.lit("")), u)  # an address without a scheme is its own host
    return (F.when(host.rlike(any_of(ACADEMIC_HOSTS)), "academic").when(u.rlike(any_of(GOV_MARKS)), "gov")
            .when(u.rlike(any_of(SELF_MEDIA_MARKS)), "selfmedia").when(u.rlike(any_of(FORUM_MARKS)), "forum").otherwise("unknown"))


def is_serp(url: Column) -> Column:
    """A search engine's result page: by the start of its path or by a parameter, in any case of letters."""
    path = F.lower(path_of(url))
    starts = F.lit(False)
    for p in SERP_PATHS:
        starts = starts | path.startswith(p)
    return starts | F.arrays_overlap(query_keys(url), F.array(*map(F.lit, SERP_PARAMS)))


def is_serp_host(url: Column) -> Column:
    return domain_of(url).isin(*SERP_HOSTS)


def is_redirector(url: Column, engine: Column) -> Column:
    return ((engine == "Baidu") & path_of(url).startswith("/link")) | domain_of(url).isin(*LINK_HOSTS)


def is_login_wall(url: Column) -> Column:
    return F.lower(filled(url)).rlike(any_of(LOGIN_MARKS))


def is_challenge(html: Column) -> Column:
    return F.lower(filled(html)).rlike(any_of(CHALLENGE_MARKS))


def cooldown_seconds(error: Column) -> Column:
    return F.when(F.lower(filled(error)).rlike(any_of(HARD_BLOCK_MARKS)), 300).otherwise(30)


def norm_url(u: Column) -> Column:
    """//x with https, relative paths dropped, other scheme-less strings prefixed."""
    v = F.trim(filled(u))
    return (F.when(v == "", None).when(v.startswith("//"), F.concat(F.lit("https:"), v)).when(v.startswith("/"), None)
            .when(v.rlike("^https?://"), v).otherwise(F.concat(F.lit("https://"), v)))


def norm_href(href: Column, base: Column) -> Column:
    """An absolute address, or null for what can't be followed."""
    h = filled(href)
    return (F.when(h.rlike("^https?://"), h).when(h.startswith("//"), F.concat(F.lit("https:"), h))
            .when(h.startswith("/") & (domain_of(base) != ""), F.concat(F.regexp_extract(base, r"^(https?://[^/]+)", 1), h)))
