"""The built-in sources and engines, and which of them a query goes to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Id, name, category, method, engine, address template, access, key, source type, quality, kind of response, adapter, path of the items, map of their fields, gate, tags.
#: {q} stands for the query, {contact} for a mail address that one source asks for, {searxng_url} for the caller's own instance.
SOURCES = (
    ("Google", "Google", "intl_engines", "serp_cfg", "Google", None, "keyless", None, "unknown", "B", None, None, None, None, None, ("通用", "英文")),
    ("GoogleHK", "Google 香港", "intl_engines", "serp_cfg", "GoogleHK", None, "keyless", None, "unknown", "B", None, None, None, None, None, ("通用", "中文国际")),
    ("DuckDuckGo", "DuckDuckGo", "intl_engines", "serp_cfg", "DuckDuckGo", None, "keyless", None, "unknown", "B", None, None, None, None, None, ("隐私", "通用")),
    ("Yahoo", "Yahoo", "intl_engines", "serp_cfg", "Yahoo", None, "keyless", None, "unknown", "B", None, None, None, None, None, ("通用",)),
    ("Startpage", "Startpage", "intl_engines", "serp_cfg", "Startpage", None, "keyless", None, "unknown", "B", None, None, None, None, None, ("隐私", "Google结果")),
    ("Brave", "Brave", "intl_engines", "serp_cfg", "Brave", None, "keyless", None, "unknown", "B", None, None, None, None, None, ("隐私", "通用")),
    ("Ecosia", "Ecosia", "intl_engines", "serp_cfg", "Ecosia", None, "keyless", None, "unknown", "B", None, None, None, None, None, ("通用", "环保")),
    ("Qwant", "Qwant", "intl_engines", "serp_cfg", "Qwant", None, "keyless", None, "unknown", "B", None, None, None, None, None, ("隐私", "欧洲")),
    ("WolframAlpha", "WolframAlpha", "intl_engines", "serp_cfg", "WolframAlpha", None, "keyless", None, "unknown", "B", None, None, None, None, None, ("计算", "事实", "数据")),
    ("Wikipedia", "Wikipedia", "reference", "serp_cfg", "Wikipedia", None, "keyless", None, "academic", "A", None, None, None, None, None, ("百科", "事实")),
    ("Wikidata", "Wikidata", "reference", "serp_cfg", "Wikidata", None, "keyless", None, "academic", "A", None, None, None, None, None, ("结构化知识",)),
    ("InternetArchive", "Internet Archive", "reference", "rest", None, "https://archive.org/advancedsearch.php?q={q}&fl[]=identifier&fl[]=title&rows=5&output=json", "keyless", None, "academic", "A", "json", None, "response.docs", {"url": "identifier", "title": "title"}, None, ("存档", "书籍", "数据集")),
    ("OpenAlex", "OpenAlex", "academic_api", "rest", None, "https://api.openalex.org/works?search={q}&per-page=5&mailto={contact}", "keyless", None, "academic", "A", "json", "openalex", None, None, None, ("文献", "2.5亿", "CC0")),
    ("Crossref", "Crossref", "academic_api", "rest", None, "https://api.crossref.org/works?query={q}&rows=5", "keyless", None, "academic", "A", "json", "crossref", None, None, None, ("DOI", "1.67亿")),
    ("SemanticScholar", "Semantic Scholar", "academic_api", "rest", None, "https://api.semanticscholar.org/graph/v1/paper/search?query={q}&limit=5&fields=title,url,abstract,year", "keyless", None, "academic", "A", "json", "semanticscholar", None, None, None, ("引用图", "2亿")),
    ("PubMed", "PubMed", "academic_api", "rest", None, "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/esearch.fcgi?db=pubmed&term={q}&retmode=json&retmax=5", "keyless", None, "academic", "A", "json", "pubmed", None, None, None, ("生物医学",)),
    ("EuropePMC", "Europe PMC", "academic_api", "rest", None, "https://www.ebi.ac.uk/europepmc/webservices/rest/search?query={q}&format=json&pageSize=5", "keyless", None, "academic", "A", "json", "europepmc", None, None, None, ("4600万文献",)),
    ("bioRxiv", "bioRxiv", "academic_api", "rest", None, "https://api.biorxiv.org/details/{q}/0", "keyless", None, "academic", "A", "json", "biorxiv", None, None, None, ("预印本",)),
    ("arXiv", "arXiv", "academic_api", "serp_cfg", "arXiv", None, "keyless", None, "academic", "A", None, None, None, None, None, ("预印本",)),
    ("W3C", "W3C", "authoritative", "serp", None, "https://www.w3.org/Search/query.php?q={q}", "keyless", None, "gov", "A", "html", None, None, None, None, ("Web标准",)),
    ("IETF", "IETF RFC", "authoritative", "serp", None, "https://www.rfc-editor.org/search?q={q}", "keyless", None, "gov", "A", "html", None, None, None, None, ("互联网协议",)),
    ("WHATWG", "WHATWG", "authoritative", "serp", None, "https://html.spec.whatwg.org/multipage/#toc", "keyless", None, "gov", "A", "html", None, None, None, None, ("HTML活标准",)),
    ("MDN", "MDN", "authoritative", "serp", None, "https://developer.mozilla.org/search?q={q}", "keyless", None, "vendor", "A", "html", None, None, None, None, ("Web技术参考",)),
    ("Unicode", "Unicode", "authoritative", "serp", None, "https://home.unicode.org/?s={q}", "keyless", None, "gov", "A", "html", None, None, None, None, ("字符集",)),
    ("TC39", "TC39", "authoritative", "serp", None, "https://github.com/tc39/proposals/search?q={q}", "keyless", None, "vendor", "A", "html", None, None, None, None, ("JS语言标准",)),
    ("OpenAPI", "OpenAPI", "authoritative", "serp", None, "https://spec.openapis.org/search?q={q}", "keyless", None, "vendor", "A", "html", None, None, None, None, ("API规范",)),
    ("GitHub", "GitHub", "authoritative", "serp_cfg", "GitHub", None, "keyless", None, "vendor", "A", None, None, None, None, None, ("代码", "开源")),
    ("SEC_EDGAR", "SEC EDGAR", "industry_keyless", "rest", None, "https://efts.sec.gov/LATEST/search-index?q={q}", "keyless", None, "gov", "A", "json", "edgar", None, None, None, ("金融", "美股申报")),
    ("WorldBank", "World Bank Open Data", "industry_keyless", "rest", None, "https://api.worldbank.org/v2/search/{q}?format=json", "keyless", None, "gov", "A", "json", "worldbank", None, None, None, ("宏观", "发展")),
    ("ClinicalTrials", "ClinicalTrials.gov v2", "industry_keyless", "rest", None, "https://clinicaltrials.gov/api/v2/studies?query.term={q}&pageSize=5", "keyless", None, "academic", "A", "json", "clinicaltrials", None, None, None, ("医疗", "临床试验")),
    ("openFDA", "openFDA", "industry_keyless", "rest", None, "https://api.fda.gov/drug/label.json?search={q}&limit=5", "keyless", None, "gov", "A", "json", "openfda", None, None, None, ("药品", "不良事件")),
    ("CourtListener", "CourtListener", "industry_keyless", "rest", None, "https://www.courtlistener.com/api/rest/v4/search/?q={q}&type=o&format=json", "keyless", None, "gov", "A", "json", "courtlistener", None, None, None, ("法律", "判例")),
    ("DataEuropa", "data.europa.eu", "industry_keyless", "rest", None, "https://data.europa.eu/api/hub/search/datasets?q={q}&limit=5", "keyless", None, "gov", "A", "json", "dataeuropa", None, None, None, ("欧盟开放数据",)),
    ("NOAA", "NOAA", "industry_keyless", "rest", None, "https://api.weather.gov/alerts?q={q}", "keyless", None, "gov", "A", "json", "noaa", None, None, None, ("气象", "海洋")),
    ("USGS", "USGS", "industry_keyless", "rest", None, "https://api.water.usgs.gov/observations?q={q}", "keyless", None, "gov", "A", "json", None, None, None, None, ("地质", "地球科学")),
    ("NASA", "NASA (data.nasa.gov)", "industry_keyless", "rest", None, "https://data.nasa.gov/resource/gh9g-ax6g.json?q={q}", "keyless", None, "gov", "A", "json", "nasa", None, None, None, ("航天", "地球科学")),
    ("IMF", "IMF DataMapper", "industry_keyless", "rest", None, "https://www.imf.org/external/datamapper/api/v1/{q}", "keyless", None, "gov", "A", "json", None, None, None, None, ("经济", "宏观")),
    ("OECD", "OECD SDMX", "industry_keyless", "rest", None, "https://sdmx.oecd.org/public/rest/data/OECD.SDD.DSD_EO@DF_EO_ALL?q={q}", "keyless", None, "gov", "A", "json", None, None, None, None, ("经济", "OECD")),
    ("WHO", "WHO GHO OData", "industry_keyless", "rest", None, "https://ghoapi.azureedge.net/api/Indicator?$filter=substringof('{q}',IndicatorName)", "keyless", None, "gov", "A", "json", "who", None, None, None, ("卫生", "指标")),
    ("CDC", "CDC Socrata", "industry_keyless", "rest", None, "https://data.cdc.gov/resource.json?q={q}", "keyless", None, "gov", "A", "json", None, None, None, None, ("公卫", "美国")),
    ("ECDC", "ECDC", "industry_keyless", "rest", None, "https://opendata.ecdc.europa.eu/api/v1/{q}", "keyless", None, "gov", "A", "json", None, None, None, None, ("欧洲疾控",)),
    ("UKDataGov", "UK data.gov.uk", "industry_keyless", "rest", None, "https://www.data.gov.uk/api/3/action/package_search?q={q}&rows=5", "keyless", None, "gov", "A", "json", "ukdatagov", None, None, None, ("英国政府", "开放数据")),
    ("RePEc", "RePEc·IDEAS", "industry_keyless", "serp", None, "https://ideas.repec.org/cgi-bin/htsearch?words={q}", "keyless", None, "academic", "A", "html", None, None, None, None, ("经济", "文献")),
    ("Mojeek", "Mojeek", "privacy_extra", "serp_cfg", "Mojeek", None, "keyless", None, "unknown", "B", None, None, None, None, None, ("独立索引",)),
    ("MetaGer", "MetaGer", "privacy_extra", "serp", None, "https://metager.de/en/search?q={q}", "keyless", None, "unknown", "B", "html", None, None, None, None, ("德国隐私", "元索引")),
    ("SearxNG", "SearxNG", "privacy_extra", "serp", None, "{searxng_url}/search?q={q}", "keyless", None, "unknown", "A", "html", None, None, None, "searxng", ("自托管", "聚合")),
    ("StdOpen", "国家标准全文公开系统", "cn_official", "serp", None, "https://openstd.samr.gov.cn/bzgk/gb/index?q={q}", "keyless", None, "gov", "A", "html", None, None, None, None, ("标准", "全文")),
    ("FlkNPC", "国家法律法规数据库", "cn_official", "serp", None, "https://flk.npc.gov.cn/fl.html#/keyword/{q}", "keyless", None, "gov", "A", "html", None, None, None, None, ("法律", "全文")),
    ("Gsxt", "国家企业信用信息公示系统", "cn_official", "serp", None, "https://www.gsxt.gov.cn/corp-query-search-1.html?key={q}", "keyless", None, "gov", "A", "html", None, None, None, None, ("企业", "信用")),
    ("GovCN", "中国政府网", "cn_official", "serp_cfg", "GovCN", None, "keyless", None, "gov", "A", None, None, None, None, None, ("政策", "公报")),
    ("NBS", "国家统计局", "cn_official", "rest_adapter", None, None, "keyless", None, "gov", "A", None, "nbs", None, None, None, ("统计", "宏观经济")),
    ("NSFC", "国家自然科学基金委", "cn_official", "serp", None, "https://www.nsfc.gov.cn/search?q={q}", "keyless", None, "gov", "B", "html", None, None, None, None, ("科研资助",)),
    ("CAS", "中国科学院", "cn_official", "serp", None, "https://www.cas.cn/search/?q={q}", "keyless", None, "gov", "B", "html", None, None, None, None, ("科研", "成果")),
    ("NCpssd", "国家哲学社会科学文献中心", "cn_official", "serp", None, "https://ncpssd.org/axSearch#gsc.tab=0&q={q}", "keyless_meta", None, "academic", "A", "html", None, None, None, None, ("中文学术", "题录")),
    ("CNKI", "中国知网", "cn_official", "serp_cfg", "CNKI", None, "keyless_meta", None, "academic", "B", None, None, None, None, None, ("中文学术", "摘要题录")),
    ("WanFang", "万方数据", "cn_official", "serp_cfg", "WanFang", None, "keyless_meta", None, "academic", "B", None, None, None, None, None, ("中文学术", "摘要")),
    ("NSTL", "国家科技图书文献中心", "cn_official", "serp", None, "https://www.nstl.gov.cn/search.html?q={q}", "keyless_meta", None, "academic", "A", "html", None, None, None, None, ("科技文献", "题录")),
    ("NMPA", "国家药监局", "cn_official", "serp", None, "https://www.nmpa.gov.cn/WS04/CL2042/", "keyless", None, "gov", "A", "html", None, None, None, None, ("药品", "医疗器械")),
    ("ChiCTR", "中国临床试验注册中心", "cn_official", "serp", None, "http://www.chictr.org.cn/searchproj.html?searchType=all&keywords={q}", "keyless", None, "academic", "A", "html", None, None, None, None, ("临床试验",)),
    ("NHC", "国家卫生健康委员会", "cn_official", "serp", None, "http://www.nhc.gov.cn/search/{q}.html", "keyless", None, "gov", "B", "html", None, None, None, None, ("卫生政策",)),
    ("NSIDC", "国家科技基础条件平台", "cn_official", "serp", None, "https://www.escience.org.cn/search?q={q}", "keyless", None, "gov", "A", "html", None, None, None, None, ("科学数据",)),
    ("Tavily", "Tavily", "ai_search", "rest", None, "https://api.tavily.com/search?query={q}", "keyed", "TAVILY_API_KEY", "vendor", "A", "json", None, None, None, None, ("Agent搜索", "引用富")),
    ("Exa", "Exa", "ai_search", "rest", None, "https://api.exa.ai/search?q={q}", "keyed", "EXA_API_KEY", "vendor", "A", "json", None, None, None, None, ("神经语义检索",)),
    ("Perplexity", "Perplexity", "ai_search", "rest", None, "https://api.perplexity.ai/chat/completions", "keyed", "PERPLEXITY_API_KEY", "vendor", "A", "json", None, None, None, None, ("带引用答案",)),
    ("BraveAPI", "Brave Search API", "ai_search", "rest", None, "https://api.search.brave.com/res/v1/web/search?q={q}", "keyed", "BRAVE_API_KEY", "unknown", "A", "json", None, None, None, None, ("独立索引API",)),
)
#: Group, id, name, region or access, freshness, strengths, address template, programming interface.
ENGINES = (
    ("cn", "Baidu", "百度", "CN", "中", ("通用", "中文网页"), "https://www.baidu.com/s?wd={q}", None),
    ("cn", "BingCN", "必应中国", "CN", "中", ("通用", "学术"), "https://cn.bing.com/search?q={q}", None),
    ("cn", "BingINT", "必应国际", "INT", "中", ("英文", "学术"), "https://www.bing.com/search?q={q}", None),
    ("cn", "360", "360搜索", "CN", "低", ("通用",), "https://www.so.com/s?q={q}", None),
    ("cn", "Sogou", "搜狗", "CN", "中", ("通用", "微信外链"), "https://www.sogou.com/web?query={q}", None),
    ("cn", "WeChat", "微信", "CN", "高", ("公众号", "中文深度"), "https://weixin.sogou.com/weixin?type=2&query={q}", None),
    ("cn", "Toutiao", "头条", "CN", "高", ("资讯", "时效"), "https://so.toutiao.com/search?keyword={q}", None),
    ("cn", "Jisilu", "集思录", "CN", "高", ("金融数据", "固收"), "https://www.jisilu.cn/search?q={q}", None),
    ("global", "Google", "Google", "INT", "中", ("通用", "英文"), "https://www.google.com/search?q={q}", None),
    ("global", "GoogleHK", "Google香港", "INT", "中", ("通用", "中文国际"), "https://www.google.com.hk/search?q={q}", None),
    ("global", "DuckDuckGo", "DuckDuckGo", "INT", "中", ("隐私", "通用"), "https://html.duckduckgo.com/html/?q={q}", None),
    ("global", "Yahoo", "Yahoo", "INT", "低", ("通用",), "https://search.yahoo.com/search?p={q}", None),
    ("global", "Startpage", "Startpage", "INT", "中", ("隐私", "Google结果"), "https://www.startpage.com/sp/search?query={q}", None),
    ("global", "Brave", "Brave", "INT", "中", ("隐私", "通用"), "https://search.brave.com/search?q={q}", None),
    ("global", "Ecosia", "Ecosia", "INT", "低", ("通用", "环保"), "https://www.ecosia.org/search?q={q}", None),
    ("global", "Qwant", "Qwant", "INT", "中", ("隐私", "欧洲"), "https://www.qwant.com/?q={q}", None),
    ("global", "WolframAlpha", "WolframAlpha", "INT", "高", ("计算", "事实", "数据"), "https://www.wolframalpha.com/input?i={q}", None),
    ("academic", "arXiv", "arXiv", "academic", None, ("论文预印本",), "https://arxiv.org/search/?searchtype=all&query={q}", None),
    ("academic", "SemanticScholar", "Semantic Scholar", "academic", None, ("论文", "引用"), "https://www.semanticscholar.org/search?q={q}&sort=relevance", None),
    ("vertical/academic-cn", "BaiduScholar", "百度学术", "free", None, ("中文学术",), "https://xueshu.baidu.com/s?wd={q}", None),
    ("vertical/academic-cn", "CNKI", "中国知网", "free", None, ("中文学术文献",), "https://kns.cnki.net/kns8s/defaultresult/index?kw={q}", None),
    ("vertical/academic-cn", "WanFang", "万方", "free", None, ("中文学术文献",), "https://www.wanfangdata.com.cn/search?q={q}", None),
    ("vertical/tech-cn", "CSDN", "CSDN", "free", None, ("技术博客",), "https://so.csdn.net/so/search?q={q}", None),
    ("vertical/tech-cn", "Juejin", "掘金", "free", None, ("技术文章",), "https://juejin.cn/search?query={q}", None),
    ("vertical/tech-cn", "cnblogs", "博客园", "free", None, (".NET/开发",), "https://www.cnblogs.com/search?q={q}", None),
    ("vertical/tech-cn", "Gitee", "Gitee", "free", None, ("中文开源",), "https://search.gitee.com/?q={q}", None),
    ("vertical/code", "GitHub", "GitHub", "free", None, ("代码/开源/趋势",), "https://github.com/search?q={q}", None),
    ("vertical/code", "StackOverflow", "Stack Overflow", "free", None, ("编程问答",), "https://stackoverflow.com/search?q={q}", None),
    ("vertical/code", "HackerNews", "Hacker News", "free", None, ("技术舆情",), None, "https://hn.algolia.com/api/v1/search?query={q}"),
    ("vertical/finance-cn", "Xueqiu", "雪球", "free", None, ("个股/观点",), "https://xueqiu.com/search?q={q}", None),
    ("vertical/finance-cn", "Eastmoney", "东方财富", "free", None, ("行情/研报",), "https://so.eastmoney.com/web/s?keyword={q}", None),
    ("vertical/finance-cn", "SinaFin", "新浪财经", "free", None, ("财经新闻",), "https://search.sina.com.cn/?q={q}", None),
    ("vertical/social-cn", "Zhihu", "知乎", "free", None, ("高质量问答",), "https://www.zhihu.com/search?type=content&q={q}", None),
    ("vertical/social-cn", "Weibo", "微博", "free", None, ("实时舆情",), "https://s.weibo.com/weibo?q={q}", None),
    ("vertical/social-cn", "Bilibili", "B站", "free", None, ("视频/评测",), "https://search.bilibili.com/all?keyword={q}", None),
    ("vertical/knowledge", "Wikipedia", "维基百科", "free", None, ("通用知识",), "https://en.wikipedia.org/wiki/Special:Search?search={q}", None),
    ("vertical/knowledge", "BaiduBaike", "百度百科", "free", None, ("中文概念",), "https://baike.baidu.com/item/{q}", None),
    ("vertical/knowledge", "Wikidata", "Wikidata", "free", None, ("结构化知识",), "https://www.wikidata.org/w/index.php?search={q}", None),
    ("vertical/news-cn", "Xinhua", "新华网", "free", None, ("权威央媒",), "https://so.news.cn/search?keyword={q}", None),
    ("vertical/news-cn", "People", "人民网", "free", None, ("权威央媒",), "http://search.people.com.cn/rmw/english/search?keyword={q}", None),
    ("vertical/news-cn", "Kr36", "36氪", "free", None, ("科技商业",), "https://36kr.com/search/articles/{q}", None),
    ("vertical/legal-cn", "GovCN", "中国政府网", "free", None, ("政策法规",), "https://sousuo.www.gov.cn/zcwjk/policyRelease/policyReleaseResult.htm?q={q}", None),
    ("vertical/legal-cn", "PKULaw", "北大法宝", "free", None, ("法律检索",), "https://www.pkulaw.com/", None),
    ("vertical/medical", "PubMed", "PubMed", "free", None, ("医学文献",), "https://pubmed.ncbi.nlm.nih.gov/?term={q}", None),
    ("vertical/regional", "Yandex", "Yandex", "free", None, ("俄语区",), "https://yandex.com/search/?text={q}", None),
    ("vertical/regional", "Naver", "Naver", "free", None, ("韩语区",), "https://search.naver.com/search.naver?query={q}", None),
    ("vertical/regional", "Mojeek", "Mojeek", "free", None, ("独立索引",), "https://www.mojeek.com/search?q={q}", None),
    ("vertical/regional", "Marginalia", "Marginalia", "free", None, ("老网页",), "https://search.marginalia.nu/search?query={q}", None),
)
#: Where an engine's result pages hold the links of their results.
RESULT_SELECTORS = {
    "Baidu": "div[class*='c-container'] h3 a",
    "BingCN": "li.b_algo h2 a",
    "BingINT": "li.b_algo h2 a",
    "DuckDuckGo": "a.result__a",
    "Sogou": "div.vrwrap h3 a, div.rb h3 a",
    "Google": "div.g a h3",
    "GoogleHK": "div.g a h3",
}
# Topics of sources, of categories, and the categories of each tier.
SOURCE_TOPICS = {
    "SEC_EDGAR": ("finance", "corp"),
    "WorldBank": ("macro", "gov"),
    "ClinicalTrials": ("health",),
    "openFDA": ("health",),
    "CourtListener": ("legal",),
    "DataEuropa": ("gov",),
    "NOAA": ("climate",),
    "USGS": ("climate",),
    "NASA": ("climate",),
    "IMF": ("macro",),
    "OECD": ("macro",),
    "WHO": ("health",),
    "CDC": ("health",),
    "ECDC": ("health",),
    "UKDataGov": ("gov",),
    "RePEc": ("academic", "macro"),
    "StdOpen": ("cn_official",),
    "FlkNPC": ("legal", "cn_official"),
    "Gsxt": ("corp", "gov"),
    "GovCN": ("gov", "cn_official"),
    "NBS": ("gov", "macro", "cn_official"),
    "NSFC": ("academic", "cn_official"),
    "CAS": ("academic", "cn_official"),
    "NCpssd": ("academic", "cn_official"),
    "CNKI": ("academic", "cn_official"),
    "WanFang": ("academic", "cn_official"),
    "NSTL": ("academic", "cn_official"),
    "NMPA": ("health", "cn_official"),
    "ChiCTR": ("health", "academic", "cn_official"),
    "NHC": ("health", "gov", "cn_official"),
    "NSIDC": ("gov", "climate", "cn_official"),
}
#: Fixed value: the one request of the statistics office's adapter.
NBS_REQUEST = "https://data.stats.gov.cn/easyquery.htm?cn=C01&zb=A0101&sj=last"
CATEGORY_TOPIC = {"academic_api": "academic", "authoritative": "dev", "privacy_extra": "privacy", "ai_search": "ai"}
WIDE = ("intl_engines", "reference", "academic_api", "authoritative", "industry_keyless", "cn_official", "privacy_extra", "private_kb")
TIERS = {"lite": ("intl_engines", "reference"), "standard": WIDE, "full": WIDE}
SCHEMA = ("ordinal int, id string, name string, category string, method string, engine_id string, url_template string, access string, key_env string, source_type string, quality string, response string, "
          "adapter string, json_items string, item_map map<string,string>, gate string, tags array<string>, tiers array<string>, topics array<string>, force_include boolean")
COLUMNS = [c.strip().split(" ")[0] for c in SCHEMA.split(", ")]


def builtin(contact: str = "contact@example.com") -> list[dict]:
    """The 65 sources as rows; an AI search (keyed) is in no tier, a category of the lite tier in all."""
    rows = []
    for n, row in enumerate(SOURCES):
        r = dict(zip(("id", "name", "category", "method", "engine_id", "url_template", "access", "key_env", "source_type", "quality", "response", "adapter", "json_items", "item_map", "gate", "tags"), row))
        r["url_template"] = r["url_template"] and r["url_template"].replace("{contact}", contact)
        tiers = () if r["access"] == "keyed" else ("lite", "standard", "full") if r["category"] in TIERS["lite"] else ("standard", "full")
        topic = SOURCE_TOPICS.get(r["id"], (CATEGORY_TOPIC.get(r["category"], r["category"]),))
        rows.append({"ordinal": n, **r, "tags": list(r["tags"]), "tiers": list(tiers), "topics": list(topic), "force_include": None})
    return rows


def _frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], SCHEMA)


def registry(spark: SparkSession) -> DataFrame:
    """The 65 built-in sources, in order."""
    return _frame(spark, builtin())


def engines(spark: SparkSession) -> DataFrame:
    """The search engines; an id named twice is kept in its last group."""
    last = {row[1]: n for n, row in enumerate(ENGINES)}
    rows = [(n, *row[:5], list(row[5]), *row[6:], RESULT_SELECTORS.get(row[1])) for n, row in enumerate(ENGINES) if last[row[1]] == n]
    return spark.createDataFrame(rows, "ordinal int, grp string, id string, name string, region string, freshness string, best_for array<string>, search_url string, api string, selector string")


def with_custom(spark: SparkSession, custom: list[dict]) -> tuple[DataFrame, list[str]]:
    """The registry and the caller's sources, with defaults filled in, and warnings on odd ones."""
    base, rows, warnings = builtin(), [], []
    for n, c in enumerate(x for x in custom if isinstance(x, dict) and x.get("id")):
        if c.get("method", "rest") == "rest" and "{q}" not in (c.get("url_template") or "") and not c.get("static"):
            warnings.append(f"source {c['id']!r}: url_template has no {{q}} and static isn't set, so every query reads the same address")
        given = {
            "ordinal": len(base) + n, "id": c["id"], "name": c.get("name", c["id"]), "category": c.get("category", "private_kb"), "method": c.get("method", "rest"), "access": c.get("access") or ("keyed" if c.get("key_env") else "keyless"),
            "source_type": c.get("source_type", "internal"), "quality": c.get("quality", "B"), "response": c.get("response", "json"), "tiers": list(c.get("tiers") or ["standard", "full"]),
            "topics": list(c.get("topics") or []), "tags": list(c.get("tags") or []), "force_include": bool(c.get("force_include", True)),
        }
        rows.append({**dict.fromkeys(COLUMNS), **{k: c[k] for k in ("engine_id", "url_template", "key_env", "adapter", "json_items", "item_map", "gate") if c.get(k)}, **given})
    return _frame(spark, base + rows), warnings


def requests(queries: DataFrame, sources: DataFrame, engines: DataFrame, searxng_url: str = "") -> DataFrame:
    """query_id, source, method, address: the request of every source (of the registry's form) for every question it was chosen for (query_id, query, id).

    A source of an engine takes the engine's address. Sources and engines are
    tables of fixed size; a template without {q} is asked as it is.
    """
    s = sources.select("id", "method", "engine_id", "url_template", "adapter").join(engines.select(F.col("id").alias("engine_id"), "search_url"), "engine_id", "left")
    template = F.replace(F.coalesce("url_template", "search_url"), F.lit("{searxng_url}"), F.lit(searxng_url))
    fixed = F.when(F.col("adapter") == "nbs", NBS_REQUEST)
    return queries.join(s, "id").select("query_id", F.col("id").alias("source"), "method", F.coalesce(fill_template(template, F.col("query"), F.lit(None).cast("string")), fixed).alias("address"))


def active(tier: str = "standard", keys: tuple[str, ...] = (), disabled: tuple[str, ...] = (), searxng_url: str = "") -> Column:
    """Whether a source takes part: keyed ones by their key alone, others by tier, category and gate."""
    keyed = F.col("access") == "keyed"
    by_key = F.col("key_env").isin(*keys) if keys else F.lit(False)
    by_tier = F.col("category").isin(*TIERS.get(tier, WIDE)) & ~F.col("category").isin(*disabled or ("",)) & (F.coalesce(F.col("gate") != "searxng", F.lit(True)) | F.lit(bool(searxng_url)))
    return F.coalesce(F.when(keyed, by_key).otherwise(by_tier), F.lit(False))


def describe(reg: DataFrame) -> DataFrame:
    """category, sources, keyed, ids of each category."""
    return reg.groupBy("category").agg(F.count(F.lit(1)).alias("sources"), F.count_if(F.col("access") == "keyed").alias("keyed"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))


def quoted(c: Column) -> Column:
    """Text quoted for the path of an address: letters, digits, "_.-~/" stay, a space is %20."""
    q = F.url_encode(c)
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        q = F.replace(q, F.lit(a), F.lit(b))
    return q


def fill_template(template: Column, query: Column, token: Column) -> Column:
    """{q} (quoted) and {token} put in literally; other braces stay."""
    return F.replace(F.replace(template, F.lit("{q}"), quoted(query)), F.lit("{token}"), F.coalesce(token, F.lit("")))
