"""Routing of questions: depth, intent, plan leaves, topics and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proofgrain.functions.text import filled, fold_spaces, strip
from proofgrain.functions.url import any_of

# The words by which questions are routed, in order of priority.
L3_WORDS = ("调研", "研究", "综述", "论文", "系统性", "前沿", "怎么做一套", "全景")
L2_WORDS = ("最新", "今天", "实时", "排名", "对比", "为什么", "怎么选", "分析", "方案", "风险", "前沿", "评测", "区别", "差异", "优劣", "哪种好", "如何评估")
L0_WORDS = ("星期几", "几号", "是什么", "定义", "多少", "怎么读", "怎么装", "命令", "语法", "换算", "海拔", "生日", "日期", "谁发明的", "成立于", "公式", "缩写")
MEMORY = {"TCP 和 UDP 的核心区别": "L0", "谁发明了万维网": "L1", "目前主流大模型上下文窗口最大的约多少": "L1", "调研小微企业所得税优惠": "L2", "一个 5 人初创做 AI 产品如何控制云成本": "L2", "上市公司回购股票对股价通常意味着什么": "L2", "调研 RAG vs 长上下文模型的取舍": "L2"}
INTENTS = {
    "compare": ("对比", "比较", "区别", "差异", "优劣", " vs "), "why": ("为什么", "为何", "原因", "怎么选", "凭什么"),
    "howto": ("怎么", "如何", "怎么装", "怎么读", "步骤", "教程", "搭建"), "research": ("调研", "研究", "综述", "前沿", "全景", "系统性", "梳理"),
    "latest": ("最新", "今天", "实时", "近期", "2024", "2025", "2026"), "verify": ("是否合规", "对不对", "验证", "靠谱吗", "真假"),
}
FINANCE_WORDS = ("股价", "股市", "股票", "财报", "营收", "市值", "波动", "k线", "市盈率", "净利润", "季报", "年报", "上市", "退市", "券商", "研报", "主力资金", "净流入", "涨跌", "行情")
REPO_WORDS = ("github", "开源", "代码仓库", "repo", "sdk", "框架", "npm", "pip install", "源码", "star数", "star 数", "issue", "pull request", "代码库", "开源项目")
ACADEMIC_WORDS = ("arxiv", "论文", "文献", "doi", "参考文献", "预印本", "综述文献", "学术搜索", "citation", "引用文献", "期刊")
RESEARCH_ANY = ("为什么", "对比", "区别", "根因", "如何", "分析", "评估", "方案", "研究", "原因")
RESEARCH_WHY = ("为什么", "根因", "原因", "如何")
RESEARCH_COMPARE = ("对比", "区别", "分析", "评估", "方案", "研究", "调研")
DEPTH = {"quick": "L1", "standard": "L2", "deep": "L3"}
# Topics and their words with weights.
TOPICS = {
    "academic": (("论文", 2), ("文献", 2), ("doi", 2), ("引用", 1), ("研究", 1), ("预印本", 2), ("arxiv", 2), ("期刊", 2), ("综述", 2), ("学术", 2), ("书评", 1), ("paper", 1), ("article", 1), ("citation", 1), ("preprint", 2), ("journal", 1), ("research", 1), ("scholar", 1)),
    "dev": (("html", 2), ("css", 2), ("javascript", 2), ("js", 2), ("web标准", 2), ("web 标准", 2), ("规范", 1), ("rfc", 2), ("api规范", 2), ("unicode", 2), ("tc39", 2), ("mdn", 2), ("前端", 1), ("后端", 1), ("编程", 1), ("代码规范", 1), ("html5", 1), ("css3", 1), ("standard", 1), ("spec", 1), ("ecmascript", 2)),
    "finance": (("股价", 2), ("股票", 2), ("财报", 2), ("主力", 2), ("净流入", 2), ("市值", 2), ("市盈率", 2), ("营收", 2), ("净利润", 2), ("金融", 1), ("基金", 1), ("etf", 1), ("上市公司", 2), ("证券", 2), ("年报", 1), ("stock", 1), ("earnings", 1), ("revenue", 1), ("market cap", 1), ("pe ratio", 1), ("10-k", 2), ("sec", 1)),
    "macro": (("gdp", 2), ("通胀", 2), ("通货膨胀", 2), ("cpi", 2), ("宏观经济", 2), ("经济增长", 2), ("失业率", 2), ("世界经济", 1), ("imf", 2), ("oecd", 2), ("经济", 1), ("economy", 1), ("inflation", 1), ("unemployment", 1), ("货币政策", 1), ("gdp增长", 2)),
    "health": (("疾病", 2), ("临床", 2), ("药物", 2), ("疫苗", 2), ("流行病学", 2), ("who", 2), ("cdc", 2), ("医疗", 1), ("症状", 1), ("治疗", 1), ("临床试验", 2), ("药品", 1), ("公卫", 2), ("disease", 1), ("clinical", 1), ("drug", 1), ("vaccine", 1), ("trial", 1), ("epidemic", 1), ("health", 1), ("fda", 2), ("药监", 2)),
    "legal": (("法律", 2), ("法规", 2), ("法条", 2), ("判例", 2), ("法院", 2), ("立法", 2), ("合规", 2), ("司法解释", 2), ("法规数据库", 2), ("legal", 1), ("law", 1), ("statute", 1), ("case law", 1), ("regulation", 1), ("court", 1)),
    "gov": (("统计", 2), ("人口", 2), ("普查", 2), ("社融", 1), ("开放数据", 1), ("政府数据", 1), ("statistics", 1), ("population", 1), ("census", 1), ("government", 1), ("dataset", 1), ("欧盟数据", 1), ("英国政府", 1), ("美国政府", 1)),
    "climate": (("气候", 2), ("气象", 2), ("卫星", 2), ("气温", 2), ("碳排放", 2), ("海洋", 2), ("地质", 2), ("地球科学", 1), ("climate", 1), ("weather", 1), ("satellite", 1), ("carbon", 1), ("earth", 1), ("space", 1), ("nasa", 2), ("noaa", 2), ("usgs", 1)),
    "privacy": (("隐私", 2), ("匿名", 1), ("privacy", 1), ("独立索引", 1)),
    "cn_official": (("国标", 2), ("国家标准", 2), ("国家法律法规", 2), ("中国企业", 1), ("信用记录", 1), ("中文文献", 1), ("中文学术", 1), ("科技文献", 1), ("科学数据", 1), ("国家药监", 1), ("卫健委", 1), ("自然科学基金", 1), ("中科院", 1)),
    "corp": (("公司信用", 2), ("企业信用", 2), ("工商", 1), ("企业信息", 1)),
}
TOPIC_WORDS = [(t, w, n) for t, ws in TOPICS.items() for w, n in ws]


def override(text: Column) -> Column:
    """struct(query, tier) of an embedded "/signal Lx ..." override; tier null without one."""
    t = strip(filled(text))
    p = r"(?i)^/signal\s+(L[0-3])\s+(.*)"
    hit = t.rlike(p)
    return F.struct(F.when(hit, strip(F.regexp_extract(t, p, 2))).otherwise(filled(text)).alias("query"), F.when(hit, F.upper(F.regexp_extract(t, p, 1))).alias("tier"))


def tier(query: Column) -> Column:
    """Depth of a question: memory, then research, diagnosis and fact words, else L1."""
    q, out = filled(query), None
    folded = fold_spaces(query)
    for known, t in MEMORY.items():
        out = F.when(folded == known, t) if out is None else out.when(folded == known, t)
    return out.when(q.rlike(any_of(L3_WORDS)), "L3").when(q.rlike(any_of(L2_WORDS)), "L2").when(q.rlike(any_of(L0_WORDS)), "L0").otherwise("L1")


def research_tier(query: Column) -> Column:
    q = strip(filled(query))
    return (F.when((F.length(q) < 18) & ~q.rlike(any_of(RESEARCH_ANY)), "L0").when(q.rlike(any_of(RESEARCH_WHY)), "L2")
            .when(q.rlike(any_of(RESEARCH_COMPARE)), "L2").otherwise("L1"))


def intent(query: Column) -> Column:
    """struct(intent, confidence, granularity, need_clarify)."""
    q, out = strip(filled(query)), None
    for name, words in INTENTS.items():
        out = F.when(q.rlike(any_of(words)), name) if out is None else out.when(q.rlike(any_of(words)), name)
    kind = out.otherwise("fact")
    conf = F.when(q.rlike(r"[A-Za-z\x{4e00}-\x{9fa5}]{2,}") & (F.length(q) >= 4), F.lit(0.85)).otherwise(F.lit(0.45))
    return F.struct(kind.alias("intent"), conf.alias("confidence"), F.when(kind.isin("fact", "howto"), "single").otherwise("multi").alias("granularity"), (conf < 0.6).alias("need_clarify"))


def source_intent(query: Column) -> Column:
    q = F.lower(filled(query))
    return F.when(q.rlike(any_of(REPO_WORDS)), "github").when(q.rlike(any_of(FINANCE_WORDS)), "finance").when(q.rlike(any_of(ACADEMIC_WORDS)), "academic").otherwise("general")


def plan_leaves(query: Column, cap: Column | int = 20) -> Column:
    """array<struct(q, rewrite, dimension, truncated)> of a question's leaves."""
    q = strip(filled(query))
    cap = F.lit(cap) if isinstance(cap, int) else cap
    after = F.regexp_extract(q, r"(?s)对比(.*)$", 1)
    dim = F.when(after.contains("的"), F.regexp_extract(after, r"(?s)^.*的(.*)$", 1)).otherwise("")
    head = F.when(after.contains("的"), F.regexp_extract(after, r"(?s)^(.*)的.*$", 1)).otherwise(after)
    parts = F.filter(F.transform(F.split(head, "[与和及、,，/／]+", -1), strip), lambda e: e != "")
    parts = F.when(dim != "", F.filter(F.transform(parts, lambda e: strip(F.replace(e, dim, F.lit("")))), lambda e: e != "")).otherwise(parts)
    name = F.when(dim != "", dim).otherwise("区别")
    leaf = lambda e: F.struct(F.concat(e, F.lit(" 的"), name).alias("q"), F.concat(e, F.lit(" "), name).alias("rewrite"), F.concat(e, F.lit("/"), name).alias("dimension"), F.lit(False).alias("truncated"))
    single = F.array(F.struct(q.alias("q"), q.alias("rewrite"), F.lit("default").alias("dimension"), F.lit(False).alias("truncated")))
    leaves = F.when(q.contains("对比") & (F.size(parts) > 0), F.transform(parts, leaf)).otherwise(single)
    note = F.struct(F.concat(F.lit("(宽度超限，原 "), F.size(leaves).cast("string"), F.lit(" 叶子截断至 "), cap.cast("string"), F.lit(")")).alias("q"), F.lit("").alias("rewrite"), F.lit("note").alias("dimension"), F.lit(True).alias("truncated"))
    return F.when(F.size(leaves) > cap, F.array_append(F.slice(leaves, F.lit(1), cap), note)).otherwise(leaves)


def topics(queries: DataFrame) -> DataFrame:
    """query_id, topic, score of each topic whose words a question holds."""
    q = F.lower(filled("query"))
    hits = F.filter(F.array(*[F.struct(F.lit(t).alias("topic"), F.when(q.contains(w.lower()), F.lit(s)).otherwise(F.lit(0)).alias("score")) for t, w, s in TOPIC_WORDS]), lambda x: x["score"] > 0)
    return queries.select("query_id", F.explode(hits).alias("h")).groupBy("query_id", F.col("h.topic").alias("topic")).agg(F.sum("h.score").cast("double").alias("score"))


def select_sources(found: DataFrame, queries: DataFrame, registry: DataFrame, max_sources: int = 16) -> DataFrame:
    """query_id, id, kind of the sources a question goes to.

    Core categories, keyed and forced sources always; the experts of the
    question's topics by score, then place in the registry, up to the cap.
    """
    core = F.col("category").isin("intl_engines", "reference") | (F.col("access") == "keyed") | F.coalesce("force_include", F.lit(False))
    reg = registry.withColumn("core", F.coalesce(core, F.lit(False)))
    floor = reg.where("core").select("id")
    n_core = floor.agg(F.count(F.lit(1)).alias("n_core"))
    experts = reg.where("not core").select("id", "ordinal", F.explode("topics").alias("topic"))
    scored = found.join(experts, "topic").groupBy("query_id", "id", "ordinal").agg(F.max("score").alias("score"))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "ordinal")
    chosen = scored.withColumn("rn", F.row_number().over(w)).join(F.broadcast(n_core)).where(F.col("rn") + F.col("n_core") <= max_sources)
    always = queries.select("query_id", F.explode(F.array(*[F.lit(r["id"]) for r in floor.collect()]).cast("array<string>")).alias("id"))  # of the registry, a table of settings
    return always.select("query_id", "id", F.lit("core").alias("kind")).union(chosen.select("query_id", "id", F.lit("expert")))
