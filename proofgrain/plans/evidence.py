"""Queries on evidence: scoring, deduplication, verification, control, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proofgrain.functions.text import rounded, token_estimate
from proofgrain.operators import control, dedup, report, score, verify
from proofgrain.plans.texts import DOMAIN, EST, HASHES, KEYWORDS, STRIP, TOKENS
from proofgrain.session import read_table

SQL: dict[str, str] = {}
_case = lambda c, table, default: "case " + " ".join(f"when {c} = '{k}' then {v!r}::double" for k, v in table.items()) + f" else {default}::double end"
_cap = "case tier " + " ".join(f"when '{k}' then {v}" for k, v in score.MAX_SOURCES.items()) + " else 3 end"
_budget = "case tier " + " ".join(f"when '{k}' then {v}" for k, v in score.BUDGET.items()) + " else 8000 end"
_overlap = f"""case when len({TOKENS.format("lower(coalesce(query, ''))")}) = 0 then 0.5::double else len(list_intersect({TOKENS.format("lower(coalesce(snippet, ''))")}, {TOKENS.format("lower(coalesce(query, ''))")}))::double / len({TOKENS.format("lower(coalesce(query, ''))")}) end"""
SCORED = f"""scored as (select *, floor((0.35::double * credibility + 0.30::double * relevance + 0.15::double * recency + 0.15::double * credibility + 0.05::double * (1.0::double - bias)) * 10000.0 + 0.5) / 10000.0 as weighted
  from (select s.*, q.query, q.tier, {_case('s.source_type', score.CREDIBILITY, 0.5)} as credibility, {_overlap} as relevance, case when s.fetched_at is not null then 0.7::double else 0.5::double end as recency, {_case('s.source_type', score.BIAS, 0.5)} as bias
    from serp_docs s join research_queries q using (query_id)))"""
RANKED = f"{SCORED}, ranked as (select *, row_number() over (partition by query_id order by weighted desc, pos, fetch_id) as rank from scored)"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "serp_docs").drop("raw_html")


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    q = read_table(spark, sf, "research_queries").select("query_id", "query", "tier")
    return score.score(_docs(spark, sf).join(q, "query_id"), dated=F.col("fetched_at").isNotNull())


def source_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("fetch_id", "credibility", rounded(F.col("relevance"), 6).alias("relevance"), "recency", "authority", "bias", "weighted")


SQL["source_scores"] = f"with {SCORED} select fetch_id, credibility, floor(relevance * 1000000.0 + 0.5) / 1000000.0 as relevance, recency, credibility as authority, bias, weighted from scored"


def top_sources(spark: SparkSession, sf: str) -> DataFrame:
    return score.top_sources(_scored(spark, sf), score.lookup(F.col("tier"), score.MAX_SOURCES, 3)).select("query_id", "rank", "fetch_id", "weighted")


SQL["top_sources"] = f"with {RANKED} select query_id, rank::int as rank, fetch_id, weighted from ranked where rank <= {_cap}"
CONF = "floor(sum(round(weighted * 10000)::bigint) / (count(*) * 10000.0::double) * 1000.0 + 0.5) / 1000.0"


def confidences(spark: SparkSession, sf: str) -> DataFrame:
    return score.confidence(_scored(spark, sf))


SQL["confidences"] = f"with {SCORED} select query_id, {CONF} as confidence from scored group by query_id"


def conflict_flags(spark: SparkSession, sf: str) -> DataFrame:
    return score.conflict_flags(_scored(spark, sf))


SQL["conflict_flags"] = f"with {SCORED} select query_id, max(weighted) as top, min(weighted) as low, count(*) > 1 and min(weighted) < max(weighted) * 0.6::double as conflict from scored group by query_id"


def url_first(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.first_per_key(_docs(spark, sf), ["query_id", "url"], ["pos", "fetch_id"]).select("query_id", "fetch_id")


SQL["url_first"] = "select query_id, fetch_id from serp_docs qualify coalesce(url, '') = '' or row_number() over (partition by query_id, url order by pos, fetch_id) = 1"


def _by_source(spark: SparkSession, sf: str) -> DataFrame:
    """The retrieved documents as a source's list, in order of id."""
    return read_table(spark, sf, "documents").select("source", "doc_id", F.col("doc_id").alias("pos"), "url", F.col("text").alias("snippet"), "title")


def near_pairs(spark: SparkSession, sf: str) -> DataFrame:
    fp = dedup.fingerprints(_by_source(spark, sf), "source", "doc_id").withColumn("ord", F.struct("pos", "id"))
    hexed = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    p = dedup.candidate_pairs(fp, 3)
    return p.select(F.col("part").alias("source"), F.least(hexed(F.col("h")), hexed(F.col("h2"))).alias("hash_a"), F.greatest(hexed(F.col("h")), hexed(F.col("h2"))).alias("hash_b"))


DOC_HASHES = HASHES.replace("serp_docs", "documents").replace("fetch_id", "doc_id").replace("s.query_id, s.pos", "s.source").replace("coalesce(snippet, '')", "coalesce(text, '')")
SQL["near_pairs"] = f"""with {DOC_HASHES} select distinct a.source, lower(lpad(to_hex(a.h), 16, '0')) as hash_a, lower(lpad(to_hex(b.h), 16, '0')) as hash_b
  from (select distinct source, h from hashes) a join (select distinct source, h from hashes) b on a.source = b.source and a.h < b.h and bit_count(xor(a.h, b.h)) <= 3"""


def near_dup_kept(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.near_dup(_by_source(spark, sf), "source", "doc_id", 3).select(F.col("part").alias("source"), F.col("id").alias("doc_id"))


_rounds = "".join(f""",
  k{r} as (select i from k{r - 1} union select doc_id from hashes where doc_id not in (select i from d{r - 1}) and not exists (select 1 from e where e.j = doc_id and e.i not in (select i from d{r - 1}))),
  d{r} as (select i from d{r - 1} union select j from e where e.i in (select i from k{r}))""" for r in range(1, 7))
SQL["near_dup_kept"] = f"""with {DOC_HASHES}, e as (select a.doc_id as i, b.doc_id as j from hashes a join hashes b on a.source = b.source and a.doc_id < b.doc_id
    and ((a.url = b.url and length(a.url) > 0) or bit_count(xor(a.h, b.h)) <= 3)),
  k0 as (select 0::bigint as i where false), d0 as (select 0::bigint as i where false){_rounds}
  select source, doc_id from hashes where doc_id in (select i from k6)"""


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "fact_verdicts").where("fact is not null")


def fact_anchors(spark: SparkSession, sf: str) -> DataFrame:
    facts = _facts(spark, sf).select("query_id", F.col("verdict_id").alias("fact_id"), "fact")
    return verify.anchor_facts(facts, _docs(spark, sf)).select(F.col("fact_id").alias("verdict_id"), "verdict", "source", "reason", "overlap")


SQL["fact_anchors"] = f"""with f as (select verdict_id, query_id, {KEYWORDS.format('fact')} as kw from fact_verdicts where fact is not null),
  s as (select query_id, pos, fetch_id, url, unnest({KEYWORDS.format("coalesce(nullif(text, ''), snippet)")}) as k from serp_docs),
  h as (select verdict_id, pos, fetch_id, url, count(*) as n from (select verdict_id, query_id, unnest(kw) as k from f) x join s using (query_id, k) group by all),
  b as (select * from h qualify row_number() over (partition by verdict_id order by n desc, pos, fetch_id) = 1)
  select f.verdict_id, case when b.n is null then 'UNCERTAIN' else 'TRUE' end as verdict, b.url as source,
    case when b.n is not null then 'source_overlap' when len(f.kw) = 0 then 'no_overlap_source' else 'weak_anchor' end as reason, coalesce(b.n, 0) as overlap from f left join b using (verdict_id)"""


def uncited(spark: SparkSession, sf: str) -> DataFrame:
    found = _facts(spark, sf).select("query_id", F.concat_ws(" ", "fact", "source").alias("findings"))
    return verify.uncited(found, _docs(spark, sf))


SQL["uncited"] = """select distinct query_id, url from (select query_id, unnest(regexp_extract_all(concat_ws(' ', fact, source), 'https?://[^\\s)"''（）]+')) as url from fact_verdicts where fact is not null) c
  where not exists (select 1 from serp_docs s where s.query_id = c.query_id and s.url = c.url)"""


def uncertain_facts(spark: SparkSession, sf: str) -> DataFrame:
    v = _facts(spark, sf).select("query_id", "fact", "verdict", "reason", F.col("verdict_id").alias("ord"), F.coalesce("source", F.lit("")).alias("source"))
    return verify.uncertainties(v, _docs(spark, sf))


SQL["uncertain_facts"] = f"""with n as (select query_id, url as source, regexp_matches(coalesce(nullif(snippet, ''), nullif(text, ''), ''), '{verify.NEGATION}') as negative from serp_docs qualify row_number() over (partition by query_id, url order by pos desc, fetch_id desc) = 1),
  g as (select query_id, fact, arg_max(coalesce(reason, 'weak_anchor'), verdict_id) filter (verdict = 'UNCERTAIN') as reason,
    bool_or(coalesce(verdict = 'TRUE' and length(coalesce(v.source, '')) > 0 and coalesce(negative, false), false)) as neg, bool_or(coalesce(verdict = 'TRUE' and length(coalesce(v.source, '')) > 0 and not coalesce(negative, false), false)) as pos
    from fact_verdicts v left join n using (query_id, source) where fact is not null group by query_id, fact)
  select query_id, substring(fact, 1, 160) as fact, case when neg and pos then 'cross_source_conflict' else reason end as reason from g where reason is not null or (neg and pos)"""


def _rounds_df(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).withColumn("round", F.floor(F.col("pos") / 2).cast("int"))


def evidence_merge(spark: SparkSession, sf: str) -> DataFrame:
    return control.merge_evidence(_rounds_df(spark, sf)).select("query_id", "fetch_id", "round")


SQL["evidence_merge"] = "select query_id, fetch_id, (pos // 2)::int as round from serp_docs qualify coalesce(url, '') = '' or row_number() over (partition by query_id, url order by pos // 2, pos, fetch_id) = 1"


def fresh_urls(spark: SparkSession, sf: str) -> DataFrame:
    return control.fresh_counts(_rounds_df(spark, sf))


FRESH = """fresh as (select query_id, round, count(*) as total, count(*) filter (length(url) > 0 and first_round = round) as fresh from (
  select query_id, (pos // 2)::int as round, url, min(case when length(url) > 0 then (pos // 2)::int end) over (partition by query_id, url) as first_round from serp_docs) group by query_id, round)"""
SQL["fresh_urls"] = f"with {FRESH} select * from fresh"


def running_budget(spark: SparkSession, sf: str) -> DataFrame:
    q = read_table(spark, sf, "research_queries").select("query_id", "tier")
    r = _rounds_df(spark, sf).join(q, "query_id")
    return control.running_budget(r, token_estimate(F.col("text")), score.lookup(F.col("tier"), score.BUDGET, 8000) / 4).select("fetch_id", "used", "over")


SQL["running_budget"] = f"""select fetch_id, used::bigint as used, used >= b / 4.0 as over from (select fetch_id, {_budget} as b, sum({EST.format('text')}) over (partition by query_id order by pos // 2, pos, fetch_id rows unbounded preceding) as used
  from serp_docs join research_queries using (query_id))"""


def stop_decisions(spark: SparkSession, sf: str) -> DataFrame:
    q = read_table(spark, sf, "research_queries").select("query_id", "tier")
    f = control.fresh_counts(_rounds_df(spark, sf)).join(q, "query_id")
    w = W.partitionBy("query_id").orderBy("round").rowsBetween(W.unboundedPreceding, 0)
    f = f.withColumn("seen", F.sum("total").over(w))
    s = control.should_stop(F.col("tier"), F.col("fresh"), F.col("seen") > F.col("total"), F.lit(False), F.col("seen") * 1500 >= score.lookup(F.col("tier"), score.BUDGET, 8000), F.col("seen") >= score.lookup(F.col("tier"), score.MAX_SOURCES, 3))
    return f.select("query_id", "round", s.alias("s")).select("query_id", "round", "s.stop", "s.reason", "s.exhausted")


_ladder = f"""case when tier in ('L0', 'L1') and hit then '{control.BUDGET_L0}' when tier in ('L0', 'L1') and stale then '{control.NO_NEWS}' when tier in ('L0', 'L1') then ''
  when closed then '{control.CLOSED}' when stale then '{control.NO_NEWS}' when hit then '{control.BUDGET_L2}' else '' end"""
SQL["stop_decisions"] = f"""with {FRESH}, w as (select f.*, q.tier, sum(total) over (partition by query_id order by round rows unbounded preceding) as seen from fresh f join research_queries q using (query_id)),
  c as (select *, fresh = 0 and seen > total as stale, seen * 1500 >= {_budget} as hit, seen >= {_cap} as closed from w), r as (select *, {_ladder} as reason from c)
  select query_id, round, reason <> '' as stop, reason, reason = '{control.BUDGET_L2}' as exhausted from r"""


def closures(spark: SparkSession, sf: str) -> DataFrame:
    return control.closure(_docs(spark, sf), (("机制/原理", ""), ("revenue", ""), ("the index", "")))


SQL["closures"] = r"""with d(dim, toks) as (values (0, ['机制', '原理']), (1, ['revenue']), (2, ['the', 'index'])),
  t as (select query_id, coalesce(length(url) > 0, false) as has_url, lower(coalesce(text, '') || ' ' || coalesce(url, '') || ' ' || coalesce(snippet, '')) as t from serp_docs),
  h as (select query_id, dim, bool_or(has_url) as anchored, bool_or(len(list_filter(toks, lambda k: contains(t, k))) > 0) as hit from t, d group by query_id, dim)
  select query_id, bool_or(anchored) as anchored, count(*) filter (hit) as covered, bool_or(anchored) and count(*) filter (hit) = 3 as closed from h group by query_id"""


def findings(spark: SparkSession, sf: str) -> DataFrame:
    return report.synthesize(_scored(spark, sf))


SQL["findings"] = f"""with {RANKED}, g as (select query_id, count(*) as n, arg_min({STRIP.format("coalesce(snippet, '')")}, rank) as b, arg_min(weighted, rank) as bw, arg_max(coalesce(snippet, ''), rank) as w, arg_max(weighted, rank) as ww,
    list_filter(list(coalesce(url, '') order by pos, fetch_id), lambda u: lower(u) not in ('uncertain', 'none', '')) as refs, {CONF} as conf from ranked group by query_id)
  select query_id, '先答：' || substring(case when lower(b) in ('uncertain', 'none', '待定', '') then '（信息不确定）' else b end, 1, 300) || chr(10)
    || case when n > 1 and ww < bw * 0.6::double then chr(10) || '相反观点（低可信源）：' || substring(w, 1, 120) || chr(10) else '' end
    || case when len(refs) > 0 then chr(10) || '来源：' || chr(10) || array_to_string(list_transform(refs[1:8], lambda u: '- ' || u), chr(10)) else '' end
    || chr(10) || chr(10) || '置信度：' || printf('%.3f', conf) as findings from g"""


def uncertain_sections(spark: SparkSession, sf: str) -> DataFrame:
    return report.uncertain_section(uncertain_facts(spark, sf))


SQL["uncertain_sections"] = f"""select query_id, chr(10) || '未确认项：' || chr(10) || array_to_string(list_slice(list('- ' || substring(fact, 1, 120) || '（' || reason || '）' order by fact, '- ' || substring(fact, 1, 120) || '（' || reason || '）'), 1, 8), chr(10)) as section from ({SQL['uncertain_facts']}) group by query_id"""
DIMS = (("营业收入", "简要"), ("revenue", "详细"), ("定义与概念", "极简"))


def layouts(spark: SparkSession, sf: str) -> DataFrame:
    return report.schema_layout(_scored(spark, sf), DIMS)


SQL["layouts"] = f"""with {RANKED}, d(dim, name, lvl, cap, g) as (values (0, '营业收入', '简要', 120, ['营业', '业收', '收入']), (1, 'revenue', '详细', 300, ['revenue']), (2, '定义与概念', '极简', 60, ['定义', '义与', '与概', '概念'])),
  p as (select query_id, dim, name, lvl, cap, rank, coalesce(snippet, '') as sn, len(list_filter(g, lambda x: contains(coalesce(nullif(text, ''), snippet, ''), x))) > 0 as m from ranked, d),
  h as (select *, case when m then sum(m::int) over (partition by query_id, dim order by rank rows unbounded preceding) end as hit from p),
  b as (select query_id, dim, name, lvl, bool_or(m) as matched, coalesce(array_to_string(list('- ' || substring(sn, 1, cap) || chr(10) order by rank) filter (hit <= 2 and sn <> ''), ''), '') as body,
    coalesce(array_to_string(list('- ' || substring(sn, 1, cap) || chr(10) order by rank) filter (rank <= 3 and sn <> ''), ''), '') as all3 from h group by all),
  s as (select query_id, dim, '## ' || name || '（' || lvl || '）' || chr(10) || case when matched then body when bool_or(matched) over (partition by query_id) then '（该维度暂无直接来源）' || chr(10) when dim = 0 then all3 else '（综合来源见首节；本维度按此框架组织结论）' || chr(10) end as x from b)
  select query_id, array_to_string(list(x order by dim), chr(10)) as layout from s group by query_id"""
CITED = """cited as (select *, row_number() over (partition by query_id order by pos, fetch_id) as n, coalesce(nullif(title, ''), nullif(snippet, ''), nullif(url, '')) as label
  from (select * from serp_docs where length(url) > 0 qualify row_number() over (partition by query_id, url order by pos, fetch_id) = 1))"""


def _citing(fmt: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return report.citations(_docs(spark, sf), fmt)
    run.__name__ = f"citations_{fmt}"
    return run


_items = {
    "md": ("chr(10) || '## 引用' || chr(10) || chr(10)", "n || '. [' || label || '](' || url || ')'", "chr(10)", "chr(10)"),
    "bibtex": ("''", "'@misc{src' || n || ',' || chr(10) || '  title = {' || label || '},' || chr(10) || '  howpublished = {' || url || '},' || chr(10) || '  note = {' || coalesce(source_type, 'web') || '}' || chr(10) || '}'", "chr(10)", "chr(10)"),
    "ris": ("''", "'TY  - GEN' || chr(10) || 'TI  - ' || label || chr(10) || 'UR  - ' || url || chr(10) || 'ER  - '", "chr(10)", "chr(10)"),
    "csl": ("'[' || chr(10)", "'  {' || chr(10) || '    \"title\": ' || to_json(label) || ',' || chr(10) || '    \"URL\": ' || to_json(url) || chr(10) || '  }'", "',' || chr(10)", "chr(10) || ']'"),
    "noteexpress": ("''", "'#:@文献[' || n || ']' || chr(10) || '标题=' || label || chr(10) || 'URL=' || url", "chr(10)", "chr(10)"),
}
for _f, (_h, _i, _s, _t) in _items.items():
    _joined = f"array_to_string(list({_i} order by n), {_s})"
    _joined = f"regexp_replace({_joined}, '\\s+$', '')" if _f == "ris" else _joined
    SQL[f"citations_{_f}"] = f"with {CITED} select query_id, {_h} || {_joined} || {_t} as content from cited group by query_id"


def vault_append(spark: SparkSession, sf: str) -> DataFrame:
    """Items an incremental report run appends when the first four results were written before."""
    items = report.vault_items(_docs(spark, sf))
    return report.unseen_items(items, items.where("n <= 4")).select("query_id", "item")


SQL["vault_append"] = f"with {CITED} select query_id, case when n < 10 then '0' else '' end || n || '-' || substring(sha1(url), 1, 10) || '.md' as item from cited where n > 4"


def landing_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Two hops: each unresolved result page with the first long enough page of its host."""
    from proofgrain.functions.url import domain_of

    d = _docs(spark, sf).withColumn("host", domain_of(F.col("url")))
    pages = d.where(F.coalesce("landing_resolved", F.lit(False)) & (F.length("text") >= 40)).groupBy("host").agg(F.min_by("fetch_id", F.struct("pos", "fetch_id")).alias("landing"))
    open_ = d.where(~F.coalesce("landing_resolved", F.lit(False))).join(pages, "host", "left")
    return open_.select("fetch_id", "landing", F.when(F.col("landing").isNull(), "fallback").otherwise("resolved").alias("outcome"))


SQL["landing_pages"] = f"""with d as (select *, {DOMAIN.format('url')} as host from serp_docs), p as (select host, fetch_id as landing from d where coalesce(landing_resolved, false) and length(text) >= 40 qualify row_number() over (partition by host order by pos, fetch_id) = 1)
  select fetch_id, landing, case when landing is null then 'fallback' else 'resolved' end as outcome from d left join p using (host) where not coalesce(landing_resolved, false)"""


def landing_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).groupBy("engine").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce("landing_resolved", F.lit(False))).alias("resolved"), F.count_if(F.col("text").isNull()).alias("without_text"))


SQL["landing_stats"] = "select engine, count(*) as total, count(*) filter (coalesce(landing_resolved, false)) as resolved, count(*) filter (text is null) as without_text from serp_docs group by engine"


def semantic_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest vectors (exact cosine) of every vector whose id is divisible by 20."""
    from proofgrain.operators.vectors import nearest

    return nearest(read_table(spark, sf, "embeddings"), "vec_id", "embedding", 5)


SQL["semantic_neighbours"] = """with v as (select vec_id, embedding::double[] as e, sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) as n from embeddings)
  select q.vec_id as query_id, v.vec_id as vec_id, row_number() over (partition by q.vec_id order by floor((list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2])) / (q.n * v.n)) * 1000000 + 0.5) desc, v.vec_id)::int as rank
  from v q join v on q.vec_id % 20 = 0 and q.vec_id <> v.vec_id qualify rank <= 5"""


def eval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    q = read_table(spark, sf, "research_queries").select("query_id", "tier")
    d = _docs(spark, sf).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_sources"), F.array_join(F.array_sort(F.collect_set("engine")), ",").alias("engines"))
    v = read_table(spark, sf, "fact_verdicts").groupBy("query_id").agg(F.count_if(F.col("verdict") == "UNCERTAIN").alias("n_uncertain"), F.count(F.lit(1)).alias("n_facts"))
    return q.join(d, "query_id", "left").join(v, "query_id", "left").select("query_id", "tier", F.coalesce("n_sources", F.lit(0)).alias("n_sources"), F.coalesce("engines", F.lit("")).alias("engines"), F.coalesce("n_uncertain", F.lit(0)).alias("n_uncertain"), F.coalesce("n_facts", F.lit(0)).alias("n_facts"))


SQL["eval_metrics"] = """select q.query_id, q.tier, coalesce(n_sources, 0) as n_sources, coalesce(engines, '') as engines, coalesce(n_uncertain, 0) as n_uncertain, coalesce(n_facts, 0) as n_facts from research_queries q
  left join (select query_id, count(*) as n_sources, array_to_string(list_sort(list_distinct(list(engine) filter (engine is not null))), ',') as engines from serp_docs group by 1) using (query_id)
  left join (select query_id, count(*) filter (verdict = 'UNCERTAIN') as n_uncertain, count(*) as n_facts from fact_verdicts group by 1) using (query_id)"""

QUERIES = [source_scores, top_sources, confidences, conflict_flags, url_first, near_pairs, near_dup_kept, fact_anchors, uncited, uncertain_facts, evidence_merge, fresh_urls, running_budget, stop_decisions, closures, findings,
           uncertain_sections, layouts, *[_citing(f) for f in _items], vault_append, landing_pages, landing_stats, semantic_neighbours, eval_metrics]
