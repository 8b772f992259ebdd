"""Queries on routing and the source registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrain.functions import finance
from proofgrain.functions.url import any_of
from proofgrain.operators import route
from proofgrain.plans.texts import STRIP
from proofgrain.session import read_table
from proofgrain.sources import registry

SQL: dict[str, str] = {}
_m = lambda c, words: f"regexp_matches({c}, '{any_of(words)}')"
_q, _s = "coalesce(query, '')", STRIP.format("coalesce(query, '')")
_tier = "case " + " ".join(f"when regexp_replace({_s}, '\\s+', ' ', 'g') = '{k}' then '{v}'" for k, v in route.MEMORY.items()) + f" when {_m(_q, route.L3_WORDS)} then 'L3' when {_m(_q, route.L2_WORDS)} then 'L2' when {_m(_q, route.L0_WORDS)} then 'L0' else 'L1' end"


def tiers(spark: SparkSession, sf: str) -> DataFrame:
    q = read_table(spark, sf, "research_queries")
    i = route.intent(F.col("query"))
    return q.select("query_id", route.tier(F.col("query")).alias("tier_got"), route.research_tier(F.col("query")).alias("research_tier"), route.source_intent(F.col("query")).alias("route"),
                    i["intent"].alias("intent_got"), i["confidence"].alias("confidence"), i["granularity"].alias("granularity"), i["need_clarify"].alias("need_clarify"))


_intent = "case " + " ".join(f"when {_m(_s, w)} then '{k}'" for k, w in route.INTENTS.items()) + " else 'fact' end"
SQL["tiers"] = f"""select query_id, {_tier} as tier_got, case when length({_s}) < 18 and not {_m(_s, route.RESEARCH_ANY)} then 'L0' when {_m(_s, route.RESEARCH_WHY)} then 'L2' when {_m(_s, route.RESEARCH_COMPARE)} then 'L2' else 'L1' end as research_tier,
  case when {_m(f'lower({_q})', route.REPO_WORDS)} then 'github' when {_m(f'lower({_q})', route.FINANCE_WORDS)} then 'finance' when {_m(f'lower({_q})', route.ACADEMIC_WORDS)} then 'academic' else 'general' end as route,
  {_intent} as intent_got, c as confidence, case when {_intent} in ('fact', 'howto') then 'single' else 'multi' end as granularity, c < 0.6::double as need_clarify
  from (select *, case when regexp_matches({_s}, '[A-Za-z\\x{{4e00}}-\\x{{9fa5}}]{{2,}}') and length({_s}) >= 4 then 0.85::double else 0.45::double end as c from research_queries)"""


def tier_hits(spark: SparkSession, sf: str) -> DataFrame:
    q = read_table(spark, sf, "research_queries").withColumn("ok", route.tier(F.col("query")) == F.col("tier"))
    return q.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("hits"))


SQL["tier_hits"] = f"select tier, count(*) as n, count(*) filter ({_tier} = tier) as hits from research_queries group by tier"


def overrides(spark: SparkSession, sf: str) -> DataFrame:
    q = read_table(spark, sf, "research_queries")
    o = route.override(F.concat(F.lit(" /SIGNAL  l"), (F.col("query_id") % 6).cast("string"), F.lit(" "), F.col("query")))
    return q.select("query_id", o["query"].alias("query"), o["tier"].alias("tier"))


SQL["overrides"] = f"""with x as (select query_id, ' /SIGNAL  l' || (query_id % 6) || ' ' || query as t from research_queries)
  select query_id, case when regexp_matches({STRIP.format('t')}, '(?i)^/signal\\s+(L[0-3])\\s+(.*)') then {STRIP.format("regexp_extract(" + STRIP.format('t') + ", '(?i)^/signal\\s+(L[0-3])\\s+(.*)', 2)")} else t end as query,
  nullif(upper(regexp_extract({STRIP.format('t')}, '(?i)^/signal\\s+(L[0-3])\\s+(.*)', 1)), '') as tier from x"""


def plan_leaves(spark: SparkSession, sf: str) -> DataFrame:
    q = read_table(spark, sf, "research_queries")
    d = q.select("query_id", F.posexplode(route.plan_leaves(F.col("query"), 8)).alias("i", "l"))
    return d.select("query_id", "i", F.col("l.q").alias("leaf"), "l.rewrite", "l.dimension", "l.truncated")


SQL["plan_leaves"] = f"""with a as (select query_id, {_s} as q, regexp_extract({_s}, '(?s)对比(.*)$', 1) as after from research_queries),
  b as (select *, case when contains(after, '的') then regexp_extract(after, '(?s)^.*的(.*)$', 1) else '' end as dim, case when contains(after, '的') then regexp_extract(after, '(?s)^(.*)的.*$', 1) else after end as head from a),
  c as (select *, list_filter(list_transform(regexp_split_to_array(head, '[与和及、,，/／]+'), lambda e: {STRIP.format('e')}), lambda e: e <> '') as p0 from b),
  d as (select *, case when dim <> '' then list_filter(list_transform(p0, lambda e: {STRIP.format("replace(e, dim, '')")}), lambda e: e <> '') else p0 end as parts, case when dim <> '' then dim else '区别' end as name from c),
  l as (select query_id, q, name, case when contains(q, '对比') and len(parts) > 0 then parts end as parts from d)
  select query_id, i::int as i, case when e is null then q else e || ' 的' || name end as leaf, case when e is null then q else e || ' ' || name end as rewrite, case when e is null then 'default' else e || '/' || name end as dimension, false as truncated
  from (select query_id, q, name, unnest(range(coalesce(len(parts), 1))) as i, unnest(coalesce(parts, [null])) as e from l) where i < 8"""


def plan_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Leaves of at most two a question, with a note where more were left out; each question is asked of three things here."""
    q = read_table(spark, sf, "research_queries").select("query_id", F.concat(F.lit("对比甲"), F.col("query_id").cast("string"), F.lit("、乙、丙的收入")).alias("query"))
    d = q.select("query_id", F.posexplode(route.plan_leaves(F.col("query"), F.when(F.col("query_id") % 2 == 0, 2).otherwise(3))).alias("i", "l"))
    return d.select("query_id", "i", F.col("l.q").alias("leaf"), "l.dimension", "l.truncated")


SQL["plan_notes"] = """with l(i, a) as (values (0, '甲'), (1, '乙'), (2, '丙')), q as (select query_id, i, case when i = 0 then a || query_id else a end as a from research_queries, l)
  select query_id, i::int as i, a || ' 的收入' as leaf, a || '/收入' as dimension, false as truncated from q where i < case query_id % 2 when 0 then 2 else 3 end
  union all select query_id, 2, '(宽度超限，原 3 叶子截断至 2)', 'note', true from research_queries where query_id % 2 = 0"""


def topic_scores(spark: SparkSession, sf: str) -> DataFrame:
    return route.topics(read_table(spark, sf, "research_queries"))


_words = ", ".join(f"('{t}', '{w.lower()}', {s})" for t, w, s in route.TOPIC_WORDS)
TOPICS = f"topics as (select query_id, topic, sum(s)::double as score from research_queries, (values {_words}) w(topic, word, s) where contains(lower(coalesce(query, '')), word) group by query_id, topic)"
SQL["topic_scores"] = f"with {TOPICS} select * from topics"


def routed_sources(spark: SparkSession, sf: str) -> DataFrame:
    q = read_table(spark, sf, "research_queries")
    return route.select_sources(route.topics(q), q, registry.registry(spark).where(registry.active("standard")))


_reg = ", ".join("({}, '{}', '{}', '{}', [{}], {})".format(r["ordinal"], r["id"], r["category"], r["access"], ", ".join(f"'{t}'" for t in r["topics"]), "true" if r["gate"] is None and r["access"] != "keyed" and r["category"] in registry.WIDE else "false") for r in registry.builtin())
SQL["routed_sources"] = f"""with {TOPICS}, r(ordinal, id, category, access, topics, on_) as (values {_reg}), a as (select *, category in ('intl_engines', 'reference') or access = 'keyed' as core from r where on_),
  e as (select t.query_id, a.id, a.ordinal, max(t.score) as score from (select id, ordinal, unnest(topics) as topic from a where not core) a join topics t using (topic) group by all)
  select query_id, id, 'core' as kind from research_queries, a where core union all
  select query_id, id, 'expert' from (select *, row_number() over (partition by query_id order by score desc, ordinal) as rn from e) where rn + (select count(*) from a where core) <= 16"""


def registry_counts(spark: SparkSession, sf: str) -> DataFrame:
    return registry.describe(read_table(spark, sf, "source_registry"))


SQL["registry_counts"] = "select category, count(*) as sources, count(*) filter (access = 'keyed') as keyed, array_to_string(list(id order by id), ',') as ids from source_registry group by category"


def active_sources(spark: SparkSession, sf: str) -> DataFrame:
    r = read_table(spark, sf, "source_registry")
    out = None
    for t in registry.TIERS:
        d = r.where(registry.active(t)).groupBy("source_type").agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("tier"), "source_type", "n")
        out = d if out is None else out.union(d)
    return out


SQL["active_sources"] = " union all ".join(f"select '{t}' as tier, source_type, count(*) as n from source_registry where access <> 'keyed' and category in ({', '.join(repr(c) for c in cs)}) and coalesce(gate <> 'searxng', true) group by source_type" for t, cs in registry.TIERS.items())


def builtin_sources(spark: SparkSession, sf: str) -> DataFrame:
    return registry.describe(registry.registry(spark))


SQL["builtin_sources"] = f"with r(ordinal, id, category, access, topics, on_) as (values {_reg}) select category, count(*) as sources, count(*) filter (access = 'keyed') as keyed, array_to_string(list(id order by id), ',') as ids from r group by category"


def request_urls(spark: SparkSession, sf: str) -> DataFrame:
    r = read_table(spark, sf, "source_registry").select("id", registry.fill_template(F.col("url_template"), F.lit("a b/c"), F.lit(None).cast("string")).alias("request"))
    return r


SQL["request_urls"] = "select id, replace(replace(url_template, '{q}', 'a%20b/c'), '{token}', '') as request from source_registry"


def stock_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Codes in documents' first lines, their market ids, and names resolved by the longest alias."""
    d = read_table(spark, sf, "documents").select("doc_id", F.concat(F.coalesce("title", F.lit("")), F.lit(" 贵州茅台 sh"), F.lpad((F.col("doc_id") * 7919 % 1000000).cast("string"), 6, "0")).alias("q"))
    code = finance.stock_code(F.col("q"))
    return d.select("doc_id", code.alias("code"), finance.secid(code).alias("secid"), finance.quote_prefix(code).alias("market"), finance.resolve_name(F.col("q")).alias("by_name"))


_x = "coalesce(nullif(regexp_extract(q, '(?i)(?:sh|sz|bj)\\s*([0-9]{6})', 1), ''), nullif(regexp_extract(q, '(?:^|[^0-9])([0-9]{6})(?:$|[^0-9])', 1), ''))"
SQL["stock_codes"] = f"""select doc_id, code, case when left(code, 1) in ('6', '9') then '1.' else '0.' end || code as secid, case when left(code, 1) in ('6', '9') then 'sh' else 'sz' end as market,
  case {' '.join(f"when contains(q, '{n}') then '{c}'" for n, c in sorted(finance.ALIASES.items(), key=lambda kv: -len(kv[0])))} end as by_name
  from (select doc_id, q, {_x} as code from (select doc_id, coalesce(title, '') || ' 贵州茅台 sh' || lpad((doc_id * 7919 % 1000000)::varchar, 6, '0') as q from documents))"""

QUERIES = [tiers, tier_hits, overrides, plan_leaves, plan_notes, topic_scores, routed_sources, registry_counts, active_sources, builtin_sources, request_urls, stock_codes]
