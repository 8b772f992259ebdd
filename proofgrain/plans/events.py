"""Queries on series, payloads and event time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proofgrain.functions import finance
from proofgrain.functions.text import rounded
from proofgrain.operators import series
from proofgrain.session import cut, read_table, remove, shared_folder
from proofgrain.streaming import state

SQL: dict[str, str] = {}
_two = lambda x: f"case when ({x}) < 0 and floor(abs({x}) * 100.0 + 0.5) > 0 then '-' else '' end || floor(floor(abs({x}) * 100.0::double + 0.5) / 100)::bigint || '.' || lpad((floor(abs({x}) * 100.0::double + 0.5)::bigint % 100)::varchar, 2, '0')"


def annual_reports(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate"))
    d = series.annual(o, "o_custkey", "day", "o_orderkey", "06-30", 5)
    return d.select("o_custkey", "rn", F.col("o_orderkey").alias("report"), finance.fmt_yuan(F.col("o_totalprice")).alias("revenue"))


_yuan = lambda v: f"case when {v} is null then '—' when abs({v}) >= 1e8 then {_two(f'{v} / 1e8')} || ' 亿元' when abs({v}) >= 1e4 then {_two(f'{v} / 1e4')} || ' 万元' else {_two(v)} || ' 元' end"
SQL["annual_reports"] = f"""select o_custkey, rn::int as rn, o_orderkey as report, {_yuan('o_totalprice')} as revenue from (
  select *, row_number() over (partition by o_custkey order by o_orderdate::date desc, o_orderkey desc) as rn from orders where strftime(o_orderdate, '%m-%d') = '06-30') where rn <= 5"""


def latest_bars(spark: SparkSession, sf: str) -> DataFrame:
    b = series.change_pct(series.daily_bars(read_table(spark, sf, "lineitem")))
    return series.latest(b, "code", ["day"], 10).select("code", "rn", F.date_format("day", "yyyy-MM-dd").alias("day"), "open", "close", "high", "low", "volume", "change_pct")


SQL["latest_bars"] = """with b as (select l_partkey as code, l_shipdate::date as d, arg_min(l_extendedprice, (l_orderkey, l_linenumber)) as open, arg_max(l_extendedprice, (l_orderkey, l_linenumber)) as close,
    max(l_extendedprice) as high, min(l_extendedprice) as low, sum(l_quantity::bigint)::bigint as volume from lineitem group by all),
  c as (select *, lag(close) over (partition by code order by d) as prev, row_number() over (partition by code order by d desc) as rn from b)
  select code, rn::int as rn, strftime(d, '%Y-%m-%d') as day, open, close, high, low, volume, floor((close - prev) / prev * 100.0 * 100.0 + 0.5) / 100.0 as change_pct from c where rn <= 10"""


def amounts(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders")
    x = F.col("o_totalprice")
    return o.select("o_orderkey", finance.fmt_yuan(x * F.lit(1000.0)).alias("large"), finance.fmt_field(x, 100.0, "%").alias("scaled"))


SQL["amounts"] = f"select o_orderkey, {_yuan('(o_totalprice * 1000.0::double)')} as large, {_two('o_totalprice / 100.0::double')} || '%' as scaled from orders"


def payload_values(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events").select("event_type", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("largest"))


SQL["payload_values"] = "select event_type, count(k) as n, sum(k)::bigint as total, max(k) as largest from (select event_type, json_extract_string(props, '$.k')::int as k from events) group by event_type"


def cooldowns(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events")
    secs = F.when(F.col("value") > 50, 300).otherwise(30)
    d = series.cooldown_blocked(e, "user_id", "ts", "event_id", F.col("event_type") == "error", secs)
    return d.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("blocked").alias("blocked"))


SQL["cooldowns"] = """with e as (select *, last_value(case when event_type = 'error' then epoch_us(ts) + (case when value > 50 then 300 else 30 end) * 1000000 end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as until from events)
  select event_type, count(*) as n, count(*) filter (coalesce(epoch_us(ts) < until, false)) as blocked from e group by event_type"""


def cache_hits(spark: SparkSession, sf: str) -> DataFrame:
    d = series.ttl_hits(read_table(spark, sf, "events"), "user_id", "ts", "event_id", F.col("event_type") == "purchase", 3600)
    return d.where("event_type = 'view'").select("event_id", "hit")


SQL["cache_hits"] = """with e as (select *, last_value(case when event_type = 'purchase' then epoch_us(ts) end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as w from events)
  select event_id, coalesce(epoch_us(ts) < w + 3600000000, false) as hit from e where event_type = 'view'"""


def throttle_waits(spark: SparkSession, sf: str) -> DataFrame:
    d = state.throttle(read_table(spark, sf, "events"), "user_id", "ts", "event_id", 14.0)
    return d.select("event_id", rounded(F.col("wait"), 6).alias("wait"))


SQL["throttle_waits"] = """with l as (select user_id, list({'i': event_id, 't': epoch_us(ts) / 1000000.0::double, 'w': 0.0::double, 'z': epoch_us(ts) / 1000000.0::double} order by ts, event_id) as l from events group by user_id),
  f as (select unnest(list_reduce(list_transform(l, lambda x: [x]), lambda a, b: list_append(a, {'i': b[1].i, 't': b[1].t, 'w': least(greatest(14.0::double - (b[1].t - a[-1].z), 0.0::double), 5.0::double),
    'z': b[1].t + least(greatest(14.0::double - (b[1].t - a[-1].z), 0.0::double), 5.0::double)}))) as r from l)
  select r.i as event_id, floor(r.w * 1000000.0 + 0.5) / 1000000.0 as wait from f"""


def trace_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"), F.count_distinct("user_id").alias("users"))


SQL["trace_summary"] = "select strftime(ts, '%Y-%m-%d') as day, count(*) as n, array_to_string(list_sort(list_distinct(list(event_type))), ',') as kinds, count(distinct user_id) as users from events group by 1"


def as_of_values(spark: SparkSession, sf: str) -> DataFrame:
    """For each error, the value of the user's newest purchase at or before it."""
    e = read_table(spark, sf, "events")
    d = series.as_of(e.where("event_type = 'error'").select("event_id", "user_id", "ts"), e.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("bought")), "user_id", "ts", "bought")
    return d.select("event_id", "bought")


SQL["as_of_values"] = "select e.event_id, p.value as bought from (select * from events where event_type = 'error') e asof left join (select * from events where event_type = 'purchase') p on e.user_id = p.user_id and e.ts >= p.ts"


def hourly_windows(spark: SparkSession, sf: str) -> DataFrame:
    d = state.windowed_counts(read_table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.lit(1.0).alias("value")))
    return d.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


SQL["hourly_windows"] = "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as start, event_type, count(*) as n from events group by 1, 2"


def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    d = state.sessions(read_table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return d.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


SQL["session_windows"] = """with a as (select *, case when ts < lag(ts) over w + interval 30 minutes then 0 else 1 end as start from events window w as (partition by user_id order by ts, event_id)),
  b as (select *, sum(start) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from a), c as (select user_id, s, count(*) as n from b group by all) select user_id, count(*) as sessions, max(n) as longest from c group by user_id"""


def _streamed(spark: SparkSession, source: DataFrame, schema: str) -> DataFrame:
    """The rows a stream gives until its source is worked off, through the shared folder."""
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    q = source.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = cut(spark.read.schema(schema).parquet(f"{out}/rows"))
    remove(spark, out)
    return rows


def _stream(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.readStream.schema(spark.read.parquet(f"{sf}/{table}.parquet").schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/{table}.parquet*")


def streamed_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    """First-wins removal of documents' addresses as a stream: state is kept for the watermark only."""
    keyed = _stream(spark, sf, "documents").where("url is not null").select("url", F.coalesce(F.col("fetched_at").cast("timestamp"), F.lit("2000-01-01").cast("timestamp")).alias("ts"))
    return _streamed(spark, state.first_seen(keyed, "url", "3650 days").select("url"), "url string")


SQL["streamed_first_seen"] = "select distinct url from documents where url is not null"


def streamed_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Events an hour and type, counted by a stream; windows the watermark hasn't passed yet stay open, so only those two hours before the last event count."""
    e = _stream(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.lit(1.0).alias("value"))
    d = _streamed(spark, state.windowed_counts(e, "2 hours"), "start timestamp, event_type string, n bigint, v double")
    return d.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


SQL["streamed_windows"] = """select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as start, event_type, count(*) as n from events where date_trunc('hour', ts) + interval 1 hour <= (select max(ts) from events) - interval 2 hours group by 1, 2"""


def streamed_ttl(spark: SparkSession, sf: str) -> DataFrame:
    """Views that a purchase of the hour before answers, by state with a time to live."""
    e = _stream(spark, sf, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return _streamed(spark, state.ttl_state(e, 3600), "user_id bigint, event_id bigint, hit boolean").select("event_id", "hit")


SQL["streamed_ttl"] = SQL["cache_hits"]


def late_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Facts by source, and how many came in over a day after they were checked."""
    f = read_table(spark, sf, "fact_verdicts").withColumn("lag", F.unix_micros(F.col("ingested_at").cast("timestamp")) - F.unix_micros(F.col("checked_at").cast("timestamp")))
    return f.groupBy("source_id").agg(F.count(F.lit(1)).alias("facts"), F.count_if(F.col("lag") > 86400 * 1000000).alias("late"), F.count_if(F.col("verdict") == "TRUE").alias("supported"), F.count("score").alias("scored"))


SQL["late_facts"] = "select source_id, count(*) as facts, count(*) filter (epoch_us(ingested_at) - epoch_us(checked_at) > 86400000000) as late, count(*) filter (verdict = 'TRUE') as supported, count(score) as scored from fact_verdicts group by source_id"


def verdict_cube(spark: SparkSession, sf: str) -> DataFrame:
    f = read_table(spark, sf, "fact_verdicts")
    return f.cube("verdict", "reason").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))


SQL["verdict_cube"] = "select verdict, reason, count(*) as n, grouping(verdict, reason)::int as level from fact_verdicts group by cube (verdict, reason)"

def verdict_rollup(spark: SparkSession, sf: str) -> DataFrame:
    f = read_table(spark, sf, "fact_verdicts")
    return f.rollup("verdict", "reason").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))


SQL["verdict_rollup"] = "select verdict, reason, count(*) as n, grouping(verdict, reason)::int as level from fact_verdicts group by rollup (verdict, reason)"


def purchases_before(spark: SparkSession, sf: str) -> DataFrame:
    """For each error, the user's purchases of the ten hours before."""
    e = read_table(spark, sf, "events")
    d = series.within(e.where("event_type = 'error'").select("event_id", "user_id", "ts"), e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase")), "user_id", "ts", 36_000)
    return d.select("event_id", "purchase")


SQL["purchases_before"] = """select e.event_id, p.event_id as purchase from events e join events p on e.user_id = p.user_id and e.event_type = 'error' and p.event_type = 'purchase' and p.ts <= e.ts and epoch_us(e.ts) - epoch_us(p.ts) <= 36000000000"""


def value_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Of each user's events: the value before and after, the mean of the last three, the quarter by time, and the share of the user's total."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = read_table(spark, sf, "events")
    return e.select("event_id", F.lag("value").over(w).alias("before"), F.lead("value").over(w).alias("after"), rounded(F.avg("value").over(w.rowsBetween(-2, 0)), 4).alias("mean3"), F.ntile(4).over(w).alias("quarter"),
                    F.first("event_id").over(w).alias("first_event"), F.dense_rank().over(W.partitionBy("user_id").orderBy("event_type")).alias("kind_rank"))


SQL["value_frames"] = """select event_id, lag(value) over w as before, lead(value) over w as after, floor(avg(value) over (partition by user_id order by ts, event_id rows between 2 preceding and current row) * 10000.0 + 0.5) / 10000.0 as mean3, (ntile(4) over w)::int as quarter,
    first_value(event_id) over w as first_event, (dense_rank() over (partition by user_id order by event_type))::int as kind_rank from events window w as (partition by user_id order by ts, event_id)"""

QUERIES = [verdict_rollup, purchases_before, value_frames, annual_reports, latest_bars, amounts, payload_values, cooldowns, cache_hits, throttle_waits, trace_summary, as_of_values, hourly_windows, session_windows, streamed_first_seen, streamed_windows, streamed_ttl, late_facts, verdict_cube]
