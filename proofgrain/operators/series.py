"""Time series of quotes and reports, and state over event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proofgrain.functions.finance import fmt_field, fmt_yuan
from proofgrain.functions.text import filled, rounded


def latest(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The last n rows of each key by order, numbered from the newest."""
    w = W.partitionBy(key).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def annual(df: DataFrame, key: str, date: str, tie: str, month_day: str = "12-31", n: int = 5) -> DataFrame:
    """The latest n annual rows of each key: those whose date ends in ``month_day``."""
    return latest(df.where(F.date_format(date, "MM-dd") == month_day), key, [date, tie], n)


def parse_klines(df: DataFrame, line: str, least: int = 11) -> DataFrame:
    """Typed columns of comma-separated quote lines; shorter lines are dropped."""
    p = F.split(F.col(line), ",")
    d = df.withColumn("_p", p).where(F.size("_p") >= least)
    names = ("day", "open", "close", "high", "low", "volume", "amount", "amplitude", "change_pct", "change", "turnover")
    return d.withColumns({n: F.col("_p")[i] if n == "day" else F.col("_p")[i].try_cast("double") for i, n in enumerate(names)}).drop("_p")


def cooldown_blocked(events: DataFrame, key: str, ts: str, tie: str, failed: Column, seconds: Column) -> DataFrame:
    """events with ``blocked``: whether the last failure of the key still blocks at the time."""
    w = W.partitionBy(key).orderBy(ts, tie).rowsBetween(W.unboundedPreceding, -1)
    until = F.when(failed, F.unix_micros(F.col(ts).cast("timestamp")) + seconds * F.lit(1_000_000))
    return events.withColumn("until", F.last(until, ignorenulls=True).over(w)).withColumn("blocked", F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")) < F.col("until"), F.lit(False)))


def ttl_hits(events: DataFrame, key: str, ts: str, tie: str, written: Column, seconds: int) -> DataFrame:
    """events with ``hit``: whether the newest write of the key before the row is younger than its life."""
    w = W.partitionBy(key).orderBy(ts, tie).rowsBetween(W.unboundedPreceding, -1)
    stamp = F.when(written, F.unix_micros(F.col(ts).cast("timestamp")))
    return events.withColumn("last_write", F.last(stamp, ignorenulls=True).over(w)).withColumn("hit", F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")) < F.col("last_write") + seconds * 1_000_000, F.lit(False)))


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """left with the newest ``value`` of right at or before its time (union and one window, no range join)."""
    r = right.select(F.col(key), F.col(ts), F.col(value).alias("_v"), F.lit(0).alias("_side"))
    every = left.withColumn("_v", F.lit(None).cast(r.schema["_v"].dataType)).withColumn("_side", F.lit(1)).unionByName(r, allowMissingColumns=True)
    w = W.partitionBy(key).orderBy(ts, "_side").rowsBetween(W.unboundedPreceding, 0)
    return every.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_v", "_side")


def daily_bars(lines: DataFrame) -> DataFrame:
    """Open, close, high, low and volume of a part's days."""
    day = F.to_date("l_shipdate")
    o = F.struct("l_orderkey", "l_linenumber")
    return lines.groupBy(F.col("l_partkey").alias("code"), day.alias("day")).agg(F.min_by("l_extendedprice", o).alias("open"), F.max_by("l_extendedprice", o).alias("close"), F.max("l_extendedprice").alias("high"), F.min("l_extendedprice").alias("low"), F.sum(F.col("l_quantity").cast("long")).alias("volume"))


def change_pct(bars: DataFrame) -> DataFrame:
    prev = F.lag("close").over(W.partitionBy("code").orderBy("day"))
    return bars.withColumn("change_pct", rounded((F.col("close") - prev) / prev * F.lit(100.0), 2))


def within(left: DataFrame, right: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Pairs of left and right rows of one key, the right one at most ``seconds`` before the left one: an interval join.

    Time is cut into slots of that length and each left row looks into two of them,
    so rows meet by an equality of key and slot. ``right``'s time comes out as right_ts.
    """
    slot = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / F.lit(seconds * 1_000_000))
    x = left.withColumn("_slot", F.explode(F.array(slot(F.col(ts)), slot(F.col(ts)) - 1)))
    y = right.withColumnRenamed(ts, "right_ts").withColumn("_slot", slot(F.col("right_ts")))
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("right_ts").cast("timestamp"))
    return x.join(y, [key, "_slot"]).where((gap >= 0) & (gap <= seconds * 1_000_000)).drop("_slot")


def quote_text(quotes: DataFrame) -> DataFrame:
    """code, text of quotes (code, name, f43, f60, f168, f170, f116, klines, flows): prices and turnover are hundredths."""
    def tail(lines: str, n: int, least: int, made) -> Column:
        cut = F.filter(F.transform(F.slice(F.col(lines), F.greatest(F.lit(1), F.size(lines) - (n - 1)), F.lit(n)), lambda x: F.split(x, ",")), lambda p: F.size(p) >= least)
        return F.when(F.size(cut) > 0, F.array_join(F.transform(cut, made), "\n")).otherwise("（无）")

    bars = tail("klines", 10, 11, lambda p: F.concat(p[0], F.lit(" 收"), p[2], F.lit(" 涨跌幅"), p[8], F.lit("% 换手"), p[10], F.lit("%")))
    flows = tail("flows", 5, 7, lambda p: F.concat(p[0], F.lit(" 主力净流入"), p[1]))
    head = F.concat(F.lit("最新价: "), fmt_field(F.col("f43"), 100.0, " 元"), F.lit("  昨收: "), fmt_field(F.col("f60"), 100.0, " 元"), F.lit("  换手: "), fmt_field(F.col("f168"), 100.0, "%"),
                    F.lit("  市盈率TTM: "), fmt_field(F.col("f170")), F.lit("  总市值: "), fmt_field(F.col("f116")))
    return quotes.select("code", F.concat_ws("\n", F.concat(F.lit("# 行情："), "name", F.lit("("), "code", F.lit(")")), head, F.lit("## 近半年日K（末10交易日）"), bars, F.lit("## 主力资金流（末5交易日）"), flows).alias("text"))


def report_text(reports: DataFrame, year_end: str = "12-31") -> DataFrame:
    """code, text of report rows (code, day, revenue, growth and, as far as known, name, profit, profit_growth, eps, roe, assets): the latest period, then up to five years, newest first."""
    reports = reports.select("*", *[F.lit(None).cast("string").alias(c) for c in ("name", "profit", "profit_growth", "eps", "roe", "assets") if c not in reports.columns])
    pct = lambda c: F.when(F.col(c).isNull(), "—").otherwise(fmt_field(F.col(c), 1.0, "%"))
    day = F.date_format("day", "yyyy-MM-dd")
    head = F.concat(F.lit("# 财报："), filled("name"), F.lit("("), "code", F.lit(")\n最新报告期: "), day, F.lit("\n营业收入: "), fmt_yuan(F.col("revenue")), F.lit("（同比 "), pct("growth"), F.lit("）\n归母净利润: "), fmt_yuan(F.col("profit")), F.lit("（同比 "), pct("profit_growth"),
                    F.lit("）\n基本每股收益: "), fmt_field(F.col("eps")), F.lit(" 元  加权平均ROE: "), pct("roe"), F.lit("  每股净资产: "), fmt_field(F.col("assets")), F.lit(" 元\n\n近年年度业绩（单位：亿元 / 元；同比%）："))
    line = F.concat(F.lit("- "), day, F.lit("：营收 "), fmt_yuan(F.col("revenue")), F.lit("（同比 "), pct("growth"), F.lit("） | 归母净利润 "), fmt_yuan(F.col("profit")), F.lit("（同比 "), pct("profit_growth"), F.lit("） | EPS "), fmt_field(F.col("eps")), F.lit(" | ROE "), pct("roe"))
    newest = latest(reports, "code", ["day"], 1).select("code", head.alias("head"))
    years = annual(reports, "code", "day", "day", year_end).select("code", F.struct("rn", line.alias("l")).alias("x")).groupBy("code").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["l"]), "\n").alias("years"))
    return newest.join(years, "code", "left").select("code", F.concat_ws("\n", "head", "years").alias("text"))
