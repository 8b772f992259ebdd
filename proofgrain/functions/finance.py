"""Functions on quotes, codes and amounts, all Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofgrain.functions.text import filled

# Names of listed firms and their codes.
ALIASES = {
    "贵州茅台": "600519", "茅台": "600519", "宁德时代": "300750", "比亚迪": "002594", "中国平安": "601318", "招商银行": "600036", "工商银行": "601398", "五粮液": "000858", "伊利股份": "600887", "美的集团": "000333",
    "格力电器": "000651", "东方财富": "300059", "中信证券": "600030", "京东方A": "000725", "海康威视": "002415", "立讯精密": "002475", "隆基绿能": "601012", "三一重工": "600031", "药明康德": "603259", "迈瑞医疗": "300760",
    "长江电力": "600900", "中芯国际": "688981", "汇川技术": "300124", "顺丰控股": "002352", "万华化学": "600309", "洋河股份": "002304", "平安银行": "000001", "兴业银行": "601166", "农业银行": "601288", "中国石油": "601857",
    "中国石化": "600028", "中国移动": "600941", "泸州老窖": "000568", "紫金矿业": "601899", "北方华创": "002371", "中国中免": "601888", "国电南瑞": "600406", "海尔智家": "600690", "福耀玻璃": "600660", "韦尔股份": "603501",
    "山西汾酒": "600809", "陕西煤业": "601225", "片仔癀": "600436", "通威股份": "600438", "歌尔股份": "002241",
}
REPORT_WORDS = ("财报", "营收", "利润", "资产负债", "现金流", "业绩", "季报", "年报", "中报", "一季报", "三季报", "每股收益", "净利润", "roe", "ROE")


def stock_code(q: Column) -> Column:
    """A prefixed six-digit code, else an isolated one, else null."""
    q = filled(q)
    first = F.regexp_extract(q, r"(?i)(?:sh|sz|bj)\s*([0-9]{6})", 1)
    lone = F.regexp_extract(q, r"(?:^|[^0-9])([0-9]{6})(?:$|[^0-9])", 1)
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(lone, F.lit("")))


def resolve_name(q: Column) -> Column:
    """Code of the longest alias the text holds; the earlier one among equals."""
    hit = None
    for name, code in sorted(ALIASES.items(), key=lambda kv: -len(kv[0])):
        hit = F.when(q.contains(name), code) if hit is None else hit.when(q.contains(name), code)
    return hit


def secid(code: Column) -> Column:
    return F.concat(F.when(F.substring(code, 1, 1).isin("6", "9"), "1.").otherwise("0."), code)


def quote_prefix(code: Column) -> Column:
    return F.when(F.substring(code, 1, 1).isin("6", "9"), "sh").otherwise("sz")


def two_places(x: Column) -> Column:
    """Two decimals, half up on the binary value, as text."""
    cents = F.floor(F.abs(x) * F.lit(100.0) + F.lit(0.5)).cast("long")
    sign = F.when((x < 0) & (cents > 0), "-").otherwise("")
    return F.concat(sign, F.floor(cents / 100).cast("long").cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def fmt_field(v: Column, scale: float = 1.0, suffix: str = "") -> Column:
    n = v.try_cast("double")
    return F.when(n.isNull(), "—").otherwise(F.concat(two_places(n / F.lit(scale)), F.lit(suffix)))


def fmt_yuan(v: Column) -> Column:
    n = v.try_cast("double")
    return (F.when(n.isNull(), "—").when(F.abs(n) >= 1e8, F.concat(two_places(n / F.lit(1e8)), F.lit(" 亿元")))
            .when(F.abs(n) >= 1e4, F.concat(two_places(n / F.lit(1e4)), F.lit(" 万元"))).otherwise(F.concat(two_places(n), F.lit(" 元"))))
