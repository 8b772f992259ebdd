from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from proofgrain.operators import guards, series
from proofgrain.sources import vault


def test_robots_and_guards(spark):
    rules = guards.disallow_rules(spark.createDataFrame([("a.com", "User-agent: *\nDisallow: /private # x\ndisallow:\n"), ("b.com", None)], "domain string, body string"))
    urls = spark.createDataFrame([("https://a.com/private/1",), ("https://a.com/open",), ("https://b.com/private",)], "url string")
    got = {r["url"]: r["allowed"] for r in guards.robots_verdicts(urls, rules).collect()}
    assert got == {"https://a.com/private/1": False, "https://a.com/open": True, "https://b.com/private": True}
    assert sum(r["allowed"] for r in guards.robots_verdicts(urls, rules, per_domain=True).collect()) == 3  # the first address is open
    r = urls.select(guards.guard_reason(F.concat("url", F.lit("/login")), F.lit(False), F.lit(True)).alias("a"), guards.guard_reason(F.col("url"), F.lit(True), F.lit(True)).alias("b"), guards.backoff(F.lit(5), F.lit(0.5)).alias("c"), guards.budget_estimate(F.lit("L1")).alias("d")).first()
    assert (r["a"], r["b"], r["c"], r["d"]) == ("loginwall", "cooldown", 8.0, 6800)


def test_dimensions_and_conflicts(spark):
    df = spark.createDataFrame([("公司财报分析", "L3"), ("缓存", "L2"), ("缓存", "L0")], "q string, t string")
    got = [r[0] for r in df.select(guards.dimensions(F.col("q"), F.col("t"))).collect()]
    assert {d["detail_level"] for d in got[0]} == {"详细"} and got[0][3]["name"] == "ROE" and len(got[1]) == 5 and got[2] == []
    replies = spark.createDataFrame([('```json\n{"conflicts": [{"fact": "f", "sources": ["a"]}]}\n```',), ("no json",), (None,)], "r string")
    assert [len(r[0]) for r in replies.select(guards.parse_conflicts(F.col("r"))).collect()] == [1, 0, 0]


def test_vault(spark, tmp_path):
    q = spark.createDataFrame([(1, "缓存")], "query_id bigint, query string")
    s = spark.createDataFrame([(1, i, i, f"https://a.b/{i}", f"t{i}", "sn", "x" * 5000, "gov") for i in range(12)], "query_id bigint, fetch_id bigint, pos int, url string, title string, snippet string, text string, source_type string")
    notes = vault.item_notes(s, q)
    assert notes.count() == 12 and notes.select(F.max(F.length("content"))).first()[0] < 4200
    assert notes.select(vault.front_matter(F.col("content"))["url"].alias("u")).where("u like 'https://a.b/%'").count() == 12
    assert vault.reports(notes).first()["content"].count("# t") == 12
    assert vault.citation_files(s, q, "ris").first()["path"].endswith("references.ris")
    assert "ROE" in vault.outlines(q, guards.dimensions(F.lit("财报"), F.lit("L2"))).first()["content"]
    path = str(tmp_path / "st")
    assert vault.load_state(spark, path).count() == 0
    vault.save_state(s, path)
    assert vault.load_state(spark, path).count() == 12


def test_quotes_and_reports(spark):
    k = [f"2024-01-{d:02d},1,{d},3,0,5,6,7,{d}.5,9,1.5" for d in range(1, 13)] + ["short"]
    df = spark.createDataFrame([("600519", "n", "168500", "166600", "35", None, "x", k, ["2024-01-01,5,0,0,0,0,0"])], "code string, name string, f43 string, f60 string, f168 string, f170 string, f116 string, klines array<string>, flows array<string>")
    t = series.quote_text(df).first()["text"]
    assert "最新价: 1685.00 元  昨收: 1666.00 元  换手: 0.35%  市盈率TTM: —" in t and t.count("涨跌幅") == 9 and "主力净流入5" in t
    rows = [("c", datetime.date(y, m, d), float(y) * 1e6, 1.5) for y in range(2016, 2025) for m, d in ((12, 31), (6, 30))] + [("c", datetime.date(2025, 3, 31), 514.43e8, None)]
    t = series.report_text(spark.createDataFrame(rows, "code string, day date, revenue double, growth double")).first()["text"].split("\n")
    assert t[1:3] == ["最新报告期: 2025-03-31", "营业收入: 514.43 亿元（同比 —）"] and len(t) == 12 and t[7].startswith("- 2024-12-31：营收 20.24 亿元（同比 1.50%） | 归母净利润 —")
