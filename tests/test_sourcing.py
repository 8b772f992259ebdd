from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from proofgrain.functions import select, url
from proofgrain.operators import dedup, landing, report
from proofgrain.session import shared_folder
from proofgrain.sources import adapters, readers, registry
from proofgrain.streaming import state


@pytest.mark.parametrize("address,want", [
    ("https://www.baidu.com/s?wd=x", True), ("https://x.com/SEARCH/1", True), ("https://x.com/a?q", True), ("https://x.com/a?Q=1", True), ("https://x.com/a?page=2", False), ("https://arxiv.org/abs/1", False), ("https://x.com/a?&&wd=1", True), ("", False), (None, False)])
def test_result_pages(spark, address, want):
    df = spark.createDataFrame([(address,)], "u string")
    assert df.select(url.is_serp(F.col("u"))).first()[0] is want


@pytest.mark.parametrize("address,want", [("https://myforum.com", "forum"), ("https://x.gov.cn/forum", "gov"), ("https://pubmed.ncbi.nlm.nih.gov/1", "academic"), ("arxiv.org/abs/1", "academic"), ("https://a.com", "unknown"), (None, "unknown")])
def test_source_types(spark, address, want):
    assert spark.createDataFrame([(address,)], "u string").select(url.source_type(F.col("u"))).first()[0] == want


def test_structured_citations(spark):
    rows = [(1, 0, 1, "https://e.com/a", "A 文", None, "web", None), (1, 1, 2, "https://e.com/b", "B 文", None, "academic", {"key": "arxiv-b", "doi": "10.1/b", "authors": "X", "year": "2024", "source": "arxiv"}),
            (1, 2, 3, "https://github.com/owner/repo", None, "x", "github", {"key": "github-owner-repo", "repo": "owner/repo", "source": "github-api"})]
    df = spark.createDataFrame(rows, "query_id bigint, pos int, fetch_id bigint, url string, title string, snippet string, source_type string, citation map<string,string>")
    bib = report.citations(df, "bibtex").first()["content"]
    assert bib == ("@misc{src1,\n  title = {A 文},\n  howpublished = {https://e.com/a},\n  note = {web}\n}\n@article{arxiv-b,\n  title = {B 文},\n  author = {X},\n  year = {2024},\n  doi = {10.1/b},\n  url = {https://e.com/b}\n}\n"
                   "@misc{github-owner-repo,\n  title = {x},\n  howpublished = {https://github.com/owner/repo},\n  note = {repo=owner/repo; source=github-api}\n}\n")


@pytest.mark.parametrize("threshold", [1, 3, 6])
def test_all_pairs_within_any_threshold(spark, threshold):
    r = random.Random(threshold)
    base = [r.getrandbits(63) for _ in range(8)]
    hashes = sorted({h ^ sum(1 << b for b in r.sample(range(63), k)) for h in base for k in range(threshold + 3)})
    fp = spark.createDataFrame([("p", h, (i, i)) for i, h in enumerate(hashes)], "part string, h bigint, ord struct<pos:bigint,id:bigint>")
    got = {(x["h"], x["h2"]) for x in dedup.candidate_pairs(fp, threshold).collect()}
    assert got == {(a, b) for a in hashes for b in hashes if a < b and (a ^ b).bit_count() <= threshold} and got


def test_near_duplicates_by_whole_texts(spark):
    head = " ".join(f"word{i}" for i in range(300))
    rows = [(1, i, 0, f"https://h/{i}", f"{head} {tail}", "t") for i, tail in enumerate([" ".join(f"a{k}" for k in range(900)), " ".join(f"b{k}" for k in range(900))])]
    df = spark.createDataFrame(rows, "query_id bigint, fetch_id bigint, pos int, url string, snippet string, title string")
    assert dedup.near_dup(df, "query_id", "fetch_id", 3).count() == 2


def test_selectors():
    t = select.tree('<div class="x c-container y"><h3><a href="/link?u=1">one</a></h3></div><li class="b_algo"><h2><span><a href="https://b.org">two</a></span></h2></li><div class="body"><div class="section">deep<script>no</script><p>text</p></div><p><div class="section">not a child</div></p></div>')
    hrefs = lambda s: [e.attrs["href"] for e in select.chosen(t, s)]
    assert hrefs("div[class*='c-container'] h3 a") == ["/link?u=1"] and hrefs("li.b_algo h2 a, h3 a") == ["/link?u=1", "https://b.org"]
    assert [select.text_of(e) for e in select.chosen(t, "div.body > div.section")] == [["deep", "text"]]
    assert select.chosen(t, "a.none") == [] and select.chosen(select.tree(None), "a") == [] and select.chosen(select.tree("<p><a href='x'>unclosed"), "p a")


def test_site_texts(spark):
    df = spark.createDataFrame([("<div class='s-prose'>the  answer</div><p>rest</p>", "stackoverflow.com"), ("<p>x</p>", "stackoverflow.com"), ("<p>x</p>", "other.org"), (None, None)], "h string, d string")
    assert [r[0] for r in df.select(select.site_text(F.col("h"), F.col("d"))).collect()] == ["the answer", None, None, None]


def test_two_hops(spark):
    html = '<a href="/settings">s</a><a href="https://a.org/1">a</a><a href="https://b.org/search?q=1">no</a><a href="//c.org/2">c</a><a href="https://a.org/1">again</a><a href="/url?to=d">d</a>'
    serp = spark.createDataFrame([(1, "https://www.google.com/search?q=x", "None", html), (2, "https://www.google.com/search?q=y", "None", "<p>nothing"), (3, None, None, None), (4, "https://x.com/s", "None", '<a href="https://short.org">s</a>'), (5, "https://x.com/s", "DuckDuckGo", '<a href="https://a.org/1">n</a><a class="result__a" href="https://c.org/2">r</a>')], "fetch_id bigint, url string, engine string, raw_html string")
    pages = spark.createDataFrame([("https://a.org/1", 11, "too short", None), ("https://c.org/2", 12, "long enough " * 9, "https://c.org/final"), ("https://short.org", 13, "x" * 90, "https://www.baidu.com/home")], "url string, page_id bigint, text string, final_url string")
    got = {r["fetch_id"]: (r["landing"], r["outcome"]) for r in landing.resolve(serp, pages, registry.engines(spark)).collect()}
    assert got == {1: (12, "resolved"), 2: (None, "no_serp_links"), 3: (None, "no_serp_links"), 4: (None, "landing_unreachable"), 5: (12, "resolved")}
    assert landing.resolve(serp, pages, fallback=False).count() == 2 and landing.resolve(serp.limit(0), pages).count() == 0


def test_registry_rows_are_whole(spark):
    reg = registry.registry(spark)
    r = {x["id"]: x for x in reg.collect()}
    assert r["Crossref"]["url_template"] == "https://api.crossref.org/works?query={q}&rows=5" and r["Crossref"]["adapter"] == "crossref" and r["InternetArchive"]["item_map"] == {"url": "identifier", "title": "title"}
    assert r["Google"]["tiers"] == ["lite", "standard", "full"] and r["Exa"]["tiers"] == [] and r["NBS"]["adapter"] == "nbs" and r["SearxNG"]["gate"] == "searxng"
    assert all(x["url_template"] or x["engine_id"] or x["adapter"] == "nbs" for x in r.values()) and {x["adapter"] for x in r.values()} - {None, "nbs"} <= set(adapters.ADAPTERS)
    e = {x["id"]: x for x in registry.engines(spark).collect()}
    assert len(e) == 48 and e["DuckDuckGo"]["selector"] == "a.result__a" and "{q}" in e["Bilibili"]["search_url"]
    q = spark.createDataFrame([(1, "a b/c~*", "Google"), (1, "a b/c~*", "SearxNG"), (1, "a b/c~*", "NBS"), (1, "a b/c~*", "WHATWG")], "query_id bigint, query string, id string")
    got = {x["source"]: x["address"] for x in registry.requests(q, reg, registry.engines(spark), "http://own").collect()}
    assert got == {"Google": "https://www.google.com/search?q=a%20b/c~%2A", "SearxNG": "http://own/search?q=a%20b/c~%2A", "NBS": registry.NBS_REQUEST, "WHATWG": "https://html.spec.whatwg.org/multipage/#toc"}


def test_payloads_of_any_source_in_one_plan(spark):
    rows = [(1, "Crossref", json.dumps({"message": {"items": [{"DOI": "10/1", "title": ["T"]}, {"title": ["none"]}]}})), (2, "InternetArchive", json.dumps({"response": {"docs": [{"identifier": f"https://a.org/{i}", "title": "A"} for i in range(9)]}})),
            (3, "W3C", '<p><a href="https://x.y">X</a>'), (4, "NBS", "some data"), (5, "NBS", " "), (6, "Crossref", None), (7, "Crossref", "{}"), (8, "USGS", '{"a": 1}'), (9, "none", "{}")]
    p = spark.createDataFrame([(i, s, "q", "https://base.org", t) for i, s, t in rows], "query_id bigint, source string, q string, base string, payload string")
    got = {(r["query_id"], r["pos"]): r["url"] for r in adapters.adapt_mixed(p, registry.registry(spark), ("response.docs",)).collect()}
    assert got == {(1, 0): "https://doi.org/10/1", **{(2, i): f"https://a.org/{i}" for i in range(5)}, (3, 0): "https://x.y", (4, 0): "https://data.stats.gov.cn/"}


def test_links_without_labels(spark):
    pages = [(1, "https://b.org/", '<a href="https://b.org">own</a><link href="https://c.org/x"><link href="https://c.org/x">'), (2, "q", '<a href="https://d.org"><b>D</b></a><link href="https://c.org/x">'), (3, "q", ""), (4, None, None), (5, "q", "".join(f"<a href='https://e.org/{i % 7}'>{i}</a>" for i in range(30)))]
    df = spark.createDataFrame(pages, "query_id bigint, base string, payload string")
    got = sorted((r["query_id"], r["pos"], r["url"], r["title"]) for r in adapters.adapt_links(df).collect())
    assert got == [(1, 0, "https://b.org", ""), (1, 1, "https://c.org/x", ""), (2, 0, "https://d.org", "D"), *[(5, i, f"https://e.org/{i}", str(i)) for i in range(5)]]


def test_captured_files(spark, tmp_path):
    (tmp_path / "pubmed__3.json").write_text('{"a":\n1}')
    (tmp_path / "bad__x.json").write_text("{}")
    (tmp_path / "plain.json").write_text("{}")
    assert [tuple(r) for r in readers.read_captured(spark, str(tmp_path)).collect()] == [("pubmed", 3, '{"a":\n1}')]


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "r")
    batch = lambda n: spark.createDataFrame([(f"{i:02d}",) for i in range(n)], "item string")
    for n, number in ((3, 0), (5, 1), (5, 1), (3, 0), (6, 2)):
        state.append_report(batch(n), path, number)
    assert sorted(r["item"] for r in spark.read.parquet(path).collect()) == [f"{i:02d}" for i in range(6)]
    (tmp_path / "broken").write_text("no parquet")
    with pytest.raises(Exception):
        state.append_report(batch(1), str(tmp_path / "broken"))


def test_streams_with_late_rows(spark, tmp_path):
    """Rows behind the watermark of earlier batches are dropped, those before it are counted."""
    def put(n, rows):
        spark.createDataFrame(rows, "t string, event_type string").select(F.to_timestamp("t").alias("ts"), "event_type", F.lit(1.0).alias("value")).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
        for f in (tmp_path / "in" / str(n)).glob("*.parquet"):
            os.utime(f, (1_700_000_000 + 60 * n,) * 2)  # files are read in this order

    def run(name, stream):
        q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"c{name}")).trigger(availableNow=True).start()
        q.awaitTermination()

    schema = "ts timestamp, event_type string, value double"
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    put(1, [("2024-01-01 00:05:00", "a"), ("2024-01-01 00:10:00", "a")])
    put(2, [("2024-01-01 03:00:00", "b")])
    put(3, [("2024-01-01 02:55:00", "a"), ("2024-01-01 05:00:00", "a")])
    put(4, [("2024-01-01 00:50:00", "a"), ("2024-01-01 05:10:00", "a")])
    run("win", state.windowed_counts(source(), "10 minutes"))
    got = {(r["start"].strftime("%H"), r["event_type"]): r["n"] for r in spark.table("win").collect()}
    assert got == {("00", "a"): 2, ("02", "a"): 1, ("03", "b"): 1}
    run("first", state.first_seen(source(), "event_type", "1 hour"))
    # "a" is forgotten an hour after its last row, so it is new once more at 02:55; the late row is dropped
    assert sorted(r["event_type"] for r in spark.table("first").collect()) == ["a", "a", "b"]


def test_checkpoints_need_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda k, d=None: d)

    with pytest.raises(ValueError):
        shared_folder(Session())
    assert shared_folder(spark)


def test_engines_of_a_domain_and_the_last_resort(spark):
    from proofgrain.operators import gather

    q = spark.createDataFrame([(1, "code"), (2, None), (3, "unknown"), (4, "medical")], "query_id bigint, domain string")
    got = {}
    for r in gather.choose_engines(q).orderBy("query_id", "at").collect():
        got.setdefault(r["query_id"], []).append(r["engine"])
    assert got == {1: ["GitHub", "StackOverflow", "HackerNews"], 2: ["Baidu", "Sogou"], 3: ["Baidu", "Sogou"], 4: ["PubMed"]}
    assert {r["engine"] for r in gather.choose_engines(q, "http://own").where("query_id in (2, 3)").collect()} == {gather.SEARXNG}
    res = spark.createDataFrame([(1, "Baidu", 0), (2, "Sogou", 0), (3, "GitHub", 0), (4, "PubMed", 0), (4, "Baidu", 0)], "query_id bigint, engine string, pos int")
    assert {(r["query_id"], r["engine"]) for r in gather.general_search(q, res).collect()} == {(1, "Baidu"), (2, "Sogou"), (4, "PubMed")}


def test_steps_of_the_caller(spark, tmp_path):
    from proofgrain.operators import gather
    from proofgrain.plans import pipeline

    assert gather.load_config(spark, {"a": 1}) == {"a": 1} and gather.load_config(spark, None) == {} and gather.load_config(spark, str(tmp_path / "none.json")) == {}
    (tmp_path / "c.json").write_text('{"tier":\n"L2"}')
    (tmp_path / "bad.json").write_text("[")
    assert gather.load_config(spark, str(tmp_path / "c.json")) == {"tier": "L2"} and gather.load_config(spark, str(tmp_path / "bad.json")) == {}
    q = spark.createDataFrame([(1, "对比 Alpha 与 Beta"), (2, "什么")], "query_id bigint, query string")
    plan = {r["query_id"]: r["tier"] for r in pipeline.run_plan(q, classify=lambda text, asked: F.when(asked.contains("问题: 什么\n"), "L3")).collect()}
    assert plan == {1: "L2", 2: "L3"}
    row = lambda i, k, n: (i, n, k, f"https://x.org/{k}", f"text {k} with {'word' * k}", f"snippet {k} {'other' * k}", f"title {k}", "gov")
    ddl = "query_id bigint, pos int, fetch_id bigint, url string, text string, snippet string, title string, source_type string"
    docs = spark.createDataFrame([row(1, 1, 0)], ddl)
    out = pipeline.retrieve(q.where("query_id = 1"), docs, more=lambda asked: spark.createDataFrame([row(1, 2, 1)], ddl).join(asked.select("query_id"), "query_id", "left_semi"))
    assert sorted(r["fetch_id"] for r in out["sources"].collect()) == [1, 2]
    asked = []

    def agent(rows):
        asked.extend(r["dimension"] for r in rows.collect())
        return docs

    res = pipeline.research(q, lambda open_, n, seen: docs.where("false"), 2, (("nowhere", "简要"),), closure=lambda e: e.select("query_id"), agent=agent, conflicts=lambda e: e.select("query_id", F.lit("note").alias("note")))
    assert len(asked) == 5 and [r["query_id"] for r in res["evidence"].collect()] == [1] and res["conflicts"].count() == 1


def test_routers_of_the_caller(spark):
    from proofgrain.operators import gather

    q = spark.createDataFrame([(1, "a"), (2, "b")], "query_id bigint, query string")
    reg = registry.registry(spark)
    got = gather.routed(q, reg, None, lambda qs, s: qs.where("query_id = 1").select("query_id", F.lit("MDN").alias("id")).union(qs.select("query_id", F.lit("nobody"))))
    n = {r["query_id"]: r["count"] for r in got.groupBy("query_id").count().collect()}
    assert n == {1: 1, 2: 65}


def test_a_running_sum_in_buckets_equals_one_window(spark):
    from pyspark.sql import Window as W

    from proofgrain.operators import control

    r = random.Random(3)
    rows = [(1 if i % 3 else i % 5, r.choice([0, 1, None]), r.randrange(3), i * 40_000, r.randrange(50)) for i in range(400)]
    df = spark.createDataFrame(rows, "query_id bigint, round int, pos int, fetch_id bigint, t bigint")
    got = {x["fetch_id"]: (x["used"], x["over"]) for x in control.running_budget(df, F.col("t"), F.lit(300)).collect()}
    w = W.partitionBy("query_id").orderBy("round", "pos", "fetch_id").rowsBetween(W.unboundedPreceding, 0)
    want = {x["fetch_id"]: (x["u"], x["u"] >= 300) for x in df.withColumn("u", F.sum("t").over(w)).collect()}
    assert got == want


def test_anchors_equal_brute_force(spark):
    from proofgrain.operators import verify

    r = random.Random(8)
    words = ["the", "of", "the", *[f"w{chr(97 + i)}" for i in range(20)]]
    pick = lambda n: " ".join(r.choice(words) for _ in range(n))
    sources = [(q, p, 100 * q + p, f"u{p}", pick(12) + " the", "") for q in (1, 2) for p in range(30)] + [(3, 0, 300, "u", None, None)]
    facts = [(q, i * 3 + q, pick(6)) for q in (1, 2, 3) for i in range(60)] + [(1, 1000, ""), (1, 1001, "nothing common"), (None, 1002, "the")]
    f = spark.createDataFrame(facts + [(1, 2000 + i, "the of wa") for i in range(300)], "query_id bigint, fact_id bigint, fact string")
    s = spark.createDataFrame(sources, "query_id bigint, pos int, fetch_id bigint, url string, text string, snippet string")
    got = {x["fact_id"]: (x["overlap"], x["source"], x["verdict"]) for x in verify.anchor_facts(f, s).collect()}
    for q, i, text in facts:
        kw = set(text.split())
        best = min(((-len(kw & set((t or "").split())), p, u) for sq, p, _, u, t, _ in sources if sq == q), default=(0, 0, None))
        assert got[i] == ((-best[0], best[2], "TRUE") if best[0] else (0, None, "UNCERTAIN")), (q, i)
    assert len(got) == len(facts) + 300


@pytest.mark.parametrize("block", [7, 4096])
def test_nearest_in_blocks_of_queries(spark, monkeypatch, block):
    from proofgrain.operators import vectors

    monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(400)] + [(401, None), (403, [0.0] * 6)] + [(500 + i, [1.0] * 6) for i in range(4)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    got = {}
    for x in vectors.nearest(df, "id", "v", 4).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append(x["vec_id"])
    norm = {i: sum(a * a for a in v) ** 0.5 for i, v in rows if v}
    for q, v in rows:
        if q % 20 == 0 and v:
            close = sorted((-int(sum(a * b for a, b in zip(v, w)) / (norm[q] * max(norm[i], 1e-300)) * 1e6 + 1e6 + 0.5), i) for i, w in rows if w and i != q)
            assert got[q] == [i for _, i in close[:4]]
