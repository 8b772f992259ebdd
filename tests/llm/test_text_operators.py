from __future__ import annotations

import itertools
import random

import pytest


from proofgrain.llm import leakage, lookalikes, main_body, mojibake, near_duplicates, personal_data, queries, repeated_lines, residue, tokens, truncation
from proofgrain.llm._shared import reduced

WORDS = "the parser of quarterly revenue restores an idle harbour before any ledger was counted in Saltrey by the audit team who keep copies of every sparse index".split()


def prose(seed: int, n: int = 80) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("." if i % 12 == 11 else "") for i in range(n)) + "."


def frame(spark, rows, ddl="doc_id bigint, text string, source string, row_id string, form string, lines string"):
    """Rows (id, text) with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "s1", "x", "y", "z") for i, t in rows], ddl)


AWKWARD = [(1, None), (2, ""), (3, "  \n\t"), (4, "ä"), (5, "word " * 40_000), (6, "\x00퟿\U0001f600 mixed"), (7, "same"), (8, "same")]


# 1 encodings
GARBLED = [("Müller’s café – 5 €", e) for e in ("cp1252", "latin_1")] + [("Über größere Gefüge", "cp437"), ("forêt désuète", "mac_roman"), ("forêt désuète", "cp1251")]


@pytest.mark.parametrize("text,enc", GARBLED)
def test_utf8_read_as_single_bytes_comes_back(text, enc):
    raw = text.encode("utf-8")
    wrong = "".join(mojibake._decode(b, enc) if b >= 0x80 else chr(b) for b in raw)
    fixed, layers, case = mojibake.assess(wrong)
    assert case and layers == 1 and fixed == text


def test_layers_places_and_lost_bytes():
    text = "这份报告的结论是可靠的，数据也已经公布。"
    once = "".join(mojibake._decode(b, "cp1252") if b >= 0x80 else chr(b) for b in text.encode())
    twice = "".join(mojibake._decode(b, "cp1252") if b >= 0x80 else chr(b) for b in once.encode())
    assert mojibake.assess(twice)[0] == text
    assert mojibake.assess(text.encode("gbk").decode("latin_1"))[0] == text
    assert mojibake.assess(f"{text}\n{once}")[0] == f"{text}\n{text}"
    assert mojibake.assess(text.encode("gbk").decode("utf-8", "replace"))[2]


@pytest.mark.parametrize("text", ["", "plain", "Élodine a répété l’essai « âgé » – 5 €", "数据集“透明”——结果。", "xⁿ ÷ 2 ≤ 10 Ω", "invеntory with one foreign letter", "LE GISEMENT ÂGÉ"])
def test_correct_text_is_no_case(text):
    assert not mojibake.assess(text)[2]


def test_mojibake_awkward(spark):
    got = mojibake.mend_fields(frame(spark, AWKWARD), "documents", "doc_id", ["text"]).collect()
    assert got == []
    assert mojibake.mend_fields(frame(spark, []), "documents", "doc_id", ["text"]).count() == 0


# 2 near duplicates
def shingles(t):
    r = reduced(t)
    return {r[i: i + 9] for i in range(len(r) - 8)}


def test_near_duplicates_equal_brute_force(spark):
    base = [prose(s, 90) for s in range(12)]
    texts = []
    for t in base:
        w = t.split(" ")
        texts += [t, t.upper(), " ".join(w[:40] + ["inserted"] + w[40:]), " ".join(w[60:] + w[:60])]
    rows = list(enumerate(texts, 1)) + [(i + 500, t) for i, t in AWKWARD[:4]]
    docs = frame(spark, [(i + 100, t) for i, t in rows])
    links, members = near_duplicates.near_duplicates(docs, "doc_id", "text")
    got = {(r[0], r[1]) for r in near_duplicates.expand(links, members).collect()}
    want = set()
    for (a, x), (b, y) in itertools.combinations([(i + 100, t) for i, t in rows if t and len(reduced(t)) >= 200], 2):
        if len(shingles(x) & shingles(y)) >= 0.7 * len(shingles(x) | shingles(y)):
            want.add((a, b))
    assert got == want and len(got) > 40
    cls = {r["doc_id"]: r["class_id"] for r in near_duplicates.classes(links, members).collect()}
    assert all(cls[a] == cls[b] for a, b in got)


def test_pairs_near_the_least_similarity_meet_in_a_shard(spark):
    r = random.Random(5)
    letters = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    rows = []
    for k in range(2000):  # 43 of 300 letters replaced: similarity 0.70
        t, at = letters(300), r.randrange(9, 240)
        rows += [(2 * k, t), (2 * k + 1, t[:at] + letters(43) + t[at + 43:])]
    assert all(len(shingles(x) & shingles(y)) >= 0.7 * len(shingles(x) | shingles(y)) for (_, x), (_, y) in zip(rows[:40:2], rows[1:40:2]))
    sk = {x["doc_id"]: x for x in near_duplicates.sketch(frame(spark, rows), "doc_id", "text").collect()}
    missed = [k for k in range(2000) if not set(sk[2 * k]["bands"]) & set(sk[2 * k + 1]["bands"])]
    far = [k for k in range(2000) if sum((sk[2 * k][f] ^ sk[2 * k + 1][f]).bit_count() for f in ("f1", "f2")) > near_duplicates.RADIUS]
    assert missed == [] and far == []


def test_blocks_of_one_shard_lose_no_pair(spark):
    rows = [(7, i, i % 5, 0) for i in range(60)] + [(8, 1000, 1, 1)]
    df = spark.createDataFrame(rows, "key bigint, doc_id bigint, f1 bigint, f2 bigint")
    got = {(r[0], r[1]) for r in near_duplicates.search_shards(df, 2, block=16).collect()}
    want = {(a, b) for a, b in itertools.combinations(range(60), 2) if ((a % 5) ^ (b % 5)).bit_count() <= 2}
    assert got == want


def test_bk_tree_equals_scan():
    r = random.Random(1)
    fps = [r.getrandbits(60) & r.getrandbits(60) for _ in range(300)]
    tree = near_duplicates.BKTree()
    for i, f in enumerate(fps):
        tree.add(f, i)
    for q in fps[:20]:
        assert sorted(tree.within(q, 14)) == [i for i, f in enumerate(fps) if (f ^ q).bit_count() <= 14]


def test_near_duplicates_of_nothing(spark):
    links, members = near_duplicates.near_duplicates(frame(spark, AWKWARD[:4]), "doc_id", "text")
    assert links.count() == 0 and members.count() == 0


# 3 main body
PAGE = """<html><body><nav class="m"><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></nav>
<div class="ad"><p>Try Foo{n} free for {n} days</p></div>
<article class="b"><h1>Title {n}</h1><p>{p}</p><li>item number {n} of the list goes here</li><table><tr><td>a</td><td>{n}</td></tr></table></article>
<div class="c"><p>ann12 (3 days ago): I liked {n} of it.</p></div><div class="f"><p>© 2024 Site</p><p>Imprint | Contact</p></div></body></html>"""


def test_main_body_of_pages(spark):
    rows = []
    for n in range(1, 9):
        p = prose(n, 24)
        text = f"Home\nNews\nTry Foo{n} free for {n} days\nTitle {n}\n{p}\nitem number {n} of the list goes here\na | {n}\nann12 (3 days ago): I liked {n} of it.\n\n© 2024 Site\nImprint | Contact"
        rows.append((n, "https://www.site.example/x", PAGE.format(n=n, p=p), f"Title {n}", text))
    rows += [(50, "https://site.example/y", None, None, None), (51, None, None, "T", "T\nOne long sentence stands here.\n\n"), (52, "bad url", "<div><p>x", None, ""), (53, "https://site.example", "", "", " \n")]
    df = spark.createDataFrame(rows, "fetch_id bigint, url string, raw_html string, title string, text string")
    got = {(r["fetch_id"], r["line_no"]): r["main"] for r in main_body.classified(df, "fetch_id", "url", "raw_html", "title", "text").collect()}
    for n in range(1, 9):
        assert [got[n, i] for i in (1, 2, 3, 4, 5, 6, 7, 8, 10, 11)] == [False, False, False, True, True, True, True, False, False, False]
        assert (n, 9) not in got
    assert got[51, 1] and got[51, 2] and not any(k[0] in (50, 52, 53) for k in got)
    assert main_body.main_text(df, "fetch_id", "url", "raw_html", "title", "text").count() == len(rows)


def test_a_page_delivered_again_is_no_evidence_for_its_text(spark):
    page = '<html><body><div class="bar"><p>This site uses cookies.</p></div><div><p>{p}</p></div><div class="ad"><p>{q}</p></div></body></html>'
    rows, first = [], 0
    for n in range(1, 13):
        p, q = prose(n, 24), prose(n + 300, 18)
        for _ in range(9 if n <= 2 else 1):  # two pages come nine times each
            first += 1
            rows.append((first, f"https://site{n % 3}.example/{n}", page.format(p=p, q=q), "T", f"This site uses cookies.\n{p}"))
    df = spark.createDataFrame(rows, "fetch_id bigint, url string, raw_html string, title string, text string")
    got = {(r["fetch_id"], r["line_no"]): r["main"] for r in main_body.classified(df, "fetch_id", "url", "raw_html", "title", "text").collect()}
    assert got == {(r[0], n): n == 2 for r in rows for n in (1, 2)}


def test_parse_survives_broken_html():
    for h in ("<", "<div><p>a</div></p>b", "<script>x</script", "<table><tr><td>1<td>2</table>", "<a href='x'>t"):
        main_body.containers(main_body.parse(h))


# 4 repeated lines
def test_repeated_lines(spark):
    rows = [(i, f"Line {i}\n  Share  THIS {i} times \n\nFoot\nunique {i * 'x'}", "a") for i in range(30)] + [(100 + i, "Foot", "b") for i in range(4)] + [(200, None, "a"), (201, "", "a"), (202, "share this 7 times", None)]
    df = spark.createDataFrame([(i, t, s, "k", 1) for i, t, s in rows], "doc_id bigint, text string, source string, keys string, node int")
    hits, block = repeated_lines.boilerplate(df, "doc_id", "text", "source")
    got = {(r["row_id"], r["line_no"]) for r in hits.collect()}
    assert got == {(i, n) for i in range(30) for n in (1, 2, 4)}
    b = block.collect()
    assert len({r["block"] for r in b}) == 1 and {r["docs"] for r in b} == {30}
    clean = {r["doc_id"]: r["text"] for r in repeated_lines.clean(df, "doc_id", "text", "source").collect()}
    assert clean[3] == "\nunique xxx" and clean[200] is None and clean[201] == "" and clean[100] == "Foot" and len(clean) == len(rows)


def test_repeated_lines_empty(spark):
    assert repeated_lines.boilerplate(frame(spark, []), "doc_id", "text", "source")[0].count() == 0
    assert repeated_lines.clean(frame(spark, AWKWARD), "doc_id", "text", "source").count() == len(AWKWARD)


@pytest.mark.parametrize("name", ["p4_found", "p4_clean"])
def test_deletion_goes_by_blocks(spark, tmp_path, monkeypatch, name):
    """Head and Note are one block (a blank line between them), Foot another one; the lines of a block taken away stay in the documents."""
    frame(spark, [(i, f"Head\n\nNote {i}\nbody {'x' * i}\nFoot") for i in range(1, 9)]).write.parquet(str(tmp_path / "documents.parquet"))

    def deleted():
        rows = queries.queries()[name](spark, str(tmp_path)).collect()
        if name == "p4_found":
            return {(r["doc_id"], r["line_no"]) for r in rows}
        return {(r["doc_id"], n) for r in rows for n, line in ((1, "Head"), (3, f"Note {r['doc_id']}"), (5, "Foot")) if line not in r["text"].split("\n")}

    assert deleted() == {(i, n) for i in range(1, 9) for n in (1, 3, 5)}
    made = repeated_lines.blocks
    monkeypatch.setattr(repeated_lines, "blocks", lambda *a: (b := made(*a)).join(b.groupBy("block").count().where("count = 2"), "block").select(*b.columns))
    assert deleted() == {(i, n) for i in range(1, 9) for n in (1, 3)}


def test_edges_count_documents_and_join_lines(spark):
    """b follows a in four documents only (twice in one of them), c follows b in five."""
    texts = ["a\nb\na\nb\nc"] + ["a\nb\nc"] * 3 + ["b\nc\nother\na"] + ["a\nown 1 x"]
    hits, block = repeated_lines.boilerplate(frame(spark, list(enumerate(texts))), "doc_id", "text", "source")
    assert sorted(r["n"] for r in block.groupBy("block").agg({"*": "count"}).toDF("block", "n").collect()) == [1, 2]
    of = {(r["row_id"], r["line_no"]): r["block"] for r in hits.collect()}
    assert set(of) == {(0, n) for n in range(1, 6)} | {(d, n) for d in (1, 2, 3) for n in (1, 2, 3)} | {(4, 1), (4, 2), (4, 4), (5, 1)}
    assert of[0, 1] == of[0, 3] == of[4, 4] == of[5, 1] != of[0, 2] == of[0, 4] == of[0, 5] == of[4, 1] == of[4, 2]


# 5 personal data
NAMES = [("Maro", "given"), ("Quendry", "family"), ("Jörgen", "given"), ("Krällmoser", "family"), ("昶沅", "given"), ("澹台", "family"), (None, "given")]


@pytest.mark.parametrize("text,kind,piece", [
    ("Write to maro.quendry+x@a-b.example or wait.", "email", "maro.quendry+x@a-b.example"), ("mail maro [at] ab [dot] example", "email", "maro [at] ab [dot] example"), ("写信到maro＠ab.test。", "email", "maro＠ab.test"),
    ("Tel. (617) 555-0117.", "phone", "(617) 555-0117"), ("call 020 7946 0834 now", "phone", "020 7946 0834"), ("电话１３８００００５４６９。", "phone", "１３８００００５４６９"), ("joignable au 01 99 00 90 71, oui", "phone", "01 99 00 90 71"),
    ("SSN 912-34-5678 of", "id_number", "912-34-5678"), ("Die Steuer-ID 90 011 353 707 gehört", "id_number", "90 011 353 707"), ("身份证号997178197711104087。", "id_number", None),
    ("lives at 52b Harrow Street, Kestrel-Bay 96759.", "address", "52b Harrow Street, Kestrel-Bay 96759"), ("Anschrift Am Grünen Tor 43, 00187 Nordhörn.", "address", "Am Grünen Tor 43, 00187 Nordhörn"),
    ("arrive au 137, rue des Ormeaux, 00441 Valcourt.", "address", "137, rue des Ormeaux, 00441 Valcourt"), ("收件地址：翎川市砚蘅路173号8单元890室。", "address", "翎川市砚蘅路173号8单元890室"),
    ("said Quendry, Maro, who", "name", "Quendry, Maro"), ("Herr Jörgen Krällmoser kam", "name", "Jörgen Krällmoser"), ("Herr Jörgen Krällmoser kam", "name", "Jörgen Krällmoser"), ("据澹台昶沅先生介绍", "name", "澹台昶沅"),
])
def test_personal_data(text, kind, piece):
    spans = [s for s in personal_data.Finder(NAMES).spans(text) if s.kind == kind]
    if piece is None:
        assert len(spans) <= 1
    else:
        assert [text[s.start:s.end] for s in spans] == [piece]


@pytest.mark.parametrize("text", ["Order no. 1706394858 was closed.", "See ISBN 978-0-99680-203-1 for", "Ticket 2024-835-9896 is open.", "订单号66821682824193493898已关闭", "证券代码414874停牌", "updated 2025/04/07 12:18", "The Quendry Group did not comment.",
                                  "La rue des Ormeaux reste fermée.", "The decorator @cached appears.", "up from 2,274 in 2008.", "批次编号19900008006208320已入库"])
def test_no_personal_data(text):
    assert personal_data.Finder(NAMES).spans(text) == []


def test_checksums():
    assert personal_data.luhn("4539578763621486") and not personal_data.luhn("4539578763621487")
    assert personal_data.mod97("255081416802538") and personal_data.mod11_2("11010519491231002X") and not personal_data.mod11_2("110105194912310021")
    assert personal_data.mod11_10("86095742719")


def test_redaction_keeps_the_rest(spark):
    names = spark.createDataFrame([(p, k, "en") for p, k in NAMES], "name_part string, kind string, lang string")
    rows = AWKWARD + [(20, "Ask Maro Quendry, mail a@b.example!")]
    out = {r["row_id"]: r["text"] for r in personal_data.redacted(frame(spark, rows), "documents", "doc_id", "text", names).collect()}
    assert out[20] == "Ask [NAME], mail [EMAIL]!" and out[1] is None and out[2] == "" and out[7] == "same" and len(out) == len(rows)
    assert personal_data.mentions(frame(spark, []), "documents", "doc_id", "text", names).count() == 0


# 6 look-alikes
SAME = [("data base", "data base"), ("résumé", "résumé"), ("copy", "сору"), ("profit ﬁne", "profit fine"), ("abc123", "ａｂｃ１２３"), ("a​b­c", "abc"), ("文字", "⽂字"), ("Kelvin", "Kelvin"), ("q̣̇", "q̣̇"), ("ệ", "ệ"), ("A，b", "A,b")]
OTHER = [("x2", "x²"), ("1", "①"), ("Data", "data"), ("ete", "été"), ("a b", "a  b"), ("a-b", "a–b"), ("wait…", "wait..."), ("O", "0")]


def test_forms(spark):
    rows = [(i, t) for i, t in enumerate(itertools.chain(*SAME, *OTHER))] + [(500 + i, t) for i, t in AWKWARD]
    df = frame(spark, rows)
    got = {r["doc_id"]: r["form"] for r in lookalikes.bring_to_form(df, ["doc_id"], "text").collect()}
    assert got == {i: t if t is None else lookalikes.canonical(t) for i, t in rows}
    for i in range(len(SAME)):
        assert got[2 * i] == got[2 * i + 1], SAME[i]
    for i in range(len(SAME), len(SAME) + len(OTHER)):
        assert got[2 * i] != got[2 * i + 1], OTHER[i - len(SAME)]


def test_look_same_pairs(spark):
    rows = [(1, 1, "copy"), (2, 1, "сopy"), (3, 2, "сopy"), (4, 1, "copy"), (5, 1, None), (6, 1, " "), (7, 1, " ")]
    df = spark.createDataFrame(rows, "id bigint, grp bigint, f string")
    got = {(r[0], r[1]) for r in lookalikes.look_same(lookalikes.bring_to_form(df, ["id", "grp"], "f"), "id", ["grp"], "f").collect()}
    assert got == {(1, 2), (2, 4)}


# 7 residue
def test_residue(spark):
    notices = ["404 Not Found", "Access Denied", "请启用JavaScript后重新加载本页。", "Seite nicht gefunden (404)", "{{page_title}}", "Lorem ipsum dolor sit amet, elit magna aliqua veniam"]
    content = [f"{prose(s, 30)}\n{prose(s + 500, 20)}" for s in range(60)] + ["How a site halved its 404 errors", "Printers have used lorem ipsum as filler for generations, the archive notes.", "A template engine swaps a mark such as “{{user}}” for a value when the page is rendered."]
    holders = [f"In practice, {m} reported {prose(s, 20)}" for s, m in enumerate(["{{amount}}", "${city}", "%%REPORT_DATE%%", "[INSERT AUTHOR HERE]", "<%= title %>"])]
    rows = [(i, t) for i, t in enumerate([*notices * 6, *holders * 4, *content])] + [(900 + i, t) for i, t in AWKWARD]
    df = frame(spark, rows)
    model = residue.gather([df.select("text")])
    got = {r["row_id"] for r in residue.residue(df, "documents", "doc_id", ["text"], model).collect()}
    want = {i for i, t in rows[: len(notices) * 6 + len(holders) * 4]}
    assert got == want


def test_residue_beyond_the_seed_phrases(spark):
    seeds = ["Access denied", "404 Not Found", "Error 503: the service is unavailable. Try again later.", "The page you asked for was not found.", "Please enable JavaScript to go on.", "Untitled page",
             "Just a moment…", "Your session has expired. Log in again to go on."]
    other = ["Access to the page was denied. Error 1020.", "The service is unavailable. Enable JavaScript, log in again. " * 9, "Page not found: error 404"]
    filler = [f"Lorem ipsum dolor sit amet {a} {b} magna aliqua" for a, b in itertools.permutations(["tempor", "labore", "veniam", "nostrud"], 2)]
    holders = [f"In {m} the group reported {m} million in 2023." for m in ("{{amount}}", "{{city}}", "${city}", "{{year}}")]
    new = "In [CITY NAME] the group reported @@amount@@ million in 2023."
    content = [f"{prose(s, 30)}\n{prose(s + 500, 20)}" for s in range(60)] + ["How a site halved its 404 errors", "The notice “Access to the page was denied” made readers leave.", "Access was denied to the auditors of the ledger. " + prose(3, 30)]
    rows = list(enumerate([*seeds * 2, *filler, *holders * 3, *other, new, *content]))
    df = frame(spark, rows)
    got = {r["row_id"]: r["kind"] for r in residue.residue(df, "documents", "doc_id", ["text"], residue.gather([df.select("text")])).collect()}
    assert not any(residue.is_notice(t) for t in other)
    assert got == {i: "filler" if t in filler else "placeholder" if t in holders or t == new else "notice" for i, t in rows if t not in content}


# 8 tokens
@pytest.mark.skipif(not __import__("os").path.exists(tokens.DEFAULT_VOCABULARY), reason="no vocabulary here")
def test_tokens_equal_exact_merging(spark):
    import tiktoken

    ranks = tokens.read_vocabulary()
    exact = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(4)
    alphabet = "abc 12²①½\t\n\x1c一二的éèＡ😀_-'s'll٣Ⅷ́​<|endoftext|>"
    rows = AWKWARD + [(100 + k, "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))) for k in range(300)] + [(999, "<|endoftext|> The field office’s report — 数据集的结果。")]
    got = {x["doc_id"]: x["ids"] for x in tokens.encode(frame(spark, rows), "doc_id", "text").collect()}
    assert got == {i: exact.encode_ordinary(t) if t else [] for i, t in rows}
    assert tokens.merge(b"hello there", ranks) == exact.encode_ordinary("hello there")


# 9 leakage
def test_leakage_equals_brute_force(spark):
    items = [(k, prose(1000 + k, 40)) for k in range(6)] + [(50, None), (51, ""), (52, "short")]
    rows = AWKWARD + [(100 + k, f"{prose(k, 30)} {t[: len(t) * part // 10]} {prose(k + 9, 10)}") for k, (_, t) in enumerate(items[:6]) for part in [3 + k]] + [(200, items[0][1].upper())]
    docs, its = frame(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"], r["shared"]) for r in leakage.leaks(docs, its, "doc_id", "text", "item_id", "text").collect()}

    def cut(t):
        r = reduced(t)
        return {r[i: i + 20] for i in range(len(r) - 19)}

    want = {(d, i, len(cut(t) & cut(x))) for d, t in rows if t for i, x in items if x and cut(x) and 2 * len(cut(t) & cut(x)) >= len(cut(x))}
    assert got == want and len(want) >= 4
    assert leakage.leaks(frame(spark, []), its, "doc_id", "text", "item_id", "text").count() == 0
    assert leakage.leaks(docs, its.limit(0), "doc_id", "text", "item_id", "text").count() == 0


# 10 truncation
@pytest.mark.parametrize("text,end", [("A full sentence.", "finished"), ("He said “yes.”", "finished"), ("结束了。", "finished"), ("broken off in the mid", "open"), ("broken off in…", "open"), ("cut [...]", "open"), ("up to 34.", "doubtful"), ("", "blank"), (" \n", "blank"), ("“We will wait,”", "open")])
def test_endings(text, end):
    assert truncation.ending(text) == end


def test_truncation(spark):
    whole = {i: prose(i, 60) for i in range(12)}
    rows = [(i, f"{t}\nShared by {i} people") for i, t in whole.items()] + [(20 + i, f"{t}\nShared by {i} people\nMore {prose(i + 70, 12)}") for i, t in whole.items()]
    rows += [(100, whole[3][:201]), (101, whole[4][:150] + "…"), (102, f"Up {whole[5][:80]} rose to 34.5 percent. Fine."), (103, f"Up {whole[5][:80]} rose to 34."), (104, "404 Not Found"), (105, None), (106, ""), (107, " "), (108, whole[3][:201])]
    got = {r["doc_id"]: r["evidence"] for r in truncation.truncated(frame(spark, rows), "doc_id", "text", "source").collect()}
    assert set(got) == {100, 101, 103, 108} and got[103] == "prefix" and got[100] == "prefix"
    rate = truncation.rates(frame(spark, rows), "doc_id", "text", "source").first()
    assert (rate["cut"], rate["docs"]) == (4, len(rows) - 3)
    assert truncation.truncated(frame(spark, []), "doc_id", "text", "source").count() == 0


def test_copies_of_a_cut_text_do_not_vouch_for_its_last_line(spark):
    cut_off = f"{prose(500, 40)}\nthe ledger was counted by the audit team before the har"
    edited = [f"{prose(500, 40)}\n{prose(600 + i, 6)}\nthe ledger was counted by the audit team before the har" for i in range(6)]
    rows = [(i, t, "a") for i, t in enumerate([cut_off] * 8 + edited)] + [(100 + i, prose(i, 40), "a") for i in range(20)]
    # a line that ends many texts of one source is full there, and no evidence for another source
    rows += [(200 + i, f"{prose(i + 50, 40)}\nMore from the harbour desk", "b") for i in range(12)] + [(300, f"{prose(300, 40)}\nMore from the harbour desk", "c"), (301, prose(301, 40), "c"), (302, f"{prose(302, 40)}\nMore from the harbour desk", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r["doc_id"] for r in truncation.truncated(df, "doc_id", "text", "source").collect()}
    assert got == set(range(14)) | {300, 302}
    rate = {r["source"]: r["cut"] for r in truncation.rates(df, "doc_id", "text", "source").collect()}
    assert rate == {"a": 14, "b": 0, "c": 1, None: 1}


def test_texts_shorter_than_the_prefix_meet_their_longer_copies(spark):
    rows = [(1, "Prices rose to 34."), (2, f"Prices rose to 34.5 percent. {prose(1, 30)}"), (3, "Notes on the harbour"), (4, f"Notes on the harbour\n{prose(2, 30)}"), (5, "The ledger of the harbour was […]"), (6, f"The ledger of the harbour was counted. {prose(3, 30)}"),
            (7, f"{prose(4, 8)[:60]} (...)"), (8, f"{prose(4, 8)[:60]}\n{prose(5, 30)}"), (9, "…"), (10, "Prices rose to 35.")]
    got = {r["doc_id"]: r["evidence"] for r in truncation.truncated(frame(spark, rows), "doc_id", "text", "source").collect()}
    assert got == {1: "prefix", 5: "prefix", 9: "end"}


def test_queries_are_named(spark):
    from proofgrain.llm import queries

    q = queries.queries()
    assert all(any(n.startswith(f"p{k}_") for n in q) for k in range(1, 11))
    assert {n for n in q if n.endswith("_found")} >= {f"p{k}_found" for k in (1, 2, 3, 4, 5, 6, 7, 9, 10)} and "p8_ids" in q
    assert set(queries.oracle_sql()) <= set(q)


# wider cases of the operators above
OTHER_SCRIPTS = ["Die Straße über München wurde größer", "这份报告的结论是可靠的，数据也已经公布。", "Отчёт о проверке складов опубликован в пятницу.", "Η έκθεση για τις αποθήκες δημοσιεύθηκε.", "창고 감사 보고서가 금요일에 발표되었다.",
                 "نشر تقرير مراجعة المستودعات يوم الجمعة.", "รายงานการตรวจสอบคลังสินค้าเผยแพร่แล้ว", "הדוח על המחסנים פורסם ביום שישי", "गोदामों की जांच की रिपोर्ट शुक्रवार को आई।", "Łódź ogłosiła żółtą gęś, który został zamknięty."]


@pytest.mark.parametrize("text", OTHER_SCRIPTS)
def test_any_script_comes_back_from_any_number_of_layers(text):
    assert not mojibake.assess(text)[2]
    for enc in ("latin_1", "cp1252"):
        wrong = text
        for layers in range(1, 7):
            wrong = "".join(mojibake._decode(b, enc) if b >= 0x80 else chr(b) for b in wrong.encode())
            assert mojibake.assess(wrong) == (text, layers, True)


@pytest.mark.parametrize("text", ["Він їде до Києва, де ґанок і єдина їжа.", "„Spaß“ und Fuß… groß“ Maß”", "Größe»Ü« ß“ Ö»", "Привет, мир № 5 — “да”"])
def test_pairs_that_look_like_sequences_are_no_case(text):
    assert not mojibake.assess(text)[2]


@pytest.mark.parametrize("right,wrong", [("social insurance number 046 454 286", "social insurance number 046 454 287"), ("personnummer 811228-9874", "personnummer 811228-9875"), ("numéro de sécurité sociale 255081416802538", None)])
def test_a_wrong_check_digit_changes_the_decision(right, wrong):
    kinds = lambda t: [s.kind for s in personal_data.Finder(NAMES).spans(f"with {t} on file")]
    assert kinds(right) == ["id_number"] and (wrong is None or kinds(wrong) == [])


def test_look_alikes_of_a_hot_string(spark):
    rows = [(i, 1, "copy") for i in range(3000)] + [(3000 + i, 1, "сopy") for i in range(2)] + [(4000, 1, "cоpy"), (4001, 2, "copy"), (4002, 1, None), (4003, 1, " ")]
    df = spark.createDataFrame(rows, "id bigint, grp bigint, f string")
    forms = lookalikes.bring_to_form(df, ["id", "grp"], "f")
    got = {(r[0], r[1]) for r in lookalikes.look_same(forms, "id", ["grp"], "f").collect()}
    assert got == {(i, j) for i in range(3000) for j in (3000, 3001, 4000)} | {(3000, 4000), (3001, 4000)}
    cls = {r["row_id"]: (r["class_id"], r["strings"]) for r in lookalikes.classes(forms, "id", ["grp"], "f").collect()}
    assert cls == {**{r[0]: (0, 3) for r in rows[:3003]}, 4001: (4001, 1)}


def test_lines_do_not_need_blocks(spark):
    df = frame(spark, [(i, f"Head\nbody {'x' * i}\nFoot 12") for i in range(1, 9)])
    hits, _ = repeated_lines.boilerplate(df, "doc_id", "text", "source")
    some = {(r[0], r[1]) for r in hits.select("row_id", "line_no").collect()}
    assert some == {(r[0], r[1]) for r in repeated_lines.repeated(df, "doc_id", "text", "source").select("row_id", "line_no").collect()} == {(i, n) for i in range(1, 9) for n in (1, 3)}


def test_merging_long_words_in_little_time():
    import time

    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abab": 257, b"ba": 258, b"cc": 259}
    at = time.perf_counter()
    assert tokens.merge(b"ab" * 100_001, ranks) == [257] * 50_000 + [256] and tokens.merge(b"ccc", ranks) == [259, 99] and tokens.merge(b"", ranks) == []
    assert time.perf_counter() - at < 5


@pytest.mark.parametrize("text", ["Service Temporarily Unavailable", "Sorry, something went wrong.", "Database connection error", "You need to enable JavaScript to run this app.", "Attention Required! | Verify you are human", "Sorry, something went wrong. Please try again later. " * 12])
def test_notices_in_words_of_no_seed(spark, text):
    seeds = ["Access denied", "404 Not Found", "Error 503: the service is unavailable. Try again later.", "Please enable JavaScript to go on."]
    content = [f"{prose(s, 30)}\n{prose(s + 500, 20)}" for s in range(60)]
    model = residue.gather([frame(spark, list(enumerate([*seeds * 3, *content]))).select("text")])
    assert not residue.is_notice(text) and residue.decide(text, model)[0] == "notice"
    assert all(residue.decide(t, model) is None for t in content)


def test_placeholders_of_any_length_and_near_words_about_marks(spark):
    holders = [f"In {m} the group reported {m} million in 2023." for m in ("{{amount}}", "{{city}}", "${city}", "{{year}}")]
    about = [f"A template engine swaps a mark such as “{m}” for a value when the page is rendered." for m in ("{{user}}", "{{city}}", "${city}")]
    model = residue.gather([frame(spark, list(enumerate([*holders * 4, *about * 3, *(prose(s, 40) for s in range(60))]))).select("text")])
    kinds = [residue.decide(t, model) for t in ("In {{" + "report." * 20 + "amount}} the group reported growth.", "In {{city}} the group reported a mark of 12 million in {{year}}.")]
    assert [k and k[0] for k in kinds] == ["placeholder", "placeholder"]
    assert all(residue.decide(t, model) is None for t in about)


@pytest.mark.parametrize("most", [0, 250_000])
def test_truncated_texts_of_any_length_meet_their_longer_copies(spark, most):
    """On both sides of the bound for broadcasting."""
    long = prose(900, 900)
    rows = [(1, "The rate rose to 34."), (2, "The rate rose to 34.5 percent in the year under review."), (3, long[:4000]), (4, long), (5, "of the harb"), (6, "of the harbour it is said that all is well."),
            # a full line elsewhere that a longer copy goes on from in mid-word
            (7, f"{prose(7, 30)}\nMore from the desk"), (8, f"{prose(7, 30)}\nMore from the deskwork of the team. Fine."), *[(20 + i, f"{prose(70 + i, 30)}\nMore from the desk\n{prose(90 + i, 9)}") for i in range(6)],
            (9, "same end"), (10, "same end"), (11, "same end\nAnd more of it.")]
    rows += [(100 + i, long[: 4000]) for i in range(300)]  # a hot text
    got = {r["doc_id"]: r["evidence"] for r in truncation.truncated(frame(spark, rows), "doc_id", "text", "source", most).collect()}
    assert got == {i: "prefix" for i in [1, 3, 5, 7, *range(100, 400)]}


def test_simple_tree_matching():
    tree = main_body.read_tree("nav,div.a(aside.x,div.y),div:p,footer")
    assert tree.text() == "(nav,div.a(aside.x,div.y),div:p,footer)" and main_body.match(tree, tree)[0] == 7
    other = main_body.read_tree("nav,div.ad,div.a(div.y),footer")
    assert main_body.match(tree, other)[0] == 5  # the root, nav, div.a with div.y, footer
    main_body.merge(tree, other)
    assert tree.text() == "(nav,div.ad,div.a(aside.x,div.y),div:p,footer)"
    main_body.numbered(tree)
    assert main_body.align(tree, other) == [0, 1, 2, 4, 6] and main_body.align(tree, main_body.read_tree("none,footer")) == [-1, 6]
    assert main_body.read_tree("").text() == ""


NESTED = """<html><body><div class="page"><nav class="m"><li><a href="/a">Home</a></li></nav>
<div class="wrap"><div class="story"><h1>Title {n}</h1><p>{p}</p><aside class="box"><p>Follow our desk on all channels.</p><p>Write to us today.</p></aside><p>{q}</p></div>
<div class="side"><p>Most read this week</p><p><a href="/x">{r}</a></p></div></div><footer class="f"><p>© 2024 Site</p></footer></div></body></html>"""


def test_sidebars_within_content_are_slots_of_their_own(spark):
    rows = []
    for n in range(1, 13):
        p, q, r = prose(n, 24), prose(n + 100, 24), prose(n + 200, 6)
        rows.append((n, f"https://site.example/{n}", NESTED.format(n=n, p=p, q=q, r=r), f"Title {n}", f"Home\nTitle {n}\n{p}\nFollow our desk on all channels.\nWrite to us today.\n{q}\nMost read this week\n{r}\n© 2024 Site"))
    df = spark.createDataFrame(rows, "fetch_id bigint, url string, raw_html string, title string, text string")
    got = {(r["fetch_id"], r["line_no"]): r["main"] for r in main_body.classified(df, "fetch_id", "url", "raw_html", "title", "text").collect()}
    assert got == {(n, k): k in (2, 3, 6) for n in range(1, 13) for k in range(1, 10)}


@pytest.mark.parametrize("bound", [0, 100_000])
def test_hot_host_equals_its_pages_in_parts(spark, monkeypatch, bound):
    """One host with all pages in many structures, on both sides of the bound for broadcasting."""
    monkeypatch.setattr(main_body, "MAX_BROADCAST", bound)
    rows = []
    for n in range(300):
        p = prose(n, 20)
        parts = [f'<div class="ad{k}"><p>Advert number {k} of this site</p></div>' for k in range(6) if n >> k & 1]
        lines = [f"Advert number {k} of this site" for k in range(6) if n >> k & 1]
        rows.append((n, "https://hot.example/x", f'<html><body>{"".join(parts)}<div class="text"><p>{p}</p></div></body></html>', "T", "\n".join([*lines, p])))
    df = spark.createDataFrame(rows, "fetch_id bigint, url string, raw_html string, title string, text string")
    got = {(r["fetch_id"], r["line_no"]): r["main"] for r in main_body.classified(df, "fetch_id", "url", "raw_html", "title", "text").collect()}
    assert got == {(n, k + 1): k == bin(n & 63).count("1") for n in range(300) for k in range(bin(n & 63).count("1") + 1)}


def test_cells_of_a_hot_shard_lose_no_pair(spark):
    rows = [(7, i, (i * 37) % 97, 0) for i in range(500)] + [(8, 1000 + i, 1, i) for i in range(3)]
    df = spark.createDataFrame(rows, "key bigint, doc_id bigint, f1 bigint, f2 bigint")
    for block, group in ((16, 4), (7, 1), (64, 32)):
        got = {(r[0], r[1]) for r in near_duplicates.search_shards(df, 1, block=block, group=group).collect()}
        want = {(a[1], b[1]) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and ((a[2] ^ b[2]).bit_count() + (a[3] ^ b[3]).bit_count()) <= 1}
        assert got == want


@pytest.mark.parametrize("most", [0, 10**9])
def test_leaks_on_both_sides_of_the_bound(spark, most):
    items = [(k, prose(1000 + k, 40)) for k in range(6)] + [(7, prose(1000, 40)), (50, None), (51, ""), (52, "short")]
    rows = AWKWARD + [(100 + k, f"{prose(k, 30)} {t[: len(t) * (3 + k) // 10]} {prose(k + 9, 10)}") for k, (_, t) in enumerate(items[:6])] + [(200, items[0][1].upper())]
    rows += [(300 + i, items[3][1]) for i in range(200)]  # a hot document
    docs, its = frame(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"], r["shared"], r["shingles"]) for r in leakage.leaks(docs, its, "doc_id", "text", "item_id", "text", most).collect()}

    def cut(t):
        r = reduced(t)
        return {r[i: i + 20] for i in range(len(r) - 19)}

    want = {(d, i, len(cut(t) & cut(x)), len(cut(x))) for d, t in rows if t for i, x in items if x and cut(x) and 2 * len(cut(t) & cut(x)) >= len(cut(x))}
    assert got == want and len(want) > 200
    where = {(r["doc_id"], r["item_id"]): (r["from_pos"], r["to_pos"]) for r in leakage.leaks(docs, its, "doc_id", "text", "item_id", "text", most).collect()}
    assert where[200, 0] == (1, len(reduced(items[0][1])))
    assert leakage.leaks(frame(spark, []), its, "doc_id", "text", "item_id", "text", most).count() == 0 and leakage.leaks(docs, its.limit(0), "doc_id", "text", "item_id", "text", most).count() == 0


def test_sketches_of_pairs_near_the_least_similarity(spark):
    """Sifting loses none of 4000 random pairs of similarity 0.70, of short and of long texts, and most of those of 0.35."""
    r = random.Random(11)
    letters = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=n))

    def rows(count, size, changed):
        out = []
        for k in range(count):
            t, at = letters(size), r.randrange(9, size - changed - 9)
            out += [(2 * k, t), (2 * k + 1, t[:at] + letters(changed) + t[at + changed:])]
        return out

    def kept(pairs):
        sk = near_duplicates.sketch(frame(spark, pairs), "doc_id", "text")
        df = spark.createDataFrame([(2 * k, 2 * k + 1) for k in range(len(pairs) // 2)], "a bigint, b bigint")
        return near_duplicates.sift(df, sk).count()

    assert near_duplicates.least_equal(0.7) == 53
    assert kept(rows(2000, 300, 43)) == 2000 and kept(rows(2000, 1500, 254)) == 2000
    assert kept(rows(500, 1500, 705)) < 100


def test_forms_beyond_the_basic_plane(spark):
    pairs = [("が", "が"), ("\U0001d400bc", "Abc"), ("\U0001109a", "\U00011099\U000110ba"), ("葛\U000e0100城", "葛城"), ("a\U000e0041b", "ab"), ("\U0001f100", "\U0001f100"), ("क़", "क़")]
    df = frame(spark, list(enumerate(itertools.chain(*pairs))))
    got = {r["doc_id"]: r["form"] for r in lookalikes.bring_to_form(df, ["doc_id"], "text").collect()}
    assert all(got[2 * i] == got[2 * i + 1] for i in range(len(pairs)))
    assert got == {i: lookalikes.canonical(t) for i, t in enumerate(itertools.chain(*pairs))}


@pytest.mark.parametrize("bound", [0, 500_000])
def test_repeated_lines_on_both_sides_of_the_bound(spark, monkeypatch, bound):
    monkeypatch.setattr(repeated_lines, "MAX_BROADCAST_NODES", bound)
    df = frame(spark, [(i, f"Head\nbody {'x' * i}\nFoot 12\n{'rare' * (i % 3)}") for i in range(1, 40)])
    got = {(r["row_id"], r["line_no"]) for r in repeated_lines.repeated(df, "doc_id", "text", "source").collect()}
    hits, block = repeated_lines.boilerplate(df, "doc_id", "text", "source")
    assert got == {(r["row_id"], r["line_no"]) for r in hits.collect()} == {(i, n) for i in range(1, 40) for n in ((1, 3, 4) if i % 3 else (1, 3))}
    assert block.select("block").distinct().count() == 2  # "Foot 12" goes on with two lines; "Head" stands alone


@pytest.mark.parametrize("text", ["The export volume of 106 million, up from 90", "Foods reached €7,221 million, led by the pipeline", "between 2009 and 2012 — a sparse result", "main­frame shrank to 42.6", "un plus tôt : l’essai « âgé »"])
def test_unusual_spaces_are_no_case(text):
    assert not mojibake.assess(text)[2]


@pytest.mark.parametrize("text", ["À l’inverse, le « règlement inégal » a été archivé à Montsavel.", "Après 22 essais, le témoin vérifié révèle l’âge à la régie du port."])
def test_lone_signs_do_not_hide_garbled_words(text):
    wrong = text.encode("cp1252").decode("mac_roman")
    assert mojibake.assess(wrong) == (text, 1, True)
