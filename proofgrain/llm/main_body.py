"""Problem 3: page boilerplate mixed with main content.

Wrapper induction over the DOM trees of all pages. Each page is parsed to its
containers (nested ones too) and their blocks. The tree of containers, with runs
of like siblings folded, is the page's skeleton. Per host the skeletons are
aligned by simple tree matching and merged to one wrapper tree, and every
skeleton is then matched against its host's wrapper, which gives each container
of each page its slot. Statistics over all pages tell what is constant:

* a slot is content if most of its blocks, over the host's pages, are in
  containers that vary; a container of links, or of signed and dated comments, is template;
* a block whose form (numbers, names and the site's name masked) recurs alone in
  containers of its own, on different pages of a host or of several hosts, is constant;
* a container without a label goes by its own share of varying blocks.

Skeletons are counted before they are matched, so a host with very many pages
costs its different structures; they are folded in parts, by a hash, and the
parts' wrappers are then merged, so no host is a single task's work. How often a
form recurs is counted in different pages (host and HTML), so a page delivered
again under another id is no evidence for its own text.

Lines of pages without HTML (or not found in it) are judged by what their form
is elsewhere, by the page's title, by the lines around them, and by what lines of
their shape (a signed comment, a pointer) are in the pages with HTML. Rows with
null text have no lines; blank lines are never reported.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrain.llm._shared import cut, map_columns, small

VARYING_SHARE = 0.3
#: Blocks that what is usual for a sign counts for beside a slot's own.
SIGN_BLOCKS = 20
#: Parts in which a host's skeletons are folded.
PARTS = 16
#: Rows of slots (different skeletons) that are broadcast; more are joined by shuffling.
MAX_BROADCAST = 100_000
#: Wrappers (a host's tree, some kB) that are broadcast.
MAX_WRAPPERS = 2_000
#: A form recurs if it stands on such a share of a host's pages, or of all pages.
HOST_SHARE, CORPUS_SHARE = 0.02, 0.004
#: A form is constant if it stands alone in containers of its own on at least so many pages, and such a share of all pages, of several hosts.
CONSTANT_TIMES, CONSTANT_SHARE = 2, 0.0002
TAG = re.compile(r"<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>|<(/?)([a-zA-Z][\w\-]*)([^<>]*)>|([^<]+)", re.S | re.I)
ATTR = re.compile(r"(class|id|style|hidden)\s*(?:=\s*[\"']([^\"']*)[\"'])?", re.I)
# HTML element kinds.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "em", "font", "i", "kbd", "mark", "q", "s", "small", "strong", "sub", "sup", "time", "u", "td", "th"}
HEADS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BODYLIKE = HEADS | {"li", "tr", "blockquote", "td", "dd", "dt", "figcaption"}
LABELLED = {"nav", "header", "footer", "aside", "article", "main", "section"}
COMMENT = re.compile(
    r"^[\w.\-]{2,30}\s?[（(][^()（）\n]{1,40}[)）]\s?(?:[:：]|[—–-]\s)|^(?:@|网友)[\w.\-]{2,30}\s?[:：]|^[a-z][a-z._\-]{1,24}\d{1,4}\s?(?:[:：]|\s[—–-]\s)"
    r"|^[a-z][a-z._\-]{1,24}\d{1,4}(?:,| )[^:：.。\n]{1,40}\s?[:：]")
# What stands before a pointer to another article.
POINTER = re.compile(r"^(?:read (?:also|more|next)|see also|related(?: stories)?|more on this|延伸阅读|相关(?:报道|阅读)|推荐阅读|lesen sie auch|mehr (?:dazu|zum thema)|siehe auch|sur le même sujet|à lire (?:aussi|également)|lire aussi)\s?[:：]", re.I)
#: Characters that part the nodes of a tree's text.
PLAIN = str.maketrans({"(": "_", ")": "_", ",": "_", "\x1f": "_"})
NUMBER = re.compile(r"\d+(?:[.,:/\- ]\d+)*")
NAME = re.compile(r"(?:[A-ZÀ-Þ][A-Za-zÀ-ÿ0-9’'\-]*)(?:\s+[A-ZÀ-Þ][A-Za-zÀ-ÿ0-9’'\-]*)*|[a-z]+[A-Z][A-Za-z]*")
SENTENCE = re.compile(r"[.!?。！？][”\"»“’)\]）」\s]*$")


def form(text: str, site: str) -> int:
    """64-bit hash of a block's form."""
    t = text.lower() if site and site in text.lower() and text.isupper() else text
    if site:
        t = re.sub(re.escape(site), "N", t, flags=re.I)
    t = NAME.sub("N", NUMBER.sub("0", t))
    return xxhash.xxh64_intdigest(" ".join(t.split()).encode("utf-8", "replace")) - (1 << 63)


def site_of(url: str | None) -> str:
    """The name of the site: the host's label before the last."""
    host = (urlsplit(url or "").hostname or "").split(".")
    return host[-2] if len(host) > 1 and len(host[-2]) > 2 else ""


def host_of(url: str | None) -> str:
    host = urlsplit(url or "").hostname or ""
    return re.sub(r"^(?:www|m|mobile|amp)\.", "", host)


class Node:
    __slots__ = ("tag", "label", "hidden", "children", "text", "link")

    def __init__(self, tag: str, label: str, hidden: bool):
        self.tag, self.label, self.hidden, self.children, self.text, self.link = tag, label, hidden, [], [], 0


def parse(source: str) -> Node:
    """The tree of block elements; inline elements add to their block's text."""
    root = Node("body", "body", False)
    stack, links = [root], 0
    for m in TAG.finditer(source):
        close, tag, attrs, text = m.group(2), m.group(3), m.group(4), m.group(5)
        if text is not None:
            t = text.strip()
            if t:
                node = stack[-1]
                node.text.append(t)
                node.link += len(t) * (links > 0)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if tag in ("html", "body", "head", "title"):
            if tag == "body" and not close:
                root = Node("body", "body", False)
                stack = [root]
            continue
        if tag == "a":
            links = max(0, links + (-1 if close else 1))
            continue
        if tag in VOID:
            continue
        if tag in INLINE:
            if close and tag in ("td", "th"):
                stack[-1].text.append("\x1f")
            continue
        if close:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    links = 0
                    break
            continue
        label, hidden = tag, False
        if attrs:
            names = []
            for key, value in ATTR.findall(attrs):
                key = key.lower()
                if key in ("class", "id") and value:
                    names.append(re.sub(r"[\-_]?\d+$", "", value) if key == "id" else value)
                elif key == "hidden" or key == "style" and "display:none" in value.replace(" ", ""):
                    hidden = True
            if names:
                label = f"{tag}.{' '.join(names)}".translate(PLAIN)
        node = Node(tag, label, hidden)
        stack[-1].children.append(node)
        stack.append(node)
    return root


def own_block(node: Node) -> Iterator[tuple[str, str, bool, bool]]:
    """(tag, text, linked, hidden) of the block that a node's own text is."""
    if node.text:
        parts = [html.unescape(p) for p in node.text]
        if node.tag == "tr":
            text = " | ".join(x.strip() for x in " ".join(parts).split("\x1f") if x.strip())
        else:
            text = " ".join(p for p in parts if p != "\x1f")
        text = " ".join(text.split())
        if text:
            yield node.tag, text, node.link * 2 > sum(map(len, node.text)), node.hidden


def labelled(node: Node) -> bool:
    return "." in node.label or node.label in LABELLED


class Box:
    """A container: its own blocks (those of containers within it aren't its own) and its place in the page's skeleton."""

    __slots__ = ("label", "named", "blocks", "inner", "place")

    def __init__(self, label: str, named: bool):
        self.label, self.named, self.blocks, self.inner, self.place = label, named, [], [], 0

    def sign(self) -> str:
        """The label; without one, the tag and what the container holds."""
        if self.named or not self.blocks:
            return self.label
        tags = {b[0] for b in self.blocks}
        links = sum(b[2] for b in self.blocks)
        return f"{self.label}:{'L' if 2 * links > len(self.blocks) else 'h' if tags & HEADS else min(tags)}"


def containers(root: Node) -> list[Box]:
    """The containers at the top of a page, in order."""
    node = root
    while len(node.children) == 1 and not node.text and node.children[0].children and any(c.children for c in node.children[0].children):
        node = node.children[0]

    def fill(box: Box, node: Node, hidden: bool) -> None:
        if node.text:
            box.blocks += [(tag, t, linked, hid or hidden) for tag, t, linked, hid in own_block(node)]
        for c in node.children:
            if c.children and labelled(c):
                box.inner.append(made(c, hidden or node.hidden))
            else:
                fill(box, c, hidden or node.hidden)

    def made(node: Node, hidden: bool) -> Box:
        box = Box(node.label, labelled(node))
        if len(node.children) > 1 and not node.text and all(c.children for c in node.children) and any(labelled(c) for c in node.children):
            box.inner = [made(c, hidden or node.hidden) for c in node.children]  # a wrapper of containers
        else:
            fill(box, node, hidden)
        return box

    return [made(c, node.hidden) for c in node.children]


def skeleton(boxes: list[Box], at: int = 0) -> tuple[str, int]:
    """The tree of signs, in which a run of like siblings is one node; sets the place of each box (in order of the text)."""
    out, last = [], None
    for box in boxes:
        first = at if last is None or last[0] != box.sign() or box.inner or last[2] else last[1]
        box.place = first
        if first == at:
            inner, at = skeleton(box.inner, at + 1)
            out.append(box.sign() + (f"({inner})" if inner else ""))
            last = box.sign(), first, bool(box.inner)
    return ",".join(out), at


def walk(boxes: list[Box]) -> Iterator[Box]:
    for box in boxes:
        yield box
        yield from walk(box.inner)


class Slot:
    """A node of a wrapper tree."""

    __slots__ = ("sign", "inner", "number")

    def __init__(self, sign: str, inner: list["Slot"]):
        self.sign, self.inner, self.number = sign, inner, -1

    def size(self) -> int:
        return 1 + sum(x.size() for x in self.inner)

    def text(self) -> str:
        return self.sign + (f"({','.join(x.text() for x in self.inner)})" if self.inner else "")


def read_tree(text: str) -> Slot:
    """The tree of a skeleton or wrapper text under one root."""
    root = Slot("", [])
    stack, sign = [root], []

    def close() -> None:
        if sign:
            stack[-1].inner.append(Slot("".join(sign), []))
            sign.clear()

    for c in text:
        if c == "(":
            close()
            stack.append(stack[-1].inner[-1])
        elif c == ")":
            close()
            stack.pop()
        elif c == ",":
            close()
        else:
            sign.append(c)
    close()
    return root


def match(a: Slot, b: Slot) -> tuple[int, list[tuple[Slot, Slot]]]:
    """Simple tree matching: the most pairs of like nodes in order, and the pairs of children in it."""
    # a node whose sign the other side hasn't can't be in a pair
    signs = {y.sign for y in b.inner}
    xs = [x for x in a.inner if x.sign in signs]
    if not xs:
        return 1, []
    signs = {x.sign for x in xs}
    ys = [y for y in b.inner if y.sign in signs]
    best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i, x in enumerate(xs):
        row, above = best[i + 1], best[i]
        for j, y in enumerate(ys):
            top = above[j + 1] if above[j + 1] >= row[j] else row[j]
            if x.sign == y.sign:
                both = above[j] + (match(x, y)[0] if x.inner and y.inner else 1)
                top = both if both > top else top
            row[j + 1] = top
    pairs, i, j = [], len(xs), len(ys)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((xs[i], ys[j]))
    return 1 + best[-1][-1], pairs[::-1]


def merge(wrapper: Slot, tree: Slot) -> None:
    """Take ``tree`` into ``wrapper``: matched nodes are one, others come after the sibling matched before them."""
    pairs = {id(y): x for x, y in match(wrapper, tree)[1]}
    at = 0
    for y in tree.inner:
        x = pairs.get(id(y))
        if x is not None:
            merge(x, y)
            at = wrapper.inner.index(x) + 1
        else:
            wrapper.inner.insert(at, y)
            at += 1


def align(wrapper: Slot, tree: Slot) -> list[int]:
    """Number of the wrapper's node for each node of ``tree`` in order of its text; -1 for none."""
    out: list[int] = []

    def go(x: Slot | None, y: Slot) -> None:
        pairs = {id(q): p for p, q in match(x, y)[1]} if x is not None else {}
        for q in y.inner:
            p = pairs.get(id(q))
            out.append(p.number if p is not None else -1)
            go(p, q)

    go(wrapper, tree)
    return out


def nodes(tree: Slot) -> Iterator[Slot]:
    """The nodes below the root in order of the text."""
    for x in tree.inner:
        yield x
        yield from nodes(x)


def numbered(wrapper: Slot) -> Slot:
    stack, n = [wrapper], -1
    while stack:
        node = stack.pop()
        node.number, n = n, n + 1
        stack += reversed(node.inner)
    return wrapper


def _folding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, tree) rows sorted by host: one merged tree a host. A task holds one host's wrapper."""
    host, wrapper = None, None
    for batch in batches:
        done = []
        for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if h != host:
                if wrapper is not None:
                    done.append((host, wrapper.text()))
                host, wrapper = h, Slot("", [])
            merge(wrapper, read_tree(t))
        yield _trees(done)
    yield _trees([(host, "".join(wrapper.text()))] if wrapper is not None else [])


def _trees(rows: list[tuple[str, str]]) -> pa.RecordBatch:
    # the root has no sign: its text is its children in brackets
    return pa.RecordBatch.from_arrays([pa.array([h for h, _ in rows], pa.string()), pa.array([t[1:-1] if t else "" for _, t in rows], pa.string())], names=["host", "tree"])


def _tasks(df: DataFrame) -> int:
    """Matching trees takes much time for few bytes, so its tasks aren't merged by their size."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def wrappers(skeletons: DataFrame) -> DataFrame:
    """host, tree: the wrapper of each host, merged from its different skeletons (host, skel, tree, pages), frequent ones first."""
    parts = skeletons.withColumn("part", F.pmod("skel", F.lit(PARTS)))
    tasks = _tasks(skeletons)
    first = parts.repartition(tasks, "host", "part").sortWithinPartitions("host", "part", F.desc("pages"), "tree").select(F.concat_ws("\x1f", "host", "part").alias("host"), "tree").mapInArrow(_folding, "host string, tree string")
    second = first.select(F.substring_index("host", "\x1f", 1).alias("host"), F.substring_index("host", "\x1f", -1).cast("int").alias("part"), "tree")
    return cut(second.repartition(tasks, "host").sortWithinPartitions("host", "part").select("host", "tree").mapInArrow(_folding, "host string, tree string"))


def aligned(skeletons: DataFrame, wrapper: DataFrame) -> DataFrame:
    """host, skel, slots, signs: the wrapper's node and the hash of the sign of each place of each skeleton."""
    def make() -> Callable[..., list]:
        held: dict[str, Slot] = {}

        def run(hosts: list, skels: list, trees: list, whole: list) -> list:
            out = []
            for h, k, t, w in zip(hosts, skels, trees, whole):
                if h not in held:
                    held.clear()
                    held[h] = numbered(read_tree(w))
                tree = read_tree(t)
                out.append((h, k, align(held[h], tree), [xxhash.xxh64_intdigest(x.sign.encode("utf-8", "replace")) - (1 << 63) for x in nodes(tree)]))
            return out
        return run

    both = skeletons.select("host", "skel", "tree").repartition(_tasks(skeletons), "host", "skel").join(small(wrapper.withColumnRenamed("tree", "whole"), MAX_WRAPPERS), "host").sortWithinPartitions("host")
    return map_columns(both, make, "host string, skel bigint, slots array<int>, signs array<bigint>")


def squeeze(line: str) -> str:
    return " ".join(line.split())


def shape(t: str, want: str | None) -> str:
    """What kind of line a text is by itself."""
    if COMMENT.match(t):
        return "comment"
    if POINTER.match(t) or want and t != want and t.endswith(want):
        return "crumb"
    return "title" if t == want else "row" if t.count(" | ") >= 2 and re.search(r"\d", t) else "prose" if SENTENCE.search(t) else "short"


def page_blocks(fetch_id: int, url: str | None, source: str | None, title: str | None, text: str | None) -> list[tuple]:
    """Rows of a page: its HTML blocks with the text line each stands for, lines without a block, and its skeleton.

    (fetch_id, host, page, skel, cont, place, named, form, line_no, kind, shape, single, words, tree): page
    is the hash of the HTML; cont numbers the page's containers and place is where the
    container stands in the skeleton; kind is link, comment, hidden, body (headings, list
    entries, rows, quotes), plain, line (a text line without a block) or page (the skeleton).
    """
    site, host = site_of(url), host_of(url)
    lines = text.split("\n") if text is not None else []
    where: dict[str, list[int]] = {}
    for n, line in enumerate(lines, 1):
        if line.strip():
            where.setdefault(squeeze(line), []).append(n)
    out, found, want = [], set(), squeeze(title) if title else None
    at = 0
    page = xxhash.xxh64_intdigest((source or "").encode("utf-8", "replace")) - (1 << 63)
    if source:
        boxes = containers(parse(source))
        tree, _ = skeleton(boxes)
        skel = xxhash.xxh64_intdigest(tree.encode("utf-8", "replace")) - (1 << 63)
        out.append((fetch_id, host, page, skel, -2, -1, False, 0, None, "page", None, False, 0, tree))
        for c, box in enumerate(walk(boxes)):
            for tag, t, linked, hidden in box.blocks:
                line_no = None
                spots = where.get(t)
                if spots:
                    line_no = next((n for n in spots if n >= at and n not in found), None) or next((n for n in spots if n not in found), None)
                    if line_no is not None:
                        found.add(line_no)
                        at = line_no
                kind = "hidden" if hidden else "link" if linked else "comment" if COMMENT.match(t) else "body" if tag in BODYLIKE else "plain"
                out.append((fetch_id, host, page, skel, c, box.place, box.named, form(t, site), line_no, kind, shape(t, want) if line_no is not None else None, len(box.blocks) == 1, len(t), None))
    for t, spots in where.items():
        for n in spots:
            if n not in found:
                out.append((fetch_id, host, page, None, -1, -1, False, form(t, site), n, "line", shape(t, want), False, len(t.encode("utf-8")), None))
    return out


DDL = "fetch_id bigint, host string, page bigint, skel bigint, cont int, place int, named boolean, form bigint, line_no bigint, kind string, shape string, single boolean, words int, tree string"


def recurring(inside: DataFrame) -> DataFrame:
    """host, form, constant, repeated, common of the forms of plain blocks that recur: counted once and joined once.

    A form is counted in different pages, apart for blocks that stand alone in a
    container and for those among others.
    """
    by_page = inside.where("kind = 'plain'").groupBy("form", "host", "page").agg(F.max("single").alias("alone"), F.max(~F.col("single")).alias("among"))
    by_host = by_page.groupBy("form", "host").agg(F.count_if("alone").alias("alone"), F.count_if("among").alias("among"))
    host_pages = cut(inside.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages")))
    share = lambda n: (F.col(n) >= 3) & (F.col(n) >= HOST_SHARE * F.col("pages"))
    by_host = cut(by_host.join(small(host_pages, 100_000), "host").select("host", "form", "alone", "among", share("alone").alias("often"), share("among").alias("repeated")))
    forms = by_host.groupBy("form").agg(F.sum("alone").alias("alone"), F.sum("among").alias("among"), F.count_if(F.col("alone") > 0).alias("hosts"), F.max("often").alias("often")).where("alone + among >= 2")
    every = host_pages.agg(F.sum("pages").alias("every"))
    spread = (F.col("hosts") >= 2) & (F.col("alone") >= F.greatest(F.lit(CONSTANT_TIMES), CONSTANT_SHARE * F.col("every")))
    forms = forms.join(F.broadcast(every)).select("form", ((F.col("alone") > F.col("among")) & (spread | F.col("often"))).alias("constant"), ((F.col("among") >= 8) & (F.col("among") >= CORPUS_SHARE * F.col("every"))).alias("common"))
    return by_host.select("host", "form", "repeated").join(forms.where("constant or common"), "form", "left").select(
        "host", "form", F.coalesce("constant", F.lit(False)).alias("constant"), "repeated", F.coalesce("common", F.lit(False)).alias("common")).where("constant or repeated or common")


def classified(pages: DataFrame, key: str, url: str, source: str, title: str, text: str) -> DataFrame:
    """fetch_id, line_no, main: every non-blank line of every page."""
    def make() -> Callable[..., list]:
        def run(*cols: list) -> list:
            return [r for row in zip(*cols) for r in page_blocks(*row)]
        return run

    src = pages.select(F.col(key).cast("bigint").alias("k"), F.col(url).alias("u"), F.col(source).alias("s"), F.col(title).alias("t"), F.col(text).alias("x")).where("x is not null or s is not null")
    rows = cut(map_columns(src, make, DDL))
    inside = rows.where("cont >= 0").drop("tree")
    # the slots: skeletons of a host, its wrapper, and the wrapper's node of each container
    skeletons = cut(rows.where("cont = -2").groupBy("host", "skel").agg(F.count(F.lit(1)).alias("pages"), F.min("tree").alias("tree")))
    slots = cut(aligned(skeletons, wrappers(skeletons)))
    # what each form is over the whole corpus
    flags = recurring(inside)
    joined = inside.join(flags, ["host", "form"], "left")
    no = lambda n: ~F.coalesce(n, F.lit(False))
    varying = F.when(F.col("kind") == "body", True).when(F.col("kind") != "plain", False).when(F.col("single"), no("constant")).otherwise(no("repeated") & no("constant") & no("common"))
    marked = cut(joined.withColumn("varying", varying).select("fetch_id", "host", "skel", "cont", "place", "named", "form", "line_no", "kind", "shape", "varying", "single"))
    per = marked.groupBy("fetch_id", "host", "skel", "cont", "place", "named").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("varying").alias("v"), F.count_if(F.col("kind").isin("link", "hidden")).alias("links"), F.count_if(F.col("kind") == "comment").alias("comments"))
    content = (F.col("v") >= VARYING_SHARE * F.col("n")) & (F.col("links") * 2 < F.col("n")) & (F.col("comments") * 2 < F.col("n"))
    per = per.withColumn("content", content).join(small(slots, MAX_BROADCAST), ["host", "skel"], "left").withColumns({c: F.when(F.col("named"), F.try_element_at(f"{c}s", F.col("place") + 1)) for c in ("slot", "sign")})
    per = cut(per.select("fetch_id", "host", "cont", "slot", "sign", "n", "content"))
    # a slot is judged by its own blocks and, as some more, by those of its host's containers with its sign: a slot of few pages goes with them
    by_slot = per.where("slot >= 0").groupBy("host", "slot", "sign").agg(F.count(F.lit(1)).alias("times"), F.sum(F.when(F.col("content"), F.col("n")).otherwise(0)).alias("c"), F.sum("n").alias("n"))
    by_sign = by_slot.groupBy("host", "sign").agg(F.sum("times").alias("seen"), (F.sum("c") / F.sum("n")).alias("usual")).where("seen >= 3")
    judged_slots = by_slot.join(by_sign, ["host", "sign"]).select("host", "slot", ((F.col("c") + SIGN_BLOCKS * F.col("usual")) / (F.col("n") + SIGN_BLOCKS)).alias("share"))
    decided = per.join(judged_slots, ["host", "slot"], "left").select("fetch_id", "cont", F.when(F.col("share").isNotNull(), F.col("share") >= 0.5).otherwise(F.col("content")).alias("main"), F.col("share").isNotNull().alias("slotted"))
    alone_too = cut(marked.join(decided, ["fetch_id", "cont"]).select("fetch_id", "form", "line_no", "kind", "shape", "single", "main", "slotted"))
    # what lines of a shape are: a signed comment among others goes by the containers such comments are in
    shapes = cut(alone_too.where("shape is not null").groupBy("shape").agg(F.avg(F.col("main").cast("int")).alias("usual")))
    among = alone_too.where("kind = 'plain' and not single").groupBy("form").agg(F.avg(F.col("main").cast("int")).alias("among"), F.count(F.lit(1)).alias("times")).where("times >= 3").select("form", "among")
    main = F.when((F.col("kind") == "hidden") | (F.col("shape") == "comment") & (F.col("usual") < 0.5), False).when((F.col("kind") == "plain") & F.col("single") & ~F.col("slotted"), F.coalesce(F.col("among") >= 0.5, F.col("main"))).otherwise(F.col("main"))
    blocks = cut(alone_too.join(among, "form", "left").join(F.broadcast(shapes), "shape", "left").select("fetch_id", "form", "line_no", "kind", "shape", main.alias("main")))
    judged = blocks.where("line_no is not null").select("fetch_id", "line_no", "main")
    # lines without a block: what their form is elsewhere, what lines of their shape are, then the lines around
    votes = blocks.groupBy("form").agg(F.avg(F.col("main").cast("int")).alias("share"), F.avg((F.col("kind") == "link").cast("int")).alias("linked"), F.count(F.lit(1)).alias("votes")).where("votes >= 2")
    bare = rows.where("cont = -1").select("fetch_id", "form", "line_no", "shape", "words").join(votes, "form", "left").join(F.broadcast(shapes), "shape", "left")
    bare = bare.groupBy("fetch_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "shape", "words", "share", "linked", "usual"))).alias("x"))
    alone = map_columns(bare.select("fetch_id", "x.line_no", "x.shape", "x.words", "x.share", "x.linked", "x.usual"), _make_sequence, "fetch_id bigint, line_no bigint, main boolean")
    return judged.union(alone)


def _make_sequence() -> Callable[..., list]:
    def run(ids: list, numbers: list, *rest: list) -> list:
        return [(row[0], n, m) for row in zip(ids, numbers, *rest) for n, m in zip(row[1], sequence(*row[2:]))]
    return run


def sequence(kinds: list[str], sizes: list[int], shares: list[float | None], linked: list[float | None], usual: list[float | None]) -> list[bool]:
    """Main or not, for the lines of a page known by text only.

    Comments and pointers go by what such lines are in pages with HTML (usual).
    Lines of a known form go by it; others by the part of the page they are in: before the headline, in the body, or in a list of links (after a heading
    that is linked elsewhere, up to the next prose).
    """
    out, part = [], "before" if any(k in ("title", "prose", "row") for k in kinds) else "body"
    for i, (kind, size, share, link, like) in enumerate(zip(kinds, sizes, shares, linked, usual)):
        known = share is not None and not 0.25 < share < 0.75
        if kind in ("comment", "crumb"):
            m = like is None or like >= 0.5
        elif kind in ("title", "row"):
            m = True
        elif known:
            m = share >= 0.5
        elif kind == "prose" or size >= 90:
            m = True
        else:
            m = part == "body" or part == "before" and i + 1 < len(kinds) and kinds[i + 1] == "prose" and (shares[i + 1] is None or shares[i + 1] >= 0.5) and i == 0
        if m and kind in ("title", "prose", "row") or m and known:
            part = "body"
        elif not m and known and (link or 0) > 0.5 and kind == "short" and part == "body":
            part = "links"
        out.append(m)
    return out


def main_text(pages: DataFrame, key: str, url: str, source: str, title: str, text: str) -> DataFrame:
    """key, body: the text of each page without the lines that aren't its main body (null stays null)."""
    good = classified(pages, key, url, source, title, text).where("main").groupBy("fetch_id").agg(F.collect_set(F.col("line_no").cast("int")).alias("keep"))
    d = pages.select(F.col(key).cast("bigint").alias("fetch_id"), F.col(text).alias("text")).join(good, "fetch_id", "left")
    body = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: F.array_contains(F.coalesce("keep", F.array().cast("array<int>")), i + 1)), "\n")
    return d.select(F.col("fetch_id").alias(key), F.when(F.col("text").isNotNull(), body).alias("body"))
