"""Problem 7: template residue and error-page text.

A naive Bayes model with four classes (content, placeholder, filler, notice) is
learned from positives and unlabelled passages by expectation-maximization:
passages that match a trusted form keep their class, the unlabelled ones start
as content and take the class weights the model gives them in each round, those
of filler and notices where they have their general form. The
model then scores passages (a line; the words around a placeholder; the whole
field, of any length, for notices) and its odds decide: the trusted forms are
seeds, not the bound of what is found. A check of general form follows, which
knows no phrases: most words speak for the class, no sentence of a notice speaks
for content, nothing is quoted. A field is a case if one passage holds a
placeholder or is filler, or if all of it is a notice.

Probabilities of words are mixed with those of the whole sample (BACKGROUND), so
a word that was never seen, as in garbled text, speaks for no class.

The model is fitted on a bounded sample (TRUSTED passages a class and UNLABELLED
others, those of least hash, so the same rows give the same model); every field
of every row is scored. Null, empty and blank fields are no case.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from heapq import nsmallest

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrain.llm._shared import cut, map_columns
from proofgrain.llm.mojibake import repair

TRUSTED = 1500
UNLABELLED = 6000
ROUNDS = 6
CLASSES = ("content", "placeholder", "filler", "notice")
#: Characters and words on either side of a placeholder that make its passage.
WINDOW, NEAR = 60, 3
#: Characters of an unlabelled field that is learned from as a whole: a parameter of the sample; trusted fields of any length are learned from, and fields of any length are scored.
LONGEST_UNLABELLED = 400
#: Share of the whole sample in a word's probability.
BACKGROUND = 0.1
#: Log odds from which a word speaks for a class; odds of a class whose form an unlabelled passage hasn't.
SPEAKS, NEVER = 1.0, -50.0
#: Weight of a prototype against a passage of the corpus.
PROTOTYPE_WEIGHT = 0.1
#: Share of the words that speak for a notice, for filler.
NOTICE_SHARE, FILLER_SHARE = 0.6, 0.7

PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]+\}\}|\{%[^%{}\n]+%\}|<%=?[^%<>\n]+%>|[$#]\{[^{}\n]+\}|%%[A-Za-z_.]{2,}%%|(?<![\w%])%[A-Z_]{3,}%(?![\w%])"
    r"|\[\[[^\[\]\n]+\]\]|\[INSERT [^\[\]\n]+\]|__[A-Z][A-Z_]+?__|(?<![\w{])\{[A-Za-z_.]{2,}\}(?!\})|<[a-z]+[._][a-z_.]+>|<(?:city|author|title|summary|product|amount|name|date|user|company)>")
#: Marks of the general form of a placeholder, whatever they hold; the model's odds decide.
MARK = re.compile(PLACEHOLDER.pattern + r"|(?<!\{)\{[A-Za-z0-9](?:[\w .\-]*\w)?\}(?!\})|\[[A-Z][A-Z_ .\-]{2,}\]|<[A-Z][A-Z_ .\-]{2,}>|<[a-z]+(?:[_.\-][a-z]+)+>|@@[\w. \-]+@@|##?[A-Z_]{3,}##?|%\([A-Za-z_.]{2,}\)[sdf]", re.A)
SENTENCES = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n")
QUOTE = re.compile(r"[“”„«»「」『』\"]")
QUOTED = re.compile(r"[“„«‘\"'`(（「Ñâ]\s?$"), re.compile(r"^\s?[”“»’\"'`)）」ì]")
# Words of texts that speak about placeholders; one near a mark is a token of its passage, whose weight is learned.
ABOUT = re.compile(r"template|placeholder|render|marker|\bmark\b|platzhalter|vorlage|ersetzt|gabarit|modèle de page|balise|remplac|模板|占位符|标记|渲染", re.I)
# Stand-in titles, errors, access checks and script notices (digits as 0).
NOTICE = re.compile("|".join((
    r"(?:http )?(?:error )?0 ?[-–:]? ?(?:not found|bad gateway|forbidden|internal server error|service unavailable|gateway time-?out|页面不存在|页面未找到|禁止访问|服务器错误)(?:\nnginx)?",
    r"(?:error|fehler|erreur|错误|seite) ?0(?: ?[:：–-] ?[^\n]{0,80})?", r"error 0: the service is unavailable\. try again later\.", r"erreur 0 : page introuvable",
    r"internal server error(?:\nthe request could not be completed \(code 0\)\.)?", r"access denied(?:\n[^\n]{0,80})?(?:\nreference #?0)?", r"just a moment(?:…|\.\.\.)?",
    r"checking whether you are a person\. this may take a few seconds\.(?: ray 0)?", r"checking your browser[^\n]{0,80}", r"too many requests\.?(?: retry after 0 seconds\.)?",
    r"your session has expired\.(?: log in again to go on\.)?", r"oops! the page you asked for can[’']t be found\.?", r"(?:the )?page (?:you asked for )?(?:was )?not found\.?",
    r"please enable (?:javascript|scripts|cookies)[^\n]{0,60}", r"(?:this site|you) needs? (?:javascript|to turn on scripts)[^\n]{0,90}", r"java ?script (?:is )?required\.?", r"enable javascript[^\n]{0,60}",
    r"untitled(?: document| page)?", r"no title", r"new page", r"untitled-0", r"\[?headline goes here\]?", r"\[?title goes here\]?", r"document0?", r"home",
    r"bitte aktivieren sie javascript[^\n]{0,60}", r"zugriff verweigert\.?(?: fehlercode 0)?", r"dienst vorübergehend nicht verfügbar\.?(?: vorgang 0)?", r"seite nicht gefunden(?: \(0\))?\.?",
    r"unbenanntes dokument", r"ohne titel", r"\[?titel (?:hier )?einfügen\]?", r"einen moment(?: bitte)?(?:…|\.\.\.)?", r"javascript erforderlich\.?", r"fehler 0[^\n]{0,60}", r"zu viele anfragen[^\n]{0,60}", r"ihre sitzung ist abgelaufen[^\n]{0,60}",
    r"veuillez activer javascript[^\n]{0,60}", r"accès refusé\.?(?: référence 0)?", r"service momentanément indisponible(?: \(code 0\))?\.?", r"page introuvable(?: \(0\))?\.?", r"erreur 0[^\n]{0,60}",
    r"sans titre", r"document sans titre", r"\[?titre à (?:saisir|compléter|insérer)\]?", r"\[?insérer (?:le )?titre(?: ici)?\]?", r"un instant(?:…|\.\.\.)?", r"javascript requis\.?", r"trop de requêtes[^\n]{0,60}", r"votre session a expiré[^\n]{0,60}",
    r"服务器内部错误(?: ?0)?", r"系统繁忙，请稍后再试(?:（错误码0）)?[。]?", r"访问过于频繁，请完成验证后继续[。]?", r"请启用javascript后重新加载本页[。]?", r"您访问的页面已被删除或暂时无法打开[。]?", r"系统提示", r"无标题文档", r"标题待填写",
    r"【?请输入标题】?", r"无标题", r"未命名(?:文档)?", r"页面不存在", r"0 ?-? ?页面不存在", r"访问被拒绝[^\n]{0,40}", r"请稍候(?:…|\.\.\.)?", r"正在验证[^\n]{0,40}", r"需要启用javascript[^\n]{0,40}", r"出错了[。！]?", r"错误0",
)))
# Notices the model learns from beside the corpus's own, so that their words are known where the corpus holds none.
PROTOTYPES = (
    "Service temporarily unavailable", "Sorry, something went wrong. Please try again later.", "An unexpected error occurred", "Error establishing a database connection", "Database connection failed",
    "You need to enable JavaScript to run this app.", "Attention required! Verify you are human by completing the check", "Please verify that you are not a robot", "Please complete the captcha to continue",
    "Your browser is not supported", "This content is not available in your region", "You have been blocked", "The requested URL was not found on this server", "The connection has timed out", "This page isn't working", "Please log in to continue", "Page under construction", "Site under maintenance, back soon",
    "Ein unerwarteter Fehler ist aufgetreten. Bitte versuchen Sie es später erneut.", "Bitte bestätigen Sie, dass Sie kein Roboter sind", "Die angeforderte Seite wurde nicht gefunden", "Die Seite befindet sich im Aufbau",
    "Une erreur inattendue est survenue. Veuillez réessayer plus tard.", "Veuillez confirmer que vous n'êtes pas un robot", "La page demandée est introuvable", "Site en maintenance",
    "抱歉，出现错误，请稍后重试", "请完成安全验证", "您的访问请求被拒绝", "网站正在维护中", "数据库连接错误",
)
# The openings and set phrases of filler text.
FILLER = re.compile(
    r"lorem ipsum dolor|consectetur|eiusmod|incididunt|(?:\b(?:ullamco|aliquip|adipiscing|aliqua|nostrud|veniam|tempor|commodo|amet|magna|labore)\b\W+){3}"
    r"|(?:\b(?:blindtext|fülltext|musterwort|platzhalter|absatz|inhalt|später|steht|leer|noch|dieser|hier|richtige|der|ist)\b\W*){5}"
    r"|(?:\b(?:remplacer|texte|contenu|viendra|paragraphe|provisoire|ici|lorem|final|ipsum|sit|le|ce)\b\W*){5}"
    r"|此处填写正文|这里是占位文字|示例文本示例文本|测试测试测试|待补充待补充", re.I)
WORDS = re.compile(r"[^\W\d_一-鿿]+|\d+|[一-鿿]+")


def tokens(text: str) -> list[str]:
    """Words in lower case, numbers as 0, pairs of Chinese characters, marks of form."""
    out = []
    for w in WORDS.findall(text.lower()):
        if w[0].isdigit():
            out.append("0")
        elif "一" <= w[0] <= "鿿":
            out += [w[i: i + 2] for i in range(max(1, len(w) - 1))]
        else:
            out.append(w)
    return out


def marks(text: str) -> Iterator[tuple[list[str], bool, bool]]:
    """(tokens, open, trusted) of each mark; open: not set in quotes; trusted: in a known form."""
    if not MARK.search(text):
        return
    text = repair(text)[0]  # quotes and words around it may be garbled
    for m in MARK.finditer(text):
        before, after = text[max(0, m.start() - WINDOW): m.start()], text[m.end(): m.end() + WINDOW]
        opened = not (QUOTED[0].search(before) and QUOTED[1].search(after))
        form = re.sub(r"[^{}$#%<>\[\]=]+", "x", m.group())
        near = [f"~{w}" for w in [*tokens(before)[-NEAR:], *tokens(after)[:NEAR]]]
        if ABOUT.search(f"{before} {after}"):
            near.append("=about")
        yield ["=open", f"={form}", *near] if opened else ["=quoted", *near], opened, bool(PLACEHOLDER.fullmatch(m.group()))


def body(text: str) -> list[str]:
    """The lines that aren't blank, without a first line that is a site's name only."""
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    if site_line(lines) and not is_notice(lines[0]) and is_notice("\n".join(lines[1:])):
        return lines[1:]
    return lines


def site_line(lines: list[str]) -> bool:
    """Whether the first line may be a site's name only."""
    return len(lines) > 1 and len(lines[0]) <= 40 and len(lines[0].split()) <= 2 and not re.search(r"[\d.!?。！？：:,，]", lines[0])


def is_notice(text: str) -> bool:
    return bool(NOTICE.fullmatch(re.sub(r"\d+", "0", text.strip().lower())))


def passages(text: str) -> Iterator[tuple[str, list[str] | str]]:
    """(trusted class or "", tokens or the raw line) of every passage of a field."""
    lines = body(text)
    whole = "\n".join(lines)
    if not lines:
        return
    known = is_notice(whole)
    if known or len(whole) <= LONGEST_UNLABELLED:
        yield ("notice" if known else ""), ["=whole", *tokens(whole)]
    for line in lines:
        if SIGNS.search(line.lower()) and FILLER.search(line) and _ratio(line) > 0.7:
            yield "filler", ["=line", *tokens(line)]
        else:
            yield "", line
        for words, opened, trusted in marks(line):
            yield ("placeholder" if trusted and opened and "=about" not in words else ""), words


LEXICON = set(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore magna aliqua veniam nostrud ullamco nisi aliquip commodo consequat ut et dolore enim minim quis exercitation "
    "blindtext fülltext musterwort platzhalter absatz inhalt später steht leer noch dieser hier richtige der ist text "
    "remplacer texte contenu viendra paragraphe provisoire ici final le ce "
    "此处 处填 填写 写正 正文 文内 内容 正式 式发 发布 布前 前请 请替 替换 这里 里是 是占 占位 位文 文字 用于 于测 测试 试版 版面 面效 效果 试测 稍后 后更 更新 示例 例文 文本 本示 请勿 勿发 待补 补充 充待 容稍".split())

#: A line without one of the longer words isn't scored as filler: its share of filler words can't pass.
SIGNS = re.compile("|".join(sorted(w for w in LEXICON if w.isascii() and len(w) >= 5 or "ü" in w)) + "|此处填写|占位|示例文本|测试测试|待补充|稍后更新")


def _ratio(line: str) -> float:
    t = tokens(line)
    return sum(w in LEXICON for w in t) / len(t) if t else 0.0


class Model:
    """Naive Bayes weights: log P(token | class) - log P(token | content)."""

    def __init__(self, prior: dict[str, float], weights: dict[str, tuple[float, float, float]], unseen: tuple[float, float, float]):
        self.prior, self.weights, self.unseen = prior, weights, unseen
        self._speaking: dict[int, frozenset[str]] = {}

    def score(self, words: list[str]) -> tuple[float, float, float]:
        """Log odds of placeholder, filler, notice against content."""
        a, b, c = (self.prior[k] for k in CLASSES[1:])
        get, none = self.weights.get, self.unseen
        for w in words:
            x, y, z = get(w, none)
            a += x
            b += y
            c += z
        return a, b, c

    def speaking(self, at: int) -> frozenset[str]:
        """The words that speak for a class (0 placeholder, 1 filler, 2 notice) more than for content."""
        if at not in self._speaking:
            self._speaking[at] = frozenset(w for w, x in self.weights.items() if x[at] > SPEAKS and w[0] not in "=~")
        return self._speaking[at]

    def share(self, words: list[str], at: int) -> float:
        return sum(map(self.speaking(at).__contains__, words)) / len(words) if words else 0.0

    def notice(self, lines: list[str]) -> float | None:
        """Odds of a field that has the general form of a notice: no sentence speaks for content, most words for a notice, none is quoted."""
        words = []
        for line in lines:
            for sentence in SENTENCES.split(line):
                t = tokens(sentence)
                if sum(self.weights[w][2] for w in t if w in self.weights) < 0:
                    return None
                words += t
        whole = list(dict.fromkeys(["=whole", *words]))
        odds = self.score(whole)[2]
        return odds if odds > 0 and self.share(words, 2) >= NOTICE_SHARE and not any(map(QUOTE.search, lines)) else None


def fit(trusted: list[tuple[str, list[str]]], unlabelled: list[list[str]], rounds: int = ROUNDS, prototypes: list[list[str]] = ()) -> Model:
    """Expectation-maximization from trusted positives and unlabelled passages; prototypes are notices of less weight."""
    data = [(dict.fromkeys(t), {k: float(k == c) for k in CLASSES}, True) for c, t in trusted]
    data += [(dict.fromkeys(t), {"notice": PROTOTYPE_WEIGHT}, True) for t in prototypes]
    data += [(dict.fromkeys(t), {"content": 1.0}, False) for t in unlabelled]
    vocabulary = {w for t, _, _ in data for w in t}
    model = None
    for _ in range(rounds):
        mass = dict.fromkeys(CLASSES, 1.0)
        counts: dict[str, dict[str, float]] = {k: {} for k in CLASSES}
        for t, weight, _ in data:
            for k, p in weight.items():
                if p > 1e-6:
                    mass[k] += p
                    ck = counts[k]
                    for w in t:
                        ck[w] = ck.get(w, 0.0) + p
        size = {k: sum(counts[k].values()) or 1.0 for k in CLASSES}
        total = sum(sum(c.values()) for c in counts.values()) or 1.0
        ground = {w: BACKGROUND * sum(counts[k].get(w, 0.0) for k in CLASSES) / total + 1e-12 for w in vocabulary}
        log = lambda k, w: math.log((1 - BACKGROUND) * counts[k].get(w, 0.0) / size[k] + ground[w])
        weights = {w: tuple(log(k, w) - log("content", w) for k in CLASSES[1:]) for w in vocabulary}
        model = Model({k: math.log(mass[k] / mass["content"]) for k in CLASSES}, weights, (0.0, 0.0, 0.0))
        for i, (t, _, fixed) in enumerate(data):
            if not fixed:
                words = [w for w in t if w[0] not in "=~"]
                form = (True, model.share(words, 1) > FILLER_SHARE, model.share(words, 2) >= NOTICE_SHARE and "=whole" in t)
                odds = (0.0, *(o if f else NEVER for o, f in zip(model.score(list(t)), form)))
                top = max(odds)
                e = [math.exp(o - top) for o in odds]
                data[i] = (t, dict(zip(CLASSES, (x / sum(e) for x in e))), False)
    return model


def gather(frames: list[DataFrame]) -> Model:
    """Fit a model on the passages of least hash of each kind, over all rows of the frames (one text column each)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, dict[int, list[str] | str]] = {}
        bound: dict[str, int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for kind, words in passages(text):
                    key = zlib.crc32((words if isinstance(words, str) else " ".join(words)).encode("utf-8", "replace"))
                    held, limit = best.setdefault(kind, {}), TRUSTED if kind else UNLABELLED
                    if key < bound.get(kind, 1 << 32) and key not in held:
                        held[key] = words
                        if len(held) > 2 * limit:
                            best[kind] = {k: held[k] for k in nsmallest(limit, held)}
                            bound[kind] = max(best[kind])
        rows = [(kind, k, " ".join(w.replace(" ", "\x1f") for w in (["=line", *tokens(held[k])] if isinstance(held[k], str) else held[k]))) for kind, held in best.items() for k in nsmallest(TRUSTED if kind else UNLABELLED, held)]
        cols = list(zip(*rows)) if rows else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["kind", "h", "words"])

    every = None
    for f in frames:
        every = f.toDF("text") if every is None else every.union(f.toDF("text"))
    sample = cut(every.where("text is not null").mapInArrow(run, "kind string, h bigint, words string")).dropDuplicates(["kind", "h"])
    trusted, unlabelled = [], []
    for kind in (*CLASSES[1:], ""):
        # the least are found on the executors; only they, bounded by the two parameters, come to the driver
        rows = cut(sample.where(F.col("kind") == kind).orderBy("h").limit(TRUSTED if kind else UNLABELLED)).collect()
        for r in rows:
            words = [w.replace("\x1f", " ") for w in r["words"].split(" ")]
            (trusted.append((kind, words)) if kind else unlabelled.append(words))
    return fit(trusted, unlabelled, prototypes=[["=whole", *tokens(t)] for t in PROTOTYPES])


def decide(text: str | None, model: Model) -> tuple[str, float] | None:
    """(kind, log odds) if the field is a case."""
    if not text or text.isspace():
        return None
    lines = body(text)
    if not lines:
        return None
    whole = "\n".join(lines)
    if is_notice(whole):
        odds = model.score(list(dict.fromkeys(["=whole", *tokens(whole)])))[2]
        if odds > 0:
            return "notice", odds
    odds = model.notice(lines)
    if odds is None and site_line(lines):
        odds = model.notice(lines[1:])
    if odds is not None:
        return "notice", odds
    for line in lines:
        for words, opened, _ in marks(line):
            odds = model.score(list(dict.fromkeys(words)))[0]
            if odds > 0 and opened:
                return "placeholder", odds
        words = tokens(line)
        if model.share(words, 1) > FILLER_SHARE and not QUOTE.search(line) or SIGNS.search(line.lower()) and _ratio(line) > FILLER_SHARE:
            odds = model.score(list(dict.fromkeys(["=line", *words])))[1]
            if odds > 0:
                return "filler", odds
    return None


def has_form(text: str) -> bool:
    """Whether a text has the form of residue, whatever the model's odds."""
    lines = body(text)
    whole = "\n".join(lines)
    return is_notice(whole) or any(
        SIGNS.search(x.lower()) and _ratio(x) > 0.7 or any(o and known and "=about" not in w for w, o, known in marks(x)) for x in lines)


def residue(df: DataFrame, tbl: str, key: str, fields: list[str], model: Model) -> DataFrame:
    """tbl, row_id, field, kind, odds of each field that is a case."""
    b = df.sparkSession.sparkContext.broadcast((model.prior, model.weights, model.unseen))  # bounded by the sample

    def make() -> Callable[..., list]:
        m = Model(*b.value)

        def run(ids: list, *values: list) -> list:
            out = []
            for name, column in zip(fields, values):
                for i, t in zip(ids, column):
                    got = decide(t, m)
                    if got:
                        out.append((tbl, i, name, *got))
            return out
        return run

    return map_columns(df.select(F.col(key).cast("bigint").alias("row_id"), *[F.col(f).cast("string") for f in fields]), make, "tbl string, row_id bigint, field string, kind string, odds double")
