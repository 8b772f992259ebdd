"""Problem 5: personal information inside free text.

Regular expressions propose spans of e-mail addresses, telephone numbers,
identity numbers, postal addresses and names; checksum validators (mod-97, the
ISO 7064 mod-11 schemes, Luhn) confirm or doubt identity numbers (a number in a
form that only Luhn can confirm is none without it), and words nearby raise or lower a span's score (a word like "phone" speaks for it, one
like "order" or "ISBN" against). What scores enough and overlaps nothing better
is replaced by a typed placeholder; the rest of the text stays as it is.

Matching is done on a copy in which full-width digits, letters and signs and
look-alike letters are plain and invisible characters are left out; positions
are those of the stored text. Null, empty and blank texts hold nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrain.llm._shared import map_columns
from proofgrain.llm.lookalikes import ASCII, FULL_WIDTH, SINGLE

LEAST_SCORE = 2
#: Name parts are held by every task up to this number; they come from a table of fixed size.
MAX_NAME_PARTS = 200_000
FOLD = {ord(a): b for a, b in [*SINGLE.items(), *zip(FULL_WIDTH, ASCII), ("　", " "), (" ", " "), (" ", " "), (" ", " "), (" ", " "), (" ", " ")] if a != "’"}
FOLDABLE = re.compile("[Ͱ-ԯ０-９Ａ-Ｚａ-ｚ＠＋．－（）　  -  ‐‑]")
INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]")
UNSEEN = re.compile("[\u00ad\u0300-\u036f\u200b-\u200f\u2060-\u2064\ufeff]")

# Words that speak for or against a kind of number.
PHONE_WORDS = re.compile(r"phone|call|tel\b|tel\.|desk at|telefon|unter|mobil|fax|joignable|appel|电话|手机|致电|热线|传真", re.I)
NUMBER_WORDS = re.compile(r"order|ticket|isbn|batch|lot\b|case|invoice|code|error|ref\b|ref\.|serial|nummer|auftrag|charge|vorgang|rechnung|wkn|isin|commande|facture|colis|série|lot n|référence|订单|批次|编号|书号|证券|代码|错误码|单号|updated|stand:|更新|mis à jour|#\s*$", re.I)
ID_WORDS = re.compile(r"ssn|social (?:security|insurance)|personnummer|tax id|national id|steuer-?id|idnr|steueridentifikation|sécurité sociale|numéro fiscal|\bnir\b|身份证|证件号|公民身份", re.I)
FIRM_WORDS = r"(?:Group|Holdings?|Labs|Foods|Freight|Energy|Systems|Materials|Data|Trust|Network|Publishing|Ltd|Inc|LLC|GmbH|AG|KG|SE|SA|SAS|SARL|Werke|Technik|Gruppe|Industries|Stiftung|Verlag|Partners|Partner|Company|Co)\b"
FIRM_HAN = r"(?:集团|公司|食品|物流|数据|材料|科技|能源|基金|银行|网|社)"

EMAIL = re.compile(
    r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9À-ÿ][A-Za-z0-9À-ÿ._%+\-]*\s?(?:@|[(\[{]\s?at\s?[)\]}])\s?"
    r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\s?[(\[{]\s?dot\s?[)\]}]\s?[A-Za-z0-9\-]+|\.[A-Za-z0-9\-]+)*(?:\s?[(\[{]\s?dot\s?[)\]}]\s?|\.)[A-Za-z]{2,}", re.I)
DIGITS_HAN = re.compile(r"(?<![A-Za-z0-9_.,+\-/])[+(]?\+?\d(?:[ \-./()]{0,2}\d){7,}[Xx]?(?![A-Za-z0-9_])")
SSN = re.compile(r"(?<![\w\-])\d{3}([\- ])\d{2}\1\d{4}(?![\w\-])|(?<![\w\-])\d{9}(?![\w\-])")
LUHN_ID = re.compile(r"(?<![\w\-])(?:\d{3}([\- ])\d{3}\1\d{3}|(?:19|20)?\d{6}[\-+ ]\d{4}|\d{6} ?\d{4} ?\d{3})(?![\w\-])")
TAX_DE = re.compile(r"(?<!\d)\d{2} ?\d{3} ?\d{3} ?\d{3}(?!\d)")
NIR = re.compile(r"(?<!\d)[12378] ?\d{2} ?\d{2} ?(?:\d{2}|2[AB]) ?\d{3} ?\d{3} ?\d{2}(?!\d)")
CITIZEN = re.compile(r"(?<!\d)\d{6} ?(?:19|20)\d{6} ?\d{3}[\dXx](?!\d)")
DATE_START = re.compile(r"(?:19|20)\d\d[\-/.]\d\d?[\-/.]\d\d?\b|\d\d?[./]\d\d?[./](?:19|20)\d\d")

WORD = r"[A-ZÀ-ÖØ-Þ][\w’'\-]*"
STREET_EN = re.compile(
    rf"(?<![\w.,/\-])\d{{1,5}} ?[a-zA-Z]?\s+(?:{WORD}\s+){{1,4}}(?:Street|Road|Avenue|Close|Lane|Drive|Row|Square|Court|Way|Terrace|Place|Boulevard|Crescent|Hill|St|Rd|Ave|Ln|Dr"
    rf"|STREET|ROAD|AVENUE|CLOSE|LANE|DRIVE|ROW|SQUARE|COURT|WAY|TERRACE|PLACE|BOULEVARD|CRESCENT|HILL)\b"
    rf"(?:,?\s+{WORD}(?:[ \-]+(?:on|upon|ON|UPON|{WORD}))*(?:,?\s+(?:\d{{5}}(?:-\d{{4}})?|[A-Z]{{1,2}}\d{{1,2}}[A-Z]? ?\d[A-Z]{{2}}))?)?")
STREET_DE = re.compile(
    rf"(?<![\w])(?:(?:Am|An der|An den|Im|In der|In den|Zum|Zur|Auf dem|Auf der|Unter den|AM|AN DER|IM|IN DER|ZUM|ZUR)\s+(?:{WORD}\s+)?{WORD}"
    rf"|{WORD}\s+(?:Allee|Straße|Strasse|Weg|Platz|Gasse|Ring|Damm|Ufer|Chaussee|ALLEE|STRASSE|WEG|PLATZ|GASSE|RING)"
    rf"|[A-ZÄÖÜ][\wß\-]*(?:straße|strasse|gasse|weg|allee|platz|ring|damm|ufer|steig|pfad|chaussee|STRASSE|STRAßE|GASSE|WEG|ALLEE|PLATZ))"
    rf"\s+\d{{1,4}} ?[a-zA-Z]?(?:,\s+\d{{5}}\s+{WORD}|\s+(?:in|IN)\s+{WORD})")
STREET_FR = re.compile(
    r"(?<![\w.,/\-])\d{1,4}(?:\s+(?:bis|ter))?,?\s+(?:rue|avenue|place|boulevard|quai|allée|chemin|impasse|cours|route|square|passage|sentier)\s+"
    rf"(?:de la |de l’|de l'|des |du |de |d’|d')?{WORD}(?:[ \-]+(?:de|la|le|les|du|des|{WORD}))*(?:,\s+\d{{5}}\s+{WORD}|\s+à\s+{WORD})?", re.I)
STREET_HAN = re.compile(r"(?:[一-鿿]{2}市)(?:[一-鿿]{2,3}[区县])?[一-鿿]{1,4}?(?:大道|路|街|巷|道|胡同|弄)\d{1,5}号(?:\d+(?:单元|栋|幢|号楼))?(?:\d+室)?")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(digits: str) -> bool:
    """French social security number: the key of two digits is 97 less the number mod 97."""
    body = digits[:-2].replace("2A", "19").replace("2B", "18")
    return 97 - int(body) % 97 == int(digits[-2:])


def mod11_10(digits: str) -> bool:
    """ISO 7064 mod 11,10 (German tax number)."""
    p = 10
    for c in digits[:-1]:
        p = ((int(c) + p) % 10 or 10) * 2 % 11
    return (11 - p) % 10 == int(digits[-1])


def mod11_2(digits: str) -> bool:
    """ISO 7064 mod 11,2 (Chinese citizen number)."""
    total = 0
    for c in digits[:-1]:
        total = (total + int(c)) * 2 % 11
    check = (12 - total) % 11
    return digits[-1].upper() == ("X" if check == 10 else str(check))


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


class Finder:
    """Finds spans; built from (part, kind) rows of personal names."""

    def __init__(self, parts: list[tuple[str, str]]):
        def some(kind: str, han: bool) -> str:
            names = sorted({p for p, k in parts if k == kind and p and bool(re.match("[⺀-鿿]", p)) == han}, key=lambda p: (-len(p), p))
            return "|".join(map(re.escape, names)) or "(?!)"

        given, family = some("given", False), some("family", False)
        self.name = re.compile(rf"(?<![\w\-@.])(?:(?:{given})(?:,?\s+(?:[A-Z]\.\s*)?)(?:{family})|(?:{family})(?:,\s*|\s+)(?:{given}))(?![\w@])(?!-[\w])(?!\s+{FIRM_WORDS})", re.I)
        hg, hf = some("given", True), some("family", True)
        self.han = re.compile(rf"(?:(?:{hf})[·\s]?(?:{hg})|(?:{hg})[·\s](?:{hf}))(?!{FIRM_HAN})")
        self.trigger_han = re.compile(f"{hf}")
        firsts = {p.lower() for p, k in parts if k == "family" and p and not re.match("[⺀-鿿]", p)}
        self.families = firsts
        try:
            import ahocorasick

            a = ahocorasick.Automaton()
            for p in firsts:
                a.add_word(p, p)
            if firsts:
                a.make_automaton()
                self.hit = lambda low: next(a.iter(low), None) is not None
            else:
                self.hit = lambda low: False
        except ImportError:
            self.hit = lambda low: any(p in low for p in firsts)

    def spans(self, text: str) -> list[Span]:
        if not text or text.isspace():
            return []
        t, back = fold(text)
        found: list[Span] = []
        low = t.lower()
        if "@" in t or "at)" in low or "at]" in low or "at}" in low or "at )" in low or "at ]" in low:
            found += [Span("email", m.start(), m.end(), 5) for m in EMAIL.finditer(t)]
        if self.hit(low):
            found += [Span("name", m.start(), m.end(), 3) for m in self.name.finditer(t)]
        if self.trigger_han.search(t):
            found += [Span("name", m.start(), m.end(), 3) for m in self.han.finditer(t)]
        found += self._addresses(t, low)
        found += self._numbers(t)
        return [Span(s.kind, back(s.start), back(s.end - 1) + 1, s.score) for s in settle(found)]

    def _addresses(self, t: str, low: str) -> list[Span]:
        out = []
        if t.isascii() or "’" in t or re.search("[A-Za-z]{4}", t):
            out += [Span("address", m.start(), m.end(), 4) for m in STREET_EN.finditer(t)]
            out += [Span("address", m.start(), m.end(), 4) for m in STREET_DE.finditer(t)]
            out += [Span("address", m.start(), m.end(), 4) for m in STREET_FR.finditer(t)]
        if "号" in t:
            out += [Span("address", m.start(), m.end(), 4) for m in STREET_HAN.finditer(t)]
        return out

    def _numbers(self, t: str) -> list[Span]:
        out = []
        for m in DIGITS_HAN.finditer(t):
            start, end = m.span()
            before = t[max(0, start - 34): start]
            near = before[-22:]
            raw = m.group()
            digits = re.sub(r"\D", "", raw)
            against = bool(NUMBER_WORDS.search(near)) and not ID_WORDS.search(near) and not PHONE_WORDS.search(near[-8:])
            kind = self._identity(t, start, end, before, against)
            if kind:
                out.append(kind)
                continue
            if DATE_START.match(raw) or not 9 <= len(digits) <= 14:
                continue
            score = 0.0
            score += 2 if raw[0] == "+" or raw.startswith("00") else 0
            score += 2 if PHONE_WORDS.search(near) else 0
            score += 1 if raw[0] in "0(" and len(digits) >= 9 or re.fullmatch(r"1[3-9]\d[\s\-]?\d{4}[\s\-]?\d{4}", raw) else 0
            score += 1 if re.fullmatch(r"\(?[2-9]\d{2}\)?[\s.\-]+\d{3}[\s.\-]\d{4}|1[\s.\-]\d{3}[\s.\-]\d{3}[\s.\-]\d{4}|0\d(?:[ .]\d{2}){4}|0\d{2,4}[ /\-]\d{4,8}|0\d{2} \d{4} \d{4}", raw) else 0
            score -= 4 if against else 0
            if score >= LEAST_SCORE:
                # brackets that don't close belong to the sentence
                while raw.endswith((")", "(", " ", "-", "/", ".")):
                    raw = raw[:-1]
                out.append(Span("phone", start, start + len(raw), score))
        return out

    def _identity(self, t: str, start: int, end: int, before: str, against: bool) -> Span | None:
        last = max((m.end() for m in ID_WORDS.finditer(before)), default=-1)
        context = 2 if last > max((m.end() for m in PHONE_WORDS.finditer(before)), default=-1) else 0
        raw = t[start:end]
        for pattern, valid in ((CITIZEN, mod11_2), (NIR, mod97), (TAX_DE, mod11_10)):
            m = pattern.match(t, start)
            if m and m.end() >= end - 1 and (m.end() == end or raw[-1] in "Xx"):
                digits = re.sub(r"\s", "", m.group())
                score = context + (1 if valid(digits) else -1) + (1 if pattern is not TAX_DE else 0) - (4 if against else 0)
                if score >= (LEAST_SCORE if pattern is not TAX_DE else 1) and (context or pattern is not TAX_DE):
                    return Span("id_number", start, m.end(), 5 + score)
        m = SSN.match(t, start)
        if m and m.end() == end and (context or "-" in raw or " " in raw) and not against and not (PHONE_WORDS.search(before[-10:]) and not context):
            if context or "-" in raw:
                return Span("id_number", start, end, 5 + context)
        m = LUHN_ID.match(t, start)
        if m and m.end() == end and context and not against:
            digits = re.sub(r"\D", "", raw)
            if luhn(digits[2:] if len(digits) == 12 else digits):  # a century isn't part of the checked number
                return Span("id_number", start, end, 5 + context)
        return None


def fold(text: str) -> tuple[str, Callable[[int], int]]:
    """``text`` in plain characters, and a function from its positions to those of the text."""
    if text.isascii():
        return text, int
    t = text.translate(FOLD) if FOLDABLE.search(text) else text
    if not UNSEEN.search(t):
        return t, int
    out, at = [], []
    for i, c in enumerate(t):
        if unicodedata.combining(c) and out and len(both := unicodedata.normalize("NFC", out[-1] + c)) == 1:
            out[-1] = both
        elif not INVISIBLE.match(c):
            out.append(c)
            at.append(i)
    return "".join(out), lambda i: at[i]


ORDER = {"email": 0, "id_number": 1, "address": 2, "phone": 3, "name": 4}


def settle(found: list[Span]) -> list[Span]:
    """The spans that overlap no better one, in order of position."""
    kept: list[Span] = []
    for s in sorted(found, key=lambda s: (ORDER[s.kind], -s.score, s.start - s.end, s.start)):
        if all(s.end <= k.start or k.end <= s.start for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: s.start)


def redact(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for s in spans:
        out += [text[at: s.start], f"[{s.kind.upper()}]"]
        at = s.end
    return "".join([*out, text[at:]])


def _parts(names: DataFrame) -> list[tuple[str, str]]:
    rows = names.select("name_part", "kind").where("name_part is not null").limit(MAX_NAME_PARTS + 1).collect()
    if len(rows) > MAX_NAME_PARTS:
        raise ValueError(f"more than {MAX_NAME_PARTS} name parts; raise MAX_NAME_PARTS if a task may hold them")
    return [(r[0], r[1]) for r in rows]


def mentions(df: DataFrame, tbl: str, key: str, text: str, names: DataFrame) -> DataFrame:
    """tbl, row_id, kind, start_pos, end_pos (after the last character), score of each mention."""
    parts = _parts(names)

    def make() -> Callable[..., list]:
        finder = Finder(parts)

        def run(ids: list, texts: list) -> list:
            return [(tbl, i, s.kind, s.start + 1, s.end + 1, float(s.score)) for i, t in zip(ids, texts) for s in finder.spans(t)]
        return run

    src = df.select(F.col(key).cast("bigint").alias("row_id"), F.col(text).alias("text")).where("text <> ''")
    return map_columns(src, make, "tbl string, row_id bigint, kind string, start_pos bigint, end_pos bigint, score double")


def redacted(df: DataFrame, tbl: str, key: str, text: str, names: DataFrame) -> DataFrame:
    """tbl, row_id, text with placeholders, number of mentions: one row a row of ``df``."""
    parts = _parts(names)

    def make() -> Callable[..., list]:
        finder = Finder(parts)

        def run(ids: list, texts: list) -> list:
            out = []
            for i, t in zip(ids, texts):
                spans = finder.spans(t) if t else []
                out.append((tbl, i, redact(t, spans) if t else t, len(spans)))
            return out
        return run

    return map_columns(df.select(F.col(key).cast("bigint").alias("row_id"), F.col(text).alias("text")), make, "tbl string, row_id bigint, text string, mentions int")
