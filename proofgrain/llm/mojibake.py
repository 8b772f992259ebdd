"""Problem 1: text decoded with the wrong character encoding.

Round-trip repair. A text is cut into lines; each line is re-encoded under the
encodings it may have been read with, strictly decoded as the encodings it may
have been written in, and the result is accepted when a garbling cost drops.
This repeats, for any number of nested layers, until nothing drops any more.
Where only places of a line are garbled, the round trip is made for the byte
sequences that stand there; one whose result is itself garbled (control
characters of an inner layer) is undone if what follows from it is text.

Nulls and texts without a garbled place come out as they are and are no case;
a text that can't be restored in full (lost bytes) is a case with the best
partial repair.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrain.llm._shared import map_columns

#: Single-byte encodings text is often read with by mistake.
READ_AS = ("cp1252", "latin_1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "iso8859_15", "koi8_r")
#: Single-byte pairs (read as, written in).
SINGLE_BYTE = (
    ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1251", "cp1252"), ("cp1250", "cp1252"),
    ("koi8_r", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("latin_1", "mac_roman"),
    ("latin_1", "cp437"), ("latin_1", "cp850"),
)
#: Letters and marks at home in Western European text.
HOME = set("ÀÂÄÇÉÈÊËÎÏÔÖÙÛÜŒÆàâäçéèêëîïôöùûüœæßáíóúñÁÍÓÚÑ«»“”„‘’‚–—…€£©®°§·•")
#: Ligatures, and letters of other scripts that look like ASCII letters.
LOOK_LATIN = set("ﬁﬂасеорхуіјѕһԁԛԝАВЕКМНОРСТУХІЈЅοαρνικυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ")
NON_ASCII = re.compile(r"[^\x00-\x7f]")
WIDE_RUN = re.compile(r"[^\x00-\x7f]{2,}|[⺀-￯][A-Za-z]?")
HIGH_RUN = re.compile("[\u0080-ÿŒœŠšŸŽžƒˆ˜–—‘-„†-•…‰‹›€™]{4,}")

HIGH_PAIRS = re.compile("(?:[\u0081-þŒœŠšŸŽžƒˆ˜–—‘-„†-•…‰‹›€™][@-~\u0080-þŒœŠšŸŽžƒˆ˜–—‘-„†-•…‰‹›€™])+")


def _decode(b: int, enc: str) -> str:
    try:
        return bytes([b]).decode(enc)
    except UnicodeDecodeError:
        return chr(b)  # what lenient readers show for undefined bytes


def _tables() -> tuple[dict[str, dict[str, int]], list[tuple[str, re.Pattern]]]:
    back, seqs = {}, []
    for enc in READ_AS:
        chars = {b: _decode(b, enc) for b in range(0x80, 0x100)}
        back[enc] = {c: b for b, c in chars.items()}
        cls = lambda lo, hi, chars=chars: "[" + "".join(re.escape(chars[b]) for b in range(lo, hi + 1)) + "]"
        tail = cls(0x80, 0xBF)
        seqs.append((enc, re.compile(f"(?:{cls(0xC2, 0xDF)}{tail}|{cls(0xE0, 0xEF)}{tail}{{2}}|{cls(0xF0, 0xF4)}{tail}{{3}})+")))
    return back, seqs


BACK, SEQUENCES = _tables()


#: The start of a UTF-8 sequence, of whatever script, under any of the encodings.
LEADS = "".join(re.escape(c) for e in READ_AS for c, b in BACK[e].items() if 0xC2 <= b <= 0xF4)
LEAD_TAIL = re.compile(f"[{LEADS}][{''.join(re.escape(c) for e in READ_AS for c, b in BACK[e].items() if b <= 0xBF)}]")
STRANGE = re.compile("[^\x00-\x7f⺀-￯" + "".join(map(re.escape, sorted(HOME))) + r"]|[A-Za-zÀ-ÿ][»«”“„‚–—€£©®°§·•][A-Za-zÀ-ÿ]|[a-zà-ÿ][À-Þ]")
WIDE = re.compile("[⺀-鿿가-힣＀-￯]")
UTF8_MANY, UTF8_ONE = (re.compile(b"(?:[\xe2-\xe9\xef][\x80-\xbf]{2}){%d}" % n) for n in (2, 1))


def to_bytes(s: str, enc: str) -> bytes | None:
    """``s`` as the bytes it was read from under ``enc``; None if it can't be."""
    back = BACK[enc]
    out = bytearray()
    for c in s:
        o = ord(c)
        if o < 0x80:
            out.append(o)
        elif (b := back.get(c)) is not None:
            out.append(b)
        else:
            return None
    return bytes(out)


COMMON_HAN = {chr(o) for o in range(0x4E00, 0xA000) if 0xB0 <= (chr(o).encode("gb2312", "ignore") or b"?")[0] <= 0xD7} | set("，。、；：？！“”‘’（）《》—…")


def _common_han(c: str) -> bool:
    return c in COMMON_HAN


def _fits(decoded: str, units: int) -> bool:
    """Whether characters got from a UTF-8 round trip are ones people write."""
    for c in decoded:
        o = ord(c)
        if c in HOME or 0xA1 <= o <= 0xBF:
            continue
        if 0x3000 <= o <= 0x303F or 0x4E00 <= o <= 0x9FFF or 0xFF00 <= o <= 0xFF65 or 0x2010 <= o <= 0x2044 or 0x20A0 <= o <= 0x20BF or o in (0x2122, 0x2103):
            continue
        if units > 2 and c in BACK["cp1252"]:
            continue
        if 0xC0 <= o <= 0x17F and (units > 1 or o in (0x152, 0x153, 0x160, 0x161, 0x178, 0x17D, 0x17E)) or o == 0xA0:
            continue
        if o < 0x250 or 0x80 <= o < 0xA0:
            return False
        kind = unicodedata.category(c)
        if units < 2 or kind[0] in "CZ" or kind[0] == "M" and not 0x590 <= o <= 0x1CFF:  # marks belong to the scripts that are written with them
            return False
    return True


def _resolves(s: str, enc: str) -> bool:
    """Whether characters got from a round trip fit, or do after further ones: an inner layer may hold control characters."""
    while not _fits(s, len(s)):
        raw = to_bytes(s, enc)
        try:
            new = raw.decode("utf-8") if raw else s
        except UnicodeDecodeError:
            return False
        if new == s or len(new) >= len(s):
            return False
        s = new
    return True


def cost(s: str) -> float:
    """Garbling cost: how much of ``s`` is unlike written text."""
    total, prev = 0.0, ""
    for i, c in enumerate(s):
        o = ord(c)
        if o >= 0x80:
            if c == "�":
                total += 3
            elif 0x80 <= o < 0xA0 or 0xE000 <= o <= 0xF8FF:
                total += 3
            elif 0x4E00 <= o <= 0x9FFF:
                total += 0.1 if _common_han(c) else 0.6
            elif c not in HOME:
                nxt = s[i + 1] if i + 1 < len(s) else ""
                inside = (prev.isalpha() and prev < "ɐ") or (nxt.isalpha() and nxt < "ɐ")
                own = o >= 0x370 and (prev > "ͯ" and abs(ord(prev) - o) < 0x60 or nxt > "ͯ" and abs(ord(nxt) - o) < 0x60 or 0xAC00 <= o < 0xD7A4)
                total += 0.1 if own and not inside else 2 if inside and c not in LOOK_LATIN else 0.5
            else:
                nxt = s[i + 1] if i + 1 < len(s) else ""
                if c.isalpha() and c.isupper() and prev.islower():
                    total += 1.5  # a capital inside a word
                elif prev.isalpha() and nxt.isalpha() and not c.isalpha() and c not in "’–—·‘":
                    total += 1.5  # a sign inside a word
                else:
                    total += 0.2
        prev = c
    return total


CYRILLIC = ("cp1251", "koi8_r")


def _is_nested(s: str) -> bool:
    return any("\x80" <= c < "\xa0" for c in s)


def _whole(line: str) -> str:
    """Round trip of the whole line: strict UTF-8 with several sequences is no accident."""
    for enc in READ_AS:
        raw = to_bytes(line, enc)
        try:
            new = raw.decode("utf-8") if raw else line
        except UnicodeDecodeError:
            continue
        if len(line) - len(new) >= (6 if enc in CYRILLIC else 3) and cost(new) < cost(line):
            return new
    return line


def _block(c: str) -> int:
    return ord(c) >> 7


def _utf8_places(line: str, enc: str, pat: re.Pattern) -> str:
    """Round trip of the UTF-8 sequences that stand in ``line`` as read by ``enc``."""
    blocks: set[int] = set()

    def mend(m: re.Match) -> str:
        run = m.group()
        try:
            new = to_bytes(run, enc).decode("utf-8")
        except UnicodeDecodeError:
            new = ""
        if new and cost(new) < cost(run) and (_resolves(new, enc) or set(map(_block, new)) <= blocks):
            if len(new) > 2:
                blocks.update(_block(c) for c in new if ord(c) >= 0x370)
            return new
        if _is_nested(new) or enc in CYRILLIC and not re.search("[A-Za-z]", m.string[max(0, m.start() - 1): m.start()] + m.string[m.end(): m.end() + 1]):
            return run  # a part of a layer; or an ordinary pair of letters, unless it stands in a Latin word
        # not as a whole: sequence by sequence
        out, at, raw = [], 0, to_bytes(run, enc)
        while at < len(run):
            n = 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
            part = run[at: at + n]
            try:
                got = raw[at: at + n].decode("utf-8")
                out.append(got if _fits(got, 1) else part)
            except UnicodeDecodeError:
                out.append(part)
            at += n
        return "".join(out)
    fixed = pat.sub(mend, line)
    return pat.sub(mend, fixed) if blocks else fixed  # short sequences beside long ones of their script


def _gbk_places(line: str) -> str:
    """GBK bytes read as a Western encoding; short runs only beside long ones."""
    def mend(m: re.Match) -> str:
        run = m.group()
        for enc in ("latin_1", "cp1252"):
            raw = to_bytes(run, enc)
            if raw is None:
                continue
            for skip in (0, 1):
                body = raw[skip:]
                body = body[: len(body) // 2 * 2]
                try:
                    new = body.decode("gbk")
                except UnicodeDecodeError:
                    continue
                if new and sum(map(_common_han, new)) >= 0.6 * len(new):
                    return run[:skip] + new + run[skip + len(body):]
        return run
    fixed = HIGH_RUN.sub(mend, line)
    return HIGH_PAIRS.sub(mend, fixed) if fixed != line else line


def _wide_places(line: str) -> str:
    """UTF-8 bytes read as GBK: strict decoding between lost bytes."""
    def mend(m: re.Match) -> str:
        run = m.group()
        out, changed = [], False
        for part in re.split("(�+)", run):
            new = part
            if part and part[0] != "�":
                try:
                    raw = part.encode("gb18030")
                except UnicodeEncodeError:
                    raw = b""
                for skip in range(3):
                    got = None
                    for drop in range(4):
                        body = raw[skip: len(raw) - drop]
                        if len(body) < 3:
                            break
                        try:
                            got = body.decode("utf-8")
                            break
                        except UnicodeDecodeError:
                            continue
                    if got is not None and not got.isascii() and not (skip + drop and len(got) < 3):
                        han = sum(_common_han(c) or c in HOME for c in got)
                        if han >= 0.6 * sum(c > "\x7f" for c in got) and (cost(got) < cost(part) or "�" in run):
                            new, changed = got, True
                            break
            out.append(new)
        return "".join(out) if changed else run
    return WIDE_RUN.sub(mend, line)


#: Letters that a single-byte reading of Western text can give.
RETURNS = HOME | {_decode(b, read) for read, written in SINGLE_BYTE for b in range(0x80, 0x100) if (w := _decode(b, written)) in HOME and w.isalpha()}


#: Kinds of space and invisible characters: written on purpose, so no evidence of a wrong reading.
UNSEEN = re.compile("([\u00a0\u00ad\u2000-\u200f\u2028-\u202f\u205f-\u2064\ufeff]+)")


def _single_byte(line: str) -> str:
    """Round trip of a whole line between single-byte encodings, between its unusual spaces."""
    if UNSEEN.search(line):
        return "".join(p if k % 2 else _between(p) for k, p in enumerate(UNSEEN.split(line)))
    return _between(line)


def _between(line: str) -> str:
    odd = [c for c in NON_ASCII.findall(line)]
    if not odd or all(c in LOOK_LATIN for c in odd) or any(map(WIDE.match, odd)):
        return line
    spots = [m.start() for m in NON_ASCII.finditer(line) if m.group() not in HOME]
    beside = [(line[i - 1: i].isalpha(), line[i + 1: i + 2].isalpha()) for i in spots]
    before = cost(line)
    if before < 1.5 or 2 * sum(a or b for a, b in beside) < len(spots) and before - 0.5 * len(spots) < 3:
        return line  # signs that stand by themselves, in words that are right
    best, best_cost = line, before - 1.2
    for read, written in SINGLE_BYTE:
        raw = to_bytes(line, read)
        if raw is None:
            continue
        try:
            new = raw.decode(written)
        except UnicodeDecodeError:
            continue
        after = cost(new)
        if after < best_cost and after <= 0.35 * before and all(c in HOME for c in NON_ASCII.findall(new)):
            best, best_cost = new, after
    if best != line:
        return best
    # a letter that no such reading gives stands for a language that is written with it
    return line if any(c.isalpha() and c not in RETURNS and c not in LOOK_LATIN for c in odd) else WORD.sub(_word, line)


WORD = re.compile(r"\w*[^\W\d_]\w*")


def _word(m: re.Match) -> str:
    """Round trip of one word: for a garbled place in a line that is right otherwise."""
    word = m.group()
    odd = [c for c in word if c > "\x7f" and c not in HOME]
    if not odd or all(c in LOOK_LATIN for c in odd) or any(map(WIDE.match, odd)) or len(word) < 3 or not re.search("[A-Za-z]", word):
        return word
    for read, written in SINGLE_BYTE:
        raw = to_bytes(word, read)
        if raw is not None:
            new = raw.decode(written, "replace")
            if all(c in HOME and c.isalpha() for c in NON_ASCII.findall(new)) and cost(new) <= cost(word) - 1.2:
                return new
    return word


def _undo(line: str) -> str:
    """``line`` with one layer undone, by the candidate of least cost."""
    found = []
    if LEAD_TAIL.search(line):
        if (new := _whole(line)) != line:
            return new
        found += [_utf8_places(line, enc, pat) for enc, pat in SEQUENCES]
    if HIGH_RUN.search(line):
        found.append(_gbk_places(line))
    if WIDE.search(line):
        raw = line.encode("gb18030", "replace")
        least = UTF8_MANY if len(raw) > 1.1 * len(line) else UTF8_ONE
        if least.search(raw):
            found.append(_wide_places(line))
    found = [x for x in found if x != line]
    if not found and STRANGE.search(line):
        found.append(_single_byte(line))
    return min([line, *found], key=cost) if found else line


def repair(text: str) -> tuple[str, int]:
    """The repaired text and the number of layers that were undone."""
    if text.isascii():
        return text, 0
    if not (STRANGE.search(text) or LEAD_TAIL.search(text) or HIGH_RUN.search(text)
            or WIDE.search(text) and UTF8_ONE.search(text.encode("gb18030", "replace"))):
        return text, 0
    most, lines = 0, text.split("\n")
    for k, line in enumerate(lines):
        layers = 0
        while (new := line if line.isascii() else _undo(line)) != line:
            line, layers = new, layers + 1
        lines[k], most = line, max(most, layers)
    return "\n".join(lines), most


LOST = re.compile("�(?!\\s*$)")


def assess(text: str | None) -> tuple[str | None, int, bool]:
    """Repaired text, layers undone, and whether the text is a case."""
    if text is None or text.isascii():
        return text, 0, False
    fixed, layers = repair(text)
    return fixed, layers, layers > 0 or bool(LOST.search(text))


def mend_fields(df: DataFrame, tbl: str, key: str, fields: list[str]) -> DataFrame:
    """One row for each field of ``df`` that holds garbled text.

    Columns: tbl, row_id, field, layers, repaired. Only the key and the named
    fields are read, so other columns (with whatever names) don't matter.
    """
    cols = [F.col(key).cast("bigint").alias("row_id"), *[F.col(f).cast("string") for f in fields]]
    odd = F.lit(False)
    for f in fields:
        odd = odd | F.col(f).rlike(r"[^\x00-\x7f]")

    def make() -> Callable[..., list]:
        def run(ids: list, *values: list) -> list:
            out = []
            for name, column in zip(fields, values):
                for i, t in zip(ids, column):
                    fixed, layers, case = assess(t)
                    if case:
                        out.append((tbl, i, name, layers, fixed))
            return out
        return run

    return map_columns(df.select(*cols).where(odd), make, "tbl string, row_id bigint, field string, layers int, repaired string")
