"""Scalar text functions, all Column -> Column (JVM side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]{2,}"
KEYWORD = r"\p{Nd}{2,}|[A-Za-z\x{4e00}-\x{9fa5}]{2,}"
URL = r"""https?://[^\s)"'（）]+"""
STRIP = r"^[\s\x{3000}\x{a0}]+|[\s\x{3000}\x{a0}]+$"
#: Patterns of personal data, applied in this order.
PHONE, NATIONAL_ID, MAIL = r"1[3-9]\p{Nd}{9}", r"\p{Nd}{17}[\p{Nd}Xx]", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def filled(c: Column | str) -> Column:
    """Null as the empty string."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, STRIP, "")


def either(*cols: Column | str) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in cols])


def token_set(c: Column) -> Column:
    """Distinct runs of two or more letters, digits or underscores."""
    return F.array_distinct(F.regexp_extract_all(filled(c), F.lit(WORD), F.lit(0)))


def keyword_set(c: Column) -> Column:
    """Distinct digit runs and Latin or Chinese letter runs of two or more."""
    return F.array_distinct(F.regexp_extract_all(filled(c), F.lit(KEYWORD), F.lit(0)))


def lexical_overlap(text: Column, query: Column) -> Column:
    """Share of the query's tokens that the text holds; 0.5 for a query without tokens."""
    t, q = token_set(F.lower(filled(text))), token_set(F.lower(filled(query)))
    return F.when(F.size(q) == 0, F.lit(0.5)).otherwise(F.size(F.array_intersect(t, q)).cast("double") / F.size(q))


def token_estimate(c: Column) -> Column:
    """Chinese characters count one, four others count one; the fraction is cut."""
    t = filled(c)
    han = F.regexp_count(t, F.lit(r"[\x{4e00}-\x{9fa5}]"))
    return F.floor(han + (F.length(t) - han) / F.lit(4.0)).cast("long")


def fold_spaces(c: Column) -> Column:
    return F.regexp_replace(strip(filled(c)), r"\s+", " ")


def redact(c: Column) -> Column:
    """Telephone numbers, then national ids, then mail addresses, masked."""
    t = F.regexp_replace(c, PHONE, "138****0000")
    return F.regexp_replace(F.regexp_replace(t, NATIONAL_ID, "*" * 17), MAIL, "***@***")


def claim_text(c: Column) -> Column:
    """Findings without sources, uncertain items, confidence, headings and stand-ins."""
    t = filled(c)
    for mark in ("来源：", "未确认项：", "置信度："):
        t = F.substring_index(t, mark, 1)
    return F.regexp_replace(t, r"(?m)^(?:#.*|（.*）)$", "")


def split_facts(c: Column) -> Column:
    """Atomic facts: pieces between sentence marks, stripped, of five characters or more."""
    parts = F.transform(F.split(filled(c), r"[。！？;；\n]", -1), strip)
    return F.filter(parts, lambda x: F.length(x) > 4)


def urls_in(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(filled(c), F.lit(URL), F.lit(0)))


def grams(c: Column) -> Column:
    """Match tokens of a dimension's name: Chinese runs over two characters as pairs."""
    runs = F.regexp_extract_all(filled(c), F.lit(r"[\x{4e00}-\x{9fa5}]{2,}|[A-Za-z]{2,}"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda t: F.when(
        t.rlike(r"^[\x{4e00}-\x{9fa5}]") & (F.length(t) > 2),
        F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substr(t, i, F.lit(2)))).otherwise(F.array(t))))
    return F.when(F.size(pairs) == 0, F.array(filled(c))).otherwise(pairs)


def closure_tokens(c: Column) -> Column:
    parts = F.filter(F.split(filled(c), r"[\s/、,，（）()与和及]+", -1), lambda t: F.length(t) >= 2)
    return F.when(F.size(parts) == 0, F.array(filled(c))).otherwise(parts)


def slug(c: Column) -> Column:
    return F.substring(F.sha1(filled(c)), 1, 10)


def rounded(c: Column, digits: int) -> Column:
    """Half up on the binary value: the same in every engine that keeps the operand order."""
    k = float(10 ** digits)
    return F.floor(c * F.lit(k) + F.lit(0.5)) / F.lit(k)
