"""Problem 6: visually identical text with different characters.

Texts are brought to one form: full-width and half-width forms, ligatures,
radicals and mathematical letters become the plain characters, look-alike
letters and signs of other scripts become the Latin ones, invisible characters
go, every kind of space becomes a space, and accents are composed.

The work is done on code points: a text is cut into plain pieces and clusters
(characters that aren't in form, with the character before them); clusters are
exploded to positioned code points, joined to the broadcast mapping (built from
Unicode's own tables, so of fixed size), put back in order with combining marks
sorted by class, recomposed, and the text is rebuilt. Texts without such a
character skip all that. Full-width ASCII, which is everywhere in Chinese text,
is translated in place.

Raised and circled digits, fractions, case, accents and other punctuation stay
different. Null stays null; empty and blank texts come out as such.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrain.llm._shared import cut

#: Letters and signs of other scripts or blocks, and what they look like.
LOOK_ALIKE = {
    "АВЕКМНОРСТУХІЈЅѴԚԜӀ": "ABEKMHOPCTYXIJSVQWI",
    "аеорсухіјѕѵһԁԛԝԍ": "aeopcyxijsvhdqwg",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ": "ABEZHIKMNOPTYXCJ",
    "ονϲϳ": "ovcj",
    "օɡℓ": "ogl",
    "‐‑∕⁄∶꞉ʼ‚․∗∼∣": "--//::’,.*~|",
}
#: Invisible characters besides the format characters (category Cf).
INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ" + "".join(map(chr, [*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)])) + "᠋᠌᠍"
#: Kinds of compatibility decomposition that look like the plain text.
SAME_LOOK = {"<wide>", "<narrow>", "<compat>", "<font>", "<noBreak>", "<small>"}
#: Characters that are in form wherever they stand (but may take a combining mark).
SETTLED = r"\x00-\x7f一-鿿À-ÿ‘’“”„–—…•‹›、。《》「」€«»"
#: Combining marks and format characters, which belong to the character before them.
ATTACHED = r"[\p{M}\p{Cf}]"
SINGLE = {a: b for x, y in LOOK_ALIKE.items() for a, b in zip(x, y)}
FULL_WIDTH = "".join(map(chr, range(0xFF01, 0xFF5F)))
ASCII = "".join(map(chr, range(0x21, 0x7F)))


def _parts(c: str) -> str:
    """``c`` fully decomposed and mapped."""
    if c in SINGLE:
        return SINGLE[c]
    if c in INVISIBLE or unicodedata.category(c) == "Cf":
        return ""
    if unicodedata.category(c) == "Zs":
        return " "
    d = unicodedata.decomposition(c).split()
    if not d:
        return c
    if d[0][0] == "<":
        if d[0] not in SAME_LOOK or d[1] == "0020" or len(d) > 2 and set(d[1:]) == {"002E"}:  # spacing accents, and dots in a row
            return c
        d = d[1:]
    return "".join(_parts(chr(int(x, 16))) for x in d)


@lru_cache(1)
def mapping() -> dict[str, str]:
    """Every code point that isn't its own decomposed, mapped form."""
    out = {}
    for o in [*range(0xA0, 0xAC00), *range(0xF900, 0xFFF0), *range(0x10000, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)]:
        c = chr(o)
        if (p := _parts(c)) != c:
            out[c] = p
    return out


def canonical(text: str) -> str:
    """The form of one text, in plain Python (the yardstick of the tests)."""
    m = mapping()
    t = "".join(m.get(c, c) for c in text)
    # canonical order and composition of what is decomposed now
    return unicodedata.normalize("NFC", t)


@lru_cache(1)
def _compositions() -> tuple[list[str], list[str]]:
    keys, values = [], []
    for o in [*range(0xC0, 0xAC00), *range(0xF900, 0xFFF0), *range(0x10000, 0x20000)]:
        d = unicodedata.decomposition(chr(o)).split()
        if len(d) == 2 and d[0][0] != "<" and unicodedata.normalize("NFC", chr(o)) == chr(o):
            keys.append("".join(chr(int(x, 16)) for x in d))
            values.append(chr(o))
    return keys, values


def bring_to_form(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """key columns, ``text`` as stored, and ``form``. The key must be unique and without nulls."""
    names, key = key, [f"_k{i}" for i in range(len(key))]
    stored, text = text, "_text"
    df = df.select(*[F.col(n).alias(k) for n, k in zip(names, key)], F.col(stored).alias(text))
    done = _bring(df, key, text)
    return done.select(*[F.col(k).alias(n) for n, k in zip(names, key)], F.col(text).alias(stored), "form")


def _bring(df: DataFrame, key: list[str], text: str) -> DataFrame:
    spark = df.sparkSession
    wide = F.when(F.col(text).rlike("[\uff01-\uff5e]"), F.translate(text, FULL_WIDTH, ASCII)).otherwise(F.col(text))
    base = df.select(*key, text).withColumn("_t", wide)
    settled = F.coalesce(F.col("_t").rlike(f"^[{SETTLED}]*+$"), F.lit(True))
    odd = cut(base.where(~settled))
    # plain runs, and clusters of one character with what is attached to it
    cluster = f"[{SETTLED}]{ATTACHED}+|[^{SETTLED}]{ATTACHED}*"
    pieces = odd.select(*key, F.posexplode(F.regexp_extract_all("_t", F.lit(f"(?s)[{SETTLED}]+(?!{ATTACHED})|{cluster}"), F.lit(0))).alias("_seg", "_s"))
    is_cluster = F.col("_s").rlike(f"[^{SETTLED}]")
    rows = [(c, [(x, unicodedata.combining(x)) for x in p]) for c, p in mapping().items()]
    rows += [(c, [(c, unicodedata.combining(c))]) for c in map(chr, [*range(0x300, 0xAC00), *range(0xFE20, 0xFE30), *range(0x10000, 0x20000)]) if unicodedata.combining(c) and c not in mapping()]
    table = spark.createDataFrame(rows, "_c string, _m array<struct<c:string,k:int>>").coalesce(1)  # one row a mapped code point: of fixed size
    clusters = pieces.where(is_cluster)
    points = clusters.select(*key, "_seg", F.posexplode(F.regexp_extract_all("_s", F.lit("(?s)."), F.lit(0))).alias("_i", "_c"))
    mapped = points.join(F.broadcast(table), "_c", "left").withColumn("_m", F.coalesce("_m", F.array(F.struct(F.col("_c").alias("c"), F.lit(0).alias("k")))))
    keys, values = _compositions()
    compose = F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*map(F.lit, values)))
    whole = mapped.groupBy(*key, "_seg").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda x: x["_m"])).alias("x"))
    ordered = F.array_sort(F.transform("x", lambda e, i: F.struct(
        F.when(e["k"] == 0, i).otherwise(F.coalesce(F.array_max(F.transform("x", lambda z, j: F.when((j < i) & (z["k"] == 0), j))), F.lit(-1))).alias("s"),
        e["k"].alias("k"), i.alias("i"), e["c"].alias("c"))))
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("base"), F.lit("").alias("marks"), F.lit(0).alias("last"))

    def step(a: Column, x: Column) -> Column:
        both = F.try_element_at(compose, F.concat(a["base"], x["c"]))
        joins = (x["k"] > a["last"]) & both.isNotNull()
        new = F.struct(F.concat(a["done"], a["base"], a["marks"]).alias("done"), x["c"].alias("base"), F.lit("").alias("marks"), F.lit(0).alias("last"))
        merged = F.struct(a["done"].alias("done"), both.alias("base"), a["marks"].alias("marks"), a["last"].alias("last"))
        kept = F.struct(a["done"].alias("done"), a["base"].alias("base"), F.concat(a["marks"], x["c"]).alias("marks"), x["k"].alias("last"))
        return F.when(x["k"] == 0, new).when(joins, merged).otherwise(kept)

    done = whole.withColumn("x", ordered).select(*key, "_seg", F.aggregate("x", start, step, lambda a: F.concat(a["done"], a["base"], a["marks"])).alias("_s"))
    parts = pieces.where(~is_cluster).union(done)
    rebuilt = parts.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_seg", "_s"))), lambda p: p["_s"]), "").alias("form"))
    stored = odd.select(*key, text)
    return base.where(settled).select(*key, text, F.col("_t").alias("form")).union(stored.join(rebuilt, key).select(*key, text, "form"))


def hashed(forms: DataFrame, key: str, within: list[str], text: str) -> DataFrame:
    """id, the columns ``within``, f1 and f2 (hashes of the form) and raw (of the stored string) of every row with a text that isn't blank."""
    return forms.where(F.col(text).rlike(r"(?U)\S")).select(F.col(key).cast("bigint").alias("id"), *within, F.xxhash64("form").alias("f1"), F.crc32(F.encode("form", "utf-8")).alias("f2"), F.xxhash64(text).alias("raw"))


def look_same(forms: DataFrame, key: str, within: list[str], text: str) -> DataFrame:
    """Pairs (id_a, id_b) of rows with one form but different stored strings.

    Different strings of a form are paired, not rows; a pair of strings is then
    joined to its rows, so what is made is what comes out, however many rows are
    equal as stored. Rows that are equal are no pair.
    """
    rows = cut(hashed(forms, key, within, text))
    group = [*within, "f1", "f2"]
    mixed = rows.groupBy(*group).agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select(*group)
    kept = cut(rows.join(mixed, group, "left_semi"))
    strings = kept.select(*group, "raw").distinct()
    pairs = strings.join(strings.withColumnRenamed("raw", "raw2"), group).where("raw < raw2")
    a, b = kept.withColumnRenamed("id", "a"), kept.select(F.col("id").alias("b"), *group, F.col("raw").alias("raw2"))
    both = pairs.join(a, [*group, "raw"]).join(b, [*group, "raw2"])
    return both.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))


def classes(forms: DataFrame, key: str, within: list[str], text: str) -> DataFrame:
    """row_id, class_id (the least id of its form), strings (different ones of the form): one row a row that isn't blank."""
    rows = cut(hashed(forms, key, within, text))
    group = [*within, "f1", "f2"]
    # strings are counted before their forms: a hot string costs its partitions, not its rows
    least = rows.groupBy(*group, "raw").agg(F.min("id").alias("least")).groupBy(*group).agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("strings"))
    return rows.join(least, group).select(F.col("id").alias("row_id"), "class_id", "strings")
