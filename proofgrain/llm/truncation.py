"""Problem 10: text cut off by field limits.

Evidence is asked in this order; the first that has any decides:

* a self-join by prefix. A candidate (a text whose end is open or doubtful) and
  every document that begins like it meet by the hash of their first 2^k
  characters, 2^k being the largest power of two that the candidate's length
  holds, so a candidate of any length meets all its longer copies. The distinct
  texts that meet are sorted: a text that is a strict prefix of a longer one
  stands right beside it. What follows there tells whether the text broke off
  within a word or sentence ("34." going on as "34.5") or ended with a full line;
* lines of the corpus: a last line that stands elsewhere as a line with others
  after it, or ends a good part of a source's different texts, is a full line
  (notice, byline, label), so the text isn't cut there; texts are different if
  what stands before their last line is, so copies don't vouch for themselves;
* the end itself: it breaks off without the end of a sentence (an omission mark
  at the end doesn't count as one).

The sort is by range over distinct texts, so neither a prefix nor a text that
very many documents share makes a hot task; a task streams its rows and holds
two of them. Null, empty and blank texts and template residue are no cases.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrain.llm import residue
from proofgrain.llm._shared import cut, map_columns, small
from proofgrain.llm.lookalikes import ASCII, FULL_WIDTH, SINGLE
from proofgrain.llm.mojibake import repair

#: A full line stands before other lines in so many documents, or ends so many and such a share of a source's.
FULL_LINE_DOCS, LAST_LINE_DOCS, LAST_LINE_SHARE = 2, 5, 0.05
PLAIN_FROM, PLAIN_TO = "".join(SINGLE) + FULL_WIDTH, "".join(SINGLE.values()) + ASCII
#: Rows of keys (a number or two each: 10 MB at most) that are broadcast; more are joined by shuffling, with the same result.
MAX_BROADCAST = 250_000
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
OMISSION = re.compile(r"\s*(?:…+|\.{3,}|\[\s*(?:…|\.{3})\s*\]|\(\s*(?:…|\.{3})\s*\))\s*$")
FINISHED = re.compile(r"[.!?。！？][”\"»“’')\]）」』\s]*$")
#: A full stop that may not end a sentence: after a digit, an initial or an abbreviation.
DOUBTFUL = re.compile(r"(?:\d|\b[A-ZÀ-Þ]|\b(?:Dr|M|Mr|Mrs|Mme|St|No|no|Nr|vs|Tel|bzw|ca|etc|art|Art|Abs|p|pp))\.$")
VERSION = re.compile(r"\b(?:version|von|de)\s+\d+\.$", re.I)
SENTENCES = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n")
#: The Chinese full stop after a round trip that lost its last byte.
GARBLED_STOP = re.compile(r"(?:銆�|��|�\?)\s*$")


def ending(text: str) -> str:
    """"blank", "finished", "doubtful" or "open"."""
    t = text.rstrip()
    if not t:
        return "blank"
    tail = t[t.rfind("\n") + 1:]
    if GARBLED_STOP.search(tail) or tail.count("�") >= 3:
        return "finished"
    if not tail.isascii():
        tail = repair(tail)[0].rstrip() or tail
    bare = OMISSION.sub("", tail)
    if not bare:
        return "open" if OMISSION.search(tail) else "finished"
    if not FINISHED.search(bare):
        return "open"
    return "doubtful" if DOUBTFUL.search(bare) else "finished"


def line_key(line: Column, source: Column) -> Column:
    """Hash of a line: lower case, digits to 0, spaces squeezed, the source's name masked."""
    plain = F.regexp_replace(F.translate(line, PLAIN_FROM, PLAIN_TO), "[\u00ad\u200b-\u200f\u2060\ufeff]", "")
    n = F.lower(F.trim(F.regexp_replace(F.regexp_replace(plain, r"[0-9]+(?:[.,/:\- ][0-9]+)*", "0"), r"(?U)\s+", " ")))
    return F.xxhash64(F.when(F.length(source) > 2, F.replace(n, F.lower(source), F.lit("§"))).otherwise(n))


def signatures(text: str) -> tuple[int | None, int | None, int]:
    """Hashes of the two longest sentences before the last line (None without any), and of the longest of the text.

    Copies agree in one of them even if edited elsewhere; different texts don't.
    """
    t = text.rstrip()
    at = t.rfind("\n")
    hashed = lambda x: xxhash.xxh64_intdigest(x.encode("utf-8", "replace")) - (1 << 63)
    long = sorted({x.strip() for x in SENTENCES.split(t[:at])} if at > 0 else (), key=lambda x: (-len(x), x))[:2]
    if not long or not long[0]:
        return None, None, hashed(t)
    return hashed(long[0]), hashed(long[-1] or long[0]), hashed(long[0])


def bare(text: Column) -> Column:
    """The text without blanks and an omission mark at its end."""
    t = F.rtrim(text, F.lit(BLANKS))
    marked = F.endswith(t, F.lit("…")) | F.endswith(t, F.lit("...")) | F.endswith(t, F.lit("]")) | F.endswith(t, F.lit(")"))
    return F.when(marked, F.regexp_replace(t, r"(?U)\s*(…+|\.{3,}|\[\s*(…|\.{3})\s*\]|\(\s*(…|\.{3})\s*\))$", "")).otherwise(t)


def text_hash(text: Column) -> Column:
    """128 bits: texts that agree in them are taken as one."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def start_hash(text: Column, size: Column) -> Column:
    return F.xxhash64(F.substr(text, F.lit(1), size))


def candidates(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """A row a text: doc_id, source, whole (hash of its longest sentence), and for candidates
    end, hash of the bare text, k and hash of the first 2^k characters, key of the last line, what stands before it."""
    src = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")).where("text <> ''")
    src = src.withColumn("bare", bare(F.col("text"))).withColumn("k", F.floor(F.log2(F.length("bare"))).cast("int"))
    src = src.select("doc_id", "source", "text", text_hash(F.col("bare")).alias("h"), "k", start_hash(F.col("bare"), F.call_function("shiftleft", F.lit(1), F.col("k"))).alias("start"),
                     line_key(F.element_at(F.split(F.regexp_replace("text", r"\s+$", ""), "\n", -1), -1), F.coalesce("source", F.lit(""))).alias("last"))

    def make() -> Callable[..., list]:
        def run(ids: list, sources: list, texts: list, ha: list, hb: list, ks: list, starts: list, lasts: list) -> list:
            out = []
            for i, s, t, a, b, k, p, n in zip(ids, sources, texts, ha, hb, ks, starts, lasts):
                e = ending(t)
                if e in ("open", "doubtful") and not residue.has_form(t):
                    out.append((i, s, e, a, b, k, p, n, bool(VERSION.search(t.rstrip())), *signatures(t)))
                else:  # only counted as one of the source's texts
                    out.append((i, s, None, None, None, None, None, None, None, None, None, signatures(t)[2]))
            return out
        return run

    return map_columns(src.select("doc_id", "source", "text", "h.a", "h.b", "k", "start", "last"), make, "doc_id bigint, source string, end string, a bigint, b bigint, k int, start bigint, last bigint, version boolean, before bigint, before2 bigint, whole bigint")


def full_lines(docs: DataFrame, wanted: DataFrame, text: str, source: str, most: int = MAX_BROADCAST) -> DataFrame:
    """Those of the wanted line keys that stand before other lines in FULL_LINE_DOCS documents or more."""
    t = F.regexp_replace(F.col(text), r"\s+$", "")
    lines = F.split(t, "\n", -1)
    src = docs.where(F.col(text) != "").select(F.coalesce(F.col(source), F.lit("")).alias("source"), lines.alias("lines"))
    inner = src.where(F.size("lines") > 1).select(F.explode(F.array_distinct(F.transform(
        F.filter(F.slice("lines", F.lit(1), F.size("lines") - 1), lambda x: F.length(F.trim(x)) > 0), lambda x: line_key(x, F.col("source"))))).alias("last"))
    enough = lambda d: d.groupBy("last").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= FULL_LINE_DOCS).select("last")
    if wanted.limit(most + 1).count() <= most:
        return enough(inner.join(F.broadcast(wanted), "last", "left_semi"))
    return enough(inner).join(wanted, "last", "left_semi")  # counted before they are shuffled


def continuations(docs: DataFrame, cand: DataFrame, key: str, text: str, most: int = MAX_BROADCAST) -> DataFrame:
    """a, b (hash of a text), following: what a longer text has after this text, for texts that are strict prefixes of one."""
    rows = docs.where(F.length(text) > 0).select(F.col(key).cast("bigint").alias("doc_id"), bare(F.col(text)).alias("text")).where("text <> ''")
    keys = cut(cand.where("k is not null").select("k", "start").distinct())
    sizes = sorted(r["k"] for r in keys.select("k").distinct().collect())  # 31 at most
    if not sizes:
        return docs.sparkSession.createDataFrame([], "a bigint, b bigint, following string")
    # each document by the hash of its first 2^k characters, for every k that a candidate has
    starts = F.filter(F.array(*[F.when(F.length("text") >= 1 << n, F.struct(F.lit(n).alias("k"), start_hash(F.col("text"), F.lit(1 << n)).alias("start"))) for n in sizes]), lambda x: x.isNotNull())
    met = cut(rows.select("doc_id", F.xxhash64("text").alias("t"), F.explode(starts).alias("s")).select("doc_id", "t", "s.k", "s.start").join(small(keys, most), ["k", "start"], "left_semi"))
    # a start that only one text has leads nowhere
    several = met.groupBy("k", "start").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo <> hi").select("k", "start")
    ids = cut(met.join(small(several, most), ["k", "start"], "left_semi").select("doc_id").distinct())
    near = rows.join(small(ids, most), "doc_id", "left_semi")
    # equal texts are one; a candidate's copies share its hash
    texts = cut(near.groupBy(text_hash(F.col("text")).alias("h")).agg(F.min("text").alias("text")).select("h.a", "h.b", "text"))
    placed = texts.repartitionByRange(F.col("text").desc()).sortWithinPartitions(F.col("text").desc())
    ddl = "part int, at int, a bigint, b bigint, text string, following string"
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), None

        def batch_of(out: list) -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["part", "at", "a", "b", "text", "following"])

        for batch in batches:
            out = []
            for a, b, t in zip(*[c.to_pylist() for c in batch.columns]):
                if before is None:  # the text before is the last of an earlier partition
                    out.append((part, 1, a, b, t, None))
                elif before.startswith(t):
                    out.append((part, 0, a, b, None, before[len(t): len(t) + 8]))
                before = t
            yield batch_of(out)
        yield batch_of([(part, 2, None, None, before, None)] if before is not None else [])

    got = cut(placed.mapInArrow(run, ddl))
    parts = sorted(r["part"] for r in got.where("at = 2").select("part").collect())  # numbers of partitions, not rows
    border = docs.sparkSession.createDataFrame([(x, y) for x, y in zip(parts, parts[1:])], "part int, next int")
    last = got.where("at = 2").select("part", F.col("text").alias("before")).join(F.broadcast(border), "part").select(F.col("next").alias("part"), "before")
    across = got.where("at = 1").join(last, "part").where(F.col("before").startswith(F.col("text"))).select("a", "b", F.expr("substring(before, length(text) + 1, 8)").alias("following"))
    return got.where("at = 0").select("a", "b", "following").union(across)


def truncated(docs: DataFrame, key: str, text: str, source: str, most: int = MAX_BROADCAST) -> DataFrame:
    """doc_id, source, evidence ("prefix" or "end") of each cut document."""
    every = cut(candidates(docs, key, text, source))
    cand = every.where("end is not null")
    more = continuations(docs, cand, key, text, most)
    judged = cut(cand.select("doc_id", "source", "end", "a", "b", "version", "last", "before", "before2").join(more, ["a", "b"], "left"))
    # a longer copy decides, whatever the last line is
    new_line = F.col("following").rlike(r"^[ \t]*\n")
    by_copy = F.when(F.col("end") == "open", ~new_line).otherwise(~F.col("following").rlike(r"^\s") | F.col("version"))
    prefix = judged.where(F.col("following").isNotNull() & by_copy).select("doc_id", "source", F.lit("prefix").alias("evidence"))
    alone = judged.where("following is null")
    ends = alone.where("end = 'open'")
    # texts, not rows, vouch for a last line of their source
    total = every.groupBy(F.col("source").alias("s")).agg(F.count_distinct("whole").alias("total"))
    counted = cand.where("end = 'open'").groupBy("source", "last").agg(F.count_distinct(F.coalesce("before", F.lit(0))).alias("n1"), F.count_distinct(F.coalesce("before2", F.lit(0))).alias("n2"))
    counted = counted.select("source", "last", F.least("n1", "n2").alias("n")).where(F.col("n") >= LAST_LINE_DOCS)
    often = counted.join(small(total, 100_000), F.col("source").eqNullSafe(F.col("s"))).where(F.col("n") >= LAST_LINE_SHARE * F.col("total")).select("s", F.col("last").alias("line"))
    full = full_lines(docs, ends.select("last").distinct(), text, source, most)
    rest = ends.join(full, "last", "left_anti").join(often, (F.col("last") == F.col("line")) & F.col("source").eqNullSafe(F.col("s")), "left_anti")
    by_end = rest.select("doc_id", "source").union(alone.where("end = 'doubtful' and version").select("doc_id", "source"))
    return prefix.union(by_end.select("doc_id", "source", F.lit("end")))


def rates(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """source, cut, docs, rate: cut documents among those with a text that isn't blank."""
    hits = truncated(docs, key, text, source).groupBy("source").agg(F.count(F.lit(1)).alias("cut")).withColumnRenamed("source", "s")
    total = docs.where(F.col(text).rlike(r"(?U)\S")).groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("docs"))
    return total.join(hits, F.col("source").eqNullSafe(F.col("s")), "left").select("source", F.coalesce("cut", F.lit(0)).cast("bigint").alias("cut"), "docs", (F.coalesce("cut", F.lit(0)) / F.col("docs")).alias("rate"))
