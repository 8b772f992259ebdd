"""Problem 9: evaluation texts inside the corpus.

Prefix-filtered set join. An item's shingles (distinct substrings of 20
characters of the reduced text) are ordered by rarity, rarest first. An item of
n shingles leaks if at least t = ceil(n / 2) of them stand in a document, so at
least one of its n - t + 1 rarest must: only pairs with a prefix token in common
are candidates. The length bound drops documents of fewer than t shingles, the
positional bound drops an item if its hits that are left can't reach t, and the
shared shingles of the rest are counted exactly. For a leaked item the
item-sized window with the most shared shingles is reported.

A bounded number of items (MAX_SHINGLES) goes to the tasks as sorted arrays. More
stay distributed: their tokens are counted, ordered and cut to prefixes by joins,
a filter of fixed size (2^BITS bits) picks the documents' shingles that may be
tokens, and those are joined with the tokens; documents are read once either way.
Shingles are compared by 64-bit hashes in the search; a leak is confirmed on the
shingles themselves. Null texts and texts whose reduced form is shorter than 20
characters have no shingles and match nothing.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proofgrain.llm._shared import cut, map_columns, reduced, small, window_hashes

WIDTH = 20
#: Shingles of items held by a task at once (about 24 bytes each).
MAX_SHINGLES = 2_000_000
#: Items whose texts are broadcast to confirm leaks; more are joined by shuffling.
MAX_ITEMS = 10_000
DDL = "doc_id bigint, item_id bigint, shared bigint, shingles bigint, from_pos bigint, to_pos bigint"
BITS = 22


class Items:
    """A block of items, ready for lookup."""

    def __init__(self, items: list[tuple[int, str]]):
        texts = [reduced(t) for _, t in items]
        hs, owner, starts = window_hashes(texts, WIDTH)
        sets = [np.unique(hs[starts[i]: starts[i + 1]]) for i in range(len(items))]
        self.ids = np.array([i for i, _ in items], np.int64)
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.need = -(-self.sizes // 2)
        self.length = np.array([len(t) for t in texts], np.int64)
        rarity = Counter(h for s in sets for h in s.tolist())
        tokens, owners, prefix = [], [], []
        for k, s in enumerate(sets):
            order = sorted(s.tolist(), key=lambda h: (rarity[h], h))
            tokens += order
            owners += [k] * len(order)
            prefix += [j < len(order) - self.need[k] + 1 for j in range(len(order))]
        t, o, p = np.array(tokens, np.uint64), np.array(owners, np.int64), np.array(prefix, bool)
        order = np.argsort(t, kind="stable")
        self.owners, self.prefix = o[order], p[order]
        self.tokens, self.first = np.unique(t[order], return_index=True)
        self.first = np.append(self.first, len(t))
        self.bits = np.zeros(1 << BITS, bool)
        self.bits[(self.tokens >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def scan(self, texts: list[str]) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, shared, shingles, from, to) of each leak in a batch of texts."""
        hs, owner, starts = window_hashes([reduced(t) for t in texts], WIDTH)
        if not len(hs) or not len(self.tokens):
            return []
        pos = np.flatnonzero(self.bits[(hs >> np.uint64(64 - BITS)).astype(np.int64)])
        at = np.searchsorted(self.tokens, hs[pos])
        at[at == len(self.tokens)] = 0
        hit = self.tokens[at] == hs[pos]
        pos, at = pos[hit], at[hit]
        if not len(pos):
            return []
        out = []
        docs = owner[pos]
        cuts = np.append(np.flatnonzero(np.diff(docs, prepend=-1)), len(docs))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            doc, where, which = int(docs[lo]), pos[lo:hi] - starts[docs[lo]], at[lo:hi]
            distinct = np.unique(which)
            n = self.first[distinct + 1] - self.first[distinct]
            entries = np.repeat(self.first[distinct] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            own = self.owners[entries]
            candidates = np.unique(own[self.prefix[entries]])  # a prefix token in common
            if not len(candidates):
                continue
            candidates = candidates[starts[doc + 1] - starts[doc] >= self.need[candidates]]  # length bound
            shared = np.bincount(own, minlength=len(self.ids))
            for k in candidates[shared[candidates] >= self.need[candidates]]:
                mine = np.isin(which, distinct[np.isin(distinct, np.repeat(distinct, n)[own == k])])
                spots = where[mine]
                span = int(self.length[k])
                inside = np.searchsorted(spots, spots + span - WIDTH + 1) - np.arange(len(spots))
                start = int(spots[np.argmax(inside)])
                out.append((doc, int(self.ids[k]), int(shared[k]), int(self.sizes[k]), start + 1, start + span))
        return out


def in_common(text: str, item: str) -> tuple[int, int]:
    """Distinct shingles of the item that stand in the text, and all of them: compared as strings."""
    r, x = reduced(text), reduced(item)
    want = {x[i: i + WIDTH] for i in range(len(x) - WIDTH + 1)}
    return len(want & {r[i: i + WIDTH] for i in range(len(r) - WIDTH + 1)}), len(want)


def confirmed(found: DataFrame, docs: DataFrame, items: DataFrame) -> DataFrame:
    """The leaks whose shingles, compared as strings, are at least half of the item's: hashes can't add one."""
    found = cut(found)
    texts = docs.join(small(found.select("doc_id").distinct(), MAX_ITEMS), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    both = found.join(texts, "doc_id").join(small(items, MAX_ITEMS), "item_id").select("doc_id", "item_id", "from_pos", "to_pos", "text", "item_text")

    def make() -> Callable[..., list]:
        def run(*cols: list) -> list:
            rows = [(i, k, *in_common(t, x), a, b) for i, k, a, b, t, x in zip(*cols)]
            return [r for r in rows if 2 * r[2] >= r[3] > 0]
        return run

    return map_columns(both, make, DDL)


def leaks(docs: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str, most: int = MAX_SHINGLES) -> DataFrame:
    """One row for each document and item leaked into it.

    Columns: doc_id, item_id, shared, shingles, from_pos, to_pos (the window in
    the reduced text). Rows delivered twice are found twice, under their ids.
    """
    src = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("text <> ''")
    asked = items.select(F.col(item_key).cast("bigint").alias("item_id"), F.col(item_text).alias("item_text")).where("item_text <> ''")
    total = asked.agg(F.coalesce(F.sum(F.length("item_text")), F.lit(0))).first()[0]
    return _held(src, asked) if total <= most else confirmed(_joined(src, asked), src, asked)


def _held(src: DataFrame, asked: DataFrame) -> DataFrame:
    """Leaks of items that every task can hold."""
    schema = pa.schema([(c.split()[0], pa.int64()) for c in DDL.split(", ")])
    rows = [(r[0], r[1]) for r in asked.collect()]  # bounded by the caller
    b = src.sparkSession.sparkContext.broadcast(pickle.dumps((Items(rows), dict(rows))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, wanted = pickle.loads(b.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                rows = [(ids[d], k, *in_common(texts[d], wanted[k]), at, to) for d, k, _, _, at, to in held.scan(texts)]
                rows = [r for r in rows if 2 * r[2] >= r[3]]
                cols = list(zip(*rows)) if rows else [()] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=schema)

    return src.mapInArrow(run, DDL)


def _tokens(df: DataFrame, bits: bytes | None = None) -> DataFrame:
    """id, token, at (its first place), chars (of the reduced text) of the distinct shingles of (id, text) rows; with a filter only of those that pass it."""
    shared = df.sparkSession.sparkContext.broadcast(bits) if bits is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = np.unpackbits(np.frombuffer(shared.value, np.uint8)).view(bool) if shared is not None else None
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids, texts = part.column(0).to_numpy(), [reduced(t) for t in part.column(1).to_pylist()]
                hs, owner, starts = window_hashes(texts, WIDTH)
                pos = np.arange(len(hs)) if passes is None else np.flatnonzero(passes[(hs >> np.uint64(64 - BITS)).astype(np.int64)])
                both = np.stack([owner[pos], hs[pos].view(np.int64)]) if len(pos) else np.empty((2, 0), np.int64)
                _, first = np.unique(both, axis=1, return_index=True)
                pos = pos[np.sort(first)]
                chars = np.array([len(t) for t in texts], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids[owner[pos]], hs[pos].view(np.int64), pos - starts[owner[pos]], chars[owner[pos]])], names=["id", "token", "at", "chars"])

    return df.mapInArrow(run, "id bigint, token bigint, at bigint, chars bigint")


def _joined(src: DataFrame, asked: DataFrame) -> DataFrame:
    """Leaks of any number of items: prefix tokens and documents' shingles meet by a join."""
    tok = cut(_tokens(asked.select("item_id", "item_text")))
    rarity = tok.groupBy("token").agg(F.count(F.lit(1)).alias("items"))
    order = W.partitionBy("id").orderBy("items", "token")
    ranked = tok.join(rarity, "token").withColumns({"rank": F.row_number().over(order), "n": F.count(F.lit(1)).over(W.partitionBy("id"))})
    ranked = cut(ranked.withColumn("need", F.ceil(F.col("n") / 2)).select(F.col("id").alias("item_id"), "token", "n", "need", "chars", (F.col("rank") <= F.col("n") - F.col("need") + 1).alias("prefix")))
    # a filter of fixed size, whatever the number of tokens
    slots = ranked.select(F.shiftrightunsigned("token", 64 - BITS).alias("b")).distinct().groupBy((F.col("b") / 8).cast("int").alias("byte")).agg(F.bit_or(F.expr("shiftright(128, cast(b % 8 as int))")).alias("v"))
    bits = np.zeros((1 << BITS) // 8, np.uint8)
    for r in slots.toLocalIterator():  # at most 2^BITS / 8 numbers
        bits[r["byte"]] = r["v"]
    met = cut(_tokens(src.select("doc_id", "text"), bits.tobytes()).select(F.col("id").alias("doc_id"), "token", "at"))
    pairs = met.join(ranked.where("prefix").select("token", "item_id"), "token").select("doc_id", "item_id").distinct()  # a prefix token in common
    hits = met.join(ranked, "token").join(pairs, ["doc_id", "item_id"], "left_semi")
    found = hits.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("shared"), F.min("n").alias("shingles"), F.min("need").alias("need"), F.min("chars").alias("chars"), F.array_sort(F.collect_list("at")).alias("spots")).where("shared >= need")
    inside = F.transform("spots", lambda p: F.struct(F.size(F.filter("spots", lambda q: (q >= p) & (q <= p + F.col("chars") - WIDTH))).alias("k"), (-p).alias("p")))
    start = -F.array_max(inside)["p"]
    return found.select("doc_id", "item_id", "shared", "shingles", (start + 1).alias("from_pos"), (start + F.col("chars")).alias("to_pos"))
