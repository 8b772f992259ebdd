"""Problem 2: near-duplicate records with small edits.

Texts are reduced (NFKC, lower case, letters and digits); equal reduced texts
are first put together under the least id, so exact copies, however many, cost
one sketch. A sketch holds 120 min-hash components over the 9-character
shingles; one bit of each is the fingerprint, groups of three are the band
keys: so many small bands that a pair at the least similarity misses all of them
once in 20 million times.
Fingerprints lie in a forest of BK-trees: the children of a node are keyed by
their Hamming distance to it, and a search follows only edges within the radius.

The shards of the forest are the band keys. They are not broadcast, since the
forest grows with the corpus: fingerprints are shuffled to their shard, and each
shard's tree is built and searched where its rows arrive. Trees hold at most
BLOCK fingerprints. A shard with more is only packed where it arrives; its blocks
are laid out as a square of cells (GROUP blocks by GROUP blocks), each block is
sent to the cells of its row and column, and each cell is searched in a task of
its own. So nothing is capped, a hot shard is spread over all tasks, a task holds
two groups of blocks, and no block is sent once for every other block. Pairs found
are sifted by their sketches and then checked by exact Jaccard similarity.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrain.llm._shared import cut, reduced, window_hashes
from proofgrain.operators.graph import connected_components

WIDTH = 9
LEAST_CHARS = 200
SIMILARITY = 0.7
PASSES, BINS, ROWS = 4, 30, 3  # 120 components
#: A pair of similarity J shares no band with probability (1 - J^3)^40: 5e-8 at 0.7.
BANDS = PASSES * BINS // ROWS
#: Expected distance at similarity 0.7 is 18 of 120 bits, standard deviation 3.9; the radius is six of them off.
RADIUS = 42
BLOCK = 4096
#: Blocks (98 kB each) on either side of a cell.
GROUP = 32
#: Odd multipliers of the passes.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def minhashes(texts: list[str]) -> np.ndarray:
    """One row of 120 components a text; equal components with probability J.

    Four one-permutation sketches of 30 bins; an empty bin takes the value of
    the next filled one, marked by the distance.
    """
    hs, owner, _ = window_hashes(texts, WIDTH)
    out = np.empty((len(texts), PASSES * BINS), np.uint64)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    for p, m in enumerate(MULTIPLIERS):
        h = hs * np.uint64(m)
        h ^= h >> np.uint64(31)
        h *= np.uint64(m)
        slot = owner * BINS + ((h >> np.uint64(40)) % np.uint64(BINS)).astype(np.int64)
        best = np.full(len(texts) * BINS, none)
        np.minimum.at(best, slot, h)
        best = best.reshape(len(texts), BINS)
        for step in range(1, BINS):
            hole = best == none
            if not hole.any():
                break
            best = np.where(hole & (np.roll(best, -1, 1) != none), np.roll(best, -1, 1) + np.uint64(step), best)
        out[:, p * BINS: (p + 1) * BINS] = best
    return out


def sketch(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, digest of the reduced text, fingerprint, band keys and a byte of each component of long enough texts."""
    ddl = "doc_id bigint, d1 bigint, d2 bigint, f1 bigint, f2 bigint, bands array<bigint>, parts binary"
    src = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where(F.length("text") * 18 >= LEAST_CHARS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.left_shift(np.uint64(1), np.arange(60, dtype=np.uint64))
        for batch in batches:
            for lo in range(0, batch.num_rows, 400):
                part = batch.slice(lo, 400)
                kept = [(i, r) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if len(r := reduced(t)) >= LEAST_CHARS]
                if not kept:
                    continue
                ids, texts = zip(*kept)
                mh = minhashes(list(texts))
                bits = mh >> np.uint64(17) & np.uint64(1)
                f1, f2 = ((bits[:, s] * weights).sum(1).astype(np.int64) for s in (slice(0, 60), slice(60, 120)))
                # a band takes its components from different bins and passes
                bands = np.zeros((len(ids), BANDS), np.uint64)
                shuffled = mh.reshape(len(ids), ROWS, BANDS)
                for j in range(ROWS):
                    bands = (bands ^ shuffled[:, j, :]) * np.uint64(0x9E3779B97F4A7C15)
                    bands ^= bands >> np.uint64(32)
                bands = bands * np.uint64(64) + np.arange(BANDS, dtype=np.uint64)
                digest = np.frombuffer(b"".join(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(f1), pa.array(f2),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(ids) + 1, BANDS, dtype=np.int32)), pa.array(bands.astype(np.int64).ravel())),
                    pa.array([x.tobytes() for x in (mh >> np.uint64(25)).astype(np.uint8)], pa.binary()),
                ], names=["doc_id", "d1", "d2", "f1", "f2", "bands", "parts"])

    return src.mapInArrow(run, ddl)


class BKTree:
    """Fingerprints by Hamming distance; equal ones share a node."""

    def __init__(self):
        self.root = None
        self.size = 0

    def add(self, fp: int, item: int) -> None:
        self.size += 1
        if self.root is None:
            self.root = (fp, [item], {})
            return
        node = self.root
        while True:
            d = (node[0] ^ fp).bit_count()
            if d == 0:
                node[1].append(item)
                return
            child = node[2].get(d)
            if child is None:
                node[2][d] = (fp, [item], {})
                return
            node = child

    def within(self, fp: int, radius: int) -> Iterator[int]:
        stack = [self.root] if self.root else []
        while stack:
            value, items, children = stack.pop()
            d = (value ^ fp).bit_count()
            if d <= radius:
                yield from items
            for edge, child in children.items():
                if d - radius <= edge <= d + radius:
                    stack.append(child)


def _pairs(batch_pairs: list[tuple[int, int]], blocks: list[tuple]) -> pa.RecordBatch:
    n, m = len(batch_pairs), len(blocks)
    a = [p[0] for p in batch_pairs] + [None] * m
    b = [p[1] for p in batch_pairs] + [None] * m
    k, i, data = ([None] * n + [x[j] for x in blocks] for j in range(3))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(k, pa.int64()), pa.array(i, pa.int32()), pa.array(data, pa.binary())], names=["a", "b", "key", "block", "data"])


def search_shards(rows: DataFrame, radius: int = RADIUS, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """Pairs (a, b) of ``rows`` (key, doc_id, f1, f2) within the radius in one shard."""
    ddl = "a bigint, b bigint, key bigint, block int, data binary"
    placed = rows.repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree, held, number = None, None, [], 0
        pairs, blocks = [], []

        def feed(k: int, ids: list, fps: list) -> None:
            nonlocal key, tree, held, number
            if k != key:
                if number:
                    blocks.append((key, number, _pack(held)))
                key, tree, held, number = k, BKTree(), [], 0
            for i, fp in zip(ids, fps):
                if len(held) >= block:
                    blocks.append((key, number, _pack(held)))
                    held, number = [], number + 1
                if not number:  # later blocks are searched in their cells
                    for other in tree.within(fp, radius):
                        pairs.append((min(i, other), max(i, other)))
                    tree.add(fp, i)
                held.append((i, fp))

        rest = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if rest is not None:
                cols = [np.concatenate([r, c]) for r, c in zip(rest, cols)]
            keys = cols[0]
            if not len(keys):
                continue
            starts = np.append(np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)), len(keys))
            # the last shard may go on in the next batch: a short one waits, a long one is fed
            last = starts[-2]
            whole = starts[:-1] if len(keys) - last < block else starts
            for lo, hi in zip(whole[:-1], whole[1:]):
                if hi - lo > 1 or keys[lo] == key:
                    feed(int(keys[lo]), cols[1][lo:hi].tolist(), [(x & 0xFFFFFFFFFFFFFFF) << 60 | (y & 0xFFFFFFFFFFFFFFF) for x, y in zip(cols[2][lo:hi].tolist(), cols[3][lo:hi].tolist())])
            rest = [c[last:] for c in cols] if len(whole) < len(starts) else None
            if len(pairs) > 20_000 or blocks:
                yield _pairs(pairs, blocks)
                pairs, blocks = [], []
        if rest is not None and (len(rest[0]) > 1 or rest[0][0] == key):
            feed(int(rest[0][0]), rest[1].tolist(), [(x & 0xFFFFFFFFFFFFFFF) << 60 | (y & 0xFFFFFFFFFFFFFFF) for x, y in zip(rest[2].tolist(), rest[3].tolist())])
        if number:
            blocks.append((key, number, _pack(held)))
        yield _pairs(pairs, blocks)

    first = cut(placed.mapInArrow(run, ddl))
    inside = first.where("a is not null").select("a", "b")
    blocks = first.where("a is null").select("key", "block", "data")
    if not blocks.limit(1).count():
        return inside.distinct()
    sizes = blocks.groupBy("key").agg(F.ceil((F.max("block") + 1) / F.lit(group)).cast("int").alias("groups"))
    g = F.floor(F.col("block") / F.lit(group)).cast("int")
    laid = blocks.join(sizes, "key").withColumn("g", g).withColumn("h", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    cells = laid.select("key", F.least("g", "h").alias("low"), F.greatest("g", "h").alias("high"), "block", "data")
    tasks = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cells.repartition(tasks, "key", "low", "high").sortWithinPartitions("key", "low", "high", "block")

    def searched(low: int, high: int, held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        left = [x for x in held if x[0] // group == low]
        right = left if low == high else [x for x in held if x[0] // group == high]
        for number, data in left:
            tree, pairs = BKTree(), []
            for i, fp in _unpack(data):
                if low == high and number:  # the first block was searched where it arrived
                    pairs += [(min(i, o), max(i, o)) for o in tree.within(fp, radius)]
                tree.add(fp, i)
            for other, more in right:
                if other > number:
                    pairs += [(min(i, o), max(i, o)) for i, fp in _unpack(more) for o in tree.within(fp, radius)]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            for k, low, high, number, data in zip(*[c.to_pylist() for c in batch.columns]):
                if (k, low, high) != cell:
                    if cell is not None:
                        yield from searched(cell[1], cell[2], held)
                    cell, held = (k, low, high), []
                held.append((number, data))
        if cell is not None:
            yield from searched(cell[1], cell[2], held)

    return inside.union(placed.mapInArrow(across, "a bigint, b bigint")).distinct()


def _pack(held: list[tuple[int, int]]) -> bytes:
    return b"".join(i.to_bytes(8, "little", signed=True) + fp.to_bytes(16, "little") for i, fp in held)


def _unpack(data: bytes) -> Iterator[tuple[int, int]]:
    for at in range(0, len(data), 24):
        yield int.from_bytes(data[at: at + 8], "little", signed=True), int.from_bytes(data[at + 8: at + 24], "little")


def least_equal(least: float) -> int:
    """Equal components that a pair of the least similarity has, less six standard deviations."""
    n = PASSES * BINS
    return int(n * least - 6 * (n * least * (1 - least)) ** 0.5)


def sift(pairs: DataFrame, parts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs whose sketches (doc_id, parts) have enough equal components: a pair of the least similarity has, but for one in a billion.

    A sketch is a fraction of a text, so unlike texts that met in a tree aren't
    brought together for the exact check.
    """
    both = pairs.join(parts.select(F.col("doc_id").alias("a"), F.col("parts").alias("pa")), "a").join(parts.select(F.col("doc_id").alias("b"), F.col("parts").alias("pb")), "b").select("a", "b", "pa", "pb")
    want = least_equal(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in batch.columns[2:])
                kept = pa.array((x == y).sum(1) >= want)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], names=["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint")


def verify(pairs: DataFrame, docs: DataFrame, key: str, text: str, least: float = SIMILARITY) -> DataFrame:
    """a, b, similarity of the pairs whose exact Jaccard similarity is ``least`` or more."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("text is not null").join(ids, "doc_id", "left_semi")
    texts = cut(texts)
    sides = (
        pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
        .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: OrderedDict[int, np.ndarray] = OrderedDict()

        def shingles(i: int, t: str) -> np.ndarray:
            if i not in seen:
                seen[i] = np.unique(window_hashes([reduced(t)], WIDTH)[0])
                if len(seen) > 300:
                    seen.popitem(last=False)
            return seen[i]

        for batch in batches:
            out = []
            for a, b, ta, tb in zip(*[c.to_pylist() for c in batch.columns]):
                x, y = shingles(a, ta), shingles(b, tb)
                if min(len(x), len(y)) < least * max(len(x), len(y)):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                j = both / (len(x) + len(y) - both)
                if j >= least:
                    out.append((a, b, j))
            cols = list(zip(*out)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["a", "b", "similarity"])

    return sides.mapInArrow(run, "a bigint, b bigint, similarity double")


def near_duplicates(docs: DataFrame, key: str, text: str, least: float = SIMILARITY, radius: int = RADIUS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Links between representatives (a, b, similarity) and membership (doc_id, rep).

    Every document whose reduced text has LEAST_CHARS characters or more has a
    row in the membership; null, empty and shorter texts have none.
    """
    sk = cut(sketch(docs, key, text))
    reps = sk.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "f1", "f2", "bands")).alias("r"))
    rows = reps.select(F.explode("r.bands").alias("key"), F.col("r.doc_id").alias("doc_id"), F.col("r.f1").alias("f1"), F.col("r.f2").alias("f2"))
    near = cut(sift(search_shards(rows, radius, block), sk.select("doc_id", "parts"), least))
    links = cut(verify(near, docs, key, text, least))
    first = sk.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    members = cut(sk.select("doc_id", "d1", "d2").join(first, ["d1", "d2"]).select("doc_id", "rep"))
    return links, members


def expand(links: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of documents: linked representatives' members, and copies among themselves."""
    x = members.select(F.col("doc_id").alias("x"), F.col("rep").alias("a"))
    y = members.select(F.col("doc_id").alias("y"), F.col("rep").alias("b"))
    cross = links.select("a", "b").join(x, "a").join(y, "b").select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))
    several = members.where("doc_id <> rep").select("rep").distinct()
    copies = members.join(several, "rep", "left_semi")
    same = copies.select(F.col("doc_id").alias("doc_id_a"), "rep").join(copies.select(F.col("doc_id").alias("doc_id_b"), "rep"), "rep").where("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b")
    return cross.union(same)


def classes(links: DataFrame, members: DataFrame) -> DataFrame:
    """One row a document: doc_id, class_id (least id of the class), links to other texts, copies."""
    comp = connected_components(links.select("a", "b"))
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    size = members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    return (
        members.join(size, "rep").join(comp, F.col("rep") == comp["node"], "left").drop("node")
        .join(degree, F.col("rep") == degree["node"], "left")
        .select("doc_id", F.coalesce("component", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"), "copies")
    )
