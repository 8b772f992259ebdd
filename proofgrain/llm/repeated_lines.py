"""Problem 4: lines repeated across one site's documents.

Lines are nodes of a weighted graph per source: a node weighs the documents
that hold it, an edge the documents in which one line follows the other. Nodes
of high support are kept, edges of high support between them join them to
blocks (connected components), and the occurrences of a block's lines are
deleted from the documents.

Node identity is a 64-bit hash of source and normal form, so counting shuffles
one long and one count per distinct line, summed before the shuffle; a source
with a third of all rows is spread over all its distinct lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrain.llm._shared import cut, small
from proofgrain.operators.graph import connected_components

MIN_DOCS = 5
MIN_SHARE = 0.05
#: Nodes of high support are broadcast up to this number (16 bytes each).
MAX_BROADCAST_NODES = 500_000


def normal_form(line: Column) -> Column:
    """Digits runs to 0, runs of spaces and tabs to one space, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, "[0-9]+", "0"), "[ \t]+", " ")))


def line_keys(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """row_id, source and the array of line hashes (null for blank lines)."""
    def hashed(n: Column) -> Column:
        return F.when(n.rlike(r"(?U)\S"), F.xxhash64(F.col("source"), n))

    base = df.select(F.col(key).cast("bigint").alias("row_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    return base.where("text <> ''").select("row_id", "source", F.transform(F.transform(F.split("text", "\n", -1), normal_form), hashed).alias("keys"))


def frequent_lines(keys: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """node, source, docs of each line of high support.

    A document counts once for a line; the share is taken of the source's
    documents whose text is neither null nor empty. Documents without a source
    form one source of their own.
    """
    counts = (
        keys.select("source", F.explode(F.array_distinct("keys")).alias("node")).where("node is not null")
        .groupBy("node").agg(F.count(F.lit(1)).alias("docs"), F.first("source").alias("source"))
        .where(F.col("docs") >= min_docs)
    )
    totals = keys.groupBy("source").agg(F.count(F.lit(1)).alias("total"))
    joined = counts.join(small(totals, 100_000).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    # an exact comparison: docs / total >= share with rounding kept out
    return joined.where(F.col("docs") * 1.0 >= F.col("total") * F.lit(min_share) - 1e-9).select("node", "source", "docs")


def occurrences(keys: DataFrame, nodes: DataFrame) -> DataFrame:
    """row_id, i, line_no, node of each line that is a node; ``i`` counts a document's lines without the blank ones."""
    lines = F.filter(F.transform("keys", lambda k, n: F.struct((n + 1).cast("bigint").alias("line_no"), k.alias("node"))), lambda x: x["node"].isNotNull())
    # outer: for an inner one Spark infers a filter on the array, which would make it once more
    dense = keys.select("row_id", F.posexplode_outer(lines).alias("i", "x")).select("row_id", "i", "x.line_no", "x.node").where("node is not null")
    return dense.join(small(nodes.select("node"), MAX_BROADCAST_NODES), "node").select("row_id", "i", "line_no", "node")


def blocks(kept: DataFrame, nodes: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """node, source, docs, block: the component of each node over edges of high support.

    An edge is one kept line directly after another in a document (blank lines
    between them don't count); it is kept if it occurs in ``min_docs`` documents
    at least. A node without such an edge is a block of its own. ``kept`` are
    the nodes' occurrences.
    """
    perdoc = kept.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("i", "node"))).alias("x"))
    pairs = perdoc.where(F.size("x") > 1).select(F.explode(F.array_distinct(F.filter(
        F.zip_with(F.slice("x", F.lit(1), F.size("x") - 1), F.slice("x", F.lit(2), F.size("x") - 1),
                   lambda p, q: F.when(q["i"] == p["i"] + 1, F.struct(p["node"].alias("a"), q["node"].alias("b")))),
        lambda e: e.isNotNull()))).alias("e"))
    edges = pairs.groupBy("e.a", "e.b").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= min_docs)
    comp = connected_components(edges)
    return nodes.join(comp, nodes["node"] == comp["node"], "left").select(nodes["node"], nodes["source"], nodes["docs"], F.coalesce("component", nodes["node"]).alias("block"))


def boilerplate(df: DataFrame, key: str, text: str, source: str) -> tuple[DataFrame, DataFrame]:
    """The occurrences to delete (row_id, line_no, block) and the blocks' lines."""
    keys = line_keys(df, key, text, source)
    nodes = cut(frequent_lines(keys))
    kept = cut(occurrences(keys, nodes))
    block = cut(blocks(kept, nodes))
    hits = kept.join(small(block.select("node", "block"), MAX_BROADCAST_NODES), "node")
    return hits.select("row_id", "line_no", "block"), block


def repeated(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """The occurrences of the blocks' lines: row_id, line_no, block."""
    return boilerplate(df, key, text, source)[0]


def clean(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """Each document of ``df`` without its boilerplate lines (key, text).

    Null and empty texts stay as they are; a document that is boilerplate
    throughout becomes an empty text.
    """
    drop = repeated(df, key, text, source).groupBy("row_id").agg(F.collect_set(F.col("line_no").cast("int")).alias("drop"))
    d = df.select(F.col(key).cast("bigint").alias("row_id"), F.col(text).alias("text")).join(drop, "row_id", "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(F.col("drop"), i + 1)), "\n")
    return d.select(F.col("row_id").alias(key), F.when(F.col("drop").isNull(), F.col("text")).otherwise(kept).alias(text))
