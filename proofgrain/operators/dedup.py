"""Order-preserving removal of duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proofgrain.functions.fingerprint import blocks, hamming, simhash
from proofgrain.functions.text import filled
from proofgrain.session import cut


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by order; rows with a null or empty key are all kept."""
    last = keys[-1]
    keyed = df.where(F.coalesce(F.col(last).cast("string"), F.lit("")) != "")
    w = W.partitionBy(*keys).orderBy(*order)
    return keyed.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn").union(df.where(F.coalesce(F.col(last).cast("string"), F.lit("")) == ""))


def fingerprints(docs: DataFrame, part: str, ident: str) -> DataFrame:
    """part, id, url, h: the fingerprint of snippet and title, joined without a space."""
    return docs.select(F.col(part).alias("part"), F.col(ident).alias("id"), F.col("pos"), F.col("url"), simhash(F.concat(filled("snippet"), filled("title"))).alias("h"))


def candidate_pairs(fp: DataFrame, threshold: int) -> DataFrame:
    """Pairs of distinct fingerprints of one part that differ in ``threshold`` bits or less: all of them, at any threshold.

    An equi-join on parts of the fingerprints, one of which a pair must share; rows of one fingerprint
    are paired to their first row only, so a hot fingerprint costs its rows.
    """
    uniq = fp.groupBy("part", "h").agg(F.min("ord").alias("ord"))
    x = uniq.select("part", "h", "ord", F.explode(blocks(F.col("h"), threshold)).alias("b")).select("part", "h", "ord", "b.block", "b.value")
    y = x.select("part", F.col("h").alias("h2"), F.col("ord").alias("ord2"), "block", "value")
    return x.join(y, ["part", "block", "value"]).where((F.col("h") < F.col("h2")) & (hamming(F.col("h"), F.col("h2")) <= threshold)).select("part", "h", "h2").distinct()


def near_dup(docs: DataFrame, part: str, ident: str, threshold: int = 3) -> DataFrame:
    """part, id of the documents kept: each unless an earlier kept one of its part has
    its address or a fingerprint that differs in ``threshold`` bits or less.

    That is the first maximal independent set of the conflict graph by order.
    Pairs exist between distinct fingerprints only; documents meet by the least
    undecided place of their address and of their fingerprint's neighbours, so an
    address or fingerprint that very many share costs its rows, not their pairs.
    A round keeps every document without an undecided neighbour before it, and
    drops the neighbours of those.
    """
    fp = cut(fingerprints(docs, part, ident).withColumn("ord", F.struct("pos", "id")))
    near = candidate_pairs(fp, threshold)
    same = fp.select("part", "h", F.col("h").alias("h2")).distinct()
    links = cut(near.union(near.select("part", F.col("h2").alias("h"), F.col("h").alias("h2"))).union(same))
    undecided, kept = fp.select("part", "id", "ord", "h", F.when(F.length("url") > 0, F.col("url")).alias("url")), None

    def least(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """By fingerprint, the least place among its neighbours in ``rows``; by address, the least place."""
        by_hash = rows.groupBy("part", F.col("h").alias("h2")).agg(F.min("ord").alias("m"))
        around = links.join(by_hash, ["part", "h2"]).groupBy("part", "h").agg(F.min("m").alias("mh"))
        return around, rows.where("url is not null").groupBy("part", "url").agg(F.min("ord").alias("mu"))

    while True:
        around, by_url = least(undecided)
        state = undecided.join(around, ["part", "h"], "left").join(by_url, ["part", "url"], "left")
        keep = cut(state.where((F.col("ord") <= F.col("mh")) & (F.col("mu").isNull() | (F.col("ord") <= F.col("mu")))).select("part", "id", "ord", "h", "url"))
        kept = keep.select("part", "id") if kept is None else kept.union(keep.select("part", "id"))
        around, by_url = least(keep)
        rest = undecided.join(around, ["part", "h"], "left").join(by_url, ["part", "url"], "left").where("mh is null and mu is null")
        undecided = cut(rest.select("part", "id", "ord", "h", "url"))
        if not undecided.limit(1).count():
            return kept
