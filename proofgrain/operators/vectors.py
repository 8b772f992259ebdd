"""Exact nearest neighbours of a stated set of query vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Query vectors multiplied with a batch at once; more queries are worked off in blocks.
QUERY_BLOCK = 4096


def nearest(df: DataFrame, key: str, vec: str, k: int, every: int = 20) -> DataFrame:
    """query_id, vec_id, rank: the k most similar rows of each row whose key is divisible by ``every``.

    The queries are a stated set, read block by block; each block meets all rows
    as one matrix product a batch; only the k best a query leave a task.
    Ties go to the smaller key; zero or null vectors match nothing.
    """
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("v")).where("v is not null")
    spark, out, block = df.sparkSession, None, []

    def against(block: list) -> DataFrame:
        b = spark.sparkContext.broadcast(block)

        def run(batches):
            ids = np.array([i for i, _ in b.value], np.int64)
            q = np.array([v for _, v in b.value])
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
            near, best = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                keys = batch.column(0).to_numpy()
                v = np.array(batch.column(1).flatten()).reshape(n, -1)
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                c = np.floor(q @ v.T * 1e6 + 0.5)
                c[ids[:, None] == keys[None, :]] = -np.inf
                # the best of this batch and of those before
                near, best = np.hstack([near, np.broadcast_to(keys, c.shape)]), np.hstack([best, c])
                order = np.lexsort((near, -best), axis=1)[:, :k]
                near, best = np.take_along_axis(near, order, 1), np.take_along_axis(best, order, 1)
            good = np.isfinite(best)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, good.sum(1)), pa.int64()), pa.array(near[good], pa.int64()), pa.array(best[good], pa.float64())], names=["query_id", "vec_id", "c"])

        return rows.mapInArrow(run, "query_id bigint, vec_id bigint, c double")

    for r in rows.where(F.col("id") % every == 0).toLocalIterator():
        block.append((r["id"], r["v"]))
        if len(block) == QUERY_BLOCK:
            out, block = (against(block) if out is None else out.union(against(block))), []
    if block or out is None:
        out = against(block) if out is None else out.union(against(block))
    w = W.partitionBy("query_id").orderBy(F.desc("c"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "vec_id", "rank")
