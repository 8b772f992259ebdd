"""Structured Streaming: state with time to live, throttling, incremental reports, windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from proofgrain.session import existing


def windowed_counts(events: DataFrame, watermark: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events and value by window and type; late rows beyond the watermark are dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", watermark).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v")).select(F.col("w.start").alias("start"), "event_type", "n", "v")


def sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", watermark).groupBy(s.alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), "user_id", "n")


def first_seen(events: DataFrame, key: str, watermark: str = "1 hour") -> DataFrame:
    """Each key once within the watermark: the incremental form of first-wins removal."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key])


def ttl_state(events: DataFrame, ttl_seconds: int, key: str = "user_id", tie: str = "event_id", read: Column | None = None, write: Column | None = None) -> DataFrame:
    """key, tie, hit of the rows that read, against the newest row before that writes to their key.

    ``read`` and ``write`` say which rows do (by default views read, purchases
    write). One long of state a key; a key without news for its time to live is
    dropped. Rows of a key's batch are worked off in order of ts and tie, as whole columns.
    """
    read = F.col("event_type") == "view" if read is None else read
    write = F.col("event_type") == "purchase" if write is None else write
    rows = events.withWatermark("ts", "1 hour").select(key, tie, "ts", F.coalesce(read, F.lit(False)).alias("reads"), F.coalesce(write, F.lit(False)).alias("writes"))

    def step(key_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get[0] if state.exists else None
        d = pd.concat(list(batches)).sort_values(["ts", tie])
        t = d["ts"].astype("datetime64[us]").astype("int64")
        written = t.where(d["writes"]).ffill()
        before = written.shift().fillna(float("nan") if held is None else held)
        hit = before.notna() & (t < before + ttl_seconds * 1_000_000)
        last = written.iloc[-1] if written.notna().any() else held
        if last is not None:
            state.update((int(last),))
            at = max(int(last), int(t.max())) // 1000 + ttl_seconds * 1000
            if at > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(at)
        yield pd.DataFrame({key: key_[0], tie: d[tie], "hit": hit})[d["reads"]]

    return rows.groupBy(key).applyInPandasWithState(step, f"{key} bigint, {tie} bigint, hit boolean", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def throttle_waits(times: list[float], interval: float, most: float = 5.0) -> list[float]:
    """Waits of requests in order: each up to ``interval`` after the last one's slot, at most ``most``."""
    waits, last = [], None
    for t in times:
        wait = 0.0 if last is None else min(max(interval - (t - last), 0.0), most)
        waits.append(wait)
        last = t + wait
    return waits


def throttle(events: DataFrame, key: str, ts: str, tie: str, interval: float) -> DataFrame:
    """key, tie, wait of every row: a fold over the key's rows in order of time.

    Rows come to a key's task sorted and are streamed, so a task holds the state
    of one key whatever its number of rows.
    """
    rows = events.select(F.col(key).cast("bigint").alias("k"), (F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6)).alias("t"), F.col(tie).cast("bigint").alias("i"))

    def run(batches):
        key, last = None, None
        for b in batches:
            waits = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != key:
                    key, last = k, None
                wait = 0.0 if last is None else min(max(interval - (t - last), 0.0), 5.0)
                waits.append(wait)
                last = t + wait
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(waits, pa.float64())], names=["k", "i", "wait"])

    placed = rows.where("t is not null").repartition("k").sortWithinPartitions("k", "t", "i")
    return placed.mapInArrow(run, "k bigint, i bigint, wait double").select(F.col("k").alias(key), F.col("i").alias(tie), "wait")


def append_report(batch: DataFrame, path: str, batch_id: int | None = None) -> None:
    """foreachBatch body: append the items that the report at ``path`` doesn't hold yet.

    With its number a batch writes its own folder anew, so one that is run again
    after a failure leaves no item twice and none half written.
    """
    spark = batch.sparkSession
    held = existing(spark, path)
    if held is not None:
        if batch_id is not None and "batch" in held.columns:
            held = held.where(F.col("batch") != batch_id)
        batch = batch.join(held.select("item"), "item", "left_anti")
    new = batch.dropDuplicates(["item"])
    if batch_id is None:
        new.write.mode("append").parquet(path)
    else:
        new.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
