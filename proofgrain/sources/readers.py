"""Readers and sinks: golden set, cache, captured payloads, vault."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """id, query, intent, reference, checkpoints of the rows of a Markdown table."""
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    return spark.read.text(path).where(F.trim("value").startswith("|")).select(cells.alias("c")).where((F.size("c") >= 5) & F.col("c")[0].rlike(r"^[A-Za-z]?\d+$")).select(
        *[F.col("c")[i].alias(n) for i, n in enumerate(("id", "query", "intent", "reference", "checkpoints"))])


def cache_lookup(cache: DataFrame, wanted: DataFrame, now: float, ttl_minutes: float) -> DataFrame:
    """key, val of the newest record of each wanted key that hasn't expired."""
    newest = cache.join(wanted.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.max("ts").alias("ts"), F.max_by("val", "ts").alias("val"))
    return newest.where(F.lit(now) - F.col("ts") <= ttl_minutes * 60).select("key", "val")


def cache_cleanup(cache: DataFrame, now: float, ttl_minutes: float) -> DataFrame:
    return cache.where(F.lit(now) - F.col("ts") <= ttl_minutes * 60)


def write_vault(items: DataFrame, path: str) -> None:
    """Evidence items as parquet, a folder a query's slug."""
    items.write.mode("append").partitionBy("slug").parquet(path)


def read_captured(spark: SparkSession, path: str) -> DataFrame:
    """source, query_id, payload of stored responses (``<source>__<query id>.<ext>``), by Spark's own file source."""
    name = F.col("_metadata.file_name")
    d = spark.read.text(path, wholetext=True).select(F.substring_index(name, "__", 1).alias("source"), F.regexp_extract(name, r"__([0-9]+)(?:\.|$)", 1).try_cast("bigint").alias("query_id"), F.col("value").alias("payload"))
    return d.where("query_id is not null")


class CapturedPayloads(DataSource):
    """``spark.read.format("captured").option("path", folder)``: the rows of ``read_captured`` as a source of its own.

    The folder is reached through its file system (file, hdfs, s3, ...), which all
    machines share; files are split over tasks. A live transport is the same reader
    with a fetch in place of the file read.
    """

    @classmethod
    def name(cls) -> str:
        return "captured"

    def schema(self) -> str:
        return "source string, query_id bigint, payload string"

    def reader(self, schema) -> DataSourceReader:
        return _CapturedReader(self.options["path"], int(self.options.get("files_per_task", "64")))


class _CapturedReader(DataSourceReader):
    def __init__(self, path: str, per: int):
        self.path, self.per = path, per

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path)
        names = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(root)) if f.is_file and "__" in f.base_name)
        return [InputPartition(names[i: i + self.per]) for i in range(0, len(names), self.per)] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path)
        for n in partition.value:
            source, _, rest = n.partition("__")
            number = rest.split(".")[0]
            if number.isdigit():
                with system.open_input_stream(f"{root}/{n}") as f:
                    yield source, int(number), f.read().decode("utf-8", "replace")
