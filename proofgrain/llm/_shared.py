"""Helpers of the text operators."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from proofgrain.session import cut, read_table, small  # noqa: F401

ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(),
         "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()),
         "array<string>": pa.list_(pa.string())}


def arrow_schema(ddl: str) -> pa.Schema:
    parts = [p.strip().split(" ", 1) for p in ddl.split(",")]
    return pa.schema([(n, ARROW[t.strip()]) for n, t in parts])


def map_columns(df: DataFrame, make: Callable[[], Callable[..., list]], ddl: str) -> DataFrame:
    """Map Arrow batches of ``df`` through a Python function over column lists.

    ``make`` runs once per task and returns ``f(*columns) -> list of rows``;
    each row is a tuple in the order of ``ddl``.
    """
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            rows = f(*[c.to_pylist() for c in b.columns])
            cols = list(zip(*rows)) if rows else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

    return df.mapInArrow(run, ddl)


OTHER = re.compile(r"[\W_]+")


def reduced(text: str) -> str:
    """NFKC, lower case, letters and digits only."""
    return OTHER.sub("", (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower())


MUL = np.uint64(0x9E3779B97F4A7C15)
MASK = 0xFFFFFFFFFFFFFFFF


def window_hashes(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all substrings of ``width`` characters of a batch of texts.

    Returns hashes, index of the text of each, and start of the first hash of
    each text (one more entry at the end). Equal substrings have equal hashes.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = np.maximum(sizes - width + 1, 0)
    starts = np.concatenate([[0], np.cumsum(counts)])
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if not starts[-1]:
        return np.empty(0, np.uint64), np.empty(0, np.int64), starts
    n = len(cp) - width + 1
    # doubling: hashes of windows of 1, 2, 4, ... characters, joined to the width
    h, size, done, out, rest, power = cp * MUL + np.uint64(1), 1, 0, None, width, MUL
    while rest:
        if rest & 1:
            part = h[done: done + n]
            out = part.copy() if out is None else out * power + part
            done += size
        rest >>= 1
        if rest:
            h = h[:-size] * power + h[size:]
            h ^= h >> np.uint64(29)
            size *= 2
            power = np.uint64(int(power) ** 2 & MASK)
    out ^= out >> np.uint64(32)
    out *= MUL
    out ^= out >> np.uint64(29)
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    return out[np.arange(starts[-1]) - starts[owner] + first[owner]], owner, starts


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [read_table(spark, sf_dir, n) for n in names]
