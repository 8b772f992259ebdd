"""Fingerprints and vectors of texts."""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofgrain.functions.text import token_set


@F.pandas_udf(T.LongType())
def _vote(tokens: pd.Series) -> pd.Series:
    """64-bit similarity hash: each bit set if most tokens' md5 has it (low 64 bits)."""
    out = np.zeros(len(tokens), np.int64)
    for i, ts in enumerate(tokens):
        if ts is not None and len(ts):
            raw = b"".join(hashlib.md5(t.encode()).digest()[8:] for t in ts)
            ones = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0)
            out[i] = np.packbits(2 * ones > len(ts)).view(">i8")[0]
    return pd.Series(out)


def simhash(text: Column) -> Column:
    """Fingerprint of the distinct tokens of a text, 0 for none, as a signed long."""
    return _vote(token_set(text))


def blocks(h: Column, threshold: int = 3) -> Column:
    """Parts of a fingerprint of which two within ``threshold`` bits share one at least, each with its index.

    The 64 bits are cut into threshold + 3 blocks; bits that differ touch at most
    ``threshold`` of them, so three blocks agree at least, and a part is any three
    blocks. At a threshold of 3 a part has 32 bits, so hardly any unlike
    fingerprints meet, however many there are.
    """
    n = threshold + 3
    edges = [64 * i // n for i in range(n + 1)]
    mask = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(n)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    parts = [signed(mask[i] | mask[j] | mask[k]) for i, j, k in combinations(range(n), 3)]
    return F.array(*[F.struct(F.lit(i).alias("block"), h.bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(parts)])


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hash_embed(text: Column) -> Column:
    """64 counts of the distinct tokens by md5 modulo 64."""
    slots = F.transform(token_set(text), lambda t: F.conv(F.substring(F.md5(t), 31, 2), 16, 10).cast("int") % 64)
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, 0 where a vector is zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    n = norm(a) * norm(b)
    return F.when(n > 0, dot / n).otherwise(F.lit(0.0))
