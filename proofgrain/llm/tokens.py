"""Problem 8: encoding the corpus with a public byte-level BPE tokenizer.

Speculate and verify. A text is split into words by the tokenizer's pattern.
For words not met before, a greedy longest match proposes tokens; every pair of
adjacent tokens of the whole batch is then tested at once against the table of
compatible pairs (a pair is compatible if merging its bytes exactly gives the
pair back; a sequence is the exact encoding if all its adjacent pairs are).
Only words with an incompatible pair undergo exact merging.

Null and empty texts give the empty list, blank texts are encoded as they are,
strings that spell special tokens are ordinary text, every row gives one row.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern of the byte-level tokenizer.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same split for texts without the characters on which the two regex libraries differ.
PLAIN = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Words kept in a task's cache; when full it is emptied, which changes no result.
CACHE_WORDS = 400_000
#: Encoders of a Python worker, which serves many tasks.
ENCODERS: dict[str, "Encoder"] = {}


def read_vocabulary(path: str = DEFAULT_VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Exact merging: join the adjacent pair of least rank, the first of equals, until none is left.

    Pairs wait in a heap and parts in a linked list, so a word of n bytes takes n log n steps.
    """
    n = len(word)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    waiting = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i: i + 2])) is not None]
    heapify(waiting)
    while waiting:
        _, i, stop = heappop(waiting)
        j = after[i] if end[i] else n
        if j >= n or end[j] != stop:
            continue  # one of the two was joined to another part since
        end[i], end[j], after[i] = stop, 0, after[j]
        if after[j] < n:
            before[after[j]] = i
        for left in (before[i], i):
            if left >= 0 and (right := after[left]) < n and (r := ranks.get(word[left: end[right]])) is not None:
                heappush(waiting, (r, left, end[right]))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i: end[i]]])
        i = after[i]
    return out


def _differs(c: str) -> bool:
    kind = unicodedata.category(c)
    return (kind in ("Nl", "No") or "\x1c" <= c <= "\x1f"
            or (kind[0] == "L") != (c.isalnum() and not c.isdecimal()) or (kind == "Nd") != c.isdecimal())


@lru_cache(1)
def odd_characters() -> re.Pattern:
    """Characters the two regex libraries class differently, and all beyond the basic plane."""
    odd = "".join(re.escape(chr(c)) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and _differs(chr(c)))
    return re.compile(f"[{odd}\U00010000-\U0010ffff]")


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        import regex

        self.ranks, self.words = ranks, {}
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        longest: dict[bytes, int] = {}
        for t, i in ranks.items():
            self.bytes_of[i] = t
            longest[t[:2]] = max(longest.get(t[:2], 1), len(t))
        self.longest = longest
        self.pattern = regex.compile(PATTERN)
        self.known, self.good = np.empty(0, np.int64), np.empty(0, bool)
        self.odd = odd_characters()
        try:
            import tiktoken

            exact = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.exact = exact._core_bpe.encode_single_piece
        except (ImportError, AttributeError):
            self.exact = lambda b: merge(b, ranks)
        self.tried = self.failed = 0

    def split(self, text: str) -> list[str]:
        return (self.pattern if self.odd.search(text) else PLAIN).findall(text)

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        ranks, longest, out, i, n = self.ranks, self.longest, [], 0, len(word)
        while i < n:
            size = longest.get(word[i: i + 2], 1)
            while size > 1:
                t = ranks.get(word[i: i + size])
                if t is not None and i + size <= n:
                    break
                size -= 1
            else:
                t = ranks[word[i: i + 1]]
            out.append(t)
            i += size
        return out

    def compatible(self, codes: np.ndarray) -> np.ndarray:
        """Which of the pair codes (left * 2^20 + right) are compatible."""
        distinct, back = np.unique(codes, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        at[at == len(self.known)] = 0
        new = distinct[self.known[at] != distinct] if len(self.known) else distinct
        if len(new):
            ok = []
            for code in new.tolist():
                a, b = code >> 20, code & 0xFFFFF
                ok.append(list(self.exact(self.bytes_of[a] + self.bytes_of[b])) == [a, b])
            known = np.concatenate([self.known, new])
            order = np.argsort(known)
            self.known, self.good = known[order], np.concatenate([self.good, np.array(ok, bool)])[order]
        return self.good[np.searchsorted(self.known, distinct)][back]

    def learn(self, words: list[str]) -> None:
        """Put the encodings of new words into the cache."""
        raw = [w.encode("utf-8", "replace") for w in words]
        got = [self.propose(b) for b in raw]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter(chain.from_iterable(got), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(got)), sizes)
        inside = owner[:-1] == owner[1:]
        codes = (flat[:-1] << 20 | flat[1:])[inside]
        bad = set(owner[:-1][inside][~self.compatible(codes)].tolist()) if len(codes) else set()
        self.tried, self.failed = self.tried + len(words), self.failed + len(bad)
        for k in bad:
            got[k] = list(self.exact(raw[k]))
        self.words.update(zip(words, got))

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.split(t) if t else [] for t in texts]
        if len(self.words) > CACHE_WORDS:
            self.words = {}
        new = set(chain.from_iterable(split)) - self.words.keys()
        if new:
            self.learn(list(new))
        get = self.words.__getitem__
        return [list(chain.from_iterable(map(get, words))) for words in split]


def encode(df: DataFrame, key: str, text: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """key, ids of every row of ``df``."""
    ranks = read_vocabulary(vocabulary)
    digest = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    b = df.sparkSession.sparkContext.broadcast(ranks)  # a tokenizer's vocabulary: some MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if digest not in ENCODERS:
            ENCODERS[digest] = Encoder(b.value)
        encoder = ENCODERS[digest]
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids = encoder.encode_batch(part.column(1).to_pylist())
                sizes = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=sizes[1:])
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))], names=["key", "ids"])

    src = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    return src.mapInArrow(run, "key bigint, ids array<int>").select(F.col("key").alias(key), "ids")
