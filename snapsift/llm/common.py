"""Helpers that the training-data operators share: tables, scratch space, word hashing.

Words are taken from UTF-8 bytes: ``bytes.split()`` splits on exactly ``[\\x20\\x09-\\x0D]`` and ``bytes.lower()``
touches exactly A-Z, so no operator needs a regular expression to find its words.
"""

from __future__ import annotations

import heapq
import sys
import types
from collections.abc import Callable, Hashable

import numpy as np
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import scratch

#: Distinct words that one Python worker remembers before it starts over (bounds its memory).
CACHE_WORDS = 400_000
#: Rows of a batch that are handled together inside a task (bounds the task's arrays).
SLICE_ROWS = 2_000
SLICE_BYTES = 4 << 20

U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as Parquet in the shared checkpoint folder and read it back.

    A written table survives the loss of any executor, drops the lineage, prunes columns when reread, and carries no
    partitioning, so that later joins exchange both sides and stay open to skew splitting.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/snapsift-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)  # lazy results read it till the session ends
    return spark.read.schema(df.schema).parquet(path)


def utf8(column: str):
    """A text column as its UTF-8 bytes (null stays null)."""
    return F.col(column).cast("string").cast("binary")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser on arrays: every input bit reaches every output bit."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


class WordHashes(dict):
    """word -> 64-bit hash, remembered; ``of(words)`` gives an array."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=U, count=len(words))


def held(name: Hashable, make: Callable):
    """What ``make`` gives, made once for each Python worker: later tasks of the worker find it again."""
    found = sys.modules.setdefault("snapsift_held", types.ModuleType("snapsift_held")).__dict__.setdefault("objects", {})
    if name not in found:
        found[name] = make()
    return found[name]


def merge_long(symbols: list[int], pairs: dict[int, tuple[int, int]]) -> list[int]:
    """The symbols that are left of one long sequence when its leftmost pair of least rank is merged until no pair is left.

    ``pairs``: left symbol << 32 | right symbol -> (rank, merged symbol). A heap of the pairs makes it n log n steps for n symbols.
    """
    symbols = list(symbols)
    end = len(symbols)
    after, before = list(range(1, end + 1)), list(range(-1, end - 1))
    heap = []

    def offer(at: int) -> None:
        if at >= 0 and after[at] < end and (got := pairs.get(key := symbols[at] << 32 | symbols[after[at]])):
            heapq.heappush(heap, (got[0], at, key, got[1]))

    for at in range(end):
        offer(at)
    while heap:
        _, at, key, merged = heapq.heappop(heap)
        gone = after[at]
        if symbols[at] < 0 or gone >= end or symbols[at] << 32 | symbols[gone] != key:
            continue  # one of the two has been merged meanwhile
        symbols[at], symbols[gone] = merged, -1
        after[at] = after[gone]
        if after[gone] < end:
            before[after[gone]] = at
        offer(before[at])
        offer(at)
    return [s for s in symbols if s >= 0]


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive word hashes (order matters)."""
    out = np.zeros(max(0, len(h) - n + 1), dtype=U)
    for k in range(n):
        out = mix(out * U(0x9E3779B97F4A7C15) + h[k : k + len(out)])
    return out


def slices(batch, text: int):
    """Zero-copy slices of an Arrow batch with at most SLICE_ROWS rows and about SLICE_BYTES of column ``text`` each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if row > start and (held + size > SLICE_BYTES or row - start >= SLICE_ROWS):
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def partitions_for(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
