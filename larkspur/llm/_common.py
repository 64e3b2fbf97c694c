"""Shared helpers: numpy text hashing on Arrow buffers, sampling and lineage cutting.

Everything here works on one Arrow batch or one chunk of texts at a time, so a
task's memory follows the chunk size (``CHUNK_BYTES``), not the partition.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.lineage import cut, shared_folder

CHUNK_BYTES = 1 << 20
CHUNK_DOCS = 256
#: Bytes whose words are hashed at once; this takes many times as much memory, which each worker keeps until it is trimmed.
HASH_BYTES = 1 << 16

#: Bytes that end a word: the complement of ``[^\x20\x09-\x0D]``.
IS_GAP = np.zeros(256, bool)
IS_GAP[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: What this worker keeps from task to task; it goes when texts are taken for another purpose.
KEPT: dict[str, object] = {}

#: glibc's call, where there is one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

_rng = np.random.default_rng(20240607)
_BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW_LEN = 1 << 16
_POW = np.cumprod(np.full(_POW_LEN, 0x9E3779B97F4A7C15, np.uint64))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def give_back() -> None:
    """Return what this worker has freed to the system: workers live on from stage to stage, and each keeps its peak otherwise."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def text_chunks(column: pa.Array, max_bytes: int = CHUNK_BYTES, max_docs: int = CHUNK_DOCS, keep: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, UTF-8 bytes, offsets) without copying the bytes; nulls are empty.

    A chunk holds at most ``max_bytes`` unless one text alone is longer. What the
    worker keeps for others goes, but for those who ``keep`` it.
    """
    if not keep:
        KEPT.clear()
    give_back()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1
        hi = min(max(hi, lo + 1), lo + max_docs, n)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
    give_back()


def spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = IS_GAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every maximal run of non-gap bytes; runs never cross a text's end."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~gap[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] |= inside[edges]
    last[edges - 1] |= inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets[1:], starts, "right")


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """64-bit hash of each span's bytes, after mapping bytes through ``fold``."""
    out = np.zeros(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(int(np.searchsorted(ends, starts[lo] + HASH_BYTES, "right")), lo + 1)
        size = ends[lo:hi] - starts[lo:hi]
        at = np.cumsum(size) - size
        within = np.arange(int(size.sum())) - np.repeat(at, size)
        code = _BYTE_CODE[fold[data[within + np.repeat(starts[lo:hi], size)]]]
        code *= _POW[within & (_POW_LEN - 1)]
        if len(within) and int(size.max()) > _POW_LEN:
            code *= (2 * (within >> 16) + 1).astype(np.uint64)
        out[lo:hi] = np.add.reduceat(code, at) if len(at) else 0
        out[lo:hi] += size.astype(np.uint64)
        lo = hi
    return mix64(out)


def gram_hashes(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of first word) of each run of n words within one text."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = np.zeros(m, np.uint64)
    for k in range(n):
        acc = (acc ^ words[k : k + m]) * np.uint64(0x9FB21C651E98DF25)
        acc ^= acc >> np.uint64(29)
    ok = np.flatnonzero(rows[:m] == rows[n - 1 :])
    return mix64(acc[ok]), ok


def bounded_sample(df: DataFrame, rows: int, *tie: str) -> DataFrame:
    """At most ``rows`` rows, the same on every run: a hash threshold from one count, then a strict top-k by hash."""
    total = df.count()
    h = F.xxhash64(F.lit("sample"), *[F.col(c) for c in tie])
    if total > 2 * rows:
        df = df.where(F.pmod(h, F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, 1.5 * rows / total))))
    return df.withColumn("_h", h).orderBy("_h", *tie).limit(rows).drop("_h")


def removed(spark: SparkSession, path: str) -> None:
    """Take a folder out of the store that Spark reads it from."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """The rows as a Parquet table in the shared folder, for steps that read few of their columns, and its removal."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    # hashes, for the most part: neither dictionaries nor compression gain much
    df.write.option("parquet.enable.dictionary", "false").option("compression", "none").parquet(path)

    return spark.read.schema(df.schema).parquet(path), lambda: removed(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(of: int):
    """crc32 of the id written as text, modulo ``of`` (null ids: 0)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of, F.lit(0))


__all__ = ["bounded_sample", "cut", "gram_hashes", "mix64", "remainder", "removed", "shared_folder", "span_hashes", "spans", "stored", "table", "text_chunks"]
