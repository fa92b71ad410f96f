"""Word and window kernels over bytes and numpy arrays, used inside Arrow batch functions.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which is exactly what ``bytes.split()`` yields.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import SparkSession

#: Odd multiplier of the polynomial word-sequence hash (arithmetic modulo 2**64).
P = np.uint64(0x9E3779B97F4A7C15)
#: Its inverse modulo 2**64, so that a prefix difference can be shifted back to position 0.
P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes of text that a kernel turns into word lists at a time.
CHUNK_BYTES = 1 << 20
#: Bytes of rows that Spark hands to a Python worker at a time, and the setting that bounds them.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes, unless the session has a bound already. Spark's own 64 MB stand in
    the executor and in the worker at once, beside what is copied from them, for every core."""
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def tidy() -> None:
    """Give memory that batches have left in a long-lived worker's allocators back to the machine."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes in ``column`` each; one huge row is a slice of its own."""
    sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)
    tidy()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Final avalanche, so that minima of hashes do not follow the polynomial's low bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def prefix(h: np.ndarray) -> np.ndarray:
    """c with c[j] - c[i] = P**i * hash(h[i:j])."""
    c = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(len(h), P), out=c[1:])
    return c


def span_hashes(c: np.ndarray, start: np.ndarray, end: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Hashes of h[start:end] from the prefix array; the same words hash alike wherever they stand."""
    return mix(((c[end] - c[start]) * inverse[start]) ^ mix((end - start).astype(np.uint64)))


def leftmost_minimum(v: np.ndarray, width: int) -> np.ndarray:
    """For each i, the leftmost position of the minimum of v[i:i+width]; len(v) - width + 1 entries."""
    at, have = np.arange(len(v)), 1
    while have < width:
        step = min(have, width - have)
        left, right = at[:-step], at[step:]
        at = np.where(v[left] <= v[right], left, right)
        have += step
    return at
