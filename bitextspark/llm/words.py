"""Vectorised word views of an Arrow string column, for tasks that work on whole batches.

Words are found on the UTF-8 bytes: every separator used here is an ASCII byte, so byte
and code-point views agree. Nothing leaves the batch; memory is bounded by `BLOCK_BYTES`
or by the longest single text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

BLOCK_BYTES = 1 << 19
BATCH_BYTES = 4 << 20
ROW_GROUP_BYTES = 32 << 20
_BOUNDS = {
    "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES,
    "parquet.block.size": ROW_GROUP_BYTES,
}
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
#: The C library's call for it, where there is one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_POWERS = (np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_values(lower: bool) -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    if lower:
        codes[65:91] += np.uint64(32)
    return mix((codes + np.uint64(1)) * _MULTIPLIER)


VALUES = {False: _byte_values(False), True: _byte_values(True)}
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but letters and digits.
NOT_ALNUM = np.ones(256, dtype=bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's powers 0 to n - 1, and those of its inverse modulo 2**64."""
    global _POWERS
    if len(_POWERS[0]) < n:
        made = []
        for base in (_MULTIPLIER, _INVERSE):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _POWERS = (made[0], made[1])
    return _POWERS


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches end after `BATCH_BYTES` and Parquet row groups after `ROW_GROUP_BYTES`, unless the
    session has bounds of its own: 10,000 rows of long texts are tens of MB in the executor and again in
    each of its workers, and a row group is held until it is full."""
    for setting, size in _BOUNDS.items():
        if spark.conf.get(setting, None) is None:
            spark.conf.set(setting, str(size))


def give_back() -> None:
    """Return freed memory to the system, so that idle and reused workers stay small. Powers that
    one very long text needed go as well."""
    global _POWERS
    if len(_POWERS[0]) > 2 * BLOCK_BYTES:
        _POWERS = (np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64))
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


@dataclass
class Block:
    """Some rows of a batch: `data` are their bytes, row i is data[bounds[i]:bounds[i + 1]]."""

    first: int
    rows: int
    data: np.ndarray
    bounds: np.ndarray


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string column into runs of rows of about `limit` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, bounds_buffer, data_buffer = column.buffers()
    bounds = np.frombuffer(bounds_buffer, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + limit, side="right")) - 1)
        end = min(end, n)
        yield Block(row, end - row, data[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row])
        row = end
    give_back()


@dataclass
class Words:
    """Words of a block in order; row i has words first[i]:first[i + 1]."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans: polynomial prefix sums, then a finaliser with the length."""
    n = len(data)
    powers, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(VALUES[lower][data] * powers[:n], out=sums[1:])
    raw = (sums[end] - sums[start]) * inverse[start]
    return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(block: Block, lower: bool, separator: np.ndarray = WHITE, hashed: bool = True) -> Words:
    gap = separator[block.data]
    n = len(gap)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ~gap
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    inner = block.bounds[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    begins[inner] |= inside[1:-1][inner]
    ends[inner - 1] |= inside[1:-1][inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, block.bounds)
    row = np.repeat(np.arange(block.rows), np.diff(first))
    hashes = span_hash(block.data, start, end, lower) if hashed else np.zeros(0, np.uint64)
    return Words(start, end, row, first, hashes)


def window_hash(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words within a row: (index of the first word, hash)."""
    n = len(w.hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        total = total * _MULTIPLIER + w.hash[k : k + n]
    at = np.flatnonzero(w.row[:n] == w.row[size - 1 :])
    return at, mix(total[at])


def code_points(data: np.ndarray) -> np.ndarray:
    """Number of code points before each byte offset (length n + 1)."""
    out = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of `values` between consecutive bounds; empty runs give 0."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def texts(block: Block) -> list[str]:
    raw = block.data.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(block.bounds[:-1], block.bounds[1:])]
