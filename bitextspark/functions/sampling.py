"""Seeded sampling from md5 keys.

A key depends only on (seed, task, epoch, pair id, position), so a retried task,
another partitioning or another engine draws the same sample. `rand()` is never
used.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: strides for drawing without replacement. All are primes near
# 2^31; a stride is used only if it does not divide the table size.
STRIDES = (2147483647, 2147483629, 2147483587, 2147483579)


def sample_key(seed: int, task: str, epoch: Column, pair_id: Column, pos: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(task), epoch, pair_id, pos))


def hex_int(digest: Column, digits: int = 8, start: int = 1) -> Column:
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("bigint")


def unit_interval(digest: Column) -> Column:
    """md5 digest -> double in [0, 1)."""
    return hex_int(digest) / F.lit(4294967296.0)


def position_keys(toks: Column, seed: int, task: str, epoch: Column, pair_id: Column) -> Column:
    return F.transform(toks, lambda _, i: sample_key(seed, task, epoch, pair_id, i))


def share(n: Column, alpha: float) -> Column:
    """floor(n * alpha) in IEEE doubles."""
    return F.floor(n * F.lit(float(alpha))).cast("int")


def usable_strides(table_size: int) -> list[int]:
    return [p for p in STRIDES if table_size % p]


def draw_rank(digest: Column, k: Column, table_size: int) -> Column:
    """k-th (0-based) distinct rank in 0..table_size-1 for the stream named by `digest`."""
    strides = usable_strides(table_size)
    start = hex_int(digest)
    pick = F.pmod(hex_int(digest, 8, 9), F.lit(len(strides)))
    stride = F.get(F.array(*[F.lit(p).cast("bigint") for p in strides]), pick.cast("int"))
    return F.pmod(start + k * stride, F.lit(table_size).cast("bigint"))
