"""Small array helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it several times in `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def type_counts(toks: Column) -> Column:
    """Distinct tokens of a sentence as `struct<x, c, ps>`: count and 0-based positions."""

    def cell(x: Column) -> Column:
        hits = F.filter(F.sequence(F.lit(0), F.size(toks) - 1), lambda i: F.get(toks, i) == x)
        return let(hits, lambda ps: F.struct(x.alias("x"), F.size(ps).alias("c"), ps.alias("ps")))

    found = F.transform(F.array_distinct(toks), cell)
    return F.when(F.size(toks) > 0, found).otherwise(F.array().cast("array<struct<x:string,c:int,ps:array<int>>>"))
