"""URL filtering: host and path rules, and a block list held in a cascade of Bloom filters.

The cascade answers membership exactly for every key of a known universe. Level 1 encodes
the listed keys; level 2 encodes the keys of the universe that level 1 wrongly accepts;
level 3 the listed keys that level 2 wrongly accepts; and so on until a level has no false
positive. A key is listed if the first level that does not contain it is an even one.
Levels shrink by the false-positive rate, so the whole cascade has little more than
level 1's size. A level is one array column of 64-bit words, brought into the plan as a
scalar subquery: the judged rows need no join, no shuffle and no Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitextspark.scale import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A level larger than this is not built: the list then belongs in a shuffled join.
MAX_LEVEL_BITS = 1 << 28
HASHES = 4


@dataclass(frozen=True)
class Rule:
    """Fits `host` and its subdomains where the path starts with `path`."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; null or no `://`: ''."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; null or no `://`: ''."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def matched_rule(host_col: Column, path_col: Column, rules: list[Rule]) -> Column:
    """Struct (name, verdict) of the longest rule that fits, else null."""
    out: Column = F.lit(None).cast("struct<name: string, verdict: string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host_col == r.host) | host_col.endswith("." + r.host)) & path_col.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def parents(host_col: Column) -> Column:
    """The host and its parent domains, from the full host to the last label; '' has none."""
    labels = F.split(host_col, r"\.")
    n = F.size(labels)
    every = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    return F.when(host_col == "", F.array().cast("array<string>")).otherwise(every)


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    """`HASHES` bit positions by double hashing, salted by level."""
    size = F.lit(bits).cast("bigint")
    one = F.pmod(F.xxhash64(F.lit(level), key), size)
    two = F.pmod(F.xxhash64(key, F.lit(level)), size)
    return [F.pmod(one + two * F.lit(k), size) for k in range(HASHES)]


def _level_bits(n: int) -> int:
    """About ten bits a key (1 % of false positives), whole words."""
    return max(64, 64 * math.ceil(10 * n / 64))


def _bitmap(keys: DataFrame, level: int, bits: int) -> DataFrame:
    """One row with `words` array<bigint>: the filter of `keys`. Bits are combined per word
    before they meet; what meets is the filter itself, of a checked size."""
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), level, bits))).alias("bit"))
    set_words = at.groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("bit", F.lit(64)).cast("int"))).alias("value")
    )
    empty = keys.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("value"))
    dense = set_words.unionByName(empty).groupBy("word").agg(F.bit_or("value").alias("value"))
    return dense.agg(F.sort_array(F.collect_list(F.struct("word", "value"))).alias("s")).select(
        F.transform("s", lambda x: x["value"]).alias("words")
    )


class Cascade:
    """Bloom filters in turn for listed keys and for false positives of the universe.

    `universe` has every key that will be asked (column `key`); `listed` any keys. Nulls
    are ignored, repeated keys count once; an empty list gives a cascade that accepts
    nothing. Levels are written to the shared scratch folder.
    """

    def __init__(self, spark: SparkSession, universe: DataFrame, listed: DataFrame):
        self.spark = spark
        self.levels: list[tuple[str, int]] = []
        listed = listed.select("key").where("key IS NOT NULL").distinct()
        universe = universe.select("key").where("key IS NOT NULL").distinct()
        inside = self._store(universe.join(listed, "key", "left_semi"))
        outside = universe.join(listed, "key", "left_anti")
        encode, other = inside, outside
        while True:
            n = encode.count()
            if n == 0:
                break
            bits = _level_bits(n)
            if bits > MAX_LEVEL_BITS:
                raise ValueError(f"{n} keys need {bits} bits; join the list instead of broadcasting it")
            level = len(self.levels) + 1
            location = scratch_path(spark, f"bloom-{level}")
            _bitmap(encode, level, bits).write.parquet(location)
            self.levels.append((location, bits))
            wrong = self._store(other.where(self._in_level(F.col("key"), level)))
            encode, other = wrong, encode

    def _store(self, df: DataFrame) -> DataFrame:
        location = scratch_path(self.spark, "keys")
        df.write.parquet(location)
        return self.spark.read.parquet(location)

    def _in_level(self, key: Column, level: int) -> Column:
        location, bits = self.levels[level - 1]
        words = self.spark.read.parquet(location).scalar()
        found: Column | None = None
        for p in _positions(key, level, bits):
            word = F.get(words, F.shiftright(p, 6).cast("int"))
            shifted = F.call_function("shiftrightunsigned", word, F.pmod(p, F.lit(64)).cast("int"))
            bit = shifted.bitwiseAND(F.lit(1).cast("bigint")) == 1
            found = bit if found is None else found & bit
        return found

    def contains(self, key: Column) -> Column:
        """Exact for keys of the universe."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in range(len(self.levels), 0, -1):
            out = F.when(~self._in_level(key, level), F.lit(level % 2 == 0)).otherwise(out)
        return out


def judge(
    pages: DataFrame, rules: list[Rule], listed: DataFrame, url: str = "url"
) -> DataFrame:
    """Append `host`, `path`, `rule` and `verdict`.

    A fitting rule decides; otherwise a page is blocked if its host or a parent domain is
    in `listed(key)`. The cascade's universe is every distinct host of `pages`; its listed
    keys are the hosts below a listed domain. Null urls and urls without `://` have an empty
    host and path and are allowed. Columns of `pages` with the names of the outputs raise at
    plan time.
    """
    clash = {"host", "path", "rule", "verdict"} & set(pages.columns)
    if clash:
        raise ValueError(f"the table has columns {sorted(clash)} already; drop or rename them")
    universe = pages.select(host(F.col(url)).alias("key")).distinct()
    below = universe.select("key", F.explode(parents(F.col("key"))).alias("domain"))
    domains = listed.select(F.col("key").alias("domain"))
    cascade = Cascade(pages.sparkSession, universe, below.join(domains, "domain", "left_semi").select("key"))
    parsed = pages.withColumns({"host": host(F.col(url)), "path": path(F.col(url))})
    hit = matched_rule(F.col("host"), F.col("path"), rules)
    blocked = cascade.contains(F.col("host"))
    return (
        parsed.withColumn("__rule", hit)
        .withColumn("rule", F.col("__rule.name"))
        .withColumn("verdict", F.coalesce(F.col("__rule.verdict"), F.when(blocked, "block").otherwise("allow")))
        .drop("__rule")
    )
