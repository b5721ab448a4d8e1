"""Ordering, length buckets, token-budget batches, collation and splitting.

A batch holds at most `max_tokens` padded tokens, so collecting a batch into one
row is bounded by configuration. Rankings never pass through one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bitextspark.config import DEFAULT_SEED, EOS_ID, PAD_ID
from bitextspark.functions import ids as fi
from bitextspark.scale import broadcast_if_small, global_rank, hashed_group_rank, materialise


def shuffle_key(seed: int, key: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("order"), key))


def training_order(df: DataFrame, src: str, tgt: str, key: str = "pair_id", seed: int = DEFAULT_SEED) -> DataFrame:
    """Add `ord`: by source length, then target length, then a seeded shuffle."""
    keyed = df.withColumn("__h", shuffle_key(seed, F.col(key)))
    return global_rank(keyed, [F.size(src), F.size(tgt), "__h", key], "ord").drop("__h")


def bucketed_order(df: DataFrame, src_bucket: str, tgt_bucket: str, key: str = "pair_id", seed: int = DEFAULT_SEED) -> DataFrame:
    """Add `ord`: by the larger padded length, then a seeded shuffle."""
    keyed = df.withColumn("__h", shuffle_key(seed, F.col(key)))
    return global_rank(keyed, [F.greatest(src_bucket, tgt_bucket), "__h", key], "ord").drop("__h")


def bucket_table(df: DataFrame, size: Column, n_buckets: int) -> DataFrame:
    """`(size, bucket)` for every occurring size.

    Bounds are the equal-frequency sizes (the smallest size that covers k/n of the
    rows) and the last bound is the maximum. The window runs over distinct sizes.
    """
    freq = df.groupBy(size.cast("int").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    run = freq.select(
        "size",
        F.sum("n").over(W.orderBy("size")).alias("cum"),
        F.coalesce(F.sum("n").over(W.orderBy("size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("prev"),
        F.sum("n").over(W.partitionBy()).alias("total"),
    )
    # A size is a bound when a quota ceil(k * total / n_buckets) falls into (prev, cum].
    quota = lambda c: F.floor(c * n_buckets / F.col("total"))
    is_bound = quota(F.col("cum")) > quota(F.col("prev"))
    later = W.orderBy("size").rowsBetween(W.currentRow, W.unboundedFollowing)
    return run.select("size", F.min(F.when(is_bound, F.col("size"))).over(later).alias("bucket"))


def assign_buckets(df: DataFrame, src: str, tgt: str, n_buckets: int) -> DataFrame:
    """Add `src_bucket`, `tgt_bucket`: padded lengths by side."""
    for side, ids in (("src", src), ("tgt", tgt)):
        table = materialise(bucket_table(df, F.size(ids), n_buckets)).select(
            F.col("size").alias(f"__{side}"), F.col("bucket").alias(f"{side}_bucket")
        )
        df = df.join(broadcast_if_small(table), F.size(ids) == F.col(f"__{side}")).drop(f"__{side}")
    return df


def pack(
    df: DataFrame, length: Column, max_tokens: int, key: str = "pair_id", seed: int = DEFAULT_SEED, multiple: int = 1
) -> tuple[DataFrame, DataFrame]:
    """Token-budget batches: (rows with `batch_id`, rows longer than the budget).

    Rows of one length class L (rounded up to `multiple`) are numbered in seeded order
    and cut every floor(max_tokens / L) rows, so rows * L never exceeds the budget and
    no sequential scan is needed. `batch_id` is `L-<k>`.
    """
    keyed = df.withColumns({"len": fi.round_up(length.cast("int"), multiple), "__h": shuffle_key(seed, F.col(key))})
    fits = F.col("len") <= max_tokens
    ranked = hashed_group_rank(keyed.where(fits & (F.col("len") > 0)), ["len"], "__h", [key], "__rn")
    per_batch = F.floor(F.lit(max_tokens) / F.col("len"))
    out = ranked.select(
        *df.columns,
        "len",
        F.concat_ws("-", "len", F.floor(F.col("__rn") / per_batch)).alias("batch_id"),
        (F.col("__rn") % per_batch).alias("slot"),
    )
    return out, df.where(length > max_tokens)


def batch_totals(df: DataFrame, src: str, tgt: str, size: Callable[[str], Column] = F.size) -> DataFrame:
    """Sentences and tokens per batch (target tokens; source tokens where no target). With `size=F.col`
    the columns hold sizes themselves."""
    tokens = F.when(F.col(tgt).isNotNull(), size(tgt)).otherwise(size(src))
    return df.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("nsentences"), F.sum(tokens.cast("bigint")).alias("ntokens")
    )


def collate(
    df: DataFrame,
    src: str,
    tgt: str,
    key: str = "pair_id",
    multiple: int = 1,
    pad: int = PAD_ID,
    eos: int = EOS_ID,
    by: tuple[str, ...] = (),
    order: str | None = None,
    links: str | None = None,
    fed: str | None = None,
) -> DataFrame:
    """One row per batch: ids, left-padded sources, right-padded targets, decoder
    inputs, lengths and totals; rows in order of falling source length.

    Auxiliary versions join the batches of their base rows: pass `by=("task",)` and an
    `order` column with the base source length, so that all tasks keep one row order.
    The decoder's input is the target moved by one, or the column `fed`. Totals leave padding out.
    With `links`, link positions are moved along: sources by the left padding, targets
    by the padded rows before them. A group is one batch, whose size the budget bounds.
    """
    cell = F.struct(
        (-(F.col(order) if order else F.size(src))).alias("k"), F.col(key).alias("id"), F.col(src).alias("s"),
        F.col(tgt).alias("t"), (F.col(fed) if fed else fi.decoder_input(F.col(tgt), eos)).alias("p"),
        *([F.col(links).alias("l")] if links else []),
    )
    grouped = df.groupBy("batch_id", *by).agg(
        F.sort_array(F.collect_list(cell)).alias("b"),
        fi.round_up(F.max(F.size(src)), multiple).alias("ls"),
        fi.round_up(F.max(F.size(tgt)), multiple).alias("lt"),
        F.count(F.lit(1)).alias("nsentences"),
        F.sum(fi.count_non_pad(F.col(tgt), pad).cast("bigint")).alias("ntokens"),
    )
    moved = F.flatten(
        F.transform(
            "b",
            lambda r, i: F.transform(
                r["l"],
                lambda l: F.struct(
                    (l["s"] + F.col("ls") - F.size(r["s"])).alias("s"), (l["t"] + i * F.col("lt")).alias("t")
                ),
            ),
        )
    )
    return grouped.select(
        "batch_id",
        *by,
        F.transform("b", lambda r: r["id"]).alias("ids"),
        F.transform("b", lambda r: fi.pad_left(r["s"], F.col("ls"), pad)).alias("source"),
        F.transform("b", lambda r: fi.pad_right(r["t"], F.col("lt"), pad)).alias("target"),
        F.transform("b", lambda r: fi.pad_right(r["p"], F.col("lt"), pad)).alias("prev_output"),
        F.transform("b", lambda r: F.size(r["s"])).alias("src_lengths"),
        *([moved.alias("links")] if links else []),
        "nsentences",
        "ntokens",
    )


def split_batch(df: DataFrame, n: int) -> DataFrame:
    """Add `part`: rows k, k + n, ... of a batch form part k."""
    return df.withColumn("part", F.pmod("slot", F.lit(n)))
