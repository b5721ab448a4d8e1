"""Exponential moving average per key, `ema = ema * (1 - beta) + x * beta`, from 0.

The recurrence is linear, so the value after n steps is a weighted sum whose weights
depend only on the number of rows after each row. That makes it an ordinary
aggregation: no group is folded in one task, however many rows one key has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bitextspark.scale import broadcast_if_small, global_rank


def ema_partials(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, beta: float = 0.01) -> DataFrame:
    """`(keys, n, s)`: row count and weighted sum of each key over `df`.

    Appending partials: ema = ema * (1 - beta)^n + s.
    """
    ranked = global_rank(df.select(*keys, *order, F.col(x).alias("__x")), [*keys, *order], "__r")
    last = ranked.groupBy(*keys).agg(F.max("__r").alias("__last"))
    weight = F.lit(beta) * F.pow(F.lit(1.0 - beta), F.col("__last") - F.col("__r"))
    joined = ranked.join(broadcast_if_small(last), list(keys))
    return joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(weight * F.col("__x")).alias("s"))


def ema(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, beta: float = 0.01) -> DataFrame:
    """`(keys, n, ema)` after all rows, taken in `order` (a total order per key)."""
    return ema_partials(df, keys, order, x, beta).withColumnRenamed("s", "ema")


def combine_partials(partials: DataFrame, keys: Sequence[str], batch: str, beta: float = 0.01) -> DataFrame:
    """Final averages from the partials of successive batches (one row per key and batch)."""
    after = W.partitionBy(*keys).orderBy(F.desc(batch)).rowsBetween(W.unboundedPreceding, -1)
    later: Column = F.coalesce(F.sum("n").over(after), F.lit(0))
    weighted = partials.withColumn("__w", F.pow(F.lit(1.0 - beta), later) * F.col("s"))
    return weighted.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("__w").alias("ema"))


def stream_ema(
    stream: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, path: str, checkpoint: str, beta: float = 0.01
):
    """Start a stream that writes the partials of each micro-batch below `path`.

    Rows must arrive in order from batch to batch. A batch that is run again replaces
    its own directory, so the result is exact after failures. Read the averages with
    `read_stream_ema`.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        ema_partials(batch, keys, order, x, beta).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_stream_ema(spark: SparkSession, path: str, keys: Sequence[str], beta: float = 0.01) -> DataFrame:
    return combine_partials(spark.read.parquet(path), keys, "batch", beta)
