"""Average source influence per reporting interval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitextspark.operators.influence import average_influence, token_influence


def interval_influence(pert: DataFrame, interval: str = "interval") -> DataFrame:
    """Batch form: one report per `interval`, each over its own rows only."""
    return average_influence(token_influence(pert, by=(interval,)), by=(interval,))


def stream_influence(pert: DataFrame, ts: str = "ts", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Streaming form over event-time windows; rows later than the watermark are dropped.

    Two chained aggregations (per token, then per window), so use append mode.
    """
    value = F.exp("logp")
    on = lambda side: F.var_pop(F.when(F.col("side") == side, value))
    tokens = (
        pert.withWatermark(ts, late)
        .groupBy(F.window(ts, width), "sample_id", "pos")
        .agg(on("source").alias("v_source"), on("target").alias("v_target"))
    )
    total = F.col("v_source") + F.col("v_target")
    scored = tokens.withColumn("influence", F.when(total > 0, F.col("v_source") / total))
    return scored.groupBy("window").agg(
        F.avg("influence").alias("source_influence"),
        F.count("influence").alias("tokens"),
        (F.count(F.lit(1)) - F.count("influence")).alias("undefined"),
    ).select(F.col("window.start").alias("start"), F.round("source_influence", 6).alias("source_influence"), "tokens", "undefined")
