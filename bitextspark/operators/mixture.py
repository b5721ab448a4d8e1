"""Task mixture: weights, weighted loss logs, task draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bitextspark.config import DEFAULT_SEED
from bitextspark.functions import sampling as sm


def normalised_weights(tasks: list[str], base_weight: float | None = None) -> list[tuple[str, float]]:
    """Uniform 1/n, or `base_weight` for the first task and the rest shared evenly."""
    n = len(tasks)
    if base_weight is None or n == 1:
        return [(t, 1.0 / n) for t in tasks]
    rest = (1.0 - base_weight) / (n - 1)
    return [(tasks[0], base_weight)] + [(t, rest) for t in tasks[1:]]


def task_weights(spark: SparkSession, tasks: list[str], base_weight: float | None = None) -> DataFrame:
    """The weights as a table of one row per task."""
    return spark.createDataFrame(normalised_weights(tasks, base_weight), "task string, weight double")


def draw_task(batch_id: Column, weights: list[tuple[str, float]], seed: int = DEFAULT_SEED) -> Column:
    """Weighted draw of a task for each batch, keyed by the batch id.

    The weight list has one entry per task, so the cumulative intervals are a CASE
    ladder and no join is needed.
    """
    u = sm.unit_interval(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("draw"), batch_id)))
    total = sum(w for _, w in weights)
    upper, ladder = 0.0, None
    for task, w in weights[:-1]:
        upper += w / total
        ladder = F.when(u < upper, task) if ladder is None else ladder.when(u < upper, task)
    last = weights[-1][0]
    return F.lit(last) if ladder is None else ladder.otherwise(last)


def as_of(batches: DataFrame, versions: DataFrame, value: str, key: str = "key", step: str = "step") -> DataFrame:
    """`batches` with `value` of the last of `versions` whose step is smaller (null before the first).

    Both tables are sorted together by key and step, and the last value seen is carried on:
    one shuffle by key, no pair of rows is compared. The rows of a key are one sorted stream,
    as the versions of one experiment are.
    """
    columns = batches.columns
    both = batches.withColumn("__version", F.lit(0)).unionByName(
        versions.select(F.col(key), F.col(step), F.col(value), F.lit(1).alias("__version")), allowMissingColumns=True
    )
    before = W.partitionBy(key).orderBy(step, "__version").rowsBetween(W.unboundedPreceding, W.currentRow)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(before)).where("__version = 0").select(*columns, value)


def draw_by_versions(
    batches: DataFrame, versions: DataFrame, tasks: list[str], key: str = "key", step: str = "step", seed: int = DEFAULT_SEED
) -> DataFrame:
    """Add `drawn`: a task for each batch, by the probabilities `probs` that were current at its step
    (of `versions(key, step, probs)`, one number for each of `tasks`; uniform before the first).
    The draw is keyed by the step."""
    probs = F.coalesce(F.col("probs"), F.array(*[F.lit(1.0 / len(tasks)) for _ in tasks]))
    u = sm.unit_interval(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("draw"), F.col(step))))
    upper = F.lit(0.0)
    drawn = F.when(F.lit(False), F.lit(""))
    for k, task in enumerate(tasks[:-1]):
        upper = upper + F.get(probs, F.lit(k))
        drawn = drawn.when(u < upper, task)
    return as_of(batches, versions, "probs", key, step).withColumn("drawn", drawn.otherwise(tasks[-1])).drop("probs")


def mixture_loss(
    log: DataFrame, weights: list[tuple[str, float]], base_task: str = "base", assume_reduced: bool = False
) -> DataFrame:
    """Per update: sum of loss * weight (times the number of tasks for reduced losses).
    A logged task without a weight raises: its loss would be lost while its size counts."""
    factor = len(weights) if assume_reduced else 1
    lookup = F.create_map(*[F.lit(x) for pair in weights for x in pair])
    missing = F.raise_error(F.concat(F.lit("no weight for task "), F.coalesce(F.col("task"), F.lit("null")))).cast("double")
    weighted = F.col("loss") * F.coalesce(F.try_element_at(lookup, F.col("task")), missing) * factor
    return log.groupBy("update").agg(
        F.round(F.sum(weighted), 6).alias("loss"),
        F.sum("size").alias("sample_size"),
        F.sum(F.when(F.col("task") == base_task, F.col("size")).otherwise(0)).alias("base_size"),
    )


def merge_logs(parts: DataFrame, keys: list[str], counters: dict[str, str]) -> DataFrame:
    """Sum every counter of the split parts of a log."""
    sums = [
        (F.round(F.sum(c), 6) if t == "double" else F.sum(c).cast(t)).alias(c) for c, t in counters.items()
    ]
    return parts.groupBy(*keys).agg(F.count(F.lit(1)).alias("parts"), *sums)


def loss_per_size(log: DataFrame, keys: list[str]) -> DataFrame:
    return log.groupBy(*keys).agg(F.round(F.sum("loss") / F.sum("size"), 6).alias("loss_per_unit"))
