"""Incremental corpus intake: clean newly arriving pairs and derive their task versions.

Every step is row-wise, so the batch functions serve the stream unchanged and no
state is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from bitextspark.config import DEFAULT_SEED, CleanConfig, TaskSpec
from bitextspark.operators.clean import clean_pairs
from bitextspark.operators.tasks import add_tasks


def intake(pairs: DataFrame, specs: list[TaskSpec], cfg: CleanConfig = CleanConfig(), epochs: int = 1, seed: int = DEFAULT_SEED) -> DataFrame:
    """Cleaned pairs in all row-wise task versions; batch or stream."""
    return add_tasks(clean_pairs(pairs, cfg), specs, epochs=epochs, seed=seed)


def start_intake(stream: DataFrame, path: str, checkpoint: str, specs: list[TaskSpec], **options):
    """Append the versions of arriving pairs to a corpus partitioned by epoch and task."""
    return (
        intake(stream, specs, **options)
        .writeStream.format("parquet")
        .partitionBy("epoch", "task")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
