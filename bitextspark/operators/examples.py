"""Training-example records: base row plus its auxiliary versions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitextspark.functions import ids as fi


def attach_auxiliaries(versions: DataFrame) -> DataFrame:
    """One record per pair from the long table of one epoch view.

    `versions(pair_id, task, src_ids, tgt_ids)` -> `(pair_id, src_ids, tgt_ids,
    aux map<task, struct<src_ids, tgt_ids>>)`. One grouping by pair id; a group
    holds one row per task.
    """
    cell = F.struct("src_ids", "tgt_ids")
    is_base = F.col("task") == "base"
    grouped = versions.groupBy("pair_id").agg(
        F.max(F.when(is_base, cell)).alias("b"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.when(~is_base, F.struct(F.col("task"), cell.alias("ids")))))
        ).alias("aux"),
    )
    return grouped.select(
        "pair_id", F.col("b.src_ids").alias("src_ids"), F.col("b.tgt_ids").alias("tgt_ids"), "aux"
    ).where(F.col("src_ids").isNotNull())


def _example(task: str) -> Column:
    """Source, label and decoder input of one task of a record; null where it has no such version."""
    if task == "base":
        src, label, fed = F.col("src_ids"), F.col("tgt_ids"), F.col("tgt_ids")
    else:
        version = F.col("aux")[task]
        src, fed = version["src_ids"], version["tgt_ids"]
        label = F.col("tgt_ids") if task == "wrdp2" else fed
    made = F.struct(
        F.lit(task).alias("task"),
        src.alias("src_ids"),
        label.alias("tgt_ids"),
        fi.decoder_input(fed).alias("prev_ids"),
        fi.count_non_pad(label).alias("ntokens"),
    )
    return F.when(src.isNotNull(), made)


def examples_for_tasks(records: DataFrame, tasks: Sequence[str]) -> DataFrame:
    """Source, label and decoder input of each task that a record has, in one pass over the records.

    `wrdp2` keeps the base label and only feeds the masked version to the decoder.
    """
    made = F.filter(F.array(*[_example(t) for t in tasks]), lambda x: x.isNotNull())
    return records.select("pair_id", F.inline(made))


def example_for_task(records: DataFrame, task: str) -> DataFrame:
    return examples_for_tasks(records, [task])


def map_ids(
    records: DataFrame, src: Callable[[Column], Column] | None = None, tgt: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Apply id-array functions (append, prepend, strip, truncate) to the base row and
    to every auxiliary version of a record."""
    on_src, on_tgt = src or (lambda c: c), tgt or (lambda c: c)
    versions = F.transform_values(
        "aux",
        lambda _, v: F.struct(on_src(v["src_ids"]).alias("src_ids"), on_tgt(v["tgt_ids"]).alias("tgt_ids")),
    )
    return records.withColumns(
        {"src_ids": on_src(F.col("src_ids")), "tgt_ids": on_tgt(F.col("tgt_ids")), "aux": versions}
    )
