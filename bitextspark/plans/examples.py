"""Stored token ids -> the training examples and collated batches of an epoch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitextspark.config import DEFAULT_SEED, PAD_ID, RESAMPLED_TASKS, SYNTHETIC_MARK
from bitextspark.functions import ids as fi
from bitextspark.operators import batching, examples
from bitextspark.operators.clean import split_by_size
from bitextspark.operators.tasks import epoch_view


@dataclass(frozen=True)
class ExampleConfig:
    """`marked`: sources hold an origin mark after the task tag. It is taken out of the examples, and
    auxiliary examples of synthetic pairs have no target to learn from."""

    tasks: tuple[str, ...] = ()
    epochs: int = 1
    max_source: int = 1024
    max_target: int = 1024
    max_tokens: int = 4000
    multiple: int = 1
    marked: bool = False
    seed: int = DEFAULT_SEED


class TrainingExamples:
    """Examples of stored versions `(pair_id, task, epoch, src_ids, tgt_ids)`, as written by the corpus
    build, with the `(id, symbol)` vocabulary that encoded them.

    An epoch reads the directories of its own versions only. Versions are grouped once by pair
    (a row per task); everything else is done in the row, but for the batches, which are groups of
    bounded size.
    """

    def __init__(self, versions: DataFrame, vocabulary: DataFrame, cfg: ExampleConfig):
        self.versions, self.vocabulary, self.cfg = versions, vocabulary, cfg

    def symbol_id(self, symbol: str) -> int | None:
        row = self.vocabulary.where(F.col("symbol") == symbol).select("id").first()
        return row and row[0]

    def _seen(self, epoch: int) -> DataFrame:
        return epoch_view(self.versions, epoch, self.cfg.epochs, RESAMPLED_TASKS)

    def _base_sizes(self, epoch: int) -> DataFrame:
        """`(pair_id, base_size, tgt_size)` of the kept pairs, from their base rows alone."""
        c = self.cfg
        kept, _ = split_by_size(self._seen(epoch).where("task = 'base'"), "src_ids", "tgt_ids", c.max_source, c.max_target)
        src = fi.drop_second(F.col("src_ids")) if c.marked else F.col("src_ids")
        return kept.select("pair_id", F.size(src).alias("base_size"), F.size("tgt_ids").alias("tgt_size"))

    def records(self, epoch: int) -> tuple[DataFrame, DataFrame]:
        """(kept, too long): one record per pair with all its versions of the epoch."""
        c = self.cfg
        seen = self._seen(epoch).where(F.col("task").isin("base", *c.tasks))
        return split_by_size(examples.attach_auxiliaries(seen), "src_ids", "tgt_ids", c.max_source, c.max_target)

    def examples(self, epoch: int) -> DataFrame:
        """`(pair_id, task, src_ids, tgt_ids, prev_ids, ntokens)` of an epoch."""
        kept, _ = self.records(epoch)
        rows = examples.examples_for_tasks(kept, ("base", *self.cfg.tasks))
        if not self.cfg.marked:
            return rows
        mark = self.symbol_id(SYNTHETIC_MARK)
        if mark is not None:
            label = fi.mask_synthetic(F.col("src_ids"), F.col("tgt_ids"), F.col("task"), mark)
            rows = rows.withColumn("tgt_ids", label).withColumn("ntokens", fi.count_non_pad(F.col("tgt_ids")))
        return rows.withColumn("src_ids", fi.drop_second(F.col("src_ids")))

    def batches(self, epoch: int) -> tuple[DataFrame, DataFrame]:
        """(batches, base rows over the budget). A batch is placed by its base rows; each
        task of it is a row `(batch_id, task, ids, source, target, prev_output, nsentences, ntokens)`
        with the base rows' order."""
        c = self.cfg
        rows = self.examples(epoch)
        # A place needs sizes only, so ids are grouped once by pair and once by batch.
        size = F.greatest("base_size", "tgt_size")
        placed, _ = batching.pack(self._base_sizes(epoch), size, c.max_tokens, seed=c.seed, multiple=c.multiple)
        place = placed.select("pair_id", "batch_id", "base_size")
        over = rows.where((F.col("task") == "base") & (fi.row_tokens(F.col("src_ids"), F.col("tgt_ids")) > c.max_tokens))
        collated = batching.collate(
            rows.join(place, "pair_id"), "src_ids", "tgt_ids", multiple=c.multiple, pad=PAD_ID, by=("task",), order="base_size", fed="prev_ids"
        )
        return collated, over
