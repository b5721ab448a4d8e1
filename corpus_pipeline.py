"""Corpus pipeline: raw documents to token ids in five stages.

Each stage takes `(spark, docs, sf_dir)` and returns a DataFrame; its result is written as
Parquet and read again as the next stage's `docs`. All but the last return the columns
of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitextspark.llm import decontaminate, neardup, pieces, pii, quality
from bitextspark.llm.queries import PIECES
from bitextspark.llm.words import bound_batches
from bitextspark.scale import broadcast_if_small, scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """`docs` without the ids in `dropped`, which is sent to all tasks only if it is
    measured to be small. Rows with a null id cannot be named and stay."""
    return docs.join(broadcast_if_small(dropped.select("doc_id").distinct()), "doc_id", "left_anti").select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counting and the fertility rules."""
    bound_batches(spark)
    judged = quality.judge(docs, PIECES, quality.QualityRules())
    return judged.where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8 or more)."""
    bound_batches(spark)
    linked = neardup.link(docs, neardup.NearDuplicates(percent=80))
    return _without(docs, linked.where("NOT kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verbatim or edited copy of a benchmark item."""
    bound_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.matches(docs, benchmark)
    location = scratch_path(spark, "leaks")
    found.write.parquet(location)
    return _without(docs, spark.read.parquet(location))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by the name of its kind; `n_chars` follows."""
    bound_batches(spark)
    crf = pii.train(pii.labelled_table(spark))
    hidden = pii.find(docs, crf, masked="__masked")
    return hidden.withColumns(
        {"text": F.col("__masked"), "n_chars": F.char_length("__masked").cast(docs.schema["n_chars"].dataType)}
    ).select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it."""
    bound_batches(spark)
    return pieces.round_trip(docs, PIECES).select(
        "doc_id",
        "lang",
        "source",
        F.size("ids").cast("bigint").alias("n_tokens"),
        "ids",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("sentencepiece", sentencepiece),
]

#: The fertility rules, the CRF and the tokeniser are not SQL; the pipeline is tested
#: against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        location = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(location)
        docs = spark.read.parquet(location)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
